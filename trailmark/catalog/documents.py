"""Documents as script bodies with partial verdicts from ``labels``; hashes, buckets, coverage, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ast_bucket, counted_parts, detection_ratio, header, label_parts, number, sample_name, scan_verdict, script_path, severity_label, shown, shown_change, shown_percent, slug, slug_aliases, top_level_parts, trace_parts, unit_vector, verdict, wrapped_expression
from ..operators import aggregates, filters
from ..plans import ast_fingerprints, cohesion, sampling
from ..session import table
from .registry import query, r6


def _with_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")


@query("SELECT doc_id, sha256(text) AS hash, substr(text, 1, 50000) = text AS whole, length(array_to_string(string_split(text, chr(10))[1:20], chr(10)))::INT AS preview_chars FROM documents")
def file_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    preview = F.array_join(F.slice(F.split("text", "\n"), 1, 20), "\n")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("hash"), (F.substring("text", 1, 50_000) == F.col("text")).alias("whole"), F.length(preview).alias("preview_chars"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN sha1(lang) WHEN 1 THEN source ELSE doc_id::VARCHAR END AS bucket FROM documents")
def ast_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 3
    return table(spark, sf_dir, "documents").select("doc_id", ast_bucket(F.when(k == 0, F.col("lang")), F.when(k == 1, F.col("source")), "doc_id").alias("bucket"))


@query("""WITH t AS (SELECT doc_id AS trace_id, source AS cluster, sha1(lang || doc_id % 5) AS bucket, n_chars % 1000 AS score FROM documents),
b AS (SELECT *, max(score) OVER (PARTITION BY cluster, bucket) AS best, row_number() OVER (PARTITION BY cluster, bucket ORDER BY score DESC, trace_id) AS n FROM t),
z AS (SELECT cluster, CASE WHEN count(DISTINCT bucket) <= 3 THEN least(3, count(*)) ELSE least(15, count(*)) END AS target FROM t GROUP BY 1)
SELECT trace_id, cluster, score, (row_number() OVER (PARTITION BY cluster ORDER BY CASE WHEN n = 1 THEN 0 ELSE 1 END, best DESC, bucket, n))::INT AS pick FROM b JOIN z USING (cluster) QUALIFY pick <= any_value(target) OVER (PARTITION BY cluster)""")
def ast_bucket_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("trace_id"), F.col("source").alias("cluster"), F.sha1(F.concat("lang", (F.col("doc_id") % 5).cast("string")).cast("binary")).alias("bucket"), (F.col("n_chars") % 1000).alias("score"))
    return sampling.diverse(own).select("trace_id", "cluster", "score", "pick")


@query("SELECT source AS cluster, round(avg(toxic), 6) AS average, count(toxic)::BIGINT AS scanned, count(*)::BIGINT AS size FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1 HAVING count(toxic) > 0")
def verdict_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _with_labels(spark, sf_dir).select(F.regexp_extract("source", r"(\d+)", 1).cast("int").alias("cluster"), F.col("toxic").alias("verdict_count"))
    out = cohesion.verdict_stats(own)
    return out.select(F.concat(F.lit("src"), F.col("cluster").cast("string")).alias("cluster"), r6("average").alias("average"), "scanned", "size")


@query("SELECT doc_id, CASE WHEN toxic > 0 THEN 'Malicious' WHEN quality = 0 THEN 'Suspicious' WHEN doc_id % 4 = 0 THEN 'Very High' ELSE 'Clean' END AS verdict, CASE WHEN doc_id % 4 = 0 THEN 'Very High' END AS severity, CASE WHEN toxic > 0 THEN 'malicious' WHEN quality = 0 THEN 'suspicious' WHEN quality = 1 THEN 'benign' ELSE 'pending' END AS label, CASE WHEN quality IS NULL THEN 'n/a' ELSE toxic || '/2' END AS ratio FROM documents LEFT JOIN labels USING (doc_id)")
def verdict_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("doc_id") % 4 == 0, "SEVERITY_VERY_HIGH")
    return _with_labels(spark, sf_dir).select(
        "doc_id", verdict("toxic", 1 - F.col("quality"), level).alias("verdict"), severity_label(level).alias("severity"),
        scan_verdict("toxic", 1 - F.col("quality"), "quality", F.lit(None).cast("int")).alias("label"), detection_ratio("toxic", F.when(F.col("quality").isNotNull(), 2)).alias("ratio"),
    )


@query("SELECT count(*)::BIGINT AS crawls, count(*) FILTER (source = 'src1')::BIGINT AS hosted, count(*) FILTER (source <> 'src1')::BIGINT AS own_domain, count(*) FILTER (n_chars > 100)::BIGINT AS with_trace, count(*) FILTER (lang = 'en')::BIGINT AS with_index, count(*) FILTER (n_chars % 7 > 0)::BIGINT AS with_scripts, count(*) FILTER (quality IS NOT NULL)::BIGINT AS with_fingerprint, count(*) FILTER (quality = 1)::BIGINT AS wordpress, count(*) FILTER (toxic = 1)::BIGINT AS with_report, count(*) FILTER (n_chars > 100 AND n_chars % 7 > 0)::BIGINT AS usable, count(*) FILTER (n_chars > 100 AND n_chars % 7 > 0 AND quality = 1)::BIGINT AS usable_wordpress FROM documents LEFT JOIN labels USING (doc_id)")
def funnel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.when(F.col("source") == "src1", "https://www.a.github.io/x").otherwise(F.concat(F.lit("https://"), "source", F.lit(".example/")))
    return aggregates.funnel(_with_labels(spark, sf_dir).select(url.alias("url"), (F.col("n_chars") > 100).alias("has_trace"), (F.col("lang") == "en").alias("has_index"), (F.col("n_chars") % 7).alias("index_rows"), F.col("quality").isNotNull().alias("has_fingerprint"), (F.col("quality") == 1).alias("is_wordpress"), (F.col("toxic") == 1).alias("has_report")))


SLUG = "trim(regexp_replace(lower(p_name || ' (' || p_type || ')'), '[^a-z0-9]+', '-', 'g'), '-')"


def _title() -> Column:
    return F.concat("p_name", F.lit(" ("), "p_type", F.lit(")"))


@query(f"SELECT p_partkey, {SLUG} AS slug FROM part")
def slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", slug(_title()).alias("slug"))


@query(f"WITH s AS (SELECT p_partkey, {SLUG} AS slug FROM part), w AS (SELECT p_partkey, slug, string_split(slug, '-') AS w FROM s), a AS (SELECT p_partkey, unnest(list_prepend(slug, list_transform(range(2, len(w)), lambda i: array_to_string(w[i:], '-')))) AS alias FROM w) SELECT DISTINCT p_partkey, alias FROM a")
def slug_alias_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(slug_aliases(_title(), 2)).alias("alias"))


@query("SELECT doc_id, source AS base, CASE WHEN doc_id % 3 > 0 THEN '1.' || doc_id % 9 ELSE 'unspecified' END AS version FROM documents")
def label_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("source", F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit(" (1."), (F.col("doc_id") % 9).cast("string"), F.lit(")"))).otherwise(""))
    p = label_parts(text, "unspecified")
    return table(spark, sf_dir, "documents").select("doc_id", p["base"].alias("base"), p["version"].alias("version"))


@query("SELECT doc_id, 'h_' || doc_id AS url_hash, '20250101' AS timestamp, (doc_id % 7)::VARCHAR AS script_id, lpad((doc_id % 50)::VARCHAR, 2, '0') || '_h_' || doc_id || '_20250101_' || doc_id % 7 || '_' || substr(sha256(text), 1, 12) || '.js' AS name, '/c/' || doc_id % 7 || '_' || sha256(text) || '.js' AS path FROM documents")
def trace_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda k: (F.col("doc_id") % k).cast("string")
    tid = F.concat(F.lit("h_"), F.col("doc_id").cast("string"), F.lit("_20250101_"), n(7))
    digest = F.sha2(F.col("text").cast("binary"), 256)
    p = trace_parts(tid)
    return table(spark, sf_dir, "documents").select("doc_id", p["url_hash"].alias("url_hash"), p["timestamp"].alias("timestamp"), p["script_id"].alias("script_id"), sample_name(F.col("doc_id") % 50, tid, digest).alias("name"), script_path(F.lit(""), F.lit("/c"), n(7), digest).alias("path"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN n_chars::DOUBLE WHEN 3 THEN -1.5 END AS value, CASE doc_id % 4 WHEN 0 THEN n_chars || '.000' WHEN 3 THEN '-1.500' ELSE 'N/A' END AS shown, CASE doc_id % 4 WHEN 0 THEN '+' || n_chars || '.000' WHEN 3 THEN '-1.500' ELSE 'N/A' END AS change FROM documents")
def lenient_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 4
    v = number(F.when(k == 0, F.col("n_chars").cast("string")).when(k == 1, " N/A ").when(k == 2, "x1").otherwise("-1.5"))
    return table(spark, sf_dir, "documents").select("doc_id", v.alias("value"), shown(v).alias("shown"), shown_change(v).alias("change"))


@query("SELECT doc_id, source || ': ' || (n_chars % 9) AS first, '2' AS parts, (n_chars % 9)::INT AS n, 'mean_' || source AS header, CASE WHEN n_chars % 9 = 0 THEN '0.0%' ELSE (n_chars % 9) || '00.0%' END AS percent FROM documents")
def written_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("n_chars") % 9).cast("string")
    text = F.concat("source", F.lit(": "), n, F.lit(", b (x, y): 2"))
    return table(spark, sf_dir, "documents").select("doc_id", F.get(top_level_parts(text), F.lit(0)).alias("first"), F.size(top_level_parts(text)).cast("string").alias("parts"), F.get(counted_parts(text), F.lit(0))["n"].alias("n"), header(F.concat(F.lit(" Mean  "), "source", F.lit(")"))).alias("header"), shown_percent(F.col("n_chars") % 9).alias("percent"))


@query("SELECT lang AS doc_lang, round(sqrt(sum(n * n)), 6) AS length, count(*)::BIGINT AS kinds FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL) GROUP BY 1")
def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of each language's histogram over sources, from its unit vector."""
    m = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n")).groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("m"))
    top = F.array_max(F.map_values("m"))
    return m.select(F.col("lang").alias("doc_lang"), r6(top / F.array_max(F.map_values(unit_vector("m")))).alias("length"), F.size("m").cast("long").alias("kinds"))


@query("SELECT source AS cluster, doc_id AS trace_id, (row_number() OVER (PARTITION BY source ORDER BY quality DESC NULLS LAST, toxic DESC NULLS LAST, n_chars DESC NULLS LAST, doc_id))::INT AS rank FROM documents LEFT JOIN labels USING (doc_id) QUALIFY rank <= 3")
def topk_per_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _with_labels(spark, sf_dir).select(F.col("source").alias("cluster"), F.col("doc_id").alias("trace_id"), F.col("quality").alias("ast_similarity"), F.col("toxic").alias("silhouette"), F.col("n_chars").alias("suspicious_event_count"), F.lit(0).alias("verdict_count"))
    return sampling.top_per_cluster(own, 3).select("cluster", "trace_id", "rank")


@query("SELECT lang AS run, source AS cluster, round(2 * avg(n_chars % 50) + 0.1 * count(*), 6) AS score, (row_number() OVER (PARTITION BY lang ORDER BY round(2 * avg(n_chars % 50) + 0.1 * count(*), 9) DESC, source))::INT AS rank FROM documents GROUP BY lang, source QUALIFY rank <= 5")
def interesting_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("run"), F.col("source").alias("cluster")).agg(F.avg(F.col("n_chars") % 50).alias("mean_suspicious"), F.count("*").alias("n")).withColumn("silhouette", F.lit(None).cast("double"))
    return sampling.interesting(own).select("run", "cluster", r6("score").alias("score"), "rank")


@query("SELECT source AS cluster, count(*)::BIGINT AS scripts, count(DISTINCT text)::BIGINT AS urls, round(avg(n_chars), 6) AS mean_events, round(avg(n_chars % 10), 6) AS mean_suspicious FROM documents GROUP BY 1")
def cluster_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").select(F.col("source").alias("cluster"), F.col("text").alias("script_url"), F.col("n_chars").alias("num_events"), (F.col("n_chars") % 10).alias("suspicious_event_count"))
    return cohesion.profiles(own).withColumns({"mean_events": r6("mean_events"), "mean_suspicious": r6("mean_suspicious")})


@query("SELECT source AS cluster, doc_id AS trace_id FROM documents LEFT JOIN labels USING (doc_id) WHERE NOT (quality = 1 AND coalesce(toxic, 0) = 0) OR quality IS NULL")
def pending_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _with_labels(spark, sf_dir).select(F.col("source").alias("cluster"), F.col("doc_id").alias("trace_id"), "quality", "toxic")
    manifest = d.where("quality is not null").select("cluster", "trace_id", F.when(F.col("quality") == 1, "ok").alias("summary"), F.when(F.col("toxic") == 1, "timeout").otherwise(" ").alias("error"))
    return sampling.pending(d.select("cluster", "trace_id"), manifest)


@query("SELECT doc_id, (n_chars % 10 >= 8 OR lang = 'fr') AS suspicious FROM documents")
def suspicious_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 10).alias("suspicious_event_count"), F.create_map(F.when(F.col("lang") == "fr", "OBFUSCATION").otherwise("OTHER"), F.lit(1)).alias("capability_counts"))
    return own.select("doc_id", filters.is_suspicious(8).alias("suspicious"))


@query("SELECT doc_id, '(' || lang || chr(10) || ')' AS wrapped FROM documents WHERE trim(text) <> ''")
def wrapped_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.with_preview(table(spark, sf_dir, "documents"), "text").select("doc_id", wrapped_expression("lang").alias("wrapped"))


@query()
def ast_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical fingerprints of the scripts inside pages, each distinct script once."""
    code = F.regexp_extract("html", r"(?s)<script[^>]*>(.*?)</script>", 1)
    own = table(spark, sf_dir, "pages").select(F.sha2(code.cast("binary"), 256).alias("hash"), code.alias("text"))
    return ast_fingerprints.fingerprints(own).select("hash", "status", "num_nodes", "max_depth", "feature_hash")
