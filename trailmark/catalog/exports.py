"""Sources, sinks and small operators over the test tables: what is written is read back and held against SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, urls
from ..operators import aggregates, filters, joins
from ..plans import cohesion, sampling, sequences, traces, vulnerabilities
from ..session import table
from ..sources import tables
from .registry import query, r6


def scratch(spark: SparkSession) -> str:
    """A new folder that all machines share: under spark.checkpoint.dir, or, on a local master without one, of this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}"
    sc, at = spark.sparkContext, f"{base.rstrip('/')}/trailmark-export-{uuid.uuid4().hex}"
    path = sc._jvm.org.apache.hadoop.fs.Path(at)
    files = path.getFileSystem(sc._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return at


def _s(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


# --- filters --------------------------------------------------------------------------------
@query("SELECT o_orderkey AS key FROM orders WHERE o_orderkey % 3 > 0")
def scripts_with_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 3
    events = F.when(k > 0, F.sequence(F.lit(1), k.cast("int"))).when(F.col("o_orderkey") % 2 == 0, F.array().cast("array<int>"))
    return filters.with_events(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), events.alias("events")), "events").select("key")


@query("SELECT s_suppkey AS key, s_suppkey % 7 = 0 AS unknown FROM supplier WHERE s_suppkey % 7 > 0 AND s_suppkey % 5 >= 3")
def suspicious_enough_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.when(F.col("s_suppkey") % 7 > 0, F.col("s_suppkey") % 5).alias("suspicious_event_count"))
    return filters.suspicious_enough(own, 3).select("key", F.col("suspicious_event_count").isNull().alias("unknown"))


@query("SELECT n_name AS trace_id FROM nation ORDER BY 1 LIMIT 10")
def first_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten in directory order: the limit is the feature."""
    return filters.first_scripts(table(spark, sf_dir, "nation").select(F.col("n_name").alias("trace_id")), 10)


@query("SELECT n_nationkey AS key, n_nationkey % 4 IN (2, 3) AS has_rows FROM nation")
def csv_has_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey") % 4
    body = F.when(k == 1, F.lit("id,url\n \n")).when(k == 2, F.lit("id,url\r\n1,a")).when(k == 3, F.lit("id\n1\n2\n"))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), filters.is_csv_with_rows(body).alias("has_rows"))


@query("SELECT c_custkey AS key FROM customer WHERE c_custkey % 20 IN (3, 5, 7) UNION ALL SELECT -n_nationkey FROM nation")
def listed_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An allow-list of clusters, and an empty one, which takes all."""
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), (F.col("c_custkey") % 20).alias("cluster"))
    every = table(spark, sf_dir, "nation").select((-F.col("n_nationkey")).alias("key"), F.col("n_regionkey").alias("cluster"))
    return filters.in_clusters(own, "3, 5 7").select("key").unionByName(filters.in_clusters(every, " ").select("key"))


@query("SELECT s_name AS slug, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'Unknown' END AS title, CASE WHEN s_suppkey % 3 = 0 THEN 'https://a.example' ELSE '' END AS reference, CASE WHEN s_suppkey % 5 = 0 THEN '2024-02-03' ELSE 'unknown' END AS published FROM supplier")
def advisory_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    own = table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("slug"), F.lit("CVE-1").alias("vuln_id"), F.when(k % 2 == 0, F.col("s_name")).otherwise("").alias("title"),
        F.when(k % 3 == 0, "https://a.example").alias("reference"), F.when(k % 5 == 0, F.lit("2024-02-03 04:05:06").cast("timestamp")).alias("published"),
    )
    return filters.advisory_view(own).drop("vuln_id")


# --- joins ----------------------------------------------------------------------------------
@query("SELECT s_suppkey AS script_id, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE '-' END AS name, CASE WHEN s_nationkey % 3 = 0 THEN n_name ELSE '-' END AS site, CASE WHEN s_nationkey % 4 = 0 THEN 'seen' ELSE '-' END AS verdict, CASE WHEN s_suppkey % 7 < 4 THEN s_suppkey % 7 ELSE -1 END AS nodes FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def scripts_with_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    crawl = ["url_hash", "timestamp"]
    day = F.lit("20250101").alias("timestamp")
    scripts = s.select(F.col("s_nationkey").alias("url_hash"), day, F.col("s_suppkey").alias("script_id"), (F.col("s_suppkey") % 7).alias("hash"))
    metadata = s.where("s_suppkey % 2 = 0").select(F.col("s_nationkey").alias("url_hash"), day, F.col("s_suppkey").alias("script_id"), F.col("s_name").alias("name"))
    prints = n.where("n_nationkey % 3 = 0").select(F.col("n_nationkey").alias("url_hash"), day, F.col("n_name").alias("site"))
    reports = n.where("n_nationkey % 4 = 0").select(F.col("n_nationkey").alias("url_hash"), day, F.lit("seen").alias("verdict"))
    asts = s.select((F.col("s_suppkey") % 7).alias("hash")).where("hash < 4").distinct().withColumn("nodes", F.col("hash"))
    none = lambda c: F.coalesce(c, F.lit("-")).alias(c)
    return traces.with_metadata(scripts, metadata, prints, reports, asts, crawl).select("script_id", none("name"), none("site"), none("verdict"), F.coalesce("nodes", F.lit(-1)).alias("nodes"))


@query("SELECT c_custkey AS key, r.k AS rep FROM customer JOIN (SELECT c_nationkey AS n, min(c_custkey) AS k FROM customer GROUP BY 1) r ON n = c_nationkey WHERE c_custkey <> r.k")
def members_beside_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("cluster"))
    return cohesion.with_representative(own, own.groupBy("cluster").agg(F.min("key").alias("key"))).select("key", "rep")


@query("SELECT c_custkey AS key, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE '' END AS name, CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey ELSE -1 END AS region FROM customer JOIN nation ON c_nationkey = n_nationkey")
def enriched_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("cluster"))
    summary = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("cluster"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return joins.enriched(own, summary, "cluster").select("key", "name", F.coalesce("region", F.lit(-1)).alias("region"))


@query("SELECT a.s_suppkey AS i, b.s_suppkey AS j FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey WHERE a.s_suppkey % 3 > 0 AND b.s_suppkey % 3 > 0 ORDER BY (a.s_suppkey + b.s_suppkey) % 10 DESC, i, j LIMIT 8")
def pairs_with_artefacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight pairs both of whose traces have artefacts: a top-k report."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), "s_nationkey")
    pairs = s.withColumnRenamed("k", "i").join(s.withColumnRenamed("k", "j"), "s_nationkey").where("i < j").select("i", "j", ((F.col("i") + F.col("j")) % 10).alias("dtw"), F.lit(0).alias("ast"))
    return sampling.with_artefacts(pairs, s.where("k % 3 > 0").select(F.col("k").alias("trace_id"), F.lit("code").alias("code")), 8).select("i", "j")


@query("SELECT n_nationkey AS cluster, n_name AS name, coalesce(c, 0) AS customers, coalesce(s, 0) AS suppliers FROM nation LEFT JOIN (SELECT c_nationkey AS k, count(*)::BIGINT AS c FROM customer GROUP BY 1) x ON x.k = n_nationkey LEFT JOIN (SELECT s_nationkey AS k, count(*)::BIGINT AS s FROM supplier GROUP BY 1) y ON y.k = n_nationkey")
def cluster_summary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("cluster"), F.col("n_name").alias("name"))
    part = lambda t, k, c: table(spark, sf_dir, t).groupBy(F.col(k).alias("cluster")).agg(F.count("*").alias(c))
    rows = joins.cluster_summaries(n, part("customer", "c_nationkey", "customers"), part("supplier", "s_nationkey", "suppliers"))
    return rows.select("cluster", "name", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("customers", "suppliers")))


@query("SELECT s_nationkey AS i, s_suppkey AS j, CASE WHEN s_suppkey % 2 = 0 THEN 'first' ELSE 'second' END AS only_in FROM supplier WHERE s_suppkey % 3 > 0")
def mismatched_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("i"), F.col("s_suppkey").alias("j"))
    return sequences.mismatched_ids(own.where("j % 3 = 0 or j % 2 = 0"), own.where("j % 3 = 0 or j % 2 = 1"))


@query("SELECT p_brand AS slug, count(*)::BIGINT AS n FROM part WHERE p_size % 2 = 0 GROUP BY 1")
def needed_advisories(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    sized = part.where("p_size % 2 = 0").select(F.col("p_brand").alias("slug"), F.col("p_partkey").alias("vuln_id"))
    strange = part.select(F.concat(F.lit("not-"), "p_brand").alias("slug"), F.col("p_partkey").alias("vuln_id"))
    return vulnerabilities.needed(sized.unionByName(strange), part.select(F.col("p_brand").alias("slug"))).groupBy("slug").agg(F.count("*").alias("n"))


@query("SELECT n_nationkey AS trace_id, n_nationkey < 10 AS found FROM nation")
def looked_up_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("trace_id"))
    known = n.where("trace_id < 10").withColumn("there", F.lit(True))
    return sampling.looked_up(n.unionByName(n), known).select("trace_id", F.coalesce("there", F.lit(False)).alias("found"))


RAW = """r AS (SELECT event_id, user_id, ts, (event_id % 50)::VARCHAR AS script, event_type FROM events),
p AS (SELECT user_id, script FROM r WHERE event_type = 'view' AND event_id % 50 % 7 > 0 AND event_id % 50 % 5 > 0 GROUP BY ALL)"""


def _raw(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Protocol events, of which views parse scripts and others call them, and an index that lacks every fifth script."""
    e, n = table(spark, sf_dir, "events"), F.col("event_id") % 50
    parsed = F.to_json(F.struct(_s(n).alias("scriptId"), F.when(n % 7 == 0, "chrome://x").otherwise("https://a.example/s.js").alias("url")))
    frames = F.array(F.struct(F.lit("0").alias("scriptId"), F.lit("chrome-error://y").alias("url")), F.struct(_s(n).alias("scriptId"), F.lit("https://a.example/s.js").alias("url")))
    called = F.to_json(F.struct(F.lit("log").alias("type"), F.struct(frames.alias("callFrames")).alias("stackTrace")))
    sent = F.to_json(F.struct(F.struct(F.lit("https://b.example").alias("url"), F.lit("GET").alias("method")).alias("request"), F.struct(F.struct(frames.alias("callFrames")).alias("stack")).alias("initiator")))
    kind, view, click = F.col("event_type"), F.lit("view"), F.lit("click")
    method = F.when(kind == view, "Debugger.scriptParsed").when(kind == click, "Runtime.consoleAPICalled").otherwise("Network.requestWillBeSent")
    raw = e.select("user_id", "event_id", _s("ts").alias("timestamp"), method.alias("method"), F.when(kind == view, parsed).when(kind == click, called).otherwise(sent).alias("params"))
    index = e.select("user_id", _s(n).alias("script_id")).where("script_id % 5 > 0").distinct()
    return raw, index


@query(f"WITH {RAW} SELECT user_id, script AS script_id FROM p")
def registered_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.registered_scripts(*_raw(spark, sf_dir), ["user_id"]).select("user_id", "script_id")


@query(f"WITH {RAW} SELECT user_id, script AS script_id, CASE WHEN event_type = 'click' THEN 'consoleAPI' ELSE 'networkRequest' END AS kind, count(*)::BIGINT AS n FROM r SEMI JOIN p USING (user_id, script) WHERE event_type <> 'view' GROUP BY ALL")
def routed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, index = _raw(spark, sf_dir)
    own = traces.routed_events(raw, traces.registered_scripts(raw, index, ["user_id"]), ["user_id"])
    return own.groupBy("user_id", "script_id", F.get_json_object("event", "$.eventType").alias("kind")).agg(F.count("*").alias("n"))


# --- functions ------------------------------------------------------------------------------
@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url WHEN page_id % 3 = 1 THEN 'https://src' ELSE '' END AS found FROM pages")
def first_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, url = F.col("page_id") % 3, F.col("url")
    arg = F.when(k == 0, F.to_json(F.struct(F.lit("").alias("url"), url.alias("href"), F.lit("z").alias("action")))).when(k == 1, F.to_json(F.struct(F.lit("https://src").alias("src"), url.alias("href")))).otherwise("[1]")
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(urls.first_url(arg), F.lit("")).alias("found"))


@query("SELECT n_nationkey AS key, n_name || ',{\"a\":1},' || CASE WHEN n_nationkey % 2 = 0 THEN 'no json' ELSE '7' END AS said, n_nationkey % 2 = 1 AS is_json FROM nation")
def console_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.when(F.col("n_nationkey") % 2 == 0, "no json").otherwise("7")
    one = lambda v, d: F.struct(F.lit("t").alias("type"), v.alias("value"), d.alias("description"))
    args = F.to_json(F.array(one(F.col("n_name"), F.lit("d")), one(F.lit('{"a":1}'), F.lit(None).cast("string")), one(F.lit(None).cast("string"), last)))
    said = traces.argument_values(args)
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.array_join(said, ",").alias("said"), text.decoded_argument(F.element_at(said, -1)).isNotNull().alias("is_json"))


@query("SELECT s_suppkey AS key, true AS close FROM supplier")
def jittered_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates move by a thousandth at most, and alike for one key."""
    a, b = text.jittered(F.col("s_acctbal").cast("double"), "s_suppkey"), text.jittered(F.lit(0.0), "s_suppkey")
    near = (F.abs(a - F.col("s_acctbal").cast("double")) <= 1.001e-3) & (F.abs(a - F.col("s_acctbal").cast("double") - b) < 1e-9)
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), near.alias("close"))


@query("SELECT n_nationkey AS key, CASE WHEN n_nationkey % 2 = 0 THEN (n_regionkey + 1) || ' (0.500), ' || n_nationkey || ' (1.250)' ELSE n_nationkey || ' (1.250)' END AS said FROM nation")
def neighbour_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda c, d: F.struct(c.alias("cluster_id"), d.alias("distance"))
    near = F.when(F.col("n_nationkey") % 2 == 0, "0.5").otherwise("far")
    listed = F.array(one(_s("n_nationkey"), F.lit("1.25")), one(F.lit("x"), F.lit("0.1")), one(_s(F.col("n_regionkey") + 1), near), one(F.lit("3"), F.lit("NaN")))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), text.neighbours_text(text.sound_neighbours(listed)).alias("said"))


@query("SELECT vec_id AS key, round((3 * embedding[1]::DOUBLE + embedding[2]::DOUBLE) / sqrt((3 * embedding[1]::DOUBLE + embedding[2]::DOUBLE) ** 2 + (3 * embedding[2]::DOUBLE + embedding[3]::DOUBLE) ** 2), 6) AS x FROM embeddings")
def blended_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = text.blended(F.slice("embedding", 1, 2), F.slice("embedding", 2, 2), 0.25)
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), r6(F.get(v, F.lit(0))).alias("x"))


@query("SELECT n_nationkey AS key, n_name || CASE WHEN n_nationkey % 2 = 0 THEN ',b' ELSE ',a,b' END AS items FROM nation")
def ordered_distinct_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("b"), F.lit(""), F.lit("b"))).otherwise(F.array(F.lit("a"), F.lit(None).cast("string"), F.lit("b"), F.lit("a")))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.array_join(text.ordered_distinct(F.concat(F.array("n_name"), rest)), ",").alias("items"))


@query("SELECT n_nationkey AS key, 'alpha beta' || chr(10) || 'gamma' || chr(10) || n_name AS said FROM nation")
def wrapped_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("n_name")
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), text.wrapped_lines(F.concat(F.lit("alpha beta gamma "), name), 12).alias("said"))


@query("SELECT r_regionkey AS key, CASE r_regionkey % 3 WHEN 0 THEN 'a:5,b:2' WHEN 1 THEN 'b:9,a:1' ELSE 'a:2,b:2' END AS top FROM region")
def top_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("r_regionkey") % 3
    counts = F.create_map(F.lit("c"), F.lit(0), F.lit("b"), F.when(k == 1, 9).otherwise(2), F.lit("a"), F.when(k == 0, 5).when(k == 1, 1).otherwise(2))
    own = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("key"), counts.alias("counts"))
    return own.select("key", F.array_join(F.transform(aggregates.top_nodes("counts", 2), lambda x: F.concat_ws(":", x["label"], _s(x["n"]))), ",").alias("top"))


@query("SELECT r_regionkey AS key, '20250102-20250101' AS run, r_name AS name, '-' AS other FROM region UNION ALL SELECT n_nationkey, '20250102-20250101', '-', n_name FROM nation")
def combined_caches(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("other"))
    run = aggregates.run_key(["20250102", "20250101", "20250102"])
    return aggregates.combined(r, n).select("key", F.lit(run).alias("run"), F.coalesce("name", F.lit("-")).alias("name"), F.coalesce("other", F.lit("-")).alias("other"))


# --- round trips ----------------------------------------------------------------------------
@query("SELECT n_nationkey AS key, n_name AS name, true AS current, false AS other FROM nation")
def run_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, n = scratch(spark), table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    before = tables.is_current(spark, at, {"epochs": 15})
    tables.write_run({"traces": n}, at, {"epochs": 15})
    same = tables.is_current(spark, at, {"epochs": 15}) and not before
    return tables.read_run(spark, at, "traces").select("key", "name", F.lit(same).alias("current"), F.lit(tables.is_current(spark, at, {"epochs": 16})).alias("other"))


@query("SELECT n_nationkey AS key, CASE WHEN n_nationkey % 2 = 0 THEN 'first' ELSE 'second' END AS written FROM nation UNION ALL SELECT r_regionkey + 100, 'forced' FROM region")
def append_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a table has stay as they are; with force it is written anew."""
    at, n = scratch(spark), table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"))
    tables.append_new(n.where("key % 2 = 0").withColumn("written", F.lit("first")), f"{at}/a", ["key"])
    tables.append_new(n.withColumn("written", F.lit("second")), f"{at}/a", ["key"])
    r = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 100).alias("key"))
    tables.append_new(n.withColumn("written", F.lit("old")), f"{at}/b", ["key"])
    tables.append_new(r.withColumn("written", F.lit("forced")), f"{at}/b", ["key"], force=True)
    return spark.read.parquet(f"{at}/a").unionByName(spark.read.parquet(f"{at}/b"))


@query("SELECT n_regionkey AS cluster, n_nationkey AS trace_id, r_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey QUALIFY row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) <= 3")
def report_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON report with three traces for each cluster, written as text and parsed again."""
    clusters = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("cluster"), F.col("r_name").alias("name"))
    own = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("cluster"), F.col("n_nationkey").alias("trace_id"))
    at = scratch(spark)
    tables.report_json(clusters, own, 3).select("value").write.text(f"{at}/report")
    back = spark.read.text(f"{at}/report").select(F.from_json("value", "cluster bigint, name string, traces array<struct<trace_id:bigint>>").alias("j"))
    return back.select("j.cluster", F.explode("j.traces").alias("t"), "j.name").select("cluster", "t.trace_id", "name")


@query("SELECT r_regionkey AS cluster, 'Cluster ' || r_regionkey || chr(10) || '  name: ' || r_name || chr(10) || '  score: ' || CASE WHEN r_regionkey % 2 = 0 THEN r_regionkey::VARCHAR ELSE 'n/a' END AS value FROM region")
def text_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("r_regionkey")
    return tables.report_text(table(spark, sf_dir, "region").select(k.alias("cluster"), F.col("r_name").alias("name"), F.when(k % 2 == 0, k).alias("score")), ["name", "score"])


@query("SELECT s_suppkey AS cluster, 'a,\"b\"' || s_name AS plugins, 16 AS columns FROM supplier")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = scratch(spark)
    own = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cluster"), F.concat(F.lit('a,"b"'), "s_name").alias("plugins"))
    tables.write_csv(own, f"{at}/samples", tables.SAMPLE_COLUMNS)
    back = spark.read.option("header", "true").option("escape", "\\").csv(f"{at}/samples")
    return back.select(F.col("cluster").cast("long").alias("cluster"), "plugins", F.lit(len(back.columns)).alias("columns"))


@query("SELECT n_nationkey AS key, '/crawls/h' || n_nationkey || '/20250101/loaded_js/s.js' AS source, n_nationkey % 3 AS cluster FROM nation")
def copied_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    own = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("h"), _s(k)).alias("url_hash"), F.lit("20250101").alias("timestamp"), F.lit("s.js").alias("file_name"), (k % 3).alias("cluster"), k.cast("int").alias("rank"), _s(k).alias("trace_id"), F.sha2(_s(k), 256).alias("hash"),
    )
    sent = tables.selection(own, "/crawls", "/out")
    return sent.select(F.regexp_extract("source", r"/h(\d+)/", 1).cast("long").alias("key"), "source", F.regexp_extract("target", r"^/out/cluster_(\d+)/", 1).cast("long").alias("cluster"))
