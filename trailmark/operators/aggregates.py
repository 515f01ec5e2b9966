"""Roll-ups. Frequencies are ordered by count and then by label."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import label, label_parts, sound_version, version_key
from ..functions.urls import on_platform, plain_host


def top_counts(rows: DataFrame, by: list[str], item: str, most: int, weight: str | None = None) -> DataFrame:
    """AGG-04, AGG-14, TOP-02, TOP-03, TOP-10: by, item, n, rank: the most frequent items of each group."""
    n = rows.groupBy(*by, item).agg((F.count("*") if weight is None else F.sum(weight)).alias("n"))
    w = Window.partitionBy(*by).orderBy(F.desc("n"), item)
    return n.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def asset_distribution(assets: DataFrame, most: int = 20) -> DataFrame:
    """AGG-14: cluster, label, n, rank of ``name (version)``. assets: cluster, name, version."""
    return top_counts(assets.select("cluster", label("name", "version").alias("label")), ["cluster"], "label", most)


def version_distribution(labels: DataFrame) -> DataFrame:
    """AGG-15: base, version, n, total from labels and counts; unsound versions fall into a null bucket. labels: label, n."""
    p = label_parts("label")
    own = labels.where("label is not null and n is not null").select(p["base"].alias("base"), sound_version(p["version"]).alias("version"), "n")
    by = own.groupBy("base", "version").agg(F.sum("n").alias("n"))
    return by.withColumn("total", F.sum("n").over(Window.partitionBy("base")))


def asset_totals(labels: DataFrame) -> DataFrame:
    """AGG-16: as version_distribution, of positive whole counts, missing versions as ``unspecified``."""
    p = label_parts("label", "unspecified")
    own = labels.select(p["base"].alias("base"), p["version"].alias("version"), F.col("n").try_cast("int").alias("n")).where("n > 0")
    return own.groupBy("base", "version").agg(F.sum("n").alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy("base")))


def mean_of_numbers(rows: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """AGG-18: means over values that are numbers."""
    return rows.groupBy(*by).agg(*(F.avg(F.col(v).try_cast("double")).alias(v) for v in values))


def asset_support(assets: DataFrame) -> DataFrame:
    """AGG-19: traces and suspicious traces of each asset, per cluster and, with a null cluster, in all. assets: cluster, trace_id, name, suspicious; an asset counts once for each trace."""
    own = assets.groupBy("cluster", "trace_id", "name").agg(F.max(F.col("suspicious").cast("int")).alias("s"))
    return own.groupingSets([["cluster", "name"], ["name"]], "cluster", "name").agg(F.count("*").alias("total"), F.sum("s").alias("suspicious"), F.grouping("cluster").alias("overall"))


def coupled(support: DataFrame, most: int = 5, least: int = 3, ratio: float = 0.6) -> DataFrame:
    """AGG-39: the assets most coupled with suspicious traces, per cluster and in all."""
    own = support.withColumn("ratio", F.col("suspicious") / F.col("total")).where((F.col("suspicious") >= least) & (F.col("ratio") >= ratio))
    w = Window.partitionBy("overall", "cluster").orderBy(F.desc("ratio"), F.desc("suspicious"), "name")
    return own.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def trace_stats(traces: DataFrame) -> DataFrame:
    """AGG-20: distinct traces, scripts and pages of each cluster."""
    return traces.groupBy("cluster").agg(F.count_distinct("trace_id").alias("traces"), F.count_distinct("script_url").alias("scripts"), F.count_distinct("page_url").alias("pages"))


def domain_counts(traces: DataFrame) -> DataFrame:
    """AGG-20: traces of each cluster by the script's host."""
    return traces.groupBy("cluster", "domain").agg(F.count_distinct("trace_id").alias("n"))


def distinct_versions(assets: DataFrame) -> DataFrame:
    """AGG-21, AGG-37: cluster, slug, version, traces: distinct traces of each version."""
    return assets.groupBy("cluster", "slug", version_key("version").alias("version")).agg(F.count_distinct("trace_id").alias("traces"))


def version_texts(distinct: DataFrame) -> DataFrame:
    """AGG-37: cluster, slug, total, text ``v ×n``, the most frequent first."""
    said = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("traces")).alias("o"), "version", "traces"))), lambda x: F.concat(x["version"], F.lit(" ×"), x["traces"].cast("string")))
    return distinct.groupBy("cluster", "slug").agg(F.sum("traces").alias("total"), F.array_join(said, ", ").alias("versions"))


def per_day(rows: DataFrame, day: str, counts: dict[str, str]) -> DataFrame:
    """AGG-22: sums for each day, and for all days where the day is null. counts: name -> column."""
    return rows.rollup(day).agg(*(F.sum(c).alias(n) for n, c in counts.items()), F.grouping(day).alias("total"))


def coverage_by_day(crawls: DataFrame, verdicts: DataFrame, day: str) -> DataFrame:
    """AGG-24, SET-02: crawls and verdicts for each day that has either, and in all."""
    a, b = crawls.groupBy(day).agg(F.count("*").alias("crawls")), verdicts.groupBy(day).agg(F.count("*").alias("verdicts"))
    both = a.join(b, day, "full_outer").select(day, F.coalesce("crawls", F.lit(0)).alias("crawls"), F.coalesce("verdicts", F.lit(0)).alias("verdicts"))
    return both.rollup(day).agg(F.sum("crawls").alias("crawls"), F.sum("verdicts").alias("verdicts"), F.grouping(day).alias("total"))


def funnel(crawls: DataFrame) -> DataFrame:
    """AGG-23: how many crawls pass each test, in one pass. crawls: url, has_trace, has_index, index_rows, has_fingerprint, is_wordpress, has_report."""
    platform = F.coalesce(on_platform(plain_host("url")), F.lit(False))
    tests = {
        "hosted": platform, "own_domain": ~platform, "with_trace": F.col("has_trace"), "with_index": F.col("has_index"), "with_scripts": F.col("index_rows") > 0,
        "with_fingerprint": F.col("has_fingerprint"), "wordpress": F.col("is_wordpress"), "with_report": F.col("has_report"),
        "usable": F.col("has_trace") & (F.col("index_rows") > 0), "usable_wordpress": F.col("has_trace") & (F.col("index_rows") > 0) & F.col("is_wordpress"),
    }
    return crawls.agg(F.count("*").alias("crawls"), *(F.count_if(F.coalesce(t, F.lit(False))).alias(n) for n, t in tests.items()))


def platform_counts(hosts: DataFrame, platforms: DataFrame) -> DataFrame:
    """AGG-25: crawls of each platform, zero included. hosts: host. platforms: platform, a short list."""
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(F.split("host", r"\.")), F.lit(1))), lambda i: F.array_join(F.slice(F.split("host", r"\."), i, F.size(F.split("host", r"\."))), "."))
    hit = hosts.where("host is not null").select(F.explode(suffixes).alias("platform"))
    return platforms.join(hit.groupBy("platform").agg(F.count("*").alias("n")), "platform", "left").select("platform", F.coalesce("n", F.lit(0)).alias("n"))


def domains_per_plugin(rows: DataFrame, most: int = 5) -> DataFrame:
    """AGG-32: distinct domains of each plugin and version, the first plugins of each cluster by distinct domains. rows: cluster, slug, version, domain."""
    by = rows.groupBy("cluster", "slug").agg(F.count_distinct("domain").alias("domains"))
    top = by.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("domains"), "slug"))).where(F.col("rank") <= most)
    versions = rows.groupBy("cluster", "slug", version_key("version").alias("version")).agg(F.count_distinct("domain").alias("version_domains"))
    return top.join(versions, ["cluster", "slug"])


def alert_counts(rows: DataFrame, excluded: tuple[str, ...] = ()) -> DataFrame:
    """AGG-33: matched assets of each cluster, clamped to its distinct domains. rows: cluster, slug, matched, domains."""
    return rows.where(~F.col("slug").isin(*excluded) if excluded else F.lit(True)).groupBy("cluster").agg(F.least(F.sum("matched"), F.max("domains")).alias("alerts"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("matched") > 0, F.col("slug")))), ", ").alias("slugs"))


def urls_and_domains(traces: DataFrame) -> DataFrame:
    """AGG-34: distinct URLs and hosts of each cluster, sorted."""
    return traces.groupBy("cluster").agg(F.array_sort(F.collect_set("script_url")).alias("urls"), F.array_sort(F.collect_set("domain")).alias("domains"))


def top_nodes(counts: str, most: int = 5):
    """AGG-36: the most frequent entries of a map, as struct(label, n)."""
    own = F.transform(F.map_entries(counts), lambda e: F.struct((-e["value"]).alias("o"), e["key"].alias("label"), e["value"].alias("n")))
    return F.transform(F.slice(F.array_sort(own), 1, most), lambda x: F.struct(x["label"], x["n"]))


def top_or_other(rows: DataFrame, item: str, most: int = 10) -> DataFrame:
    """TOP-09: rows with their item, or ``Other`` beyond the most frequent ones."""
    top = rows.groupBy(item).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), item).limit(most).select(item, F.col(item).alias("shown"))
    return rows.join(top, item, "left").withColumn("shown", F.coalesce("shown", F.lit("Other")))


def node_histogram(nodes: DataFrame) -> DataFrame:
    """AGG-35: doc, num_nodes, max_depth, node_type_counts, depth_histogram from rows doc, node, depth."""
    kinds = nodes.groupBy("doc", "node").agg(F.count("*").alias("n")).groupBy("doc").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("node", "n")))).alias("node_type_counts"))
    depths = nodes.groupBy("doc", F.col("depth").cast("string").alias("d")).agg(F.count("*").alias("n")).groupBy("doc").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("d", "n")))).alias("depth_histogram"))
    return nodes.groupBy("doc").agg(F.count("*").alias("num_nodes"), F.max("depth").alias("max_depth")).join(kinds, "doc").join(depths, "doc")


def combined(*tables: DataFrame) -> DataFrame:
    """SET-05: rows of all tables, columns that one lacks as null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def run_key(stamps: list[str]) -> str:
    """SET-08: distinct timestamps in their order, joined by dashes."""
    return "-".join(dict.fromkeys(stamps))
