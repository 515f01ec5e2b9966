"""Two runs from ``orders``: the old run has even order keys and more, the new one others; status and priority are clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates
from ..plans import cohesion, comparison
from ..session import table
from .registry import query, r6

R = """o AS (SELECT o_orderkey AS key, o_custkey % 8 AS cluster FROM orders WHERE o_orderkey % 5 < 4), n AS (SELECT o_orderkey AS key, CASE WHEN o_orderkey % 3 = 0 THEN (o_custkey + 1) % 8 ELSE o_custkey % 8 END AS cluster FROM orders WHERE o_orderkey % 5 > 0)"""
OV = R + """, sh AS (SELECT n.cluster AS target, o.cluster AS source, count(*) AS shared FROM o JOIN n USING (key) GROUP BY ALL), so AS (SELECT cluster, count(*) AS c FROM o GROUP BY 1), sn AS (SELECT cluster, count(*) AS c FROM n GROUP BY 1),
ov AS (SELECT target, source, shared::BIGINT AS shared, shared / so.c AS source_fraction, shared / sn.c AS target_fraction FROM sh JOIN so ON so.cluster = source JOIN sn ON sn.cluster = target)"""


def _runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    x = table(spark, sf_dir, "orders")
    key, c = F.col("o_orderkey"), F.col("o_custkey")
    return x.where(key % 5 < 4).select(key.alias("key"), (c % 8).alias("cluster")), x.where(key % 5 > 0).select(key.alias("key"), F.when(key % 3 == 0, (c + 1) % 8).otherwise(c % 8).alias("cluster"))


@query(f"WITH {R} SELECT coalesce(o.key, n.key) AS key, CASE WHEN n.key IS NULL THEN 'removed' WHEN o.key IS NULL THEN 'added' WHEN o.cluster = n.cluster THEN 'kept' ELSE 'moved' END AS state FROM o FULL JOIN n USING (key)")
def run_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.moves(*_runs(spark, sf_dir)).select("key", "state")


@query(f"WITH {OV} SELECT target, source, shared, round(source_fraction, 6) AS source_fraction, round(target_fraction, 6) AS target_fraction FROM ov")
def cluster_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.overlaps(*_runs(spark, sf_dir)).withColumns({c: r6(c) for c in ("source_fraction", "target_fraction")})


@query(f"WITH {OV} SELECT target, count(*) FILTER (shared >= 10 AND target_fraction >= 0.2)::BIGINT AS sources FROM ov GROUP BY 1 HAVING sources >= 2")
def cluster_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.merges(comparison.overlaps(*_runs(spark, sf_dir)), 10, 0.2)


@query(f"WITH {OV} SELECT source, count(*) FILTER (shared >= 10 AND source_fraction >= 0.2)::BIGINT AS targets FROM ov GROUP BY 1 HAVING targets >= 2")
def cluster_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.splits(comparison.overlaps(*_runs(spark, sf_dir)), 10, 0.2)


@query(f"WITH {OV} SELECT target, source, shared, (row_number() OVER (PARTITION BY target ORDER BY shared DESC, source))::INT AS rank FROM ov WHERE shared >= 10 OR target_fraction >= 0.25 OR source_fraction >= 0.25 QUALIFY rank <= 5")
def cluster_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.transitions(comparison.overlaps(*_runs(spark, sf_dir))).select("target", "source", "shared", "rank")


M = "o AS (SELECT o_custkey % 50 AS cluster, round(avg(o_totalprice), 2) AS value FROM orders WHERE o_orderkey % 2 = 0 AND o_custkey % 50 > 5 GROUP BY 1), n AS (SELECT o_custkey % 50 AS cluster, CASE WHEN o_custkey % 50 = 20 THEN NULL ELSE round(avg(o_totalprice), 2) END AS value FROM orders WHERE o_orderkey % 3 > 0 AND o_custkey % 50 < 40 GROUP BY 1)"


@query(f"WITH {M} SELECT coalesce(o.cluster, n.cluster) AS cluster, round(n.value - o.value, 4) AS change, CASE WHEN o.cluster IS NULL THEN 'new' WHEN n.cluster IS NULL THEN 'removed' WHEN n.value - o.value IS NULL THEN 'missing' WHEN abs(n.value - o.value) <= 1e-9 THEN 'stable' WHEN n.value > o.value THEN 'improved' ELSE 'decayed' END AS state FROM o FULL JOIN n USING (cluster)")
def metric_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "orders").withColumn("cluster", F.col("o_custkey") % 50)
    mean = F.round(F.avg("o_totalprice"), 2)
    old = x.where("o_orderkey % 2 = 0 and cluster > 5").groupBy("cluster").agg(mean.alias("value"))
    new = x.where("o_orderkey % 3 > 0 and cluster < 40").groupBy("cluster").agg(mean.alias("value")).withColumn("value", F.when(F.col("cluster") != 20, F.col("value")))
    return comparison.metric_changes(old, new).select("cluster", F.round("change", 4).alias("change"), "state")


@query(f"WITH {R} SELECT s.key, CASE WHEN n.key IS NULL THEN 'removed' WHEN n.cluster = 7 THEN 'unmapped_noise' ELSE 'mapped' END AS state FROM (SELECT o_orderkey AS key FROM orders) s LEFT JOIN n USING (key)")
def mapped_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _runs(spark, sf_dir)
    new = new.withColumn("cluster", F.when(F.col("cluster") == 7, -1).otherwise(F.col("cluster")))
    return comparison.mapped_samples(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key")), old, new).select("key", "state")


@query(f"WITH {R} SELECT n.key FROM n ANTI JOIN o USING (key)")
def novel_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.novel(*_runs(spark, sf_dir)).select("key")


@query(f"WITH {R}, f AS (SELECT cluster, min(key) AS f FROM n WHERE cluster <> 7 GROUP BY 1), k AS (SELECT cluster, row_number() OVER (ORDER BY f, cluster) AS label FROM f) SELECT n.key, coalesce(label, -1)::INT AS label FROM n LEFT JOIN k USING (cluster)")
def renumbered_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = _runs(spark, sf_dir)[1].withColumn("cluster", F.when(F.col("cluster") == 7, -1).otherwise(F.col("cluster")))
    return cohesion.renumbered(new, "key").select("key", "label")


@query("SELECT coalesce(strftime(o_orderdate, '%Y%m%d'), 'TOTAL') AS day, count(*)::BIGINT AS traces, sum(o_custkey % 7)::BIGINT AS files FROM orders GROUP BY ROLLUP (strftime(o_orderdate, '%Y%m%d'))")
def per_day_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyyMMdd").alias("day"), F.lit(1).alias("one"), (F.col("o_custkey") % 7).alias("f"))
    return aggregates.per_day(x, "day", {"traces": "one", "files": "f"}).select(F.coalesce("day", F.lit("TOTAL")).alias("day"), "traces", "files")


@query("WITH a AS (SELECT strftime(o_orderdate, '%Y%m') AS day, count(*) AS crawls FROM orders GROUP BY 1), b AS (SELECT strftime(l_shipdate, '%Y%m') AS day, count(*) AS verdicts FROM lineitem GROUP BY 1), x AS (SELECT coalesce(a.day, b.day) AS day, coalesce(crawls, 0) AS crawls, coalesce(verdicts, 0) AS verdicts FROM a FULL JOIN b USING (day)) SELECT coalesce(day, 'TOTAL') AS day, sum(crawls)::BIGINT AS crawls, sum(verdicts)::BIGINT AS verdicts FROM x GROUP BY ROLLUP (day)")
def scan_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyyMM").alias("day"))
    v = table(spark, sf_dir, "lineitem").select(F.date_format("l_shipdate", "yyyyMM").alias("day"))
    return aggregates.coverage_by_day(c, v, "day").select(F.coalesce("day", F.lit("TOTAL")).alias("day"), "crawls", "verdicts")


@query("SELECT c_mktsegment AS cluster, round(avg(CASE WHEN c_custkey % 4 > 0 THEN c_acctbal END), 4) AS balance FROM customer GROUP BY 1")
def null_skipping_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("cluster"), F.when(F.col("c_custkey") % 4 > 0, F.col("c_acctbal").cast("string")).otherwise("n/a").alias("balance"))
    return aggregates.mean_of_numbers(own, ["cluster"], ["balance"]).withColumn("balance", F.round("balance", 4))


@query("SELECT o_orderpriority AS cluster, count(DISTINCT o_orderkey)::BIGINT AS traces, count(DISTINCT o_custkey)::BIGINT AS scripts, count(DISTINCT o_orderdate)::BIGINT AS pages FROM orders GROUP BY 1")
def trace_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.trace_stats(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("cluster"), F.col("o_orderkey").alias("trace_id"), F.col("o_custkey").alias("script_url"), F.col("o_orderdate").alias("page_url")))


@query("SELECT n_regionkey AS doc, count(*)::BIGINT AS num_nodes, max(n_nationkey % 4)::INT AS max_depth, count(DISTINCT n_name)::BIGINT AS kinds FROM nation GROUP BY 1")
def node_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = aggregates.node_histogram(table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("doc"), F.col("n_name").alias("node"), (F.col("n_nationkey") % 4).alias("depth")))
    return own.select("doc", "num_nodes", F.col("max_depth").cast("int").alias("max_depth"), F.size("node_type_counts").cast("long").alias("kinds"))
