"""Joins that need more than a key."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import day_of
from ..functions.urls import comparable_url, page_or_unknown


def crawl_reports(crawls: DataFrame, reports: DataFrame) -> DataFrame:
    """JN-04: each crawl with the first report, by file name, of its day and URL; URLs match with or without ``www.``.

    crawls: crawl_id, folder, url. reports: report_id, file, folder, url. The four equalities become one equi-join over the forms of each URL.
    """
    forms = lambda: F.explode(F.array_distinct(F.array(comparable_url("url"), comparable_url("url", without_www=True)))).alias("_form")
    c = crawls.select("crawl_id", day_of("folder").alias("_day"), forms())
    r = reports.select("report_id", "file", day_of("folder").alias("_day"), forms())
    both = c.join(r, ["_day", "_form"]).select("crawl_id", "report_id", "file").distinct()
    return both.withColumn("_n", F.row_number().over(Window.partitionBy("crawl_id").orderBy("file", "report_id"))).where("_n = 1").select("crawl_id", "report_id")


def page_edges(traces: DataFrame) -> DataFrame:
    """JN-16: page_url, trace_id: which page ran which script, once each."""
    return traces.select(page_or_unknown("page_url", "trace_id").alias("page_url"), "trace_id").distinct()


def asset_edges(traces: DataFrame) -> DataFrame:
    """JN-16: page_url, kind, slug, version: which page used which asset, once each. traces: assets (array of struct(kind, slug, version))."""
    return traces.select(page_or_unknown("page_url", "trace_id").alias("page_url"), F.explode("assets").alias("a")).select("page_url", "a.*").distinct()


def numbered(items: DataFrame, key: list[str], order: str) -> DataFrame:
    """WIN-09: key, idx: distinct keys numbered from 0 by first appearance."""
    first = items.groupBy(*key).agg(F.min(order).alias("_first"))
    return consecutive(first, ["_first", *key]).drop("_first")


def consecutive(rows: DataFrame, order: list[str], name: str = "idx") -> DataFrame:
    """Adds numbers from 0 in this order, without gaps and without one task for all: ranks within ranges of the order, and the sizes of the ranges before.

    The ranges are kept on disk, so that both see the same ones.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()).persist(StorageLevel.DISK_ONLY)
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each range
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return ranged.withColumn("_within", within).join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + F.col("_within")).cast("int")).drop("_part", "_within", "_before")


def page_verdicts(traces: DataFrame) -> DataFrame:
    """AGG-28: the largest verdict count of a page's scripts, -1 without any."""
    return traces.groupBy(page_or_unknown("page_url", "trace_id").alias("page_url")).agg(F.coalesce(F.max("verdict_count"), F.lit(-1)).alias("verdict"))


def enriched(samples: DataFrame, summary: DataFrame, key: str) -> DataFrame:
    """JN-14: samples with their cluster's summary; text that is missing is blank."""
    x = samples.join(summary, key, "left")
    text = [c for c, t in summary.dtypes if t == "string" and c != key]
    return x.withColumns({c: F.coalesce(c, F.lit("")) for c in text})


def cluster_summaries(clusters: DataFrame, *parts: DataFrame) -> DataFrame:
    """JN-19, JN-20: a row for each cluster with all its metrics and roll-ups, left joins by cluster."""
    for p in parts:
        clusters = clusters.join(p, "cluster", "left")
    return clusters


def existing_or_new(wanted: DataFrame, done: DataFrame, keys: list[str], force: bool = False) -> DataFrame:
    """SNK-03, SNK-04: rows still to be made: those that are not done, or all of them."""
    return wanted if force else wanted.join(done.select(*keys), keys, "left_anti")
