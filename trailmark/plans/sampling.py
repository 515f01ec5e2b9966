"""Choosing traces: scores, buckets of equal code, top-k per cluster, filters, mismatches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import trace_score
from ..functions.tokens import is_request, is_xhr


def scored(traces: DataFrame) -> DataFrame:
    """FN-37: adds score. traces: suspicious_event_count, capability_summary, event_distribution (arrays of struct(label, n)), event_sequence_preview, capability_counts."""
    obf = F.try_element_at("capability_counts", F.lit("OBFUSCATION"))
    return traces.withColumn("score", trace_score(F.col("suspicious_event_count"), F.col("capability_summary"), F.col("event_distribution"), F.col("event_sequence_preview"), obf, K.SCORE_WORDS, K.SCORE_CAPABILITIES))


def filtered(traces: DataFrame, network: bool = False, xhr: bool = False, least_suspicious: int | None = None, wordpress: int | None = None) -> DataFrame:
    """FLT-13: traces with a network event, with an XHR, with so many suspicious events, and of WordPress pages with so many, in this order."""
    events = "event_distribution"
    out = traces
    if network:
        out = out.where(F.exists(events, lambda e: is_request(e["label"])))
    if xhr:
        out = out.where(F.exists(events, lambda e: is_xhr(e["label"])))
    if least_suspicious is not None:
        out = out.where(F.coalesce("suspicious_event_count", F.lit(0)) >= least_suspicious)
    if wordpress is not None:
        out = out.where(F.coalesce("is_wordpress", F.lit(False)) & (F.coalesce("suspicious_event_count", F.lit(0)) >= wordpress))
    return out


def kept_clusters(traces: DataFrame, least_mean: float = 20, traces_over: int = 2, over: float = 35) -> DataFrame:
    """FLT-15: clusters whose mean score is high enough, or that have enough traces of a high score."""
    return traces.groupBy("cluster").agg(F.avg("score").alias("mean_score"), F.count_if(F.col("score") >= over).alias("n_over")).where((F.col("mean_score") >= least_mean) | (F.col("n_over") >= traces_over))


def diverse(traces: DataFrame, key: str = "trace_id", bucket: str = "bucket") -> DataFrame:
    """WIN-04: adds pick (from 1): the best trace of each bucket by the buckets' best scores, then others until the target. Ties by bucket and key.

    The target is min(3, n) with up to three buckets, else min(15, n).
    """
    by = Window.partitionBy("cluster", bucket)
    own = traces.withColumns({"_best": F.max("score").over(by), "_in": F.row_number().over(by.orderBy(F.desc("score"), key))})
    sizes = traces.groupBy("cluster").agg(F.count("*").alias("_n"), F.count_distinct(bucket).alias("_b"))
    target = F.when(F.col("_b") <= 3, F.least(F.lit(3), F.col("_n"))).otherwise(F.least(F.lit(15), F.col("_n")))
    order = Window.partitionBy("cluster").orderBy(F.when(F.col("_in") == 1, 0).otherwise(1), F.desc("_best"), bucket, "_in")
    return own.join(sizes, "cluster").withColumn("pick", F.row_number().over(order)).where(F.col("pick") <= target).drop("_best", "_in", "_n", "_b")


def top_per_cluster(traces: DataFrame, k: int, total: int | None = None, key: str = "trace_id") -> DataFrame:
    """WIN-03: the k best of each cluster by AST similarity, silhouette, suspicious events and verdicts; clusters in order until one reaches ``total``, which it may exceed."""
    best = Window.partitionBy("cluster").orderBy(*(F.col(c).desc_nulls_last() for c in ("ast_similarity", "silhouette", "suspicious_event_count", "verdict_count")), key)
    own = traces.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    if total is None:
        return own
    upto = own.groupBy("cluster").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("cluster").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each cluster
    return own.join(upto.where(F.col("before") < total).select("cluster"), "cluster", "left_semi")


def ranked_clusters(clusters: DataFrame) -> DataFrame:
    """WIN-05: clusters by suspicious events and score."""
    return clusters.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("suspicious"), F.desc("score"), "cluster")))  # a row for each cluster


def interesting(clusters: DataFrame, most: int = 5) -> DataFrame:
    """AGG-27, WIN-06: score 2 * mean suspicious + silhouette + 0.1 * size, the top of each run. clusters: run, cluster, mean_suspicious, silhouette, n."""
    score = 2 * F.coalesce("mean_suspicious", F.lit(0.0)) + F.coalesce("silhouette", F.lit(0.0)) + 0.1 * F.col("n")
    own = clusters.withColumn("score", score)
    return own.withColumn("rank", F.row_number().over(Window.partitionBy("run").orderBy(F.desc("score"), "cluster"))).where(F.col("rank") <= most)


def pair_range(pair_table: DataFrame, a: tuple[float, float], b: tuple[float, float], most: int | None = None) -> DataFrame:
    """FLT-18, TOP-01: pairs whose AST similarity and time-warping similarity lie in their ranges, most alike first. pair_table: i, j, ast, dtw."""
    own = pair_table.where(F.col("ast").between(*a) & F.col("dtw").between(*b))
    return own if most is None else own.orderBy(F.desc("dtw"), F.desc("ast"), "i", "j").limit(most)


def with_artefacts(pair_table: DataFrame, artefacts: DataFrame, most: int) -> DataFrame:
    """JN-17: the first pairs both of whose traces have artefacts; joins come before the limit."""
    side = lambda k: artefacts.select(F.col("trace_id").alias(k), F.struct("*").alias(f"artefact_{k}"))
    return pair_table.join(side("i"), "i").join(side("j"), "j").orderBy(F.desc("dtw"), F.desc("ast"), "i", "j").limit(most)


def mismatches(clusters: DataFrame, low: float = 0.25, high: float = 0.75, least_gap: float = 0.05, most: int = 5) -> DataFrame:
    """AGG-29, AGG-30, TOP-08: clusters whose AST similarity and silhouette disagree: one at or below its low percentile, the other at or above its high one. clusters: cluster, ast, silhouette.

    kind, cluster, ast, silhouette, gap, rank, beyond (how many more there are). Where none qualifies, the largest gaps of at least ``least_gap``, else the largest gaps.
    """
    both = clusters.where("ast is not null and silhouette is not null")
    q = both.agg(*(F.percentile(c, F.lit(p)).alias(f"{c}_{n}") for c in ("ast", "silhouette") for n, p in (("low", low), ("high", high))))
    x = both.join(F.broadcast(q))  # one row
    rows = None
    for kind, a, b in (("code_differs", "ast", "silhouette"), ("behaviour_differs", "silhouette", "ast")):
        gap = F.col(b) - F.col(a)
        level = F.when((F.col(a) <= F.col(f"{a}_low")) & (F.col(b) >= F.col(f"{b}_high")) & (gap >= least_gap), 0).when(gap >= least_gap, 1).otherwise(2)
        one = x.select(F.lit(kind).alias("kind"), "cluster", "ast", "silhouette", gap.alias("gap"), level.alias("level"))
        rows = one if rows is None else rows.unionByName(one)
    by = Window.partitionBy("kind")
    best = rows.withColumn("_l", F.min("level").over(by)).where("level = _l")
    out = best.withColumns({"rank": F.row_number().over(by.orderBy(F.desc("gap"), "cluster")), "_n": F.count("*").over(by)})
    return (out if most == 0 else out.where(F.col("rank") <= most)).select("kind", "cluster", "ast", "silhouette", "gap", "rank", F.greatest(F.col("_n") - (most or 1 << 30), F.lit(0)).alias("beyond"))


def retriable(results: DataFrame) -> Column:
    """FLT-22: no summary, or an error."""
    return F.col("summary").isNull() | (F.trim(F.coalesce("error", F.lit(""))) != "")


def pending(selected: DataFrame, manifest: DataFrame) -> DataFrame:
    """JN-15: selected rows that the manifest has not done; those with errors are not done."""
    done = manifest.where(~retriable(manifest)).select(F.col("cluster").alias("_c"), F.col("trace_id").alias("_t"))
    return selected.join(done, F.col("cluster").eqNullSafe(F.col("_c")) & F.col("trace_id").eqNullSafe(F.col("_t")), "left_anti")


def looked_up(spark_ids: DataFrame, traces: DataFrame, key: str = "trace_id") -> DataFrame:
    """FLT-19: the traces of a list of ids, with nulls for those that are missing."""
    return spark_ids.select(key).distinct().join(traces, key, "left")


def selected(traces: DataFrame, network: bool = False, xhr: bool = False, least_suspicious: int | None = None, wordpress: int | None = None, least_mean: float = 20, traces_over: int = 2, over: float = 35) -> DataFrame:
    """FLT-25: filters, scores, clusters worth keeping, and a sample of each that is diverse in code. traces: as scored(), and cluster, trace_id, bucket."""
    own = scored(filtered(traces, network, xhr, least_suspicious, wordpress))
    return diverse(own.join(kept_clusters(own, least_mean, traces_over, over).select("cluster"), "cluster", "left_semi"))
