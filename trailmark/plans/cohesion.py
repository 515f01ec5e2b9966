"""How good clusters are: silhouettes, cohesion, neighbours, representatives, verdict coverage.

Label -1 is noise throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tiles
from .sequences import symmetric, vectors


def silhouettes(pair_table: DataFrame, labels: DataFrame) -> DataFrame:
    """AGG-13: key, cluster, silhouette. pair_table: i, j, dist; labels: key, cluster. Noise is left out; a singleton has 0; with fewer than two clusters there are no rows."""
    own = labels.where("cluster >= 0")
    x = symmetric(pair_table).join(own.select(F.col("key").alias("i"), F.col("cluster").alias("ci")), "i").join(own.select(F.col("key").alias("j"), F.col("cluster").alias("cj")), "j")
    return _silhouettes(x.groupBy("i", "ci", "cj").agg(F.avg("dist").alias("d")), own)


def vector_silhouettes(items: DataFrame, key: str, vector: str, labels: DataFrame, block: int = 256) -> DataFrame:
    """AGG-13: as silhouettes() of all pairs of vectors; distances are summed up by row and cluster in tiles."""
    own = labels.where("cluster >= 0")
    rows, size = vectors(items, key, vector)
    sums = tiles.group_sums(rows.join(own, "key"), "cluster", size, "vector", by_row=True, block=block, measured=rows)
    return _silhouettes(sums.groupBy(F.col("key").alias("i"), F.col("own").alias("ci"), F.col("other").alias("cj")).agg((F.sum("s") / F.sum("n")).alias("d")), own)


def _silhouettes(means: DataFrame, own: DataFrame) -> DataFrame:
    """means: i, ci, cj, d: mean distance of a member of ci to those of cj."""
    sizes = own.groupBy("cluster").agg(F.count("*").alias("size"))
    ab = means.groupBy("i", "ci").agg(F.min(F.when(F.col("ci") == F.col("cj"), F.col("d"))).alias("a"), F.min(F.when(F.col("ci") != F.col("cj"), F.col("d"))).alias("b"))
    s = F.when(F.col("size") == 1, 0.0).otherwise(F.coalesce((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)), F.lit(0.0)))
    out = own.join(ab, (F.col("key") == F.col("i")) & (F.col("cluster") == F.col("ci"))).join(sizes, "cluster").where("b is not null")
    return out.select("key", "cluster", s.alias("silhouette"))


def silhouette_by_cluster(samples: DataFrame) -> DataFrame:
    """AGG-13: mean per cluster, and of all samples where cluster is null."""
    return samples.groupingSets([["cluster"], []], "cluster").agg(F.avg("silhouette").alias("silhouette"), F.count("*").alias("n"))


def cohesion(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """AGG-11: key, cluster, similarity to the cluster's centroid. entries: key, node, weight (unit vectors in long form). Null where a cluster has fewer than two vectors."""
    own = entries.join(labels.where("cluster >= 0"), "key")
    centroid = own.groupBy("cluster", "node").agg(F.sum("weight").alias("c"))
    norm = centroid.groupBy("cluster").agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("norm"))
    members = own.groupBy("cluster").agg(F.count_distinct("key").alias("n"))
    s = own.join(centroid, ["cluster", "node"]).groupBy("cluster", "key").agg(F.sum(F.col("weight") * F.col("c")).alias("dot"))
    return s.join(norm, "cluster").join(members, "cluster").select("key", "cluster", F.when(F.col("n") >= 2, F.col("dot") / F.nullif("norm", F.lit(0.0))).alias("similarity"))


def neighbours(pair_table: DataFrame, labels: DataFrame, most: int = 5) -> DataFrame:
    """AGG-12, AGG-40: cluster, other, distance, rank: nearest clusters by mean distance of their members."""
    own = labels.where("cluster >= 0")
    x = symmetric(pair_table).join(own.select(F.col("key").alias("i"), F.col("cluster").alias("cluster")), "i").join(own.select(F.col("key").alias("j"), F.col("cluster").alias("other")), "j")
    return _nearest_clusters(x.where("cluster != other and not isnan(dist)").groupBy("cluster", "other").agg(F.avg("dist").alias("distance")), most)


def vector_neighbours(items: DataFrame, key: str, vector: str, labels: DataFrame, most: int = 5, block: int = 256) -> DataFrame:
    """AGG-12, AGG-40: as neighbours() of all pairs of vectors; distances are summed up by clusters in tiles."""
    rows, size = vectors(items, key, vector)
    sums = tiles.group_sums(rows.join(labels.where("cluster >= 0"), "key"), "cluster", size, "vector", by_row=False, block=block, measured=rows)
    means = sums.where("own != other").groupBy(F.col("own").alias("cluster"), "other").agg((F.sum("s") / F.sum("n")).alias("distance"))
    return _nearest_clusters(means, most)


def _nearest_clusters(means: DataFrame, most: int) -> DataFrame:
    return means.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy("distance", "other"))).where(F.col("rank") <= most)


def representatives(traces: DataFrame, key: str = "key", score: str = "silhouette", sequence: str | None = None) -> DataFrame:
    """WIN-02: the member of each cluster with the best score, the first on ties; null and NaN are worst, noise and empty sequences are out."""
    own = traces.where("cluster >= 0")
    own = own.where(F.size(sequence) > 0) if sequence else own
    ok = F.when(~F.isnan(F.col(score)), F.col(score))
    return own.withColumn("_n", F.row_number().over(Window.partitionBy("cluster").orderBy(ok.desc_nulls_last(), key))).where("_n = 1").drop("_n")


def with_representative(members: DataFrame, reps: DataFrame, key: str = "key") -> DataFrame:
    """JN-11: members beside their cluster's representative, which is left out itself."""
    return members.join(reps.select("cluster", F.col(key).alias("rep")), "cluster").where(F.col(key) != F.col("rep"))


def verdict_stats(traces: DataFrame, count: str = "verdict_count") -> DataFrame:
    """AGG-10: cluster, average over scanned members, scanned, size; clusters without a scanned member and noise are out."""
    return traces.where("cluster >= 0").groupBy("cluster").agg(F.avg(count).alias("average"), F.count(count).alias("scanned"), F.count("*").alias("size")).where("scanned > 0")


def profiles(traces: DataFrame) -> DataFrame:
    """AGG-09: scripts, distinct URLs, mean events and mean suspicious events of each cluster."""
    return traces.groupBy("cluster").agg(F.count("*").alias("scripts"), F.count_distinct("script_url").alias("urls"), F.avg("num_events").alias("mean_events"), F.avg("suspicious_event_count").alias("mean_suspicious"))


def renumbered(labels: DataFrame, order: str) -> DataFrame:
    """WIN-10: clusters numbered from 1 by first appearance; noise stays -1. The second sort is over one row for each cluster."""
    first = labels.where("cluster >= 0").groupBy("cluster").agg(F.min(order).alias("first"))
    number = first.withColumn("label", F.row_number().over(Window.orderBy("first", "cluster"))).select("cluster", "label")
    return labels.join(number, "cluster", "left").withColumn("label", F.coalesce("label", F.lit(-1)))


def rejected(aligned: DataFrame, furthest: float | None = None, least_coverage: float | None = None) -> DataFrame:
    """SEQ-09: adds ``rejected`` to aligned members: too far by normalised distance, or too little of their sequence covered."""
    far = F.lit(False) if furthest is None else F.col("normalized") > furthest
    thin = F.lit(False) if least_coverage is None else F.col("coverage") < least_coverage
    return aligned.withColumn("rejected", F.coalesce(far | thin, F.lit(False)))


def without_rejected(labels: DataFrame, aligned: DataFrame) -> DataFrame:
    """SEQ-09: labels, rejected members as noise."""
    r = aligned.where("rejected").select("key", F.lit(True).alias("_r"))
    return labels.join(r, "key", "left").withColumn("cluster", F.when(F.col("_r"), -1).otherwise(F.col("cluster"))).drop("_r")
