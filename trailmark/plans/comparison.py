"""Two runs against each other: moves, overlaps, merges, splits, metric changes, sample mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STABLE = 1e-9


def moves(old: DataFrame, new: DataFrame) -> DataFrame:
    """JN-09, SET-01: key, old_cluster, new_cluster, state (kept, moved, removed, added). old, new: key, cluster."""
    o, n = old.select("key", F.col("cluster").alias("old_cluster"), F.lit(1).alias("_o")), new.select("key", F.col("cluster").alias("new_cluster"), F.lit(1).alias("_n"))
    state = F.when(F.col("_n").isNull(), "removed").when(F.col("_o").isNull(), "added").when(F.col("old_cluster").eqNullSafe(F.col("new_cluster")), "kept").otherwise("moved")
    return o.join(n, "key", "full_outer").select("key", "old_cluster", "new_cluster", state.alias("state"))


def overlaps(old: DataFrame, new: DataFrame) -> DataFrame:
    """JN-10: target (new), source (old), shared, share of each."""
    shared = old.select("key", F.col("cluster").alias("source")).join(new.select("key", F.col("cluster").alias("target")), "key").groupBy("target", "source").agg(F.count("*").alias("shared"))
    so, sn = old.groupBy(F.col("cluster").alias("source")).agg(F.count("*").alias("so")), new.groupBy(F.col("cluster").alias("target")).agg(F.count("*").alias("sn"))
    return shared.join(so, "source").join(sn, "target").select("target", "source", "shared", (F.col("shared") / F.col("so")).alias("source_fraction"), (F.col("shared") / F.col("sn")).alias("target_fraction"))


def merges(overlap: DataFrame, least: int = 10, fraction: float = 0.25) -> DataFrame:
    """FLT-20: targets to which two sources or more contribute enough."""
    return overlap.groupBy("target").agg(F.count_if((F.col("shared") >= least) & (F.col("target_fraction") >= fraction)).alias("sources")).where("sources >= 2")


def splits(overlap: DataFrame, least: int = 10, fraction: float = 0.25) -> DataFrame:
    """FLT-20, the other way: sources of which two targets or more hold enough."""
    return overlap.groupBy("source").agg(F.count_if((F.col("shared") >= least) & (F.col("source_fraction") >= fraction)).alias("targets")).where("targets >= 2")


def transitions(overlap: DataFrame, least: int = 10, fraction: float = 0.25, most: int = 5) -> DataFrame:
    """FLT-21: overlaps that pass any threshold, the largest of each target."""
    own = overlap.where((F.col("shared") >= least) | (F.col("target_fraction") >= fraction) | (F.col("source_fraction") >= fraction))
    return own.withColumn("rank", F.row_number().over(Window.partitionBy("target").orderBy(F.desc("shared"), "source"))).where(F.col("rank") <= most)


def metric_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """AGG-31: cluster, old, new, change, state (improved, decayed, stable, new, removed, missing). old, new: cluster, value."""
    x = old.select("cluster", F.col("value").alias("old"), F.lit(1).alias("_o")).join(new.select("cluster", F.col("value").alias("new"), F.lit(1).alias("_n")), "cluster", "full_outer")
    change = F.col("new") - F.col("old")
    state = F.when(F.col("_o").isNull(), "new").when(F.col("_n").isNull(), "removed").when(change.isNull(), "missing").when(F.abs(change) <= STABLE, "stable").when(change > 0, "improved").otherwise("decayed")
    return x.select("cluster", "old", "new", change.alias("change"), state.alias("state"))


def members(labels: DataFrame) -> DataFrame:
    """AGG-38: cluster, size and its keys' digest, for a comparison without moving members."""
    return labels.groupBy("cluster").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("key")).alias("digest"))


def mapped_samples(samples: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """JN-12, SET-06: old samples with their new cluster and why some have none. samples: key."""
    o = old.select("key", F.col("cluster").alias("old_cluster"))
    n = new.select("key", F.col("cluster").alias("new_cluster"), F.lit(True).alias("_n"))
    state = F.when(F.col("_n").isNull(), "removed").when(F.col("new_cluster") < 0, "unmapped_noise").otherwise("mapped")
    return samples.join(o, "key", "left").join(n, "key", "left").select("key", "old_cluster", F.when(F.col("new_cluster") >= 0, F.col("new_cluster")).alias("new_cluster"), state.alias("state"))


def cluster_mapping(mapped: DataFrame) -> DataFrame:
    """JN-12: for each old cluster its new clusters by mapped samples, the largest first."""
    n = mapped.where("state = 'mapped'").groupBy("old_cluster", "new_cluster").agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("old_cluster").orderBy(F.desc("n"), "new_cluster")))


def novel(old: DataFrame, new: DataFrame) -> DataFrame:
    """JN-12: traces of the new run that the old one lacks."""
    return new.join(old.select("key"), "key", "left_anti")


def state_of(expected: Column, found: Column) -> Column:
    return F.when(expected.eqNullSafe(found), "same").otherwise("different")
