"""Connected components of links between documents, without gathering them anywhere.

Alternating large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce
and Beyond", 2014). A step is a minimum per node, taken with map-side combination, and a join back
to the links: narrow rows, of which a node has no more than its component has nodes. After each step
every task replaces the links that it holds by a forest of stars with the same components, which
shortens chains. Each round is written to the shared folder, so that neither lineage nor recovery
grows with the number of rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import kept


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a task as stars around the least node of each of their components."""
    up: dict[int, int] = {}

    def top(i: int) -> int:
        while up.setdefault(i, i) != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            x, y = top(a), top(b)
            if x != y:
                up[max(x, y)] = min(x, y)
    links = [(i, top(i)) for i in up]
    links = [x for x in links if x[0] != x[1]]
    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])


def _with_least(e: DataFrame) -> DataFrame:
    """a, b, m: the links, and the least of each a's neighbours and itself."""
    least = e.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return e.join(least, "a").select("a", "b", "m")


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _with_least(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    out = _with_least(e).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
    return out.where("a != b").distinct()


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """id, label of every node with a link to another; label: the least node that links reach. links: columns a and b, in any order and number."""
    spark = links.sparkSession
    e = kept(spark, links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().mapInArrow(_stars, "a long, b long"), name)
    state = None
    while (now := _state(e)) != state:
        state = now
        if not now[0]:
            break
        e = kept(spark, _small_star(_large_star(e)).mapInArrow(_stars, "a long, b long").distinct(), name)
    return e.select(F.col("a").alias("id"), F.col("b").alias("label")).unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("label")).distinct())
