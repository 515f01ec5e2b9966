"""All-pairs work in tiles against the same operators over tables of pairs, and what it deals out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trailmark.plans import clustering, cohesion, sequences, tiles, traces


@pytest.fixture(scope="module")
def points(spark):
    """Vectors with copies and near copies, whose keys are names."""
    rng = np.random.RandomState(3)
    v = rng.randn(90, 5)
    v[60:70] = v[0]
    v[70:80] = v[10:20] + 1e-9
    df = spark.createDataFrame([(f"k{i * 37 % 90:02}", x.tolist(), i % 4) for i, x in enumerate(v)], "key string, v array<double>, cluster int").cache()
    rows = df.collect()
    d = {(a["key"], b["key"]): float(np.linalg.norm(np.subtract(a["v"], b["v"]))) for a in rows for b in rows if a["key"] < b["key"]}
    return df, spark.createDataFrame([(i, j, x) for (i, j), x in d.items()], "i string, j string, dist double").cache(), df.select("key", "cluster")


def same(got, want, *ids):
    value = next(c for c in want.columns if c not in ids)
    a, b = ({tuple(r[c] for c in ids): r[value] for r in x.collect()} for x in (got, want))
    assert a == pytest.approx(b, abs=1e-9)


def test_a_row_travels_once_for_each_block(spark):
    def run(left, right):
        yield pa.RecordBatch.from_arrays([pa.array([left.num_rows + (right.num_rows if right else 0)])], ["n"])

    dealt = [r["n"] for r in tiles.tiled(spark.range(20_000).withColumnRenamed("id", "key"), [], F.lit(8), run, "n long").collect()]
    assert len(dealt) == tiles.GRID * (tiles.GRID + 1) // 2 and sum(dealt) == 20_000 * tiles.GRID  # blocks of 256 would give 79 times the rows
    small = tiles.tiled(spark.range(100).withColumnRenamed("id", "key"), [], F.lit(tiles.BLOCK_BYTES), run, "n long")
    assert len(small.collect()) > tiles.GRID * (tiles.GRID + 1) // 2  # but no block is too large


def test_density_clusters_in_tiles(points):
    df, p, _ = points
    assert {(r["key"], r["cluster"]) for r in clustering.vector_hdbscan(df, "key", "v", 4, block=20).collect()} == {(r["key"], r["cluster"]) for r in clustering.hdbscan(p, 4).collect()}


def test_cores_and_reachability_in_tiles(points):
    df, p, _ = points
    cores = clustering.core_distances(p, 5)
    same(clustering.vector_core_distances(df, "key", "v", 5, block=20), cores, "key")
    same(clustering.vector_reachability(df, "key", "v", cores, block=20), clustering.mutual_reachability(p, cores), "i", "j")


def test_pairs_in_tiles(points):
    df, p, labels = points
    same(sequences.vector_pairs(df, "key", "v", 20), p, "i", "j")
    gone = labels.where("cluster = 1").limit(5)
    same(sequences.guarded_vectors(df, "key", "v", gone, labels, 20), sequences.guarded(p, sequences.former_mates(gone, labels)), "i", "j")


def test_missing_pairs_in_tiles(points):
    df, p, _ = points

    def cached(i, j):
        there = np.array([int(a[1:]) % 3 == 0 and int(b[1:]) % 2 == 0 for a, b in zip(i, j, strict=True)], bool)
        return j[there], i[there]

    known = p.where("substr(i, 2) % 3 = 0 and substr(j, 2) % 2 = 0").select(F.col("j").alias("i"), F.col("i").alias("j"))
    want = sequences.missing_pairs(p.select("i", "j"), known)
    assert sorted(map(tuple, sequences.missing_of_all(df, "key", cached, 20).collect())) == sorted(map(tuple, want.collect()))


def test_silhouettes_and_neighbours_in_tiles(points):
    df, p, labels = points
    same(cohesion.vector_silhouettes(df, "key", "v", labels, 20).drop("cluster"), cohesion.silhouettes(p, labels).drop("cluster"), "key")
    noise = labels.withColumn("cluster", F.when(F.col("cluster") == 2, -1).otherwise(F.col("cluster")))
    same(cohesion.vector_neighbours(df, "key", "v", noise, 5, 20).drop("rank"), cohesion.neighbours(p, noise).drop("rank"), "cluster", "other")


def test_best_pairs_of_tiles(points):
    df, p, _ = points
    own, size = sequences.vectors(df, "key", "v")
    got = tiles.best_pairs(own, ["vector"], size, lambda a, b: ((d := tiles.distances(a, b)) > 1, [tiles.rounded(-d, 6)]), ["s"], 7, "vector", 20).orderBy(F.desc("s"), "i", "j").limit(7)
    want = p.where("dist > 1").select("i", "j", F.round(-F.col("dist"), 6).alias("s")).orderBy(F.desc("s"), "i", "j").limit(7)
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]


def test_sparse_cosines_in_tiles(spark, monkeypatch):
    rng = np.random.RandomState(4)
    rows = [(i, f"n{k}", float(w)) for i in range(40) for k, w in zip(rng.choice(30, 3, replace=False), rng.randn(3), strict=True)]
    want: dict = {}
    for i, n, x in rows:
        for j, m, y in rows:
            if i < j and n == m:
                want[i, j] = want.get((i, j), 0) + x * y
    e = spark.createDataFrame(rows, "key int, node string, w double")
    for nodes in (1024, 4):
        monkeypatch.setattr(sequences, "NODES", nodes)
        got = {(r["i"], r["j"]): r["cosine"] for r in sequences.sparse_cosine_pairs(e, "key", "node", "w", 10).collect()}
        assert got == pytest.approx({k: max(-1, min(1, x)) for k, x in want.items()})


def test_nearest_trace_is_that_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(sequences, "MEMBERS", 3)
    rng = np.random.RandomState(5)
    rows = [(f"u{i:02}", [str(t) for t in rng.choice(["a", "b", "Eval Call", "c|weak_host=x"], rng.randint(0, 4))]) for i in range(60)]
    df = spark.createDataFrame(rows, "key string, seq array<string>")
    p = sequences.dtw_pairs(df, "key", "seq", block=4)
    assert p.count() == 60 * 59 // 2
    assert {tuple(r) for r in sequences.dtw_nearest(df, "key", "seq", block=4).collect()} == {tuple(r) for r in sequences.nearest(p).collect()}
    near = sequences.dtw_pairs(df, "key", "seq", block=4, within=(0.3, 0.6))
    assert sorted(map(tuple, near.collect())) == sorted(map(tuple, p.where("1 / (1 + dist) between 0.3 and 0.6").collect()))


def test_long_traces_are_used_whole(spark):
    n = 2100
    rows = [(1, k, "ab"[k % 2], "A") for k in range(n)] + [(2, k, "ab"[k % 2] if k < 2000 else "c", "A") for k in range(2001)]
    own = traces.trace_rows(spark.createDataFrame(rows, "k int, ts int, token string, capability string"), "k", ["ts"])
    assert {r["k"]: len(r["compressed_event_sequence"]) for r in own.collect()} == {1: n, 2: 2001}
    assert sequences.dtw_pairs(own, "k", "compressed_event_sequence").first()["dist"] == 51.0  # the last b to 50 times a, then c; 0 by the first 2000
