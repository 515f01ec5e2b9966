"""Benchmark decontamination (operator 1).

1. The benchmark's normalised windows of ``WINDOW`` words are written as a table: item, words, hash.
2. Their distinct 64-bit hashes, counted first, are broadcast as sorted arrays of 8 bytes a window.
   A benchmark of more than ``MOST`` windows (32 MB of hashes) is not broadcast: every window of a
   document is then a candidate, and the join of step 4 alone decides. Results are the same.
3. Documents are scanned once. Windows whose hash is in the set are candidates, with their words.
4. Candidates are joined to the benchmark's windows by hash and verified on the words; hits of a
   text are merged to spans, and spans or documents are taken out.

Texts themselves are never shuffled but for those which a fixed-size map of contaminated texts
cannot tell from them.

Defined results: null or empty texts have no words and no hits; items without words have no
window; repeated items count each by its item_id, and null item_ids are left out; repeated and
unnamed documents are each scanned; an empty benchmark hits nothing. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops as X
from .storage import kept, split, spread

WINDOW = 10
MOST = 4_000_000
_CANDIDATES = "array<struct<pos:bigint,k:int,h:bigint,words:string>>"
_CANDIDATE = pa.list_(pa.struct([("pos", pa.int64()), ("k", pa.int32()), ("h", pa.int64()), ("words", pa.string())]))


def _item_windows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in X.slices(batch.column("text")):
                w = X.words(part, X.NOT_ALNUM, lower=True)
                for d, (a, b) in enumerate(zip(w.ptr[:-1].tolist(), w.ptr[1:].tolist(), strict=True)):
                    if b > a:
                        k = min(size, b - a)
                        h = X.windows(w.hash[a:b], k)
                        said = [w.bytes(a + i, k).decode() for i in range(len(h))]
                        cols = [pa.array([batch.column("item")[at + d].as_py()] * len(h), pa.string()), pa.array([k] * len(h), pa.int32()), pa.array(h.view(np.int64)), pa.array(said, pa.string())]
                        yield pa.RecordBatch.from_arrays(cols, ["item", "k", "h", "words"])

    return run


def windows(benchmark: DataFrame, size: int = WINDOW, item: str = "item_id", text: str = "text") -> DataFrame:
    """k, h, words, items: each distinct window of the benchmark, with the items that hold it; written once."""
    own = benchmark.where(F.col(item).isNotNull()).select(F.col(item).cast("string").alias("item"), F.col(text).alias("text"))
    found = own.mapInArrow(_item_windows(size), "item string, k int, h long, words string")
    return kept(benchmark.sparkSession, found.groupBy("k", "h", "words").agg(F.array_sort(F.collect_set("item")).alias("items")), "benchmark")


class Hashes:
    """The benchmark's hashes by length of window, each sorted; or lengths alone, where every window is a candidate."""

    def __init__(self, lengths: dict[int, np.ndarray | None]):
        self.lengths, self.maybe = lengths, {}

    def candidates(self, w: X.Words) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By length, first words and hashes of the windows that may be the benchmark's."""
        out = {}
        for k, known in self.lengths.items():
            own = X.windows(w.hash, k)
            at = np.arange(len(own))
            if known is not None:
                if k not in self.maybe:  # a map of the upper bits tells most windows apart at once
                    bits = min(22, max(12, 6 + len(known).bit_length()))
                    self.maybe[k] = np.uint64(64 - bits), np.zeros(1 << bits, bool)
                    self.maybe[k][1][known >> self.maybe[k][0]] = True
                shift, there = self.maybe[k]
                at = np.flatnonzero(there[own >> shift])
                at = at[known[np.minimum(np.searchsorted(known, own[at]), len(known) - 1)] == own[at]]
            at = at[w.doc[at] == w.doc[at + k - 1]]
            out[k] = at, own[at]
        return out


def hashes(found: DataFrame, most: int = MOST) -> Hashes:
    """From the table of windows()."""
    distinct = found.select("k", "h").distinct()
    if distinct.count() > most:
        return Hashes({r["k"]: None for r in distinct.select("k").distinct().collect()})  # at most WINDOW rows
    t = distinct.toArrow()
    k, h = t.column("k").to_numpy(), t.column("h").to_numpy().view(np.uint64)
    return Hashes({int(x): np.sort(h[k == x]) for x in np.unique(k)})


def _scan(sent: Broadcast, text: str, some: bool):
    """n_words, candidates and a number of its own for each row, in place of its text; only rows with candidates where ``some``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, row = sent.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            keep = [c for c in batch.schema.names if c != text]
            for at, part in X.slices(batch.column(text)):
                w = X.words(part, X.NOT_ALNUM, lower=True)
                found: list[list[dict]] = [[] for _ in range(len(part))]
                for k, (first, h) in known.candidates(w).items():
                    for i, x in zip(first.tolist(), h.view(np.int64).tolist(), strict=True):
                        d = int(w.doc[i])
                        found[d].append({"pos": i - int(w.ptr[d]), "k": k, "h": x, "words": w.bytes(i, k).decode()})
                cols = [pa.array(w.counts(), pa.int64()), pa.array(np.arange(row, row + len(part)), pa.int64()), pa.array(found, _CANDIDATE)]
                row += len(part)
                out = pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, len(part)) for c in keep), *cols], [*keep, "n_words", "row", "candidates"])
                yield out.filter(pa.array([bool(x) for x in found], pa.bool_())) if some else out

    return run


def scanned(docs: DataFrame, found: DataFrame, text: str = "text", most: int = MOST, some: bool = False) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(hashes(found, most))
    fields = [f for f in docs.schema.fields if f.name != text]
    more = [T.StructField("n_words", T.LongType()), T.StructField("row", T.LongType()), T.StructField("candidates", T._parse_datatype_string(_CANDIDATES))]
    return spread(docs).mapInArrow(_scan(sent, text, some), T.StructType([*fields, *more]))


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        runs = [_merged([(x["pos"], x["pos"] + x["k"]) for x in own]) for own in batch.column("hits").to_pylist()]
        items = [sorted({x for own in sets for x in own}) for sets in batch.column("items").to_pylist()]
        cols = [pa.array([[a for a, _ in r] for r in runs], pa.list_(pa.int64())), pa.array([[b for _, b in r] for r in runs], pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays([batch.column("id"), *cols], ["id", "span_starts", "span_ends", "items"])


def verified(candidates: DataFrame, found: DataFrame) -> DataFrame:
    """id, span_starts, span_ends, items of each id with a hit. ``candidates``: id, candidates."""
    one = candidates.select("id", F.explode("candidates").alias("c")).select("id", "c.*")
    hits = one.join(found, ["k", "h", "words"]).groupBy("id").agg(F.collect_list(F.struct("pos", "k")).alias("hits"), F.collect_set("items").alias("items"))
    kind = candidates.schema["id"].dataType.simpleString()
    return hits.mapInArrow(_spans, f"id {kind}, span_starts array<long>, span_ends array<long>, items array<string>")


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: int = MOST) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hit_spans: a row for each document."""
    spark = docs.sparkSession
    found = windows(benchmark, window)
    rows = kept(spark, scanned(docs.select("doc_id", "text"), found, most=most), "scanned")  # narrow: texts stay behind
    hits = verified(rows.where(F.size("candidates") > 0).select(F.col("row").alias("id"), "candidates"), found)
    a, b = (F.coalesce(F.col(c), F.array().cast("array<bigint>")) for c in ("span_starts", "span_ends"))
    items = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    hit = F.aggregate(F.zip_with(b, a, lambda x, y: x - y), F.lit(0).cast("long"), lambda x, y: x + y)
    return rows.drop("candidates").join(hits, F.col("row") == F.col("id"), "left").select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
        F.array_join(F.zip_with(a, b, lambda x, y: F.concat_ws(":", x.cast("string"), y.cast("string"))), ",").alias("hit_spans"),
    )


_KEY = "coalesce({}, '')"


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", most: int = MOST) -> DataFrame:
    """t, span_starts, span_ends, items: each contaminated text, by its SHA-256, once however many documents have it; written once."""
    found = windows(benchmark, window)
    own = docs.select(F.sha2(F.expr(_KEY.format(text)), 256).alias("t"), F.col(text).alias("text"))
    first = scanned(own, found, most=most, some=True).groupBy("t").agg(F.first("candidates").alias("candidates"))  # equal texts have equal candidates
    return kept(docs.sparkSession, verified(first.withColumnRenamed("t", "id"), found).withColumnRenamed("id", "t"), "contaminated")


def _apart(docs: DataFrame, found: DataFrame, text: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """Documents whose texts are not among those found, those whose texts may be (columns c0, c1, ... and t), and the name of the text's."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    own = docs.toDF(*names)
    here = names[docs.columns.index(text)]
    sure, maybe = split(own.withColumn("t", F.sha2(F.expr(_KEY.format(here)), 256)), found.select("t"), "t")
    return sure.select(*names), maybe, names


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """The documents without a hit."""
    found = hits(docs, benchmark, window, text)
    sure, maybe, names = _apart(docs, found, text)
    return sure.unionByName(maybe.join(found.select("t"), "t", "left_anti").select(*names)).toDF(*docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """All documents; from the first to the last letter of each hit span their text is taken out."""
    found = hits(docs, benchmark, window, text)
    sure, maybe, names = _apart(docs, found, text)
    here = names[docs.columns.index(text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, starts, ends, cut = batch.column(here).to_pylist(), batch.column("span_starts").to_pylist(), batch.column("span_ends").to_pylist(), []
            for t, first, last in zip(texts, starts, ends, strict=True):
                if t and first:
                    w, raw = X.words(pa.array([t], pa.large_string()), X.NOT_ALNUM, lower=True), t.encode()
                    keep, at = [], 0
                    for a, b in zip(first, last, strict=True):
                        keep.append(raw[at : int(w.start[a])])
                        at = int(w.end[b - 1])
                    t = b"".join([*keep, raw[at:]]).decode()
                cut.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(cut, pa.string()) if c == here else batch.column(c) for c in names], names)

    joined = maybe.join(found, "t", "left").select(*names, "span_starts", "span_ends")
    changed = joined.mapInArrow(run, T.StructType([f for f in joined.schema.fields if f.name in names]))
    return sure.unionByName(changed).toDF(*docs.columns)
