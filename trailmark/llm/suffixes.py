"""Repeated passages by sparse suffix arrays (operator 7).

Passages of ``PASSAGE`` words or more that occur more than once, in one document or several.

1. Suffixes are kept only at minimiser positions: those whose ``GRAM`` words have the least hash of
   some window of ``PASSAGE`` words. Equal passages keep the same positions.
2. Suffixes whose first words occur once in the corpus are left out, by counts per hash.
3. The others are sorted by their first words and compared with their neighbours of equal first
   words: for every number of words that a match can reach to the left, the ``PASSAGE`` words from
   there on are sorted, equal neighbours mark each other's places, and neighbouring numbers extend
   the mark to the left and right.
4. Where more than ``HOT`` suffixes share a hash, the windows of ``PASSAGE`` words whose least hash
   it is are counted by their own hashes instead, which combines before the shuffle; those that occur
   again are marked. Equal windows have the same least hash, so none of a frequent hash is left out.
5. Marks of a document are merged.

A suffix of step 3 carries the words that a match needs, up to ``PASSAGE`` to the right and the rest of its
window to the left, as hashes of 32 bits; longer matches are marked through their other suffixes.
Words are compared by these hashes: the first ``GRAM`` words by 64 bits together, the others by 31
bits each. Two windows that differ in one word pass for equal with a chance of 2**-31, and only if
all else, their key included, agrees; windows of frequent keys are equal by a 64-bit hash.

Defined results: null, empty and short texts have no passages; repeated rows repeat each other's
passages; rows that share a doc_id share marks; null doc_ids are left out of the search and have no
marks; an empty table gives no rows. doc_id is a whole number; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as X
from .storage import kept, ranges, spread

PASSAGE, GRAM, HOT = 50, 8, 2000
#: rows that are compared at once, but for a single key with more
AT_ONCE = 2000
WINDOW = PASSAGE - GRAM + 1
_LEFT = WINDOW - 1
_BASE = 0x9FB21C651E98DF25
_COLUMNS = ["key", "right", "left", "doc_id", "pos"]


def _slide(x: np.ndarray, n: int, pick: np.ufunc) -> np.ndarray:
    """pick over every n consecutive values."""
    span = 1
    while 2 * span <= n:
        x = pick(x[:-span], x[span:])
        span *= 2
    return pick(x[: len(x) - (n - span)], x[n - span :]) if n > span else x


def _least(g: np.ndarray, w: X.Words) -> np.ndarray:
    """The least of the hashes g in each window of PASSAGE words, 0 in windows across texts."""
    least = _slide(g, WINDOW, np.minimum)
    least[w.doc[: len(least)] != w.doc[PASSAGE - 1 :]] = 0
    return least


def minimisers(w: X.Words) -> tuple[np.ndarray, np.ndarray]:
    """Word positions of the kept suffixes, and hashes of their first words."""
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(w) < PASSAGE:
        return none
    g = X.windows(w.hash, GRAM)
    least = _least(g, w)
    most = _slide(np.concatenate((np.zeros(WINDOW - 1, np.uint64), least, np.zeros(len(g) - len(least), np.uint64))), WINDOW, np.maximum)
    at = np.flatnonzero((most[: len(g)] == g) & (g > 0))
    return at, g[at]


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, part in X.slices(batch.column("text")):
            w = X.words(part, X.SPACE)
            pos, key = minimisers(w)
            ptr = np.searchsorted(pos, w.ptr)
            keys = pa.ListArray.from_arrays(pa.array(ptr, pa.int32()), pa.array(key.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(part)), pa.array(w.counts(), pa.int64()), keys], ["doc_id", "n_words", "keys"])


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes at the keys that repeat, and as hot rows the windows of frequent keys: hash and first word."""
    for batch in batches:
        for at, part in X.slices(batch.column("text")):
            rows = batch.slice(at, len(part))
            w = X.words(part, X.SPACE)
            pos, key = minimisers(w)
            keep = np.zeros(len(pos), bool)
            for d, (a, b) in enumerate(np.stack((np.searchsorted(pos, w.ptr[:-1]), np.searchsorted(pos, w.ptr[1:])), 1).tolist()):
                keep[a:b] = np.isin(key[a:b].view(np.int64), rows.column("keys")[d].values.to_numpy())
            pos, key = pos[keep], key[keep]
            small = (w.hash >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
            first, end = w.ptr[w.doc[pos]], w.ptr[w.doc[pos] + 1]
            sides = []
            for index, ok in ((pos[:, None] + np.arange(PASSAGE), lambda i: i < end[:, None]), (pos[:, None] - 1 - np.arange(_LEFT), lambda i: i >= first[:, None])):
                words = np.where(ok(index), small[np.clip(index, 0, len(small) - 1)], 0) if len(small) else np.zeros(index.shape)
                sides.append(pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * index.shape[1]), len(pos), [None, pa.py_buffer(words.astype(">u4").tobytes())]).cast(pa.binary()))
            yield _rows(rows, w, key, sides, pos, False)
            hot = rows.column("hot_keys").flatten()
            if len(hot):
                pos = np.flatnonzero(np.isin(_least(X.windows(w.hash, GRAM), w), hot.to_numpy().view(np.uint64))) if len(w) >= PASSAGE else np.zeros(0, np.int64)
                yield _rows(rows, w, X.windows(w.hash, PASSAGE)[pos], [pa.nulls(len(pos), pa.binary())] * 2, pos, True)


def _rows(docs: pa.RecordBatch, w: X.Words, key: np.ndarray, sides: list[pa.Array], pos: np.ndarray, hot: bool) -> pa.RecordBatch:
    doc = w.doc[pos]
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *sides, docs.column("doc_id").take(pa.array(doc)), pa.array(pos - w.ptr[doc]), pa.array(np.full(len(pos), hot))], [*_COLUMNS, "hot"])


def _repeated(key: np.ndarray, right: np.ndarray, left: np.ndarray) -> np.ndarray:
    """For each row and number of words to the left, whether another row of the key has the same PASSAGE words from there on."""
    row = np.concatenate((left[:, ::-1], right), axis=1).astype(np.uint64)
    up, down = X.powers(_BASE, row.shape[1] + 1)
    sums = np.zeros((len(row), row.shape[1] + 1), np.uint64)
    np.cumsum(row * up[: row.shape[1]], axis=1, out=sums[:, 1:])
    start = _LEFT - np.arange(WINDOW)
    h = (sums[:, start + PASSAGE] - sums[:, start]) * down[start]
    h = X.mix(X.mix(h + key.view(np.uint64)[:, None]) + np.arange(WINDOW, dtype=np.uint64))
    there = (np.arange(WINDOW) <= (left > 0).sum(1)[:, None]) & (PASSAGE - np.arange(WINDOW) <= (right > 0).sum(1)[:, None])
    at = np.flatnonzero(there.ravel())
    order = at[np.argsort(h.ravel()[at], kind="stable")]
    same = np.diff(h.ravel()[order]) == 0
    out = np.zeros(h.size, bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out.reshape(h.shape)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u4").reshape(-1, width).astype(np.uint32)


def _compared(table: pa.RecordBatch) -> pa.RecordBatch:
    """doc_id, start, end of what the rows of a key repeat of each other."""
    key, right, left = table.column("key").to_numpy(), _matrix(table.column("right"), PASSAGE), _matrix(table.column("left"), _LEFT)
    flags = np.zeros((len(key), WINDOW + 2), np.int8)
    flags[:, 1:-1] = _repeated(key, right, left)
    step = np.diff(flags, axis=1)
    row, least = np.nonzero(step == 1)
    most = np.nonzero(step == -1)[1] - 1
    pos = table.column("pos").to_numpy()[row]
    return pa.RecordBatch.from_arrays([table.column("doc_id").take(pa.array(row)), pa.array(pos - most), pa.array(pos - least + PASSAGE)], ["doc_id", "start", "end"])


def _whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks from rows sorted by key, every key's rows together: the last key of a batch waits for the next."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        key = batch.column("key").to_numpy()
        cut = int(np.searchsorted(key, key[-1], "left"))
        if cut or held and held[-1].column("key")[len(held[-1]) - 1].as_py() != key[0]:
            yield from _by_keys(_joined([*held, batch.slice(0, cut)]))
            held = []
        held.append(batch.slice(cut))
    if held:
        yield from _by_keys(_joined(held))


def _by_keys(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Compares sorted rows, some whole keys at a time."""
    key = rows.column("key").to_numpy()
    ends = np.append(np.flatnonzero(np.diff(key)) + 1, len(key))
    at = 0
    while at < len(key):
        fit = ends[(ends > at) & (ends <= at + AT_ONCE)]
        to = int(fit[-1]) if len(fit) else int(ends[ends > at][0])
        yield _compared(rows.slice(at, to - at))
        at = to


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.concat_arrays([b.column(c) for b in batches]) for c in _COLUMNS], _COLUMNS)


def marks(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_words, keys of every document; doc_id, start, end of places that repeat another)"""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sparse = kept(spark, spread(docs).mapInArrow(_sparse, "doc_id long, n_words long, keys array<long>"), "sparse")
    each = sparse.where("doc_id is not null").select("doc_id", F.explode("keys").alias("key"))
    again = kept(spark, each.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "repeated")
    hot = F.col("n") > HOT
    own = each.join(again, "key").groupBy("doc_id").agg(*(F.collect_set(F.when(some, F.col("key"))).alias(name) for name, some in (("keys", ~hot), ("hot_keys", hot))))
    suffixes = docs.join(own, "doc_id").mapInArrow(_suffixes, "key long, right binary, left binary, doc_id long, pos long, hot boolean")
    rows = kept(spark, suffixes, "suffixes")
    parts = ranges(rows.where("not hot"), f"{4 * (PASSAGE + _LEFT) + 32}L", 32 << 20)
    place = "doc_id long, start long, end long"
    found = rows.where("not hot").select(*_COLUMNS).repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_whole_keys, place)
    if again.where(hot).limit(1).count():
        windows = rows.where("hot").select("key", "doc_id", "pos")
        twice = kept(spark, windows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "twice")  # read again, so that AQE can split the join
        found = found.unionByName(windows.join(twice, "key").select("doc_id", F.col("pos").alias("start"), (F.col("pos") + PASSAGE).alias("end")))
    return sparse, found


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_repeated (words in passages that repeat), spans (start:end, comma-joined; of words, ends exclusive) of each document."""
    sparse, found = marks(docs)
    by_doc = found.distinct().groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("marks"))
    merged = F.expr("""aggregate(marks, cast(array() as array<struct<start:bigint,end:bigint>>), (m, x) ->
        if(size(m) > 0 and x.start <= element_at(m, -1).end,
           concat(slice(m, 1, size(m) - 1), array(named_struct('start', element_at(m, -1).start, 'end', greatest(element_at(m, -1).end, x.end)))),
           concat(m, array(named_struct('start', x.start, 'end', x.end)))))""")
    spans = by_doc.select("doc_id", merged.alias("m"))
    total = F.aggregate(F.transform("m", lambda x: x["end"] - x["start"]), F.lit(0).cast("long"), lambda a, b: a + b)
    said = F.array_join(F.transform("m", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")
    spans = spans.select("doc_id", total.alias("n_repeated"), said.alias("spans"))
    return sparse.select("doc_id", "n_words").join(spans, "doc_id", "left").select("doc_id", "n_words", F.coalesce("n_repeated", F.lit(0).cast("long")).alias("n_repeated"), F.coalesce("spans", F.lit("")).alias("spans"))
