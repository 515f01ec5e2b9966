"""Shortest-pack-first histogram packing (operator 9).

A document's ids and its end id are cut into full sequences and a remainder; only remainders are
packed. Their lengths make a histogram of at most ``SEQUENCE`` - 1 counts, the only thing that
comes to the driver. Lengths are placed longest first, each into the shortest pack that has room
(Krell et al., "Efficient Sequence Packing without Cross-contamination", 2021), all packs of one
pattern at a time, so that the number of patterns is bounded by the lengths and not by the
documents. Where packs leave ``LEAST`` ids or more open, the emptiest of them are taken apart and
their pieces, end to end, are cut to fill the others: see ``dissolved``. Documents find their place
by rank: the pieces of one length are numbered without gaps, in groups of about
``GROUP`` (or more, where a length would have over ``GROUPS`` of them) so that a frequent length is
no single task, and the number's place in the list of
patterns gives sequence and offset.

Sequences of a power of two ids need no padding.

Defined results: null and empty texts have the end id alone; repeated rows are packed each, and are
told apart by a number that they are written with; other columns are not read; an
empty table gives no pieces. Rows with a null doc_id are packed as others are.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textops as X
from .encode import ENCODE_BYTES, KEEP, encoder
from .storage import kept, spread

SEQUENCE, END, GROUP, GROUPS = 2048, 1, 2000, 10_000
#: room in a pack that is filled by cutting; less than this is under 1 % of a sequence
LEAST = 20


@dataclass
class Pattern:
    """``n`` packs that hold pieces of these lengths, in this order."""

    n: int
    lengths: list[tuple[int, int]] = field(default_factory=list)  # (length, how many), longest first

    @property
    def used(self) -> int:
        return sum(a * b for a, b in self.lengths)

    def plus(self, n: int, length: int, times: int) -> Pattern:
        last, before = self.lengths[-1] if self.lengths else (0, 0), self.lengths[:-1]
        return Pattern(n, [*before, (length, last[1] + times)] if last[0] == length else [*self.lengths, (length, times)])


def patterns(histogram: dict[int, int], size: int = SEQUENCE) -> list[Pattern]:
    """Packs of at most ``size`` for all pieces of the histogram, fullest first."""
    packs: list[tuple[int, int, Pattern]] = []  # a heap: the shortest is on top
    order = 0

    def put(p: Pattern) -> None:
        nonlocal order
        order += 1
        heapq.heappush(packs, (p.used, order, p))

    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            if packs and packs[0][0] + length <= size:
                p = heapq.heappop(packs)[2]
                take = min(p.n, n)
                put(p.plus(take, length, 1))
                if take < p.n:
                    put(Pattern(p.n - take, p.lengths))
                n -= take
            else:  # a new pack takes this length as often as it can before the next is opened
                times = min(size // length, n)
                put(Pattern(n // times, [(length, times)]))
                n -= n // times * times
    return [p for _, _, p in sorted(packs, key=lambda x: (-x[0], x[1]))]


def dissolved(found: list[Pattern], size: int = SEQUENCE) -> tuple[list[Pattern], list[Pattern]]:
    """(packs that stay, packs taken apart): the most of the emptiest packs whose pieces fit in what the others leave open."""
    stay = [p for p in found if size - p.used < LEAST]
    loose = sorted((p for p in found if size - p.used >= LEAST), key=lambda p: -p.used)
    room, ids, apart = sum((size - p.used) * p.n for p in loose), 0, []
    while loose:
        p = loose.pop()
        n = min(p.n, (room - ids) // size)  # a pack taken apart loses its own room and needs its ids elsewhere
        if n:
            apart.append(Pattern(n, p.lengths))
            room, ids = room - n * (size - p.used), ids + n * p.used
        if n < p.n:
            stay += [*loose, Pattern(p.n - n, p.lengths)]
            break
    return stay, apart


def padding(used: int, size: int = SEQUENCE) -> int:
    return 0 if used & (used - 1) == 0 else size - used


def _pieces(path: str, size: int, keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, at_all = encoder(path, keep), TaskContext.get().partitionId() << 40
        for batch in batches:
            for at, part in X.slices(batch.column("text"), ENCODE_BYTES):
                rows: list[list] = [[], [], [], [], [], []]
                for row, ids in enumerate(enc.encode(part)):
                    all_ids = np.append(ids, END).astype("<u4")
                    for start in range(0, len(all_ids), size):
                        piece = all_ids[start : start + size]
                        narrow = None if len(piece) == size else piece.astype("<u2" if piece.max() < 65536 else "<u4").tobytes()
                        for c, v in zip(rows, (row, start, len(piece), zlib.crc32(piece.tobytes()), len(all_ids), narrow), strict=True):
                            c.append(v)
                own = batch.column("doc_id").slice(at, len(part)).take(pa.array(rows[0], pa.int64()))
                numbers = pa.array(np.arange(at_all, at_all + len(own)), pa.int64())
                at_all += len(own)
                yield pa.RecordBatch.from_arrays([own, *(pa.array(c, pa.int64()) for c in rows[1:-1]), pa.array(rows[-1], pa.binary()), numbers], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "piece"])

    return run


def _slots(found: list[Pattern], apart: list[Pattern] = (), size: int = SEQUENCE) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """Where pieces go, by length and rank: rows (first rank, pieces in a pack, first sequence, first offset), or, of packs taken apart, (first rank, 0, 0, first place in the order of cut ids); and the room for those, rows (first place, ids in a pack, first sequence, first offset)."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    room: list[tuple[int, int, int, int]] = []
    sequence = place = 0
    for p in found:
        offset = 0
        for length, times in p.lengths:
            out.setdefault(length, []).append((ranks.get(length, 0), times, sequence, offset))
            ranks[length] = ranks.get(length, 0) + p.n * times
            offset += length * times
        if apart and size - offset >= LEAST:
            room.append((place, size - offset, sequence, offset))
            place += p.n * (size - offset)
        sequence += p.n
    place = 0
    for p in apart:
        for length, times in p.lengths:
            out.setdefault(length, []).append((ranks.get(length, 0), 0, 0, place))
            ranks[length] = ranks.get(length, 0) + p.n * times
            place += p.n * times * length
    return {k: np.array(v, np.int64) for k, v in out.items()}, np.array(room, np.int64).reshape(-1, 4)


def _parts(place: int, length: int, room: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(start in the piece, length, sequence, offset) of each part of a piece of a pack taken apart."""
    at = 0
    while at < length:
        first, ids, sequence, offset = room[np.searchsorted(room[:, 0], place + at, "right") - 1].tolist()
        pack, within = divmod(place + at - first, ids)
        n = min(length - at, ids - within)
        yield at, n, sequence + pack, offset + within
        at += n


def _placed(slots: dict[int, np.ndarray], room: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset, whole = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64), np.ones(len(rank), bool)
            for x in np.unique(length).tolist():
                at, s = np.flatnonzero(length == x), slots[x]
                own = s[np.searchsorted(s[:, 0], rank[at], "right") - 1]
                beyond, times = rank[at] - own[:, 0], np.maximum(own[:, 1], 1)
                whole[at] = own[:, 1] > 0
                sequence[at], offset[at] = own[:, 2] + beyond // times, own[:, 3] + np.where(own[:, 1] > 0, beyond % times, beyond) * x
            names = [c for c in batch.schema.names if c not in ("rank", "ids")]
            rows = pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])
            yield rows.filter(pa.array(whole))
            cut: list[tuple[int, int, int, int, int, int]] = []
            for i in np.flatnonzero(~whole).tolist():
                raw, n = batch.column("ids")[i].as_py(), int(length[i])
                ids = np.frombuffer(raw, f"<u{len(raw) // n}").astype("<u4")
                cut += [(i, a, k, zlib.crc32(ids[a : a + k].tobytes()), q, o) for a, k, q, o in _parts(int(offset[i]), n, room)]
            if cut:
                i, start, k, crc, q, o = (np.array(c, np.int64) for c in zip(*cut, strict=True))
                own = rows.take(pa.array(i))
                new = {"start": own.column("start").to_numpy() + start, "length": k, "ids_crc32": crc, "sequence_id": q, "offset": o}
                yield pa.RecordBatch.from_arrays([pa.array(new[c]) if c in new else own.column(c) for c in own.schema.names], own.schema.names)

    return run


def ranked(pieces: DataFrame, histogram: dict[int, int], group: int = GROUP) -> DataFrame:
    """Adds ``rank``: the pieces of each length numbered from 0, without gaps, through groups of about ``group`` pieces of one length. ``piece`` tells equal rows apart."""
    parts = F.create_map(*(F.lit(x) for k, n in histogram.items() for x in (k, min(GROUPS, -(-n // group))))) if histogram else F.create_map()
    own = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "piece"), F.coalesce(F.try_element_at(parts, F.col("length").cast("int")), F.lit(1)).cast("long")))
    sizes = own.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32", "piece")
    return own.withColumn("within", F.row_number().over(within) - 1).join(sizes, ["length", "part"]).withColumn("rank", (F.col("before") + F.col("within")).cast("long")).drop("part", "before", "within")


def packed(docs: DataFrame, path: str, size: int = SEQUENCE, keep: int = KEEP) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A Python worker keeps the ids of ``keep`` words."""
    columns = "doc_id {}, start long, length long, ids_crc32 long, doc_tokens long".format(docs.schema["doc_id"].dataType.simpleString())
    pieces = kept(docs.sparkSession, spread(docs.select("doc_id", "text")).mapInArrow(_pieces(path, size, keep), columns + ", ids binary, piece long"), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``size`` rows
    stay, apart = dissolved(patterns(histogram, size), size)
    slots, room = _slots(stay, apart, size)
    cut = sorted({length for p in apart for length, _ in p.lengths})
    pieces = pieces.withColumn("ids", F.when(F.col("length").isin(*cut), F.col("ids")) if cut else F.lit(None).cast("binary"))  # only lengths that are cut carry ids
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    return ranked(pieces, histogram).select(*out, "ids", "rank").mapInArrow(_placed(slots, room), columns + ", sequence_id long, offset long")
