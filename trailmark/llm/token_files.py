"""Token ids in a compact binary format (operator 2).

Ids are Huffman coded with one canonical code for the whole corpus, made from global counts with
no code longer than ``LONGEST`` bits (package-merge), so that a decoder's table of 2**``LONGEST``
entries gives a symbol and its length for any position. A file folder holds

* ``code``: id, length, the only table that a decoder needs;
* ``blocks``, one folder for each range of doc_ids, in ascending order: a row for each independent
  block with ``start`` (ids of all blocks before), ``doc_ids`` and ``n_tokens`` of its documents,
  ``bits`` (big-endian bit stream) and ``checkpoints`` (bit offset of every ``STEP``-th id, as
  little-endian unsigned 32-bit numbers, each from the one before).

Decoding starts at all checkpoints of a block at once and takes one id from each at every step.

Writing sorts texts by doc_id once, in ranges as many as their bytes ask for, encodes them, counts ids as it goes, and
codes the ids in a second pass over what it has stored. Only id counts (at most 65,536) and the
number of ids of each range come to the driver.

Defined results: null and empty texts have the end id alone; documents that share a doc_id follow
one another in order of a hash of their texts, by which many of them are dealt out as well; rows with a null doc_id come first; an empty table gives no
blocks, and reading it gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as X
from .encode import encoder
from .storage import folder, kept, ranges

LONGEST, STEP, END = 16, 256, 0
KEEP, SLICE = 800_000, 4 << 20  # words whose ids a worker keeps, and bytes of text that it encodes at once
AT_ONCE = 256 * STEP  # ids that are coded at once
FILE_BYTES = 64 << 20  # of a table's files, compressed as they are, for a range
_U = np.uint64


def code_lengths(counts: dict[int, int], longest: int = LONGEST) -> dict[int, int]:
    """Lengths of an optimal prefix code without codes longer than ``longest`` (Larmore and Hirschberg, 1990)."""
    symbols = sorted(counts, key=lambda s: (counts[s], s))
    n = len(symbols)
    if n > 1 << longest:
        raise ValueError("more symbols than codes")
    if n < 2:
        return dict.fromkeys(symbols, 1)
    leaf = np.array([counts[s] for s in symbols], np.int64)
    packages, is_leaf = np.zeros(0, np.int64), []
    for _ in range(longest):
        both = np.concatenate((leaf, packages))
        order = np.argsort(both, kind="stable")
        is_leaf.append(order < n)
        both = both[order]
        packages = both[: len(both) // 2 * 2].reshape(-1, 2).sum(1)
    out, take = np.zeros(n, np.int64), 2 * n - 2
    for flags in reversed(is_leaf):
        leaves = int(flags[:take].sum())
        out[:leaves] += 1
        take = 2 * (take - leaves)
    return dict(zip(symbols, out.tolist(), strict=True))


class Code:
    """The canonical code of given lengths: codes ascend with length and then id."""

    def __init__(self, lengths: dict[int, int]):
        ids, n = (np.fromiter(x, np.int64, len(lengths)) for x in (lengths.keys(), lengths.values()))
        order = np.lexsort((ids, n))
        ids, n = ids[order], n[order]
        span = 1 << (LONGEST - n)  # entries of the decoder's table that begin with the code
        end = np.cumsum(span)
        self.lengths, self.codes = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, _U)
        self.lengths[ids], self.codes[ids] = n, (end - span) >> (LONGEST - n)
        self.symbol, self.size = np.zeros(1 << LONGEST, np.uint16), np.ones(1 << LONGEST, np.uint8)
        self.symbol[: span.sum()], self.size[: span.sum()] = np.repeat(ids, span), np.repeat(n, span)

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """Bits and checkpoints."""
        if not len(ids):
            return b"", b""
        words = np.zeros((int(self.lengths[ids].sum(dtype=np.int64)) >> 6) + 2, _U)
        marks, bit = [], 0
        for at in range(0, len(ids), AT_ONCE):
            part = ids[at : at + AT_ONCE]
            n, c = self.lengths[part].astype(np.int64), self.codes[part]
            end = np.cumsum(n) + bit
            start = end - n
            bit = int(end[-1])
            word, over = start >> 6, (start & 63) + n - 64  # bits of the code that reach into the next word
            inside = np.where(over > 0, c >> np.maximum(over, 0).astype(_U), c << np.maximum(-over, 0).astype(_U))
            first = np.flatnonzero(np.diff(word, prepend=-1))
            words[word[first]] |= np.bitwise_or.reduceat(inside, first)
            split = np.flatnonzero(over > 0)
            words[word[split] + 1] |= c[split] << (64 - over[split]).astype(_U)
            marks.append(start[::STEP])
        return words.astype(">u8").tobytes()[: (bit + 7) // 8], np.diff(np.concatenate(marks), prepend=0).astype("<u4").tobytes()

    def decode(self, bits: bytes, checkpoints: bytes, n: int) -> np.ndarray:
        """The n ids of a block."""
        at = np.cumsum(np.frombuffer(checkpoints, "<u4").astype(np.int64))
        data = np.frombuffer(bits + bytes(8), np.uint8).astype(np.uint32)
        ahead = (data[:-3] << 16) | (data[1:-2] << 8) | data[2:-1]  # the three bytes from each byte on
        out = np.zeros((len(at), STEP), np.uint16)
        last = len(ahead) - 1
        for k in range(STEP):
            if k == n - (len(at) - 1) * STEP and len(at):  # the last run is shorter
                at = at[:-1]
            if not len(at):
                break
            window = (ahead[np.minimum(at >> 3, last)] >> (8 - (at & 7)).astype(np.uint32)) & 0xFFFF
            out[: len(at), k] = self.symbol[window]
            at = at + self.size[window]
        return out.reshape(-1)[:n]


_STORED = "part int, seg int, before long, doc_ids array<{}>, n_tokens array<long>, ids binary, counts binary"


def _stored(path: str, end: int):
    """Rows of a few MB of text: ids and where they stand in the partition; a last row has the partition's counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seg, before = encoder(path, KEEP), TaskContext.get().partitionId(), 0, 0
        counts, pack = np.zeros(1 << 16, np.int64), zstandard.ZstdCompressor(1)
        kind = None

        def row(doc_ids: pa.Array, n: list[int], ids: bytes | None, counts: bytes | None) -> pa.RecordBatch:
            ids_list = pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), doc_ids)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seg], pa.int32()), pa.array([before], pa.int64()), ids_list, pa.array([n], pa.list_(pa.int64())), pa.array([ids], pa.binary()), pa.array([counts], pa.binary())], names)

        names = ["part", "seg", "before", "doc_ids", "n_tokens", "ids", "counts"]
        for batch in batches:
            kind = batch.column("doc_id").type
            for at, texts in X.slices(batch.column("text"), SLICE):
                own = [np.append(x, np.uint16(end)) for x in enc.encode(texts)]
                flat = np.concatenate(own)
                counts += np.bincount(flat, minlength=1 << 16)
                yield row(batch.column("doc_id").slice(at, len(texts)), [len(x) for x in own], pack.compress(flat.astype("<u2").tobytes()), None)
                seg, before = seg + 1, before + len(flat)
        if kind is not None:
            yield row(pa.array([], kind), [], None, pack.compress(counts.astype("<i8").tobytes()))

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for x in batch.column("counts").to_pylist():
            total += np.frombuffer(zstandard.decompress(x), "<i8")
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["id", "n"])


def _coded(code_of: dict[int, int], base: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(code_of)
        for batch in batches:
            start = [base[p] + b for p, b in zip(batch.column("part").to_pylist(), batch.column("before").to_pylist(), strict=True)]
            coded = [code.encode(np.frombuffer(zstandard.decompress(x), "<u2")) for x in batch.column("ids").to_pylist()]
            cols = [batch.column("part"), batch.column("seg"), pa.array(start, pa.int64()), batch.column("doc_ids"), batch.column("n_tokens"), *(pa.array([c[i] for c in coded], pa.binary()) for i in range(2))]
            yield pa.RecordBatch.from_arrays(cols, ["part", "seg", "start", "doc_ids", "n_tokens", "bits", "checkpoints"])

    return run


def write(docs: DataFrame, path: str, vocabulary: str, end: int = END) -> None:
    """Encodes all texts, each followed by the end id, and writes them in ascending order of doc_id."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("h"))
    own = own.repartitionByRange(ranges(docs, "octet_length(text)", FILE_BYTES, planned=True), "doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h")
    stored = kept(spark, own.mapInArrow(_stored(vocabulary, end), _STORED.format(kind)), "token-ids")
    counts = stored.where("counts is not null").select("counts").mapInArrow(_summed, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    code = code_lengths({r["id"]: r["n"] for r in counts.collect()})  # at most 65,536 rows
    base, total = {}, 0
    for r in stored.where("counts is not null").select("part", "before").orderBy("part").collect():  # a row for each range
        base[r["part"]], total = total, total + r["before"]
    spark.createDataFrame(sorted(code.items()), "id int, length int").coalesce(1).write.parquet(f"{path}/code")
    blocks = stored.where("counts is null").mapInArrow(_coded(code, base), f"part int, seg int, start long, doc_ids array<{kind}>, n_tokens array<long>, bits binary, checkpoints binary")
    blocks.sortWithinPartitions("part", "seg").write.partitionBy("part").parquet(f"{path}/blocks")


def _decoded(code_of: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(code_of)
        for batch in batches:
            for i in range(len(batch)):
                n = batch.column("n_tokens")[i].values.to_numpy()
                ids = code.decode(batch.column("bits")[i].as_py(), batch.column("checkpoints")[i].as_py(), int(n.sum()))
                doc_ids, until = batch.column("doc_ids")[i].values, np.cumsum(n)
                yield pa.RecordBatch.from_arrays(
                    [doc_ids, pa.array(batch.column("start")[i].as_py() + until - n, pa.int64()), pa.array(n, pa.int64()), pa.LargeListArray.from_arrays(np.concatenate(([0], until)), pa.array(ids.astype(np.int32))).cast(pa.list_(pa.int32()))],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    return run


def _blocks(spark: SparkSession, path: str) -> tuple[DataFrame, dict[int, int], str]:
    code = {r["id"]: r["length"] for r in spark.read.parquet(f"{path}/code").collect()}
    blocks = spark.read.parquet(f"{path}/blocks") if code else spark.createDataFrame([], "part int, seg int, start long, doc_ids array<long>, n_tokens array<long>, bits binary, checkpoints binary")
    return blocks, code, blocks.schema["doc_ids"].dataType.elementType.simpleString()


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids of each document."""
    blocks, code, kind = _blocks(spark, path)
    return blocks.mapInArrow(_decoded(code), f"doc_id {kind}, start long, n_tokens long, ids array<int>")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from its decoded ids."""
    blocks, code, kind = _blocks(spark, path)
    decode = _decoded(code)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in decode(batches):
            crc = [zlib.crc32(x.values.to_numpy().astype("<u4").tobytes()) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def report(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Writes the documents to the shared folder and reads them back: doc_id, start, n_tokens, ids_crc32."""
    import uuid

    spark = docs.sparkSession
    path = f"{folder(spark)}/token-files-{uuid.uuid4().hex}"
    write(docs, path, vocabulary)
    return digests(spark, path)
