"""Token counts by dynamic programming shared through a trie (operator 10).

A pre-token is a word with the mark of a word's start before it. Its tokens are the segmentation
into pieces of the least total cost under a unigram model, and of the fewest tokens among those.
Costs are whole numbers made from the pieces' ranks in a public vocabulary by Zipf's law; letters
that no piece covers cost ``UNKNOWN`` for each of their bytes, each a token.

1. Every task gives the distinct pre-tokens of its slices with their counts, which are added up.
2. Pre-tokens are dealt out by ranges of their letters and sorted, and each range goes into tries of
   ``TRIE`` pre-tokens. A node holds the forward score of its prefix, worked out once however many
   pre-tokens share it; terminals hold the tokens of their pre-token. The result is a written table.
3. The counts of the ``COMMON`` most frequent pre-tokens are broadcast, and texts are read again.
   A document's other pre-tokens leave with its row's number, are joined to the table, added up for
   each row and joined back. No pre-token is left out, and texts are never shuffled.

Defined results: null and empty texts have no tokens; repeated rows and rows without a doc_id are
counted each; a pre-token may be as long as a text; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as X
from .encode import ENCODE_BYTES
from .storage import kept, ranges, spread

MARK, UNKNOWN = "▁", 20_000
#: pre-tokens of one trie, and pre-tokens whose counts are broadcast: a bound, not a cut, as others are joined
TRIE, COMMON = 20_000, 200_000
_AS_SPACE = np.arange(256, dtype=np.uint8)
_AS_SPACE[0x09:0x0E] = 0x20


def piece_costs(path: str) -> dict[str, int]:
    """Costs of the normal pieces of a sentencepiece vocabulary, from their ranks."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    normal = [i for i in range(p.vocab_size()) if not (p.IsByte(i) or p.IsControl(i) or p.IsUnknown(i) or p.IsUnused(i))]
    return {p.IdToPiece(i): round(1000 * math.log(rank + 2)) for rank, i in enumerate(normal)}


class Trie:
    """Pre-tokens by their letters. Node 0 is the empty prefix; every node has its children, forward cost and tokens."""

    def __init__(self, costs: dict[str, int]):
        self.costs = costs
        ends: dict[str, set[int]] = {}
        for p in costs:
            ends.setdefault(p[-1], set()).add(len(p))
        #: by last letter, the lengths of pieces that end with it
        self.ends = {c: sorted(x) for c, x in ends.items()}
        self.clear()

    def clear(self) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.cost, self.tokens = [0], [0]
        self.terminals: dict[str, int] = {}

    def insert(self, word: str) -> int:
        """Tokens of the word: only the letters that no word before it had in this place are worked out."""
        s = MARK + word
        children, cost, tokens, pieces, ends, none = self.children, self.cost, self.tokens, self.costs, self.ends, ()
        at, path = 0, [0]
        for i, letter in enumerate(s, 1):
            node = children[at].get(letter)
            if node is None:
                size = len(letter.encode(errors="replace"))
                best, n = cost[at] + UNKNOWN * size, tokens[at] + size
                for k in ends.get(letter, none):
                    if k > i:
                        break
                    c = pieces.get(s[i - k : i])
                    if c is not None:
                        before = path[i - k]
                        c += cost[before]
                        if c < best or c == best and tokens[before] < n - 1:
                            best, n = c, tokens[before] + 1
                node = children[at][letter] = len(cost)
                children.append({})
                cost.append(best)
                tokens.append(n)
            at = node
            path.append(at)
        self.terminals[word] = tokens[at]
        return tokens[at]


def _split(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of a column from slices(), "" among them; the word of each place; and the first place of each text, with the end."""
    data, off = X.raw(column)
    spaced = pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(off), pa.py_buffer(_AS_SPACE[data].tobytes()))
    split = pc.split_pattern(spaced, " ")
    coded = split.flatten().dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), split.offsets.to_numpy()


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, part in X.slices(batch.column("text"), ENCODE_BYTES):
            words, code, _ = _split(part)
            n = np.bincount(code, minlength=len(words)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([words.cast(pa.string()), pa.array(n)], ["word", "n"]).filter(pc.not_equal(words, ""))


def _counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(piece_costs(path))
        for batch in batches:
            out = []
            for word in batch.column("word").to_pylist():
                out.append(trie.insert(word))
                if len(trie.terminals) >= TRIE:
                    trie.clear()
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(out, pa.int64())], ["word", "n", "tokens"])

    return run


def vocabulary(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """word, n, tokens of each distinct pre-token of all texts; written once."""
    spark = docs.sparkSession
    words = kept(spark, docs.select(F.col(text).alias("text")).mapInArrow(_distinct, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "pretokens")
    parts = ranges(words, "octet_length(word) + 16")
    return kept(spark, words.repartitionByRange(parts, "word").sortWithinPartitions("word").mapInArrow(_counted(path), "word string, n long, tokens long"), "terminals")


def frequent(words: DataFrame, most: int) -> DataFrame:
    """The most frequent pre-tokens, ``most`` at most: those of the highest classes of counts, of which there are at most 512."""
    owned = words.withColumn("c", F.floor(8 * F.log2("n")).cast("int"))
    taken, least = 0, None
    for r in sorted(owned.groupBy("c").agg(F.count("*").alias("size")).collect(), key=lambda r: -r["c"]):
        taken += r["size"]
        if taken > most:
            break
        least = r["c"]
    return owned.where(F.col("c") >= least if least is not None else F.lit(False)).drop("c")


class _Common:
    """Tokens of the most frequent pre-tokens, as sent to every worker."""

    def __init__(self, words: list[str], tokens: list[int]):
        self.words, self.tokens = words, tokens
        self.of: dict[str, int] | None = None

    def find(self, words: list[str]) -> np.ndarray:
        if self.of is None:
            self.of = dict(zip(self.words, self.tokens, strict=True)) | {"": 0}
        return np.array([self.of.get(w, -1) for w in words], np.int64)


_REST = pa.list_(pa.struct([("word", pa.string()), ("times", pa.int64())]))


def _known(sent: Broadcast):
    """For each row a number of its own, its pre-tokens, the tokens of common ones, and the others with how often they stand there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, row = sent.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            for at, part in X.slices(batch.column("text"), ENCODE_BYTES):
                words, code, ptr = _split(part)
                said = words.to_pylist()
                tokens, full = common.find(said), np.array([bool(w) for w in said], np.int64)
                rest: list[dict[str, int]] = [{} for _ in range(len(part))]
                new = np.flatnonzero(tokens[code] < 0) if len(said) else code
                for d, c in zip((np.searchsorted(ptr, new, "right") - 1).tolist(), code[new].tolist(), strict=True):
                    rest[d][said[c]] = rest[d].get(said[c], 0) + 1
                cols = [
                    batch.column("doc_id").slice(at, len(part)), pa.array(np.arange(row, row + len(part)), pa.int64()),
                    pa.array(X.per_doc(full[code], ptr), pa.int64()), pa.array(X.per_doc(np.maximum(tokens, 0)[code], ptr), pa.int64()),
                    pa.array([[{"word": w, "times": n} for w, n in r.items()] for r in rest], _REST),
                ]
                row += len(part)
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "row", "n_pretokens", "known", "rest"])

    return run


def counted(docs: DataFrame, path: str, common: int = COMMON) -> DataFrame:
    """doc_id, n_pretokens, n_tokens of each document."""
    spark = docs.sparkSession
    docs = spread(docs.select("doc_id", "text"))
    words = vocabulary(docs, path)
    most = frequent(words, common).toArrow()
    sent = spark.sparkContext.broadcast(_Common(most.column("word").to_pylist(), most.column("tokens").to_pylist()))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = kept(spark, docs.mapInArrow(_known(sent), f"doc_id {kind}, row long, n_pretokens long, known long, rest array<struct<word:string,times:bigint>>"), "known")
    others = rows.select("row", F.explode("rest").alias("r")).select("row", "r.word", "r.times").join(words.select("word", "tokens"), "word")
    others = others.groupBy("row").agg(F.sum(F.col("times") * F.col("tokens")).alias("others"))
    return rows.drop("rest").join(others, "row", "left").select("doc_id", "n_pretokens", (F.col("known") + F.coalesce("others", F.lit(0))).cast("long").alias("n_tokens"))
