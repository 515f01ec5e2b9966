"""Near-duplicate documents by HyperMinHash (operator 5).

1. Each text becomes the set of its 5-word shingles (64-bit hashes), and ``K`` registers, each the
   minimum of one hash function over the set, stored as its leading-zero count and ``MANTISSA``
   bits after the leading one: 16 bits. Documents with equal sets are one class from here on.
2. Bands of ``ROWS`` registers are hashed; classes that share a band are a bucket. Of buckets with
   the same members one is kept. A link of 0.85 shares no band with a chance of
   (1 - 0.85**8)**40, 3 in 10**6 (at 0.8: 6 in 10**4); a pair of 0.3 shares one with 3 in 1,000.
3. Within a bucket the registers decide who may be linked: the Jaccard similarity that they estimate,
   corrected for chance collisions of registers, must reach the threshold less ``MARGIN`` standard
   errors. Each member is held against the bucket's first, and members that are not near it against
   the whole bucket, in pairs of blocks. Components of near pairs are families, so that neither
   chance collisions nor shared boilerplate chain families together.
4. The members of families are shingled again. Each full set is compared with that of its family's
   first member, and sets without that link with the whole family, in pairs of blocks.
5. Components of all links give the result.

A pair of blocks sends on the pairs that join components, fewer than its members; no pair of
documents is ever a row. Blocks are bounded by members and by bytes.

Defined results: null, empty or wordless texts have an empty set, link with nothing and are their
own component. Rows with a null doc_id take part in no link: component_id is null, kept is true.
Repeated rows give a row each. Where one doc_id stands with several texts, each row has its own
text's component, and texts that are first of their copies under the same doc_id count as linked.
An empty table gives no rows. doc_id is a whole number; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage
from . import textops as X
from .graph import components
from .storage import kept

SHINGLE, ROWS, BANDS, MANTISSA = 5, 8, 40, 10
K = ROWS * BANDS
#: members and bytes of a block of full sets, and members of a block of registers
BLOCK, BLOCK_BYTES, NEAR_BLOCK = 128, 8 << 20, 512
_MUL = np.random.RandomState(11).randint(0, 1 << 62, K, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
#: an estimate this many standard errors below the threshold rules a pair out
MARGIN = 6


def sets(column: pa.Array) -> list[np.ndarray]:
    """The sorted shingle hashes of each text of a column from slices()."""
    w = X.words(column, X.SPACE, lower=True)
    h = X.windows(w.hash, SHINGLE)
    out = []
    for a, b in zip(w.ptr[:-1].tolist(), w.ptr[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(h[a : b - SHINGLE + 1]))
        else:
            out.append(X.windows(w.hash[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def registers(own: list[np.ndarray]) -> np.ndarray:
    """A row of K registers for each set; those of empty sets are 0."""
    out = np.zeros((len(own), K), np.uint16)
    full = [i for i, s in enumerate(own) if len(s)]
    if full:
        h = np.concatenate([own[i] for i in full])
        ptr = np.cumsum([0, *(len(own[i]) for i in full[:-1])])
        least = np.empty((K, len(full)), np.uint64)
        for k in range(K):
            least[k] = np.minimum.reduceat(h * _MUL[k], ptr)
        v = (least | np.uint64(1)).astype(np.float64).view(np.uint64) >> np.uint64(52 - MANTISSA)  # exponent, then the leading bits
        out[full] = (v - np.uint64(1023 << MANTISSA)).astype(np.uint16).T
    return out


def estimate(equal: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the number of equal registers, less those expected to be equal by chance (Yu and Weber, "HyperMinHash", 2017)."""
    chance = 0.169919487 * 2.0**-MANTISSA * 4 * n * m / (n + m) ** 2
    return (equal / K - chance) / (1 - chance)


def _possible(percent: int) -> float:
    p = percent / 100
    return p - MARGIN * (p * (1 - p) / K) ** 0.5


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, part in X.slices(batch.column("text")):
            own = sets(part)
            regs = registers(own)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(at, len(part)), pa.array([len(s) for s in own], pa.int64()), pa.array([digest(s) for s in own], pa.binary()), pa.array([r.tobytes() for r in regs], pa.binary())],
                ["doc_id", "n_shingles", "digest", "registers"],
            )


def digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of classes, where the text is the class's own."""
    for batch in batches:
        for at, part in X.slices(batch.column("text")):
            rows = batch.slice(at, len(part))
            own = sets(part)
            keep = [digest(s) == d for s, d in zip(own, rows.column("digest").to_pylist(), strict=True)]
            cols = [*(rows.column(c) for c in ("rep", "family", "registers")), pa.array([s.tobytes() for s in own], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["rep", "family", "registers", "content"]).filter(pa.array(keep, pa.bool_()))


def _linked(n: int, m: int, both: int, percent: int) -> bool:
    return 100 * both >= percent * (n + m - both)


def _near_first(percent: int):
    """Adds whether the registers let a member and its bucket's first be linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            regs = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, K) for c in ("registers", "first_registers")]
            n = [batch.column(c).to_numpy().astype(float) for c in ("n", "first_n")]
            near = estimate((regs[0] == regs[1]).sum(1), *n) >= _possible(percent)
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("first"), pa.array(near, pa.bool_())], ["rep", "first", "linked"])

    return run


def _to_first(percent: int):
    """Adds whether each member links with the first of its family."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r, s, fr, fs in zip(*(batch.column(c).to_pylist() for c in ("registers", "content", "first_registers", "first_content")), strict=True):
                s, fs = np.frombuffer(s, np.uint64), np.frombuffer(fs, np.uint64)
                equal = int((np.frombuffer(r, np.uint16) == np.frombuffer(fr, np.uint16)).sum())
                out.append(estimate(equal, len(s), len(fs)) >= _possible(percent) and _linked(len(s), len(fs), len(np.intersect1d(s, fs, assume_unique=True)), percent))
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("family"), pa.array(out, pa.bool_())], ["rep", "family", "linked"])

    return run


def _shared(a: list[np.ndarray], b: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of every a with every b, over ``width`` shingles at a time."""
    ha, hb = np.concatenate(a), np.concatenate(b)
    both = np.intersect1d(ha, hb)
    ia, ib = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])
    out = np.zeros((len(a), len(b)), np.float32)
    if not len(both):
        return out
    pa_, pb_ = np.minimum(np.searchsorted(both, ha), len(both) - 1), np.minimum(np.searchsorted(both, hb), len(both) - 1)
    ka, kb = both[pa_] == ha, both[pb_] == hb
    pa_, ia, pb_, ib = pa_[ka], ia[ka], pb_[kb], ib[kb]
    oa, ob = np.argsort(pa_, kind="stable"), np.argsort(pb_, kind="stable")
    pa_, ia, pb_, ib = pa_[oa], ia[oa], pb_[ob], ib[ob]
    for at in range(0, len(both), width):
        m = []
        for p, i, rows in ((pa_, ia, len(a)), (pb_, ib, len(b))):
            lo, hi = np.searchsorted(p, [at, at + width])
            x = np.zeros((rows, width), np.float32)
            x[i[lo:hi], p[lo:hi] - at] = 1
            m.append(x)
        out += m[0] @ m[1].T
    return out


def _in_blocks(percent: int, exact: bool):
    """Links between two blocks of a group that join components, as a forest: on the full sets, or as the registers alone let them be."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        reps, regs = g["rep"].to_numpy(), np.frombuffer(b"".join(g["registers"]), np.uint16).reshape(-1, K)
        first, n = g["linked"].to_numpy(bool), g["n"].to_numpy(float)
        own = [np.frombuffer(x, np.uint64) for x in g["content"]] if exact else []
        left, right = np.flatnonzero(g["side"] == 0), np.flatnonzero(g["side"] == 1)
        if not len(right):  # a block with itself
            right = left
        up = {int(i): int(i) for i in range(len(reps))}

        def top(i: int) -> int:
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        links = []
        for at in range(0, len(left), 32):
            rows = left[at : at + 32]
            equal = np.stack([(regs[right] == regs[i]).sum(1) for i in rows])
            maybe = (estimate(equal, n[rows][:, None], n[right][None, :]) >= _possible(percent)) & ~(first[rows][:, None] & first[right][None, :]) & (rows[:, None] != right[None, :])
            ri, ci = np.flatnonzero(maybe.any(1)), np.flatnonzero(maybe.any(0))
            if not len(ri):
                continue
            sure = maybe[np.ix_(ri, ci)]
            if exact:
                both = _shared([own[i] for i in rows[ri]], [own[i] for i in right[ci]])
                sure = sure & (100 * both >= percent * (n[rows[ri]][:, None] + n[right[ci]][None, :] - both))
            for i, j in zip(*np.nonzero(sure), strict=True):
                x, y = int(rows[ri[i]]), int(right[ci[j]])
                if top(x) != top(y):
                    up[top(x)] = top(y)
                    links.append((reps[x], reps[y]))
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def _classes(sketch: DataFrame) -> DataFrame:
    """digest, rep, n, registers of each set that is not empty."""
    full = sketch.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    return full.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers"))


def _buckets(classes: DataFrame) -> DataFrame:
    """band, first, rep: the members of buckets of two or more, one bucket for each set of members."""
    width = 2 * ROWS
    key = lambda i: F.xxhash64(i, F.substring("registers", i * width + 1, F.lit(width)))
    bands = classes.select("rep", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), key)).alias("band"))
    drawn = bands.groupBy("band").agg(F.count("*").alias("n"), F.min("rep").alias("first"), F.max("rep").alias("last"), F.bit_xor(F.xxhash64("rep")).alias("x")).where("first != last")
    one = kept(classes.sparkSession, drawn.groupBy("n", "first", "last", "x").agg(F.min("band").alias("band")).select("band", "first"), "buckets")
    return storage.split(bands, one, "band")[1].join(one, "band").select("band", "first", "rep")


def _families(classes: DataFrame, percent: int) -> DataFrame:
    """id, label: classes that may be linked by way of near ones, and the least of each family."""
    spark = classes.sparkSession
    members = kept(spark, _buckets(classes), "members")
    of_first = classes.select(F.col("rep").alias("first"), F.col("n").alias("first_n"), F.col("registers").alias("first_registers"))
    pairs = members.where("rep != first").select("rep", "first").distinct().join(classes.select("rep", "n", "registers"), "rep").join(of_first, "first")
    near = kept(spark, pairs.mapInArrow(_near_first(percent), "rep long, first long, linked boolean"), "near")
    own = members.join(near, ["rep", "first"], "left").withColumn("linked", F.coalesce("linked", F.lit(True)))
    far = own.groupBy("band").agg(F.count_if(~F.col("linked")).alias("n0"), F.count("*").alias("n")).where("n0 > 0 and n > 2").select("band")
    rest = kept(spark, own.join(far, "band").select(F.col("band").alias("family"), "rep", "linked"), "far")
    others = _rest(rest.join(classes.select("rep", "n", "registers"), "rep"), percent, exact=False)
    return components(near.where("linked").select(F.col("rep").alias("a"), F.col("first").alias("b")).unionByName(others), "families")


def _rest(members: DataFrame, percent: int, exact: bool = True) -> DataFrame:
    """Links within groups (families or buckets) that have members without a link to their first."""
    size = F.octet_length("content") if exact else F.lit(0)
    total = lambda ok: F.sum(F.when(ok, size).otherwise(0))
    yes, no = F.col("linked"), ~F.col("linked")
    by = members.groupBy("family").agg(F.count_if(yes).alias("n1"), F.count_if(no).alias("n0"), total(yes).alias("z1"), total(no).alias("z0")).where("n0 > 0 and n0 + n1 > 2")
    most = BLOCK if exact else NEAR_BLOCK
    blocks = lambda n, z: F.greatest(F.ceil(F.col(n) / most), F.ceil(F.col(z) / BLOCK_BYTES)).cast("int")
    m = members.join(by, "family").withColumns({"b1": blocks("n1", "z1"), "b0": blocks("n0", "z0")})
    own = F.pmod(F.xxhash64("rep"), F.when(yes, F.col("b1")).otherwise(F.col("b0"))).cast("int")
    m = m.withColumn("own", F.when(yes, own + F.col("b0")).otherwise(own))  # blocks of members without the link come first
    # (i, j): i is a block without the link, j any block from i on
    until = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    upto, after = F.least(F.col("own") + 1, F.col("b0")), F.when(no, F.sequence(F.col("own"), F.col("b0") + F.col("b1") - 1))
    right = F.transform(F.filter(until(upto), lambda i: i != F.col("own")), lambda i: F.struct(i.alias("i"), F.col("own").alias("j"), F.lit(1).alias("side")))
    left = F.coalesce(F.transform(after, lambda j: F.struct(F.col("own").alias("i"), j.alias("j"), F.lit(0).alias("side"))), F.array().cast("array<struct<i:int,j:int,side:int>>"))
    carried = ["rep", "linked", "n", "registers", *(["content"] if exact else [])]
    return m.withColumn("p", F.explode(F.concat(right, left))).select("family", "p.i", "p.j", "p.side", *carried).groupBy("family", "i", "j").applyInPandas(_in_blocks(percent, exact), "a long, b long")


def duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = kept(spark, storage.spread(docs).mapInArrow(_sketched, "doc_id long, n_shingles long, digest binary, registers binary"), "sketch")
    classes = kept(spark, _classes(sketch), "classes")
    families = _families(classes, percent)
    ids = kept(spark, families.join(classes, F.col("id") == F.col("rep")).select(F.col("rep").alias("doc_id"), "rep", "digest", "registers", F.col("label").alias("family")), "ids")
    some = storage.split(docs, ids, "doc_id")[1]  # texts of classes without a family stay where they are
    contents = some.join(ids, "doc_id").mapInArrow(_contents, "rep long, family long, registers binary, content binary")
    contents = kept(spark, contents, "contents")
    first = contents.where("rep = family").select("family", F.col("registers").alias("first_registers"), F.col("content").alias("first_content")).dropDuplicates(["family"])
    linked = kept(spark, contents.where("rep != family").join(first, "family").mapInArrow(_to_first(percent), "rep long, family long, linked boolean").groupBy("rep", "family").agg(F.max("linked").alias("linked")), "linked")
    members = contents.join(linked, ["rep", "family"], "left").withColumns({"linked": F.coalesce("linked", F.lit(True)), "n": F.expr("octet_length(content) div 8")})
    links = linked.where("linked").select(F.col("rep").alias("a"), F.col("family").alias("b")).unionByName(_rest(members, percent))
    labels = components(links, "links")
    own = sketch.join(classes.select("digest", "rep"), "digest", "left").withColumn("node", F.when(F.col("n_shingles") > 0, F.col("rep")))
    out = own.join(labels, F.col("node") == F.col("id"), "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "node", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def report(docs: DataFrame) -> DataFrame:
    return duplicates(docs, 85)


def deduplicated(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The documents, with their own columns, that are the first of their component, by doc_id; of rows that repeat a doc_id all stay or go."""
    gone = kept(docs.sparkSession, duplicates(docs, percent).where(~F.col("kept")).select("doc_id").distinct(), "gone")
    sure, maybe = storage.split(docs, gone, "cast(doc_id as bigint)")
    return sure.unionByName(maybe.join(gone, "doc_id", "left_anti").select(*docs.columns))
