"""Quality rules with adaptive thresholds (operator 8).

One pass over the texts gives whole-number measures of each document. Their distribution is kept
per language and source in a quantile sketch: counts of logarithmic buckets of relative width
2**-``BITS``, exact below 2**``BITS``. Sketches of this kind merge by adding counts, so they do
not depend on how rows are dealt out: those of a language's sources merge into the language's, and
those of languages into the corpus's. The quantiles of a group are blended with its language's,
which count as ``WEIGHT`` documents, and those with the corpus's, so that no verdict jumps at a
size. A document fails where a measure lies further above its group's upper quantile than ``times``
the distance from the median to that quantile, or, for the length of words, as far below the lower
quartile. The distance is taken as ``least`` at least, for measures that most texts have none of.
The thresholds come back to the documents by a join.

Defined results: null and empty texts have no words and fail the base rules; null languages and
sources form groups of their own; repeated rows count as often as they occur; an empty table gives
no rows. Ratios of a text without words are null and lie within any fence.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops as X
from .storage import kept, spread

MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 20, 30, 8
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
BITS, WEIGHT = 7, 200
#: measure: (numerator, factor, denominator, upper percentile, times, least distance, whether too low is bad as well)
MEASURES = {
    "word_length": ("word_chars", 100, "n_words", 75, 12, 5, True),
    "symbol_rate": ("n_symbols", 1000, "n_words", 75, 6, 10, False),
    "dup_line_rate": ("n_dup_lines", 1000, "n_lines", 90, 2, 175, False),
    "repeat_rate": ("n_repeat_words", 1000, "n_words", 90, 2, 145, False),
    "echo_rate": ("n_echo", 1000, "n_words", 75, 15, 2, False),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_echo")


def _repeats(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which entries occur at least twice with the same doc; hashes are mixed with the doc's number."""
    key = X.mix(h ^ X.mix(doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = s[1:] == s[:-1]
    out = np.zeros(len(h), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS of each text of a column from slices()."""
    w = X.words(column, X.SPACE)
    n = len(w.off) - 1
    c = np.zeros(len(w.data) + 1, np.int64)
    np.cumsum((w.data & 0xC0) != 0x80, out=c[1:])
    out = {"n_words": w.counts(), "word_chars": X.per_doc(c[w.end] - c[w.start], w.ptr), "n_symbols": X.per_doc(SYMBOLS[w.data], w.off)}

    repeat = np.zeros(len(w), bool)
    if len(w) >= REPEAT_WINDOW:
        at = np.flatnonzero(w.doc[: len(w) - REPEAT_WINDOW + 1] == w.doc[REPEAT_WINDOW - 1 :])
        if len(at):
            again = at[_repeats(X.windows(w.hash, REPEAT_WINDOW)[at], w.doc[at])]
            repeat = X.cover(again, REPEAT_WINDOW, len(w)) if len(again) else repeat
    out["n_repeat_words"] = X.per_doc(repeat, w.ptr)
    echo = np.zeros(len(w), bool)
    echo[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    out["n_echo"] = X.per_doc(echo, w.ptr)

    ends = np.flatnonzero(w.data == 10)
    bounds = np.unique(np.concatenate((w.off, ends + 1)))
    start, end = bounds[:-1], bounds[1:].copy()
    if len(start):
        end -= w.data[end - 1] == 10
        has = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
        start, end = start[has], end[has]
    doc = np.searchsorted(w.off, start, "right") - 1
    h = X.span_hash(X.prefix(w.data), start, end)
    key = X.mix(h ^ X.mix(doc.astype(np.uint64) + np.uint64(1)))
    first = np.unique(key, return_index=True)[1]
    out["n_lines"] = np.bincount(doc, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(doc[first], minlength=n)
    return out


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds COUNTS to each row."""
    own = docs.drop(*COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [measure(p) for _, p in X.slices(batch.column(text))]
            cols = [pa.array(np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, np.int64), pa.int64()) for c in COUNTS]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [*batch.schema.names, *COUNTS])

    return own.mapInArrow(run, T.StructType([*own.schema.fields, *(T.StructField(c, T.LongType()) for c in COUNTS)]))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def rate(name: str) -> Column:
    top, factor, bottom, *_ = MEASURES[name]
    return F.when(F.col(bottom) > 0, F.expr(f"({factor} * {top}) div {bottom}"))


def bucket(x: str) -> Column:
    """Bucket of a whole number: itself below 2**BITS, else by its leading BITS bits."""
    shift = f"(length(bin({x})) - {BITS})"
    return F.expr(f"if({x} < {2**BITS}, {x}, {2 ** (BITS - 1)} * {shift} + shiftright({x}, {shift}))")


def value(b: str) -> Column:
    """Least whole number of a bucket."""
    half = 2 ** (BITS - 1)
    return F.expr(f"if({b} < {2**BITS}, {b}, shiftleft(pmod({b}, {half}) + {half}, cast({b} div {half} - 1 as int)))")


def sketches(measures: DataFrame, keys: list[str]) -> DataFrame:
    """measure, keys, b, n: the sketch of each measure and group, as counts of buckets."""
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), rate(m).alias("x")) for m in MEASURES))).alias("p")
    return measures.select(*keys, pairs).select(*keys, "p.measure", "p.x").where("x is not null").select(*keys, "measure", bucket("x").alias("b")).groupBy("measure", *keys, "b").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, keys: list[str]) -> DataFrame:
    return sketch.groupBy("measure", *keys, "b").agg(F.sum("n").alias("n"))


def _by_measure(at: int) -> Column:
    """A column of MEASURES by the row's measure."""
    return reduce(lambda c, m: c.when(F.col("measure") == m, MEASURES[m][at]), MEASURES, F.when(F.lit(False), 0))


def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """measure, keys, total, low, mid, up: the 25th, 50th and the measure's upper percentile; each the least value of the bucket that holds rank ceil(total * p)."""
    upto = Window.partitionBy("measure", *keys).orderBy("b")
    whole = Window.partitionBy("measure", *keys)
    ranked = sketch.withColumns({"upto": F.sum("n").over(upto), "total": F.sum("n").over(whole)}).withColumn("v", value("b"))
    at = lambda p: F.min(F.when(100 * F.col("upto") >= p * F.col("total"), F.col("v")))
    return ranked.groupBy("measure", *keys).agg(F.first("total").alias("total"), at(F.lit(25)).alias("low"), at(F.lit(50)).alias("mid"), at(_by_measure(3)).alias("up"))


def thresholds(measures: DataFrame, lang: str = "lang", source: str = "source", weight: int = WEIGHT) -> DataFrame:
    """lang, source, and lo and hi of each measure, a row for each group."""
    sketch = sketches(measures, [lang, source])
    own = quantiles(sketch, [lang, source]).alias("o")
    by_lang = quantiles(merged(sketch, [lang]), [lang]).alias("l")
    every = quantiles(merged(sketch, []), []).alias("e")
    q = own.join(by_lang, (F.col("o.measure") == F.col("l.measure")) & F.col(f"o.{lang}").eqNullSafe(F.col(f"l.{lang}"))).join(every, F.col("o.measure") == F.col("e.measure"))

    def blended(name: str) -> Column:
        outer = f"((l.total * l.{name} + {weight} * e.{name}) div (l.total + {weight}))"
        return F.expr(f"(o.total * o.{name} + {weight} * {outer}) div (o.total + {weight})").alias(name)

    q = q.select(F.col("o.measure").alias("measure"), F.col(f"o.{lang}").alias("_lang"), F.col(f"o.{source}").alias("_source"), *map(blended, ("low", "mid", "up")))
    far = lambda d: _by_measure(4) * F.greatest(d, _by_measure(5))
    q = q.withColumns({"lo": F.col("low") - far(F.col("mid") - F.col("low")), "hi": F.col("up") + far(F.col("up") - F.col("mid"))})
    cols = [F.max(F.when(F.col("measure") == m, F.col(c))).alias(f"{m}_{c}") for m in MEASURES for c in ("lo", "hi")]
    return q.groupBy("_lang", "_source").agg(*cols)


def judged(measures: DataFrame, limits: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Adds base_failed and kept to measured rows, by the thresholds of their groups."""
    out = F.lit(False)
    for m, (*_, lower) in MEASURES.items():
        far = rate(m) > F.col(f"{m}_hi")
        out = out | F.coalesce(far | (rate(m) < F.col(f"{m}_lo")) if lower else far, F.lit(False))
    joined = measures.join(limits, F.col(lang).eqNullSafe(F.col("_lang")) & F.col(source).eqNullSafe(F.col("_source")), "left")
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~out).drop(*limits.columns)


def report(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, the contract's counts, base_failed, kept."""
    m = kept(docs.sparkSession, measured(spread(docs.select("doc_id", "text", "lang", "source"))).drop("text"), "quality")
    return judged(m, thresholds(m)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def accepted(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their own columns. Texts are measured twice rather than stored."""
    spark = docs.sparkSession
    limits = kept(spark, thresholds(kept(spark, measured(docs.select("text", "lang", "source")).drop("text"), "quality")), "thresholds")  # of a known size: if it is small, texts stay where they are
    name = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    own = judged(measured(docs.toDF(*name.values()), name["text"]), limits, name["lang"], name["source"])
    return own.where("kept").select(*name.values()).toDF(*name)
