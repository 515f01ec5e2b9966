"""Secret scans over an incremental blob ledger (operator 4).

Every text is a version of a blob, addressed by the SHA-256 of its bytes. The ledger holds a row
for each blob and rule version scanned so far. A scan takes the blobs which the ledger has not
seen under the current ``RULE_VERSION``, once each however many paths hold them, and appends its rows
to the ledger, of which those with findings join back to all paths. A ledger is a folder of Parquet
files that later runs are given again; a run that names none has one of its own. Copies are dropped twice: in each input partition before the shuffle, so
that a blob with a third of all rows sends one row from each, and again after it. Texts are
shuffled once, by their address; the ledger's rows, which are narrow, are gathered into files whose
number follows the texts' bytes and not the partitions of that shuffle. A worker decodes a slice of a batch at a time.

Rules ``assign``, ``access`` and ``hex`` are the base; ``pem``, ``jwt`` and ``url`` add spans.

Defined results: null texts count as empty; empty texts hold nothing; a path that is repeated
appears as often; spans are of code points, ends exclusive; an absent or empty ledger means a full
scan; a blob that two runs add at once has two equal rows in the ledger and counts once; other
columns pass through ``redacted``.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import folder, gathered, kept, split, spread
from .textops import slices

RULE_VERSION = 2
#: kind: pattern, group whose length counts, least length; in the order in which kinds are listed
BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]{24,}"), 0, 24),  # shorter runs fail in any case
}
MORE = {
    "pem": (re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s:,.-]+?-----END [A-Z ]*PRIVATE KEY-----"), 0, 1),
    "jwt": (re.compile(r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"), 0, 1),
    "url": (re.compile(r"\b[a-z][a-z0-9+.-]{1,20}://[^\s/:@]++:[^\s/:@]++@"), 0, 1),
}
#: what a text must hold for a rule to be tried; "assign" needs one of these in any case
NEEDS = {"access": "AKIA", "pem": "PRIVATE KEY", "jwt": "eyJ", "url": "://"}
WORDS = ("passw", "secret", "token", "api")
KINDS = [*BASE, *MORE]


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans, by start and then kind as listed."""
    found = []
    low = text.lower() if text.isascii() else text.translate(_LOWER)
    for rank, (kind, (pattern, group, least)) in enumerate([*BASE.items(), *MORE.items()]):
        if kind in NEEDS and NEEDS[kind] not in text or kind == "assign" and not any(w in low for w in WORDS):
            continue
        found += [(m.start(), rank, m.end(), kind) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return [(kind, a, b) for a, _, b, kind in sorted(found)]


_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


def address(text: str = "text") -> Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


_FINDING = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_LEDGER = T.StructType([T.StructField("blob", T.StringType()), T.StructField("rule_version", T.IntegerType()), T.StructField("findings", T.ArrayType(_FINDING))])
_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First row of each blob in this partition; it keeps 32 bytes for each."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for b in batch.column("blob").to_pylist():
            key = bytes.fromhex(b)
            keep.append(key not in seen)
            seen.add(key)
        yield batch.filter(pa.array(keep, pa.bool_()))


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _distinct(batches):
        found = [[{"kind": k, "start": a, "end": b} for k, a, b in scan(t)] for _, rows in slices(batch.column("text")) for t in rows.to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("blob"), pa.array([RULE_VERSION] * len(found), pa.int32()), pa.array(found, _FOUND)], ["blob", "rule_version", "findings"])


def unseen(paths: DataFrame, ledger: DataFrame | None, text: str = "text") -> DataFrame:
    """Ledger rows of the blobs not yet scanned under RULE_VERSION: blob, rule_version, findings."""
    blobs = paths.select(address(text).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(_distinct, "blob string, text string")
    if ledger is not None:
        blobs = blobs.join(ledger.where(F.col("rule_version") == RULE_VERSION).select("blob"), "blob", "left_anti")
    return blobs.repartition("blob").mapInArrow(_scanned, _LEDGER)


def updated(paths: DataFrame, ledger: str | None = None, text: str = "text") -> DataFrame:
    """The ledger in this folder, after a scan of the blobs which it lacked; without a folder, a new one for this run."""
    spark = paths.sparkSession
    at = ledger or f"{folder(spark)}/ledger-{uuid.uuid4().hex}"
    old = None
    if ledger:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            old = spark.read.schema(_LEDGER).parquet(at)
    gathered(unseen(spread(paths), old, text), paths).write.mode("append").parquet(at)
    return spark.read.schema(_LEDGER).parquet(at)


def _some(ledger: DataFrame) -> DataFrame:
    """blob, findings of blobs that hold secrets."""
    return ledger.where((F.col("rule_version") == RULE_VERSION) & (F.size("findings") > 0)).select("blob", "findings").dropDuplicates(["blob"])


def report(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: a row for each document."""
    own = docs.select("doc_id", address().alias("blob"))
    some = _some(updated(docs.select("text"), ledger))
    f = F.coalesce(F.col("findings"), F.array().cast(T.ArrayType(_FINDING)))
    said = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    n = lambda kind: F.size(F.filter(f, lambda x: x["kind"] == kind)).cast("long")
    base = F.filter(f, lambda x: x["kind"].isin(*BASE))
    return own.join(some, "blob", "left").select("doc_id", *(n(k).alias(f"n_{k}") for k in BASE), F.sha2(said(base), 256).alias("base_sha256"), said(f).alias("spans"))


def redacted(docs: DataFrame, ledger: str | None = None, text: str = "text") -> DataFrame:
    """All documents, each span of a secret replaced by its kind in brackets. Texts without secrets stay as they are, and where they are."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    here = names[docs.columns.index(text)]
    some = kept(docs.sparkSession, _some(updated(docs.select(F.col(text).alias("text")), ledger)), "findings")
    sure, maybe = split(docs.toDF(*names).withColumn("blob", address(here)), some, "blob")
    found = maybe.join(some, "blob", "left").select(*names, "findings")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [t if not f else redact(t, [(x["kind"], x["start"], x["end"]) for x in f]) for t, f in zip(batch.column(here).to_pylist(), batch.column("findings").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == here else batch.column(c) for c in names], names)

    changed = found.mapInArrow(run, T.StructType([f for f in found.schema.fields if f.name != "findings"]))
    return sure.select(*names).unionByName(changed).toDF(*docs.columns)


def redact(text: str, found: list[tuple[str, int, int]]) -> str:
    out, at = [], 0
    for kind, a, b in sorted(found, key=lambda x: (x[1], -x[2])):
        if b > at:
            out.append(text[at : max(a, at)])
            if a >= at:
                out.append(f"[{kind}]")
            at = b
    return "".join([*out, text[at:]])


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
