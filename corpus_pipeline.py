"""From raw documents to packed sequences: five stages, each written and read again before the next.

1. quality rules: documents that they reject go;
2. MinHash near-dedup: of each group of near-duplicates the document with the least doc_id stays;
3. benchmark decontamination: documents that hold a window of an item go;
4. secret scans: secrets are replaced by their kind, n_chars follows the text;
5. packing: what is left, as pieces of sequences.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm import decontam, neardup, packing, quality, secretscan
from trailmark.llm.queries import vocabulary
from trailmark.llm.storage import folder
from trailmark.session import ship, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return quality.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return neardup.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    clean = secretscan.redacted(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.packed(docs, vocabulary("word_bpe_49k.json"), keep=150_000)  # workers hold what the other stages left as well


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    at = f"{folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return docs


#: no SQL: the near-duplicate and packing stages are procedures; tests/llm holds run() against a plain version
ORACLE_SQL = None
