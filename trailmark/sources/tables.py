"""Run tables, reports and exports. A run is a folder of Parquet tables; its configuration is one row, keyed by a hash."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE_COLUMNS = ["cluster", "size", "silhouette", "ast_similarity", "mean_events", "mean_suspicious", "verdict_average", "plugins", "themes", "neighbours", "domains", "urls", "exact_matches", "recent_alerts", "top_plugins", "notes"]


def config_hash(config: dict[str, Any]) -> str:
    """DEC-5: key of whatever depends on these settings."""
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:16]


def write_run(tables: dict[str, DataFrame], path: str, config: dict[str, Any]) -> None:
    """SNK-01, SNK-02, SNK-05, SNK-14, SNK-16: each table as Parquet, the configuration as a JSON row."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(config_hash(config), json.dumps(config, sort_keys=True))], "config_hash string, config string").write.mode("overwrite").json(f"{path}/config")


def read_run(spark: SparkSession, path: str, name: str) -> DataFrame:
    """SRC-14, SRC-15."""
    return spark.read.parquet(f"{path}/{name}")


def is_current(spark: SparkSession, path: str, config: dict[str, Any]) -> bool:
    """SRC-23, DEC-21: whether a run was made with these settings; False where there is none."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.schema("config_hash string").json(f"{path}/config").take(1)
    except AnalysisException:
        return False
    return bool(rows) and rows[0]["config_hash"] == config_hash(config)


def append_new(rows: DataFrame, path: str, keys: list[str], force: bool = False) -> None:
    """SNK-03, SNK-04, SRC-22, SRC-24: writes the rows whose keys the table lacks, or all of them anew."""
    from pyspark.errors import AnalysisException

    spark = rows.sparkSession
    if force:
        rows.write.mode("overwrite").parquet(path)
        return
    try:
        rows = rows.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
    except AnalysisException:
        pass  # the first write
    rows.write.mode("append").parquet(path)


def report_json(clusters: DataFrame, traces: DataFrame, most: int = 20) -> DataFrame:
    """SNK-06, SNK-10, SNK-12, SNK-17: a JSON text for each cluster with its first traces."""
    from pyspark.sql import Window

    first = traces.withColumn("_n", F.row_number().over(Window.partitionBy("cluster").orderBy("trace_id"))).where(F.col("_n") <= most).drop("_n")
    listed = first.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct(*(c for c in ["trace_id", *(c for c in first.columns if c not in ("trace_id", "cluster"))])))).alias("traces"))
    return clusters.join(listed, "cluster", "left").select("cluster", F.to_json(F.struct("*")).alias("value"))


def report_text(clusters: DataFrame, fields: list[str]) -> DataFrame:
    """SNK-06, SNK-07, SNK-08, SNK-18: a text section for each cluster."""
    lines = [F.concat(F.lit(f"  {f}: "), F.coalesce(F.col(f).cast("string"), F.lit("n/a"))) for f in fields]
    return clusters.select("cluster", F.concat_ws("\n", F.concat(F.lit("Cluster "), F.col("cluster").cast("string")), *lines).alias("value"))


def write_csv(rows: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """SNK-07, SNK-13: columns in a fixed order, missing ones blank, with a header."""
    columns = columns or rows.columns
    rows.select(*((F.col(c) if c in rows.columns else F.lit("")).alias(c) for c in columns)).write.mode("overwrite").option("header", "true").csv(path)


def html(rows: DataFrame, most: int = 200) -> str:
    """SNK-09: a top-k table as HTML."""
    return rows.limit(most).toPandas().to_html(index=False, escape=True)


def selection(samples: DataFrame, root: str, target: str) -> DataFrame:
    """SNK-11: source and target of files to copy; copying stays outside the engine."""
    from ..functions.text import sample_name

    return samples.select(F.concat_ws("/", F.lit(root), "url_hash", "timestamp", F.lit("loaded_js"), "file_name").alias("source"), F.concat_ws("/", F.lit(target), F.concat(F.lit("cluster_"), F.col("cluster").cast("string")), sample_name("rank", "trace_id", "hash")).alias("target"))


def resolved(explicit: str | None, default: str | None, found: list[str]) -> str:
    """SRC-29: the path that is given, else the default, else the first that was found, by name."""
    for path in (explicit, default, *sorted(found)):
        if path:
            return path
    raise FileNotFoundError("no samples were given or found")
