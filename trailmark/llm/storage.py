"""Written tables that cut lineage, in the folder which the cluster names for them, and how rows are dealt out."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []
#: bytes that a partition of a shuffle should hold
PARTITION_BYTES = 128 << 20
#: Spark plans rows of unknown size with more bytes than this
_UNKNOWN = 1 << 60


def folder(spark: SparkSession) -> str:
    """A folder of this application under the session's ``spark.checkpoint.dir``; Spark removes it when the application ends.

    Where the setting is absent, as in tests, it is a folder of this machine, which only a local master may use.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="trailmark-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        return f"file://{_own[0]}"
    sc = spark.sparkContext
    at = f"{base.rstrip('/')}/trailmark-{sc.applicationId}"
    if not getattr(sc, "_trailmark_folder", False):
        path = sc._jvm.org.apache.hadoop.fs.Path(at)
        files = path.getFileSystem(sc._jsc.hadoopConfiguration())
        files.mkdirs(path)  # only what is there can be named for removal
        files.deleteOnExit(path)
        sc._trailmark_folder = True
    return at


def kept(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written once as Parquet in the shared folder and read from there."""
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt out anew where a scan has fewer splits than there are cores, as for a table of one row group."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def ranges(df: DataFrame, size: str, most: int = PARTITION_BYTES, planned: bool = False) -> int:
    """Partitions for a shuffle of ``df``: as many as the session has, or more so that none holds over ``most`` of the bytes that the expression ``size`` adds up to.

    Where ``planned``, the bytes are those that the plan's statistics tell, which reads nothing (for a table in files, the files' bytes), if they are known.
    """
    total = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) if planned else _UNKNOWN
    if total >= _UNKNOWN:
        total = df.agg(F.sum(F.expr(size)).alias("n")).first()["n"] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // most))


def gathered(rows: DataFrame, source: DataFrame, most: int = PARTITION_BYTES // 4) -> DataFrame:
    """Narrow ``rows``, made behind a shuffle of ``source``, dealt out to few tasks for writing: none stands for over ``most`` bytes of the source, by the plan's statistics.

    They stay as they are where that saves no file, or where the statistics don't tell the source's bytes.
    """
    spark = source.sparkSession
    total = int(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    n = max(1, -(-total // most))
    return rows.repartition(n) if n < int(spark.conf.get("spark.sql.shuffle.partitions")) else rows


#: bits of the map by which split() tells most rows apart: 2**18 rows of 64 bits at most
MAP_BITS = 24


def split(df: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is not among the ids', rows whose key may be): of two scans the first needs no shuffle, and the second shuffles little more than it must.

    ``key`` is SQL over columns that both have. The map of hashed keys has a fixed largest size, so it is broadcast however many ids there are.
    """
    bit = f"pmod(xxhash64({key}), {1 << MAP_BITS})"
    slots = ids.select(F.expr(bit).alias("b")).selectExpr("shiftright(b, 6) as _slot", "shiftleft(1L, cast(pmod(b, 64) as int)) as m").groupBy("_slot").agg(F.bit_or("m").alias("_mask"))
    own = df.withColumn("_bit", F.expr(bit)).join(F.broadcast(slots), F.expr("shiftright(_bit, 6) = _slot"), "left")
    told = F.expr("coalesce(_mask & shiftleft(1L, cast(pmod(_bit, 64) as int)), 0L)")
    return own.where(told == 0).select(*df.columns), own.where(told != 0).select(*df.columns)
