"""Where tables are kept, and how rows are dealt out."""

from __future__ import annotations

import pytest

from trailmark.llm import storage


class _Session:
    """A session without spark.checkpoint.dir."""

    def __init__(self, master):
        self.conf = {}
        self.sparkContext = type("C", (), {"master": master})()


def test_a_cluster_without_a_shared_folder_is_an_error():
    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        storage.folder(_Session("spark://host:7077"))
    assert storage.folder(_Session("local[2]")).startswith("file:///")


def test_tables_lie_in_the_applications_folder(spark):
    at = storage.folder(spark)
    assert at.startswith(spark.conf.get("spark.checkpoint.dir")) and spark.sparkContext.applicationId in at
    assert sorted(r[0] for r in storage.kept(spark, spark.range(5), "five").collect()) == [0, 1, 2, 3, 4]


def test_few_splits_are_dealt_out(spark):
    one = spark.range(100).coalesce(1)
    assert storage.spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(100).repartition(9)
    assert storage.spread(many) is many


def test_ranges_follow_bytes(spark):
    df = spark.range(1000).selectExpr("repeat('x', 100) as text")
    base = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert storage.ranges(df, "octet_length(text)") == base
    assert storage.ranges(df, "octet_length(text)", 1000) == 100
    written = storage.kept(spark, spark.range(100_000), "numbers")
    assert storage.ranges(written, "8", 1000, planned=True) > 100 and storage.ranges(written, "8", planned=True) == base
    assert storage.ranges(spark.createDataFrame([(1,)] * 50, "a long"), "1000", 1000, planned=True) == 50
    assert storage.ranges(df.where("false"), "octet_length(text)") == base


def test_rows_are_gathered_by_the_bytes_of_their_source(spark):
    written = storage.kept(spark, spark.range(100_000), "numbers")
    rows, most = written.repartition(9), int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert storage.gathered(rows, written).rdd.getNumPartitions() == 1 < most
    assert sorted(r["id"] for r in storage.gathered(rows, written, 200_000).collect()) == list(range(100_000))
    assert storage.gathered(rows, written, 1000) is rows  # no file saved
    assert storage.gathered(rows, spark.sparkContext.parallelize([(1,)]).toDF("a long")) is rows  # bytes unknown


def test_split_keeps_every_row(spark):
    df = spark.range(5000).selectExpr("if(id % 7 = 0, null, id % 900) as a", "id as b")
    ids = spark.range(0, 900, 9).selectExpr("id as a")
    sure, maybe = storage.split(df, ids, "a")
    assert sure.columns == maybe.columns == ["a", "b"]
    assert sorted(r["b"] for r in sure.unionByName(maybe).collect()) == list(range(5000))
    assert not {r["a"] for r in sure.collect()} & set(range(0, 900, 9)) and maybe.count() < 700
    none, _ = storage.split(df, ids.where("false"), "a")
    assert none.count() == 5000
