"""Session helpers: measured broadcasts, spreading, shared folder, exact column choice."""

import pytest
from pyspark.sql import functions as F

from tamarack import runtime


def hinted(df):
    return "broadcast" in df._jdf.queryExecution().logical().toString().lower()


def test_broadcasts_are_measured(spark, monkeypatch):
    wide = spark.range(100).select("id", F.repeat(F.lit("x"), 1000).alias("text"), F.array(F.lit("a"), F.lit(None)).alias("list"), F.struct(F.lit(1.0).alias("d")).alias("s"))
    assert hinted(runtime.broadcast_if_small(wide)) and hinted(runtime.broadcast_if_small(wide.limit(0)))
    monkeypatch.setattr(runtime, "BROADCAST_BYTES", 50_000)
    assert not hinted(runtime.broadcast_if_small(wide)) and hinted(runtime.broadcast_if_small(wide.select("id")))


def test_only_narrow_scans_are_spread(spark, data):
    narrow = runtime.table(spark, data, "postings").select("seq", "raw_text")
    assert runtime.spread(narrow).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    wide = spark.range(0, 100, 1, 64)
    assert runtime.spread(wide) is wide
    shuffled = wide.groupBy((F.col("id") % 3).alias("k")).count()
    assert runtime.spread(shuffled) is shuffled


def test_written_tables_are_removed(spark):
    kept = runtime.written(spark.range(3), "three")
    path = kept.inputFiles()[0]
    assert kept.count() == 3
    runtime.drop_written()
    assert not spark._jvm.java.io.File(path.replace("file:", "")).exists()


class Elsewhere:
    """A session whose master is a cluster."""

    class sparkContext:
        master = "spark://host:7077"

    class conf:
        values: dict = {}

        @classmethod
        def get(cls, name, default=None):
            return cls.values.get(name, default)


def test_no_machine_local_folder_on_a_cluster():
    for warehouse in ("file:/home/x/spark-warehouse", "/home/x", "file:///home/x"):
        Elsewhere.conf.values = {"spark.sql.warehouse.dir": warehouse}
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            runtime.shared_folder(Elsewhere)
    Elsewhere.conf.values = {"spark.sql.warehouse.dir": "hdfs://n/w"}
    assert runtime.shared_folder(Elsewhere) == "hdfs://n/w/_tamarack"
    Elsewhere.conf.values = {"spark.checkpoint.dir": "file:///shared"}
    assert runtime.shared_folder(Elsewhere) == "file:///shared"


def test_columns_are_picked_by_exact_name(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, A int, `b.c` int")
    assert runtime.picked(df, x="A", y="b.c").first() == (2, 3)
    with pytest.raises(ValueError, match="no column"):
        runtime.picked(df, x="B")
