"""JSON Lines in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of an explicit schema; blank lines are skipped, a malformed one raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_jsonl_if_exists(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """As :func:`read_jsonl`, empty if there is no such file yet."""
    return read_jsonl(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def first_lines(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The first n raw lines of a file in its order, blank ones too."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    return lines.orderBy("_block", "_at").limit(n).select("value")


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """UTF-8 with explicit nulls; ``append`` adds files, committed per task."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)
