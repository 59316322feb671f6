"""Session helpers shared by all operators: tables, shared folder, lineage cuts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Beyond this many bytes a table is joined by shuffle, never by an explicit broadcast.
BROADCAST_BYTES = 32 << 20

#: Setting of Spark that drops an execution's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own_folder: str | None = None
_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``, else one of our own.

    Our own is a temporary folder on a local master (tests) and lies below the
    warehouse on a cluster. A warehouse on a single machine's disk is an error there.
    """
    global _own_folder
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        if "://" not in warehouse or warehouse.startswith("file:"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share: the warehouse is on a local disk")
        return f"{warehouse}/_tamarack"
    if _own_folder is None:
        _own_folder = f"file://{tempfile.mkdtemp(prefix='tamarack-')}"
    return _own_folder


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    Cuts the lineage like a reliable checkpoint, but stays columnar, so later
    reads prune columns and push filters. Removed by :func:`drop_written`, at the
    latest when the process ends. The shuffle files it took are removed at once:
    nothing reads them again, and Spark would keep them until the driver happens
    to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def kept(spark: SparkSession, path: str) -> None:
    """Notes a file of our own in the shared folder, to be removed with the tables."""
    _written.append((spark, path))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if its scan has fewer parts than there are cores, for work that costs more than moving the rows.

    A table of at least as many parts as cores is left as it is, so a large one is never shuffled for this; so is what
    comes from a shuffle, whose parts adaptive execution sets.
    """
    plan = df._jdf.queryExecution().executedPlan()
    if plan.nodeName() == "AdaptiveSparkPlan":
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if plan.execute().getNumPartitions() < cores else df


@atexit.register
def drop_written() -> None:
    """Removes all tables of :func:`written`. Results that read them must have been collected or saved before."""
    for spark, path in _written:
        try:
            jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)
        except Exception:  # the session may be gone
            pass
    _written.clear()


def _width(c: Column, kind: T.DataType) -> Column:
    """Bytes of a value; those of a nested value are counted from its elements."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(c) + 16
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType)):
        size = F.aggregate(c, F.lit(16), lambda s, x: s + _width(x, kind.elementType).cast("int"))
    elif isinstance(kind, T.ArrayType):
        size = F.size(c) * 8 + 16
    elif isinstance(kind, T.StructType):
        size = sum((_width(c.getField(f.name), f.dataType) for f in kind), F.lit(8))
    else:
        size = F.lit(16 if isinstance(kind, T.DecimalType) else 8)
    return F.coalesce(size, F.lit(8))


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if its rows, measured, take no more than ``BROADCAST_BYTES``; else as it is.

    Measuring reads ``df`` once, so it should be a table, not a long plan.
    """
    size = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(16))
    return F.broadcast(df) if (df.agg(F.sum(size.cast("bigint"))).first()[0] or 0) <= BROADCAST_BYTES else df


def picked(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under new names (``new=name``), whatever other columns are called.

    Names are matched exactly, so columns that differ from one only in case, or
    repeat it, do not make it ambiguous; of equal names the first is taken.
    """
    names = df.columns
    missing = [c for c in columns.values() if c not in names]
    if missing:
        raise ValueError(f"no column {missing[0]!r}")
    numbered = df.toDF(*[f"_{i}" for i in range(len(names))])
    return numbered.select(*[F.col(f"_{names.index(c)}").alias(new) for new, c in columns.items()])
