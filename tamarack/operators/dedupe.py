"""Keyed and textual deduplication, leakage, upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key. Only the first row per key and task is shuffled (WindowGroupLimit)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def last_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Keyed upsert of a log: the last row of each key."""
    return first_per_key(df, keys, F.desc(order))


def ingest_flags(records: DataFrame, id_col: str, order: list[str], minimum: int = 200) -> DataFrame:
    """Every first row of an id with ``kept_length`` and ``kept`` (also first of its text).

    The id counts as seen before the length filter, so a short first copy hides later ones.
    """
    first = first_per_key(records, [id_col], *[F.col(c) for c in order]).withColumn(
        "kept_length",
        F.coalesce(F.col("description_chars") >= minimum, F.lit(False))
    )
    # the first of each text is one id, found in a state of fixed size: a text repeated by many ids is never sorted
    own = first.where("kept_length").groupBy("text_hash").agg(F.min_by(id_col, F.struct(*order, id_col)).alias(id_col))
    kept = own.select(id_col, F.lit(True).alias("_kept"))
    return first.join(kept, id_col, "left").withColumn("kept", F.coalesce("_kept", F.lit(False))).drop("_kept")


def ingest_summary(flags: DataFrame) -> DataFrame:
    """Per bucket: kept before the text dedupe, dropped as short, dropped as repeated text."""
    return flags.groupBy("bucket").agg(
        F.count_if("kept_length").alias("kept_before_hash_dedupe"),
        F.count_if(~F.col("kept_length")).alias("dropped_short"),
        F.count_if(F.col("kept_length") & ~F.col("kept")).alias("dropped_hash_dupes")
    )


def overlap(train: DataFrame, test: DataFrame, column: str) -> DataFrame:
    """Distinct values both have; NULLs are no overlap."""
    return train.select(column).where(F.col(column).isNotNull()).intersect(test.select(column))


def assert_no_leakage(train: DataFrame, test: DataFrame, id_col: str = "posting_id", hash_col: str = "text_hash") -> None:
    """Raises ValueError if train and test share an id or a text hash."""
    found = {c: overlap(train, test, c) for c in (id_col, hash_col)}
    counts = {c: d.count() for c, d in found.items()}
    if any(counts.values()):
        shown = [r[0] for r in found[id_col].orderBy(id_col).limit(10).collect()]
        raise ValueError(f"train and test overlap: {counts[id_col]} ids {shown}, {counts[hash_col]} texts")


def upsert(existing: DataFrame, new: DataFrame, key: str, order: str, candidates: DataFrame, candidate_order: str) -> DataFrame:
    """Last row per key of both, of candidate keys only, with the candidates' order in ``position``."""
    merged = last_per_key(existing.unionByName(new), [key], order)
    return merged.join(candidates.select(key, F.col(candidate_order).alias("position")), key)


def neighbours(candidates: DataFrame, key: str, order: str) -> DataFrame:
    """(key, order, previous, following): the keys before and after each candidate, NULL at the ends.

    Ranges of ``order`` are ordered by themselves; only their ends are put side by side.
    """
    spread = candidates.select(key, order).repartitionByRange(F.col(order), F.col(key)).withColumn("_range", F.spark_partition_id())
    own = Window.partitionBy("_range").orderBy(order, key)
    inside = spread.select("*", F.lag(key).over(own).alias("_before"), F.lead(key).over(own).alias("_after"))
    ends = spread.groupBy("_range").agg(
        F.min_by(key, F.struct(order, key)).alias("_first"),
        F.max_by(key, F.struct(order, key)).alias("_last")
    )
    over = Window.partitionBy().orderBy("_range")  # one row a range
    ends = ends.select("_range", F.lag("_last").over(over).alias("_left"), F.lead("_first").over(over).alias("_right"))
    joined = inside.join(F.broadcast(ends), "_range")
    return joined.select(key, order, F.coalesce("_before", "_left").alias("previous"), F.coalesce("_after", "_right").alias("following"))


def first_open(candidates: DataFrame, done: DataFrame, key: str, order: str) -> DataFrame:
    """One row: the lowest order of a candidate that is not done, NULL if all are."""
    return candidates.join(done.select(key), key, "left_anti").agg(F.min(order).alias("first_open"))
