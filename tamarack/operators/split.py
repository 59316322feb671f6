"""Stratified train/test split with largest-remainder allocation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarack.operators.dedupe import assert_no_leakage


def bucket_sizes(df: DataFrame, bucket: str, order: str) -> DataFrame:
    return df.groupBy(bucket).agg(F.count("*").alias("n"), F.min(order).alias("first_seen"))


def allocate(sizes: DataFrame, total: int) -> DataFrame:
    """``sizes`` (bucket, n, first_seen) with ``alloc``: shares of ``total`` by largest remainder, ties by first appearance.

    The windows run over one row per bucket, in one task: buckets are a list to be counted in thousands, not a key of rows.
    """
    every = Window.partitionBy()
    raw = sizes.withColumn("raw", (F.col("n") * total).cast("double") / F.sum("n").over(every)).withColumn("base", F.floor("raw"))
    rank = F.row_number().over(Window.partitionBy().orderBy(F.desc(F.col("raw") - F.col("base")), "first_seen"))
    extra = F.when(rank <= F.lit(total) - F.sum("base").over(every), 1).otherwise(0)
    return raw.withColumn("alloc", (F.col("base") + extra).cast("bigint")).drop("raw", "base")


def seeded_order(seed: int, id_col: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), id_col), 256)


def sample_by_bucket(df: DataFrame, id_col: str, bucket: str, order: str, total: int, seed: int = 42) -> DataFrame:
    """``total`` rows, allotted to buckets in proportion, lowest seeded hashes first.

    A bucket is not sorted as a whole: WindowGroupLimit keeps the first ``total``
    of it in each task. NULL is a bucket; ids are to be unique.
    """
    sizes = allocate(bucket_sizes(df, bucket, order), total).select(F.col(bucket).alias("_bucket"), "alloc")
    keyed = df.withColumn("_order", seeded_order(seed, F.col(id_col)))
    rank = F.row_number().over(Window.partitionBy(bucket).orderBy("_order", id_col))
    first = keyed.withColumn("_rank", rank).where(F.col("_rank") <= total)
    return first.join(sizes, F.col(bucket).eqNullSafe(F.col("_bucket"))).where("_rank <= alloc").drop("_order", "_rank", "_bucket", "alloc")


def train_test(labelled: DataFrame, id_col: str, bucket: str, order: str, total: int, *, seed: int = 42, prefix: str = "groq", default_labeller: str = "groq", hash_col: str | None = None, leakage: str = "raise") -> tuple[DataFrame, DataFrame]:
    """(train, test): a stratified test sample of the baseline labeller's rows, and the valid rest.

    Rows are first made unique by id, baseline rows before others, then the
    latest. Invalid rows may be in test, never in train. With ``hash_col``, a
    text that both would have is an error before anything is written, or with
    ``leakage="drop"`` is taken out of train.
    """
    if leakage not in ("raise", "drop"):
        raise ValueError(f"leakage is {leakage!r}, not raise or drop")
    base = F.coalesce("labeller", F.lit(default_labeller)).startswith(prefix)
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc(base), F.desc(order)))
    unique = labelled.withColumn("_base", base).withColumn("_rank", rank).where("_rank = 1").drop("_rank")
    picked = sample_by_bucket(unique.where("_base"), id_col, bucket, order, total, seed).select(id_col)
    test = unique.join(picked, id_col, "left_semi").drop("_base")
    train = unique.join(picked, id_col, "left_anti").where(F.coalesce("valid", F.lit(False))).drop("_base")
    if hash_col and leakage == "drop":
        train = train.join(test.select(hash_col).where(F.col(hash_col).isNotNull()).distinct(), hash_col, "left_anti")
    elif hash_col:
        assert_no_leakage(train, test, id_col, hash_col)
    return train, test


def holdout(df: DataFrame, id_col: str, share: float, seed: int = 42) -> DataFrame:
    """``df`` with ``held_out``: the given share of rows, of exact size, by seeded hash.

    The hash at the cut is found from counts per leading digits. Rows of other
    leading digits are decided by comparison, without a shuffle; only those of
    the one group in which the cut falls are ranked.
    """
    keyed = df.withColumn("_order", seeded_order(seed, F.col(id_col))).withColumn("_lead", F.substring("_order", 1, 4))
    n = keyed.groupBy("_lead").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy().orderBy("_lead").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    every = n.withColumns(
        {"_before": before, "_all": F.sum("_n").over(Window.partitionBy())}
    ).withColumn("_take", F.floor(F.col("_all") * share))
    rows = keyed.join(F.broadcast(every), "_lead")  # at most 65,536 groups
    inside = (F.col("_before") < F.col("_take")) & (F.col("_take") < F.col("_before") + F.col("_n"))
    rank = F.row_number().over(Window.partitionBy("_lead").orderBy("_order", id_col))
    ranked = rows.where(inside).withColumn("held_out", F.col("_before") + rank <= F.col("_take"))
    decided = rows.where(~inside).withColumn("held_out", F.col("_before") < F.col("_take"))
    return decided.unionByName(ranked).drop("_order", "_lead", "_n", "_before", "_all", "_take")
