"""The rows of lowest key in each group up to a budget, without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins of the key range. Only the one bin in which a group's budget ends is sorted.
BINS = 4096


def uniform(*columns: Column) -> Column:
    """A number in (0, 1) that depends on the values only."""
    return (F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") + 0.5) / float(1 << 53)


def lowest(rows: DataFrame, group: list[str], key: str, tie: str, budgets: DataFrame, size: Column | None = None) -> DataFrame:
    """Rows of each group in order of ``key`` in [0, 1) while the sum of ``size`` before them is below ``budget``.

    ``budgets`` has the group's columns and ``budget`` (at most one row a group; groups without one get none).
    Without ``size`` rows are counted, so ``budget`` is a number of rows. Sums per
    (group, bin) are combined before they are shuffled; a bin below the one where
    the budget ends is taken whole, so a hot group is never sorted as one.
    """
    size = F.lit(1) if size is None else size
    binned = rows.withColumns({"_bin": F.least(F.floor(F.col(key) * BINS), F.lit(BINS - 1)).cast("int"), "_size": size.cast("double")})
    sums = binned.groupBy(*group, "_bin").agg(F.sum("_size").alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(*group).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))
    bins = sums.withColumn("_before", F.coalesce(before, F.lit(0.0))).join(
        budgets.select(*group, F.col("budget").alias("_budget")),
        group
    ).where("_before < _budget")
    # at most BINS rows a group, few groups: joined by broadcast only if Spark finds it small
    joined = binned.join(bins, [*group, "_bin"])
    whole = joined.where("_before + _sum <= _budget")
    inner = F.sum("_size").over(Window.partitionBy(*group).orderBy(key, tie).rowsBetween(Window.unboundedPreceding, -1))
    edge = joined.where("_before + _sum > _budget").withColumn(
        "_inner",
        F.coalesce(inner, F.lit(0.0))
    ).where("_before + _inner < _budget").drop("_inner")
    return whole.unionByName(edge).select(*rows.columns)
