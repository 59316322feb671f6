"""Exact order statistics per group without collecting a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def order_statistics(df: DataFrame, group: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Per group n, mean and for each share s the value at sorted position floor(n x s), from 0.

    Equal values are counted first, so a value that many rows share is one row;
    the values are counted in bins between approximate quantiles, and only the
    bins that hold a wanted position are ordered. NULL values are left out; a
    group without values has no row.
    """
    rows = df.where(F.col(value).isNotNull()).select(*group, F.col(value).alias("_v"))
    cuts = rows.groupBy(*group).agg(
        F.percentile_approx("_v", [k / 64 for k in range(1, 64)], 2000).alias("_cuts"),
        F.count("*").alias("n"),
        F.avg("_v").alias("mean")
    )
    bin_of = F.size(F.filter("_cuts", lambda c: c < F.col("_v")))
    values = rows.groupBy(*group, "_v").agg(F.count("*").alias("_c"))
    binned = values.join(cuts.select(*group, "_cuts"), group).select(*group, "_v", "_c", bin_of.alias("_bin"))
    sums = binned.groupBy(*group, "_bin").agg(F.sum("_c").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = {name: F.floor(F.col("n") * F.lit(s)).cast("bigint") for name, s in shares.items()}
    placed = sums.withColumn("_before", before).join(cuts.drop("_cuts"), group).withColumns({f"_at_{k}": c for k, c in at.items()})
    holds = F.lit(False)
    for k in at:
        holds = holds | ((F.col("_before") <= F.col(f"_at_{k}")) & (F.col(f"_at_{k}") < F.col("_before") + F.col("_n")))
    end = F.sum("_c").over(Window.partitionBy(*group, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)) + F.col("_before")
    ranked = binned.join(placed.where(holds), [*group, "_bin"]).withColumn("_end", end)
    wanted = {k: (F.col("_end") - F.col("_c") <= F.col(f"_at_{k}")) & (F.col(f"_at_{k}") < F.col("_end")) for k in at}
    found = [F.max(F.when(c, F.col("_v"))).alias(k) for k, c in wanted.items()]
    return ranked.groupBy(*group).agg(F.first("n").alias("n"), F.first("mean").alias("mean"), *found)


def latency_stats(df: DataFrame, group: list[str], value: str = "latency_seconds") -> DataFrame:
    """n, upper median, mean and 95th percentile by rank."""
    return order_statistics(df, group, value, {"median": 0.5, "p95": 0.95})
