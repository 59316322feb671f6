"""A sample whose category shares follow targets (problem 5).

Rows are counted by the targets they match, a table bounded by the targets, not
by the categories. Weights are raked over all margins by iterative proportional
fitting; rows get exponential keys of those weights; each target takes its quota
of lowest keys. Quotas are repaired up to the minimum rows. What is short, and
each gap, is measured on the rows drawn.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tamarack.llm._ranked import lowest, uniform
from tamarack.runtime import broadcast_if_small, picked

#: Targets, and combinations of targets that rows match at once, the driver may hold.
MAX_CELLS = 200_000


def bounded_rows(df: DataFrame, limit: int, what: str) -> list[Row]:
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} {what}")
    return rows


def rake(cells: dict[tuple, float], margins: list[dict[int, tuple[list[tuple], float]]], rounds: int = 200, close: float = 1e-9) -> dict[tuple, float]:
    """Cell weights whose totals have each margin's target shares within the cells the margin covers.

    A margin maps a target to its cells and share. Shares are those within the
    cells covered, so that margins over different parts of the rows can hold at
    once; targets without rows are left out and the others' shares scaled up.
    Ends when no factor differs from 1 by more than ``close``, or after ``rounds``.
    """
    total = {c: float(n) for c, n in cells.items()}
    for _ in range(rounds):
        worst = 0.0
        for margin in margins:
            sums = {t: sum(total[c] for c in own) for t, (own, _) in margin.items()}
            covered, shares = sum(sums.values()), sum(share for t, (_, share) in margin.items() if sums[t] > 0)
            if not covered or not shares:
                continue
            for t, (own, share) in margin.items():
                if sums[t] > 0:
                    factor = share / shares * covered / sums[t]
                    worst = max(worst, abs(factor - 1))
                    for c in own:
                        total[c] *= factor
        if worst <= close:
            break
    return {c: total[c] / n if n else 0.0 for c, n in cells.items()}


def quotas(targets: list[Row], available: dict[int, int], size: int) -> dict[int, int]:
    """Rows per target: largest remainders of share x size, then at least min_rows, never above what there is.

    Minimums are paid for by the targets furthest above their own minimum. A
    target with fewer rows than it needs takes all and pays nothing.
    """
    exact = {t.target_id: (t.target_share or 0.0) * size for t in targets}
    got = {i: math.floor(x) for i, x in exact.items()}
    spare = min(size, round(sum(exact.values()))) - sum(got.values())
    for i in sorted(got, key=lambda i: (got[i] - exact[i], i))[: max(0, spare)]:
        got[i] += 1
    least = {t.target_id: t.min_rows or 0 for t in targets}
    owed = 0
    for i in got:
        if available[i] < max(least[i], exact[i]):
            least[i] = got[i] = available[i]
        elif got[i] < least[i]:
            owed += least[i] - got[i]
            got[i] = least[i]
    while owed > 0 and got[rich := max(got, key=lambda i: (got[i] - least[i], -i))] > least[rich]:
        step = min(owed, max(1, (got[rich] - least[rich]) // 8))
        got[rich] -= step
        owed -= step
    return {i: min(n, available[i]) for i, n in got.items()}


@dataclass
class QuotaSample:
    #: (target_set, target_id, id and the category columns): the rows drawn for each set.
    sample: DataFrame
    #: One row per target: available, needed and quota, known before anything is drawn.
    plan: DataFrame

    @property
    def report(self) -> DataFrame:
        """One row per target: the plan, and what the sample holds of it: rows drawn, their share of the set's sample and
        the gap to the target's share. ``short``: all rows there are were drawn, and they are fewer than needed."""
        drawn = self.sample.groupBy("target_set", "target_id").agg(F.count("*").alias("drawn"))
        joined = self.plan.join(drawn, ["target_set", "target_id"], "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
        total = F.sum("drawn").over(Window.partitionBy("target_set"))  # one row a target, at most MAX_CELLS
        share = F.when(total > 0, F.col("drawn") / total).otherwise(F.lit(0.0))
        gap = F.coalesce("target_share", F.lit(0.0)) - F.col("drawn_share")
        short = (F.col("drawn") >= F.col("available")) & (F.col("drawn") < F.col("needed"))
        columns = ["target_id", "target_set", "available", "needed", "quota", "drawn", "drawn_share"]
        return joined.withColumn("drawn_share", share).select(*columns, gap.alias("share_gap"), short.alias("short"))


def normal_category(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def first_rows(df: DataFrame, id_col: str, order_col: str, columns: list[str]) -> DataFrame:
    """One row per id, with ``columns`` as in its row of lowest order; combined before the shuffle, so hot ids do no harm."""
    own = picked(df, _id=id_col, _order=order_col, **{f"_{i}": c for i, c in enumerate(columns)}).where("_id is not null")
    first = own.groupBy("_id").agg(F.min_by(F.struct(*[f"_{i}" for i in range(len(columns))]), F.coalesce("_order", F.lit(1 << 62))).alias("_first"))
    return first.select(F.col("_id").alias("id"), *[F.col(f"_first._{i}").alias(c) for i, c in enumerate(columns)])


def quota_sample(rows: DataFrame, targets: DataFrame, categories: list[str], *, fraction: float = 0.1, seed: int = 42) -> QuotaSample:
    """Draws a sample of ``fraction`` of ``rows`` for each target set.

    ``rows`` has a unique ``id`` and the ``categories``, already normalised;
    ``targets`` has a unique target_id, target_set, the categories (NULL where the
    target leaves one open), target_share and min_rows. A target needs the
    greater of min_rows and its share of the sample; one with fewer rows takes
    all and is reported with its gap. A NULL category matches only targets that
    leave it open; rows of no target are counted but not drawn. Empty tables give empty results. The
    draw depends on seed and ids only.
    """
    spark = rows.sparkSession
    rows = picked(rows, id="id", **{c: c for c in categories})
    wanted = bounded_rows(targets.orderBy("target_id"), MAX_CELLS, "targets")

    # one column for each set and choice of fixed categories: the target a row matches there. Weights depend on these only.
    margins: dict[tuple, list[Row]] = {}
    for t in wanted:
        margins.setdefault((t.target_set, tuple(c for c in categories if t[c] is not None)), []).append(t)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    matched = [f"_t{k}" for k in range(len(margins))]
    for name, ((_, fixed), own) in zip(matched, margins.items()):
        if not fixed:  # a target that leaves all open; of several the first
            rows = rows.withColumn(name, F.lit(own[0].target_id))
            continue
        of = {tuple(t[c] for c in fixed): t.target_id for t in reversed(own)}
        listed = spark.createDataFrame([(*k, i) for k, i in of.items()], f"{', '.join(f'_c{k} {kinds[c]}' for k, c in enumerate(fixed))}, {name} int")
        same = reduce(and_, [F.col(c) == F.col(f"_c{k}") for k, c in enumerate(fixed)])
        rows = rows.join(broadcast_if_small(listed), same, "left").select(*rows.columns, name)
    counted = bounded_rows(rows.groupBy(*matched).agg(F.count("*").alias("n")), MAX_CELLS, "combinations of targets") if matched else []
    cells = {tuple(r[c] for c in matched): r["n"] for r in counted}
    population = sum(cells.values())
    size = fraction * population

    sets: dict[str, dict[int, tuple[list[tuple], float]]] = {}
    for t in wanted:
        sets.setdefault(t.target_set, {})[t.target_id] = ([], t.target_share or 0.0)
    set_of = {t.target_id: t.target_set for t in wanted}
    for cell in cells:
        for i in cell:
            if i is not None:
                sets[set_of[i]][i][0].append(cell)
    available = {i: sum(cells[c] for c in own) for margin in sets.values() for i, (own, _) in margin.items()}
    weights = rake(cells, list(sets.values()))

    plan, quota = [], []
    for name, margin in sets.items():
        own = [t for t in wanted if t.target_set == name]
        granted = quotas(own, available, int(size))
        for t in own:
            needed, n = max(float(t.min_rows or 0), (t.target_share or 0.0) * size), granted[t.target_id]
            plan.append((t.target_id, name, available[t.target_id], needed, n, t.target_share))
            quota.append((name, t.target_id, float(n)))
    placed = [(set_of[i], i, *cell, float(weights[cell])) for cell in cells for i in cell if i is not None]

    plan_df = spark.createDataFrame(plan, "target_id int, target_set string, available bigint, needed double, quota bigint, target_share double")
    budgets = spark.createDataFrame(quota, "target_set string, target_id int, budget double")
    cell_columns = [f"_m{k}" for k in range(len(matched))]
    cell_kinds = "".join(f"{c} int, " for c in cell_columns)
    cell_df = broadcast_if_small(spark.createDataFrame(placed, f"target_set string, target_id int, {cell_kinds}weight double"))
    same_cell = reduce(and_, [F.col(c).eqNullSafe(F.col(m)) for c, m in zip(matched, cell_columns)], F.lit(True))
    drawn = rows.join(cell_df, same_cell).select("target_set", "target_id", "id", *categories, "weight")
    # exponential key of the weight, folded into [0, 1): a larger weight gives a smaller key
    exponential = F.log(uniform(F.lit(seed), F.col("target_set"), F.col("id"))) / F.greatest("weight", F.lit(1e-12))
    keyed = drawn.withColumn("_key", 1 - F.exp(exponential))
    sample = lowest(keyed, ["target_set", "target_id"], "_key", "id", budgets).select("target_set", "target_id", "id", *categories)
    return QuotaSample(sample, plan_df)
