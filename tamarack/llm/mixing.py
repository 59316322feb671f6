"""Sources mixed to target weights with capped repeats (problem 7).

Sizes are summed per source. Sources that reach their weight get it; what the
others fall short of goes to those with room, along a tempered path: weights and
token shares are raised to exponents x and 1 - x, and x is bisected so that the
result is as near to the target weights as the repeat limits allow. Without
target weights, the natural shares are tempered themselves, to an entropy or to
the repeat limits. Budgets are realised as passes over blocks of documents: each
pass has the blocks in another order, and the last one ends within a block.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamarack.llm._ranked import BINS, lowest, uniform
from tamarack.llm.quota_sample import bounded_rows
from tamarack.llm.tokens import VOCABULARY, with_tokens
from tamarack.runtime import broadcast_if_small, picked, written

#: Sources the driver may hold.
MAX_SOURCES = 100_000


def tempered(sizes: dict[str, float], exponent: float) -> dict[str, float]:
    """Shares of sizes raised to the exponent: 1 keeps them, 0 makes them equal, more sharpens them."""
    logs = {s: exponent * math.log(n) for s, n in sizes.items() if n > 0}
    top = max(logs.values(), default=0.0)
    raised = {s: math.exp(x - top) for s, x in logs.items()}
    whole = sum(raised.values())
    return {s: x / whole for s, x in raised.items()}


def entropy(shares: dict[str, float]) -> float:
    return -sum(p * math.log(p) for p in shares.values() if p > 0)


def bisect(f: Callable[[float], float], low: float, high: float, rounds: int = 80) -> float:
    """Where the falling f crosses 0 between low and high; the nearer end if it doesn't."""
    if f(low) <= 0:
        return low
    if f(high) >= 0:
        return high
    for _ in range(rounds):
        middle = (low + high) / 2
        low, high = (middle, high) if f(middle) > 0 else (low, middle)
    return (low + high) / 2


def exponent_for_entropy(sizes: dict[str, float], target: float) -> float:
    """Exponent whose shares have the entropy ``target``: from equal shares at 0 it falls as the exponent grows."""
    return bisect(lambda x: entropy(tempered(sizes, x)) - target, 0.0, 16.0)


def exponent_for_repeats(sizes: dict[str, float], total: float, most: dict[str, int]) -> float:
    """Smallest exponent in [0, 1], so the flattest shares, at which no source is repeated more than allowed.

    Small sources want a larger exponent, large ones with few repeats a smaller
    one, so the first allowed one of a grid is sought and refined; if there is
    none, the one that exceeds the limits least.
    """
    excess = lambda x: max((p * total / (sizes[s] * max(most[s], 1e-9)) for s, p in tempered(sizes, x).items()), default=0.0) - 1 - 1e-12
    grid = [k / 128 for k in range(129)]
    over = [excess(x) for x in grid]
    first = next((k for k, e in enumerate(over) if e <= 0), None)
    if first is None:
        return grid[over.index(min(over))]
    return bisect(excess, grid[first - 1], grid[first]) if first else 0.0


def toward(weights: dict[str, float], sizes: dict[str, float], exponent: float) -> dict[str, float]:
    """Shares in proportion to weight^x size^(1 - x): the natural token shares at 0, the target weights at 1."""
    logs = {s: exponent * math.log(weights[s]) + (1 - exponent) * math.log(sizes[s]) for s in weights}
    top = max(logs.values(), default=0.0)
    raised = {s: math.exp(x - top) for s, x in logs.items()}
    whole = sum(raised.values())
    return {s: x / whole for s, x in raised.items()}


def budgets(sizes: dict[str, float], weights: dict[str, float], most: dict[str, int], total: float) -> tuple[dict[str, float], float]:
    """Tokens each source gives, and the exponent at which those with room filled up what the others lack.

    No source gets less than its weight of ``total`` unless that exceeds its size
    times its repeats, and none more than those. The exponent is the largest in
    [0, 1] at which what is lacking fits; where none does, sources full at 0 are
    filled and the rest goes on. 1 if nothing is lacking.
    """
    limit = {s: sizes.get(s, 0.0) * most[s] for s in weights}
    given = {s: min(w * total, limit[s]) for s, w in weights.items()}
    lacking, exponent = sum(w * total for w in weights.values()) - sum(given.values()), 1.0
    while lacking > 1e-9 * total:
        free = {s: weights[s] for s in weights if weights[s] > 0 and limit[s] > given[s] * (1 + 1e-12)}
        if not free:
            break
        excess = lambda x: max((given[s] + lacking * p) / limit[s] for s, p in toward(free, sizes, x).items()) - 1 - 1e-12
        grid = [k / 128 for k in range(129)]
        fits = [x for x in grid if excess(x) <= 0]
        if fits:
            top = fits[-1]
            exponent = top if top == 1.0 else bisect(lambda x: -excess(x), top, top + 1 / 128)
            exponent = exponent if excess(exponent) <= 0 else top
            given |= {s: given[s] + lacking * p for s, p in toward(free, sizes, exponent).items()}
            break
        exponent = 0.0
        for s, p in toward(free, sizes, 0.0).items():
            if given[s] + lacking * p > limit[s]:
                given[s] = limit[s]
        lacking = sum(w * total for w in weights.values()) - sum(given.values())
    return given, exponent


@dataclass
class Mixture:
    #: (id, source, tokens, pass, key): a row for each use of a document; ``key`` in [0, 1) orders a source's pass.
    uses: DataFrame
    #: One row per target source: size, target, budget, exponents.
    plan: DataFrame

    @property
    def documents(self) -> DataFrame:
        """(id, source, tokens, pass, block, position): the uses in the order of each source's passes.

        A block's place in the pass is the whole part of key x BINS. Positions are counted by block first, so that no
        pass is sorted in one task.
        """
        placed = self.uses.withColumn("block", F.floor(F.col("key") * BINS).cast("int"))
        sizes = placed.groupBy("source", "pass", "block").agg(F.count("*").alias("n"))
        before = F.sum("n").over(Window.partitionBy("source", "pass").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
        starts = sizes.select("source", "pass", "block", F.coalesce(before, F.lit(0)).alias("before"))
        inside = F.row_number().over(Window.partitionBy("source", "pass", "block").orderBy("key", "row"))
        joined = placed.join(starts, ["source", "pass", "block"])
        return joined.select("id", "source", "tokens", "pass", "block", (F.col("before") + inside).alias("position"))

    @property
    def repeats(self) -> DataFrame:
        """(id, source, tokens, repeats): how often each document is used; unused ones are not listed, equal ids are one row."""
        return self.uses.groupBy("id", "source").agg(F.max("tokens").alias("tokens"), F.count("*").alias("repeats"))

    @property
    def report(self) -> DataFrame:
        """The plan with what the uses realise: tokens given and their share of the mixture. ``short`` is a source that,
        with all its repeats, gives less than its target."""
        given = self.uses.groupBy("source").agg(F.sum("tokens").alias("given_tokens"))
        joined = self.plan.join(given, "source", "left").withColumn("given_tokens", F.coalesce("given_tokens", F.lit(0)))
        whole = F.sum("given_tokens").over(Window.partitionBy())  # one row a target source, at most MAX_SOURCES
        share = F.coalesce(F.try_divide("given_tokens", whole), F.lit(0.0))
        return joined.select("*", share.alias("actual_share"), (F.col("given_tokens") < F.col("target_tokens") * (1 - 1e-9)).alias("short"))


def mix_sources(
    df: DataFrame,
    id_col: str,
    text_col: str,
    source_col: str,
    targets: DataFrame,
    *,
    total: float | None = None,
    target_entropy: float | None = None,
    seed: int = 42,
    vocabulary: str = VOCABULARY,
) -> Mixture:
    """Combines documents so that each target source has ``target_weight`` of ``total`` tokens.

    ``targets`` has source, target_weight and max_repeats (NULL: 1). NULL weights
    make all weights tempered natural shares: of the entropy ``target_entropy``,
    or the flattest within the repeat limits. ``total`` is the size of all of
    ``df`` unless given. A source gives whole passes over its documents, then the
    part of one more that ends with the document which reaches the budget, never
    more than max_repeats passes; one too small gives all it has and is ``short``.
    A source in targets but not in ``df`` has size 0. Documents of other sources
    and of a NULL source only count for the total; NULL and empty texts have no
    tokens. Repeated rows are documents of their own. Empty tables give an empty
    mixture. The order depends on seed, ids and row numbers.
    """
    spark = df.sparkSession
    counted = with_tokens(picked(df, id=id_col, source=source_col, text=text_col), ["id", "source"], "text", vocabulary)
    sized = written(counted.withColumn("row", F.monotonically_increasing_id()), "sizes")
    wanted = {r.source: r for r in bounded_rows(targets.where("source is not null"), MAX_SOURCES, "sources")}
    sums = {r.source: float(r.n) for r in bounded_rows(sized.groupBy("source").agg(F.sum("tokens").alias("n")), MAX_SOURCES, "sources")}
    if total is None:
        total = sum(sums.values())
    sizes = {s: sums.get(s, 0.0) for s in wanted}
    most = {s: int(r.max_repeats) if r.max_repeats is not None else 1 for s, r in wanted.items()}
    weights, natural = {s: r.target_weight for s, r in wanted.items()}, None
    if any(w is None for w in weights.values()):
        natural = exponent_for_repeats(sizes, total, most) if target_entropy is None else exponent_for_entropy(sizes, target_entropy)
        shares = tempered(sizes, natural)
        weights = {s: shares.get(s, 0.0) for s in wanted}
    given, filled = budgets(sizes, weights, most, total)

    rows, ends = [], []
    for s in wanted:
        # a hair below a whole number of passes is that number
        passes = min(most[s], int(given[s] / sizes[s] + 1e-9)) if sizes[s] else 0
        rest = given[s] - passes * sizes[s] if passes < most[s] else 0.0
        rows.append((s, int(sizes[s]), float(weights[s]), most[s], weights[s] * total, given[s], natural, filled))
        ends.append((s, passes, rest if rest > 0.5 else 0.0))
    kinds = "source string, size_tokens bigint, target_weight double, max_repeats int, target_tokens double, budget_tokens double, share_exponent double, fill_exponent double"
    plan = spark.createDataFrame(rows, kinds)
    passes = broadcast_if_small(spark.createDataFrame(ends, "source string, passes int, budget double"))

    # a document's block is the same in all passes; the blocks' order is another permutation of 0 .. BINS - 1 in each
    number = F.col("pass")
    block = F.floor(uniform(F.lit(seed), F.col("id"), F.col("row")) * BINS)
    factor = F.pmod(F.xxhash64(F.lit(seed), F.col("source"), number), F.lit(BINS // 2)) * 2 + 1
    start = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("source"), number), F.lit(BINS))
    key = ((block * factor + start) % BINS + uniform(F.lit(seed), number, F.col("id"), F.col("row"))) / BINS
    own = sized.join(passes, "source")
    whole = own.where("passes > 0").withColumn("pass", F.explode(F.sequence(F.lit(1), F.col("passes")))).withColumn("key", key)
    more = own.where("budget > 0").withColumn("pass", F.col("passes") + 1).withColumn("key", key)
    ending = passes.where("budget > 0").select("source", "budget")
    columns = ["id", "source", "tokens", "pass", "key", "row"]
    uses = whole.select(*columns).unionByName(lowest(more, ["source"], "key", "row", ending, F.col("tokens")).select(*columns))
    return Mixture(uses, plan)
