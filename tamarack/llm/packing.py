"""Documents packed into containers of fixed capacity (problem 6).

Only ids and sizes leave the tokenizing pass. Rows are dealt at random into
blocks of bounded size, and each block is packed on its own: a block loses at
most about one container's slack. Within a block, dominance fixes sets of up to
three documents for good, again and again until no document has a dominating
set; the rest goes best-fit, largest first. How much was fixed, and how far the
result is from a lower bound, is reported.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm.quota_sample import bounded_rows
from tamarack.llm.tokens import VOCABULARY, with_tokens
from tamarack.runtime import picked, written

#: Documents packed together.
BLOCK = 20_000
#: Capacities in one call.
MAX_CAPACITIES = 1_000


class _Sizes:
    """Multiset of item numbers by size."""

    def __init__(self, sizes: list[int]):
        self.items: dict[int, list[int]] = {}
        for i, s in enumerate(sizes):
            self.items.setdefault(s, []).append(i)
        self.order = sorted(self.items)
        self.left = len(sizes)

    def take(self, size: int) -> int:
        own = self.items[size]
        item = own.pop()
        self.left -= 1
        if not own:
            del self.items[size]
            self.order.pop(bisect_left(self.order, size))
        return item

    def put(self, size: int, item: int) -> None:
        if size not in self.items:
            insort(self.order, size)
        self.items.setdefault(size, []).append(item)
        self.left += 1

    def at_most(self, size: int) -> int | None:
        """Largest size not above ``size``."""
        k = bisect_right(self.order, size)
        return self.order[k - 1] if k else None

    def smallest(self, n: int) -> list[int]:
        """Up to n smallest sizes, repeated ones repeatedly."""
        out: list[int] = []
        for s in self.order:
            out += [s] * min(n - len(out), len(self.items[s]))
            if len(out) >= n:
                break
        return out

    def best_pair(self, room: int) -> tuple[int, int] | None:
        """Sizes of two items of largest sum that fit into ``room``, the smaller first; of equal sums the one with the largest item."""
        best, pair = -1, None
        lo, hi = 0, bisect_right(self.order, room) - 1
        while lo <= hi:
            a, b = self.order[lo], self.order[hi]
            if a + b > room or (lo == hi and len(self.items[a]) < 2):
                hi -= 1
                continue
            if a + b > best:
                best, pair = a + b, (a, b)
            lo += 1
        return pair


def dominating(sizes: _Sizes, size: int, capacity: int) -> tuple[int, ...] | None:
    """Sizes that some best packing puts beside an item of ``size`` (already taken out), or None if no such set is known.

    A set S beside the item dominates if the companions of the item in any other
    container fit, in parts, into the places of S. That holds if

    * nothing fits beside the item;
    * one item fills the room, or only one more can fit: the largest that fits;
    * two more can fit but not three, and no pair weighs more than the largest
      single one: that one;
    * two more can fit but not three, and the heaviest pair has the largest that
      fits and beside it the largest that fits then: no companions exceed it in either place.
    """
    room = capacity - size
    single = sizes.at_most(room)
    if single is None:
        return ()
    if single == room:
        return (single,)
    least = sizes.smallest(3)
    if len(least) < 2 or least[0] + least[1] > room:
        return (single,)
    if len(least) == 3 and sum(least) <= room:
        return None
    pair = sizes.best_pair(room)
    if pair is None or sum(pair) <= single:
        return (single,)
    # any pair (x <= y) has y <= single; S = (a, single) dominates it if x <= a, which holds if no feasible x exceeds a
    low, high = pair
    if high == single:
        k = bisect_right(sizes.order, low)
        above = sizes.order[k] if k < len(sizes.order) else None
        if above is None or 2 * above > room or (above == single and len(sizes.items[above]) < 2):
            return pair
    return None


def reduce_by_dominance(sizes: _Sizes, capacity: int) -> list[list[int]]:
    """Containers that some best packing has: every item from the largest on is tried, and all again after a pass that fixed any."""
    fixed: list[list[int]] = []
    changed = True
    while changed and sizes.left:
        changed = False
        for size in reversed(list(sizes.order)):
            while size in sizes.items:
                item = sizes.take(size)
                beside = dominating(sizes, size, capacity)
                if beside is None:
                    sizes.put(size, item)
                    break
                fixed.append([item, *map(sizes.take, beside)])
                changed = True
    return fixed


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Containers that any packing needs: the Martello-Toth bound L2. ``counts`` has the items of each size, 0 to capacity."""
    sizes = np.arange(capacity + 1)
    n, weight = np.cumsum(counts), np.cumsum(counts * sizes)
    k = np.arange(capacity // 2 + 1)
    half = capacity // 2
    alone = n[capacity] - n[capacity - k]  # larger than capacity - k: nothing of size k or more fits beside them
    large, large_weight = n[capacity - k] - n[half], weight[capacity - k] - weight[half]
    before = np.maximum(k - 1, 0)
    small = weight[half] - np.where(k > 0, weight[before], 0)
    more = np.ceil(np.maximum(0, small - (large * capacity - large_weight)) / capacity).astype(np.int64)
    return int((alone + large + more).max(initial=0))


def best_fit(sizes: _Sizes, capacity: int) -> list[list[int]]:
    """Largest item first, each into the fullest container that still takes it."""
    rooms: list[int] = []
    by_room: dict[int, list[int]] = {}
    containers: list[list[int]] = []
    for size in reversed(list(sizes.order)):
        for item in sizes.items[size]:
            k = bisect_left(rooms, size)
            if k < len(rooms):
                room = rooms[k]
                c = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room]
                    rooms.pop(k)
            else:
                room, c = capacity, len(containers)
                containers.append([])
            containers[c].append(item)
            if room > size:
                if room - size not in by_room:
                    insort(rooms, room - size)
                by_room.setdefault(room - size, []).append(c)
    return containers


def pack(sizes: list[int], capacity: int) -> tuple[list[int], list[bool]]:
    """Container number of each item, and whether dominance fixed it; every size is in 1..capacity."""
    left = _Sizes(sizes)
    number, fixed = [0] * len(sizes), [False] * len(sizes)
    certain = reduce_by_dominance(left, capacity)
    for c, items in enumerate([*certain, *best_fit(left, capacity)]):
        for i in items:
            number[i], fixed[i] = c, c < len(certain)
    return number, fixed


def pack_tokens(sized: DataFrame, capacities: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """(capacity, id, part, parts, tokens, container, fixed) for each capacity and each piece of a document.

    ``sized`` has ``id`` and ``tokens``. A document above the capacity is cut
    into full containers and a rest that is packed like any item; no other is
    split. ``fixed`` tells pieces that dominance placed. Documents of no tokens
    (NULL or empty texts) take no room: they are listed with the first container
    of their block and a size of 0. Repeated and NULL ids are packed as the rows
    they are, dealt over the blocks like any others. Capacities below 1 or NULL
    are ignored; an empty table gives an empty result.
    """
    id_type = sized.schema["id"].dataType.simpleString()
    wanted = sorted({int(r[0]) for r in bounded_rows(capacities.distinct(), MAX_CAPACITIES, "capacities") if r[0] is not None and r[0] >= 1})
    # rows are numbered and kept, so that a row of a lost task falls into the same block again
    numbered = written(sized.select("id", "tokens", F.monotonically_increasing_id().alias("_row")), "numbered")
    blocks = max(1, math.ceil(numbered.count() / block))
    dealt = numbered.withColumn("_block", F.pmod(F.xxhash64("_row"), F.lit(blocks)).cast("bigint"))
    every = F.array(*[F.lit(c) for c in wanted]).cast("array<int>")
    each = dealt.select(F.explode(every).alias("capacity"), "_block", "id", "tokens")

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        capacity, number = int(key[0]), int(key[1])
        tokens = rows["tokens"].to_numpy(np.int64)
        full = np.where(tokens > capacity, (tokens - 1) // capacity, 0)
        rest = tokens - full * capacity
        items = np.flatnonzero(rest > 0)
        place, fixed = np.zeros(len(rows), np.int64), np.zeros(len(rows), bool)
        place[items], fixed[items] = pack(rest[items].tolist(), capacity)
        used = int(place.max(initial=0)) + 1
        at = np.repeat(np.arange(len(rows)), full)
        first = np.repeat(np.cumsum(full) - full, full)
        return pd.DataFrame(
            {
                "capacity": np.int32(capacity),
                "id": pd.concat([rows["id"], rows["id"].iloc[at]], ignore_index=True),
                "part": np.concatenate([full, np.arange(len(at)) - first]).astype(np.int32),
                "parts": np.concatenate([full + 1, full[at] + 1]).astype(np.int32),
                "tokens": np.concatenate([rest, np.full(len(at), capacity)]),
                "container": (number << 32) + np.concatenate([place, used + np.arange(len(at))]),
                "fixed": np.concatenate([fixed, np.ones(len(at), bool)]),
            }
        )

    result = f"capacity int, id {id_type}, part int, parts int, tokens bigint, container bigint, fixed boolean"
    return each.groupBy("capacity", "_block").applyInPandas(run, result)


def pack_documents(df: DataFrame, id_col: str, text_col: str, capacities: DataFrame, *, vocabulary: str = VOCABULARY, block: int = BLOCK) -> DataFrame:
    """:func:`pack_tokens` of the texts of ``df``, sized by a public tokenizer."""
    return pack_tokens(with_tokens(picked(df, id=id_col, text=text_col), ["id"], "text", vocabulary), capacities, block=block)


def containers(packed: DataFrame) -> DataFrame:
    """(capacity, pieces, fixed, containers, lower_bound, tokens, fill): what dominance fixed, how full the containers are
    and the fewest that any packing of these pieces needs."""
    own = packed.where("tokens > 0")
    totals = own.groupBy("capacity").agg(
        F.count("*").alias("pieces"),
        F.count_if("fixed").alias("fixed"),
        F.count_distinct("container").alias("containers"),
        F.sum("tokens").alias("tokens"),
    )

    def bound(rows: pd.DataFrame) -> pd.DataFrame:  # one row a size, so at most capacity rows
        capacity = int(rows["capacity"].iloc[0])
        counts = np.bincount(rows["tokens"], weights=rows["n"], minlength=capacity + 1).astype(np.int64)
        return pd.DataFrame({"capacity": [capacity], "lower_bound": [lower_bound(counts, capacity)]})

    sizes = own.groupBy("capacity", "tokens").agg(F.count("*").alias("n"))
    bounds = sizes.groupBy("capacity").applyInPandas(bound, "capacity int, lower_bound bigint")
    fill = F.col("tokens") / (F.col("containers") * F.col("capacity"))
    return totals.join(bounds, "capacity").select("capacity", "pieces", "fixed", "containers", "lower_bound", "tokens", fill.alias("fill"))
