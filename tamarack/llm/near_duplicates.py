"""Near-duplicate groups by MinHash banding (problem 2).

Plan: one Arrow pass makes, per row, a content class (equal shingle sets), the
band keys and a sketch of two bits a hash. Exact copies collapse into their class
before anything is shuffled by band. Classes that share a band key are joined on
that key (AQE splits hot keys), a few bands at a time. Their number grows with the
square of the rows where texts share stock phrases, so each row brings its sketch
along and the join itself drops what is too different: nothing quadratic is
written. What is left is made distinct and verified on the full shingle sets of
the two texts, which are made once per class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.llm import _shingles as sh
from tamarack.runtime import broadcast_if_small, picked, spread, written

#: Standard deviations by which a sketch may underrate a pair at the threshold before the pair is dropped unverified.
SKETCH_SIGMAS = 5.0
#: Bands joined at a time, at most.
SLICE_BANDS = 8
#: Low bit of each two-bit hash of a sketch word.
LOW_BITS = 0x5555555555555555


def bands_for(threshold: float, recall: float, rows: int) -> int:
    """Number of bands of ``rows`` hashes that find a pair at ``threshold`` with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def _hash_parameters(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    return (
        rng.integers(1, 2**32, n, dtype=np.uint64) | np.uint64(1)
    ).astype(np.uint32), rng.integers(0, 2**32, n, dtype=np.uint64).astype(np.uint32)


def _minhash(shingle: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """n minima of 32-bit multiply-add hashes over blocks of shingles, so that long texts need no large matrix."""
    low = shingle.astype(np.uint32)
    best = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for s in range(0, len(low), 256):
        h = low[s : s + 256, None] * a[None, :]
        h += b[None, :]
        np.minimum(best, h.min(axis=0), out=best)
    return best


def _signatures(k: int, bands: int, rows: int):
    n = bands * rows
    words = _words(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        a, b = _hash_parameters(n)
        row = TaskContext.get().partitionId() << 33  # numbers the rows, the same if the task is run again
        salts = sh.mix(np.arange(1, bands + 1, dtype=np.uint64))
        seen: set[bytes] = set()  # of this task, whose rows are bounded by the size of its split
        for batch in batches:
            texts = batch.column(1).to_pylist()
            classes, sizes, keys, sketches = [], [], [], []
            with np.errstate(over="ignore"):
                for text, s in zip(texts, sh.shingle_sets(texts, k)):
                    cls = sh.content_class(text, s)
                    classes.append(cls)
                    sizes.append(len(s))
                    if not len(s) or cls in seen:  # one copy per task is enough to find and describe its class
                        keys.append(None)
                        sketches.append(None)
                        continue
                    seen.add(cls)
                    m = _minhash(s, a, b)
                    h = salts.copy()
                    for part in m.astype(np.uint64).reshape(bands, rows).T:
                        h = sh.mix(h * np.uint64(0x9E3779B97F4A7C15) + part)
                    keys.append(h.astype(np.uint32).view(np.int32))  # classes that share one by chance differ in their sketches
                    bits = np.zeros(words * 64, np.uint8)
                    bits[: 2 * n : 2], bits[1 : 2 * n : 2] = (m >> np.uint32(7)) & np.uint32(1), (m >> np.uint32(8)) & np.uint32(1)
                    sketches.append(np.packbits(bits, bitorder="little").view(np.int64))
            numbers = pa.array(range(row, row + len(classes)), pa.int64())
            row += len(classes)
            lists = [pa.array(keys, pa.list_(pa.int32())), pa.array(sketches, pa.list_(pa.int64()))]
            columns = [batch.column(0), numbers, pa.array(classes, pa.binary()), pa.array(sizes, pa.int32()), *lists]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "row", "cls", "n", "keys", "sketch"])

    return run


def _own_shingles(k: int):
    """(row, shingles) of the rows whose text is of the class wanted: an id can have several texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep, lists = batch.column(2).to_pylist(), [], []
            for i, (cls, text, s) in enumerate(zip(batch.column(1).to_pylist(), texts, sh.shingle_sets(texts, k))):
                if cls == sh.content_class(text, s):
                    keep.append(i)
                    lists.append(s.view(np.int64))
            rows = batch.column(0).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows, pa.array(lists, pa.list_(pa.int64()))], names=["row", "shingles"])

    return run


def _words(hashes: int) -> int:
    """Words of a sketch of so many hashes."""
    return -(-hashes // 32)


def _differing(words: int) -> Column:
    """Hashes in which the sketches x0, x1, ... and y0, y1, ... differ; plain columns, so that the join compiles it."""
    each = (F.col(f"x{i}").bitwiseXOR(F.col(f"y{i}")) for i in range(words))
    return sum((F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(F.lit(LOW_BITS))) for d in each), F.lit(0))


def _lowest_linked(edges: DataFrame) -> DataFrame:
    """(u, v): each node of the undirected ``edges`` (u, v) that is not the lowest of its component, with the lowest one.

    Large-star and small-star in turn, until every component is a star around
    its lowest node. Rounds grow with the logarithm of the longest chain;
    each is written, and nothing but the answer "is it done" goes to the driver.
    """
    u, v, m = F.col("u"), F.col("v"), F.col("m")
    edges = written(edges.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "edges")
    while True:
        # a star has centres without a lower neighbour, and other nodes with one
        ends = edges.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
            edges.select(v.alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down"))
        )
        if ends.groupBy("u").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).where("up > 1 or up = 1 and down > 0").isEmpty():
            return edges
        both = edges.unionByName(edges.select(v.alias("u"), u.alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = written(both.join(lowest, "u").where(v > u).select(v.alias("u"), m.alias("v")).distinct(), "large-star")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where(v != m).select(v.alias("u"), m.alias("v")).unionByName(lowest.select("u", m.alias("v")))
        edges = written(small.distinct(), "small-star")


class NearDuplicates:
    """Result of :func:`near_duplicates`: ``members`` and the ``links`` between classes."""

    def __init__(self, members: DataFrame, links: DataFrame):
        #: (id, cls, n): one row per distinct id and content class.
        self.members = members
        #: (cls_a < cls_b, similarity): each pair of different classes at or above the threshold.
        self.links = links

    def pairs(self) -> DataFrame:
        """(id_a < id_b): every pair of different ids that share a class or a linked pair of classes, once."""
        m = self.members.select("id", "cls")
        a, b = m.select(F.col("id").alias("x"), F.col("cls").alias("cls_a")), m.select(F.col("id").alias("y"), F.col("cls").alias("cls_b"))
        within = a.join(
            b,
            (F.col("cls_a") == F.col("cls_b")) & (F.col("x") < F.col("y"))
        ).select(F.col("x").alias("id_a"), F.col("y").alias("id_b"))
        across = self.links.join(a, "cls_a").join(b, "cls_b").where("x <> y").select(
            F.least("x", "y").alias("id_a"),
            F.greatest("x", "y").alias("id_b")
        )
        return within.unionByName(across).distinct()

    def groups(self) -> DataFrame:
        """(cls, group) of each class of a group of several: its connected component over the verified links, named by its lowest class.

        Classes of one id are in one group, so groups are the components of :meth:`pairs`.
        A group can be a chain: its ends need not be similar to each other.
        """
        several = self.members.groupBy("id").agg(F.min("cls").alias("v"), F.max("cls").alias("_last")).where(F.col("v") != F.col("_last"))
        of_one_id = self.members.join(several, "id").select(F.col("cls").alias("u"), "v")
        found = _lowest_linked(self.links.select(F.col("cls_a").alias("u"), F.col("cls_b").alias("v")).unionByName(of_one_id))
        return found.unionByName(found.select(F.col("v").alias("u"), "v").distinct()).toDF("cls", "group")

    def linked(self) -> DataFrame:
        """(id, cls, group, copies, links): per id its class of equal texts, its group of near-same ones, how many other ids
        share the class and how many other classes are linked to it. An id has a row per class, all in one group."""
        copies = self.members.groupBy("cls").agg((F.count("*") - 1).alias("copies"))
        ends = self.links.select(F.explode(F.array("cls_a", "cls_b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("links"))
        own = self.members.select("id", "cls").join(copies, "cls").join(ends, "cls", "left").join(self.groups(), "cls", "left")
        return own.select(
            "id",
            F.lower(F.hex("cls")).alias("cls"),
            F.lower(F.hex(F.coalesce("group", "cls"))).alias("group"),
            "copies",
            F.coalesce("links", F.lit(0)).alias("links")
        )


def near_duplicates(df: DataFrame, id_col: str, text_col: str, *, shingle: int = 5, threshold: float = 0.8, recall: float = 0.99, rows: int = 4) -> NearDuplicates:
    """Classes of texts with equal shingle sets and links between classes of Jaccard similarity >= ``threshold``.

    Shingles are runs of ``shingle`` words after lower-casing and dropping
    accents. Banding finds a pair exactly at the threshold with probability
    ``recall`` and more similar ones more surely; similarity is then exact.
    NULL ids or texts take no part. Texts of fewer than ``shingle`` words
    (empty ones too) have no shingles: they match equal texts only. Repeated
    rows of an id count once per class. An empty table gives empty results.
    Other columns are ignored, whatever their names.
    """
    bands = bands_for(threshold, recall, rows)
    hashes = bands * rows
    docs = spread(picked(df, id=id_col, text=text_col).where("id is not null and text is not null"))
    id_type = docs.schema["id"].dataType.simpleString()
    signed = f"id {id_type}, row bigint, cls binary, n int, keys array<int>, sketch array<bigint>"
    sig = written(docs.mapInArrow(_signatures(shingle, bands, rows), signed), "minhash")

    # Of a class that several tasks met, one row goes on: copies would else pair up in every band, once per two tasks.
    keyed = sig.where("keys is not null")
    met = keyed.groupBy("cls").agg(F.min("row").alias("first"), F.count("*").alias("tasks"))
    copied = written(met.where("tasks > 1").select("cls", "first"), "copied")
    once = keyed.join(broadcast_if_small(copied), "cls", "left").where("first is null or row = first")

    # At the threshold two sketches agree in t + (1 - t) / 4 of their hashes; what is below by SKETCH_SIGMAS deviations can't reach it.
    words = _words(hashes)
    agree = threshold + (1 - threshold) / 4
    differ = hashes * (1 - agree) + SKETCH_SIGMAS * math.sqrt(hashes * agree * (1 - agree))
    alike = (F.col("a") < F.col("b")) & (F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b")) & (_differing(words) <= differ)

    # Classes, by the number of their row, that share a band key. Both sides are one exchange, read twice; AQE splits a
    # hot key's partition. The rows by band are many times the input: their shuffle goes before that of the next bands.
    size = math.ceil(bands / math.ceil(bands / SLICE_BANDS))
    found = []
    for begin in range(0, bands, size):
        key = F.explode(F.slice("keys", begin + 1, size)).alias("key")
        band = once.select("row", "n", *[F.get("sketch", F.lit(i)).alias(f"s{i}") for i in range(words)], key)
        left, right = (band.toDF(x, f"n_{x}", *[f"{w}{i}" for i in range(words)], "key") for x, w in (("a", "x"), ("b", "y")))
        pairs = left.join(right, "key").where(alike)
        found.append(written(pairs.select("a", "b").distinct(), "alike"))
    likely = written(reduce(DataFrame.unionByName, found).distinct(), "likely")

    # The full shingle set of one row of each class that is in a likely pair: made once, compared inside the JVM.
    involved = likely.select(F.explode(F.array("a", "b")).alias("row")).distinct()
    first = written(involved.join(sig.select("row", "cls", "id"), "row"), "involved")
    wanted = docs.join(broadcast_if_small(first), "id").select("row", "cls", "text")
    sets = wanted.mapInArrow(_own_shingles(shingle), "row bigint, shingles array<bigint>").dropDuplicates(["row"])
    sets = written(sets, "shingles")  # so that the texts moved for it are gone before the sets are
    pairs = likely.join(sets.toDF("a", "s_a"), "a").join(sets.toDF("b", "s_b"), "b")
    common = F.size(F.array_intersect("s_a", "s_b"))
    similarity = common / (F.size("s_a") + F.size("s_b") - common)
    near = pairs.select("a", "b", similarity.alias("similarity")).where(F.col("similarity") >= threshold)
    name = broadcast_if_small(first.select("row", "cls"))
    named = near.join(name.toDF("a", "x"), "a").join(name.toDF("b", "y"), "b")
    links = named.select(F.least("x", "y").alias("cls_a"), F.greatest("x", "y").alias("cls_b"), "similarity")
    members = sig.select("id", "cls", "n").distinct()
    return NearDuplicates(members, written(links, "links"))
