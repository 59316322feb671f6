"""Evaluation records that also stand in training texts (problem 3).

Passages are runs of k words of the normalised texts. An index over the rarer
passages of the evaluation records finds the pairs of a record and a training
text that can be near-same; of each such pair, the Aho-Corasick automaton over
all passages of the record scans the training text: the matched intervals are
merged into its coverage, and similarity is exact.

The index loses no pair. Passages are ordered, rarest first, by how many
evaluation texts hold their bucket, then by hash: the same order in all texts.
Of sets of a and b passages that share enough, the first shared one is near
the front in both, so only these fronts are indexed and looked up; the rest
that both have after it, and the passages by which sets of bits prove the
texts to differ, bound what they can share.

Evaluation records are dealt into shards of bounded size: one index is on the
driver and in the workers at a time, and is released before the next. What a
shard costs is one lookup for each passage at the front of a training text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm import _shingles as sh
from tamarack.runtime import picked, spread, written

#: Indexed passages in one shard (a longer record is one of its own), so also what the driver and a broadcast hold at a time.
SHARD = 4_000_000
#: Buckets in which passages are counted, as a power of two; the counts are on the driver and in every worker.
BUCKETS = 22
#: Bits for each passage of a text, and the most for a text.
BITS, MOST_BITS = 2.5, 1 << 16
#: Pairs compared at a time; texts prepared, and texts looked up at a time.
PAIRS, TEXTS, LOOKED_UP = 1 << 16, 1_000, 5_000
#: For sums and products of fractions that are whole numbers.
HAIR = 1e-6


def _classes(k: int):
    """(id, cls, text): the text only on the first row of its class in a task, which is enough to describe it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            classes = [sh.content_class(t, s) for t, s in zip(texts, sh.shingle_sets(texts, k))]
            for i, cls in enumerate(classes):
                if cls in seen:
                    texts[i] = None
                seen.add(cls)
            columns = [batch.column(0), pa.array(classes, pa.binary()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "cls", "text"])

    return run


def _bucket(passages: np.ndarray) -> np.ndarray:
    return (passages >> np.uint64(64 - BUCKETS)).astype(np.int64)


def _counts(k: int):
    """(bucket, held): in how many texts of the task a passage of the bucket stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << BUCKETS, np.int64)
        for batch in batches:
            sets = sh.shingle_sets(batch.column(1).to_pylist(), k)
            met, times = np.unique(_bucket(np.concatenate([*sets, np.empty(0, np.uint64)])), return_counts=True)
            held[met] += times
        met = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(held[met])], names=["bucket", "held"])

    return run


def _widths(n: np.ndarray) -> np.ndarray:
    """Bits of a text of n passages: a power of two."""
    return np.clip(2 ** np.ceil(np.log2(np.maximum(n, 1) * BITS)), 64, MOST_BITS).astype(np.int64)


def _parities(passages: np.ndarray, own: np.ndarray, texts: int, width: int) -> list[bytes]:
    """Of each text, for each value of the lowest bits, whether the passages with it are odd in number."""
    bits = np.bincount(own * width + (passages & np.uint64(width - 1)).astype(np.int64), minlength=texts * width) & 1
    rows = np.packbits(bits.astype(np.uint8).reshape(texts, width), axis=1, bitorder="little")
    return [r.tobytes() for r in rows]


def _ends(n, at, threshold: float) -> np.ndarray:
    """The largest set with which one of n passages can be near-same if the first shared passage is its at-th: n - at passages are left."""
    return np.floor((n - at) * (1 + threshold) / threshold - n + HAIR).astype(np.int64)


def _least(n, threshold: float) -> np.ndarray:
    """The smallest set with which one of n passages can be near-same."""
    return np.ceil(n * threshold - HAIR).astype(np.int64)


def _fronts(level, k: int, threshold: float, indexed: bool):
    """(cls, n, passages, at, bits): of each text with passages, how many it has, 32 bits of each in its front, their places and its bits.

    Bits are as wide as those of the largest near-same text if ``indexed``; else as its own. Passages that stand in no
    evaluation text, and texts that have only such in front, are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, TEXTS):
                part = batch.slice(begin, TEXTS)
                sets = sh.shingle_sets(part.column(1).to_pylist(), k)
                n = np.fromiter(map(len, sets), np.int64, len(sets))
                flat, own = np.concatenate(sets), np.repeat(np.arange(len(n)), n)
                rank = level.value[_bucket(flat)]
                # a set is in order of its hashes, so a stable sort orders by level, then by the whole hash
                order = np.argsort((own << 8) | rank, kind="stable")
                at = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
                front = (at <= (n - _least(n, threshold))[own]) & (rank[order] > 0)
                keep = order[front]
                counts = np.bincount(own[keep], minlength=len(n))
                rows = np.flatnonzero(counts)
                bits, widths = np.empty(len(n), object), _widths(np.floor(n / threshold + HAIR) if indexed else n)
                for width in np.unique(widths[rows]).tolist():
                    chosen = np.flatnonzero((widths == width) & (counts > 0))
                    for first in range(0, len(chosen), step := max(1, (1 << 22) // width)):
                        some = chosen[first : first + step]
                        number = np.full(len(n), -1)
                        number[some] = np.arange(len(some))
                        inside = number[own] >= 0
                        bits[some] = _parities(flat[inside], number[own[inside]], len(some), width)
                ends = pa.array(np.concatenate([[0], np.cumsum(counts[rows])]).astype(np.int32))
                lists = [(flat[keep] >> np.uint64(32)).astype(np.uint32).view(np.int32), at[front].astype(np.int32)]
                columns = [
                    part.column(0).take(pa.array(rows)),
                    pa.array(n[rows].astype(np.int32)),
                    *(pa.ListArray.from_arrays(ends, pa.array(x)) for x in lists),
                    pa.array(bits[rows].tolist(), pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["cls", "n", "passages", "at", "bits"])

    return run


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All elements, and the row of each."""
    return lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))


def _words(bits: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(bits.to_pylist()), np.uint64).reshape(len(bits), width // 64)


def _ones(words: np.ndarray) -> np.ndarray:
    """Bits set in each row."""
    ones = np.bitwise_count(words)
    if ones.shape[1] % 8:
        return ones.sum(axis=1, dtype=np.int64)
    lanes = np.ascontiguousarray(ones).view(np.uint64)  # eight counts of up to 64 each
    low = np.uint64(0x00FF00FF00FF00FF)
    lanes = (lanes & low) + ((lanes >> np.uint64(8)) & low)
    with np.errstate(over="ignore"):
        lanes = (lanes * np.uint64(0x0001000100010001)) >> np.uint64(48)
    return (lanes[:, 0] if lanes.shape[1] == 1 else lanes.sum(axis=1)).astype(np.int64)


class Index:
    """Passages in front of some records, ordered by passage and size of the record."""

    def __init__(self, records: pa.Table, threshold: float):
        self.threshold = threshold
        whole = {c: pa.concat_arrays(records.column(c).chunks) if records.num_rows else None for c in records.column_names}
        self.n = whole["n"].to_numpy().astype(np.int64) if records.num_rows else np.empty(0, np.int64)
        if not len(self.n):
            return
        self.cls = whole["cls"]
        passages, own = _flat(whole["passages"])
        keys = (passages.view(np.uint32).astype(np.uint64) << np.uint64(32)) | self.n[own].astype(np.uint64)
        order = np.argsort(keys)
        self.keys, self.record = keys[order], own[order].astype(np.int32)
        self.most = np.minimum(_ends(self.n[own], _flat(whole["at"])[0], threshold), (1 << 31) - 1).astype(np.int32)[order]
        # a text is compared at its own width: the wider bits of a record are folded
        self.bits: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        widths, lowest = pc.binary_length(whole["bits"]).to_numpy() * 8, _widths(_least(self.n, threshold))
        parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for width in np.unique(widths).tolist():
            rows = np.flatnonzero(widths == width)
            words = _words(whole["bits"].take(pa.array(rows)), width)
            while len(rows):
                parts.setdefault(width, []).append((rows, words))
                inside = lowest[rows] < width
                rows, words, half = rows[inside], words[inside], width // 128
                words, width = words[:, :half] ^ words[:, half:], width // 2
        for width, own in parts.items():
            place = np.full(len(self.n), -1, np.int32)
            place[np.concatenate([rows for rows, _ in own])] = np.arange(sum(len(rows) for rows, _ in own))
            self.bits[width] = place, np.concatenate([words for _, words in own])

    def candidates(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the batch and records that can be near-same."""
        found = [np.empty(0, np.int64)]
        if len(self.n) and batch.num_rows:
            n = batch.column("n").to_numpy().astype(np.int64)
            passages, own = _flat(batch.column("passages"))
            most = _ends(n[own], _flat(batch.column("at"))[0], self.threshold)
            keys = passages.view(np.uint32).astype(np.uint64) << np.uint64(32)
            widths = _widths(n)
            for width in np.unique(widths).tolist():
                if width in self.bits:
                    texts = np.flatnonzero(widths == width)
                    place = np.full(len(n), -1)
                    place[texts] = np.arange(len(texts))
                    inside = np.flatnonzero(place[own] >= 0)
                    inside = inside[np.argsort(keys[inside])]  # neighbours in the index are looked up together
                    words = _words(batch.column("bits").take(pa.array(texts)), width)
                    found += self._compared(keys[inside], own[inside], n, most[inside], place, words, width)
        both = np.unique(np.concatenate(found))
        return both >> 32, both & 0xFFFFFFFF

    def _compared(self, keys, own, n, most, place, words, width: int) -> Iterator[np.ndarray]:
        size = n[own]
        low = np.searchsorted(self.keys, keys | _least(size, self.threshold).astype(np.uint64))
        count = np.maximum(np.searchsorted(self.keys, keys | np.maximum(most, 0).astype(np.uint64), "right") - low, 0)
        some = np.flatnonzero(count)
        low, count, own, size = low[some], count[some], own[some].astype(np.int32), size[some].astype(np.int32)
        ends = np.cumsum(count)
        starts = ends - count
        places, records = self.bits[width]
        for begin in range(0, int(ends[-1]) if len(ends) else 0, PAIRS):
            end = min(begin + PAIRS, int(ends[-1]))
            x, y = np.searchsorted(ends, begin, "right"), np.searchsorted(ends, end - 1, "right") + 1
            times = np.minimum(ends[x:y], end) - np.maximum(starts[x:y], begin)
            at = np.repeat(low[x:y] - starts[x:y], times)
            at += np.arange(begin, end)
            near = np.flatnonzero(self.most.take(at) >= np.repeat(size[x:y], times))
            record, text = self.record.take(at.take(near)), np.repeat(own[x:y], times).take(near)
            total = self.n.take(record) + n.take(text)
            differ = total - 2 * np.ceil(total * (self.threshold / (1 + self.threshold)) - HAIR)
            unlike = records.take(places.take(record), axis=0)
            unlike ^= words.take(place.take(text), axis=0)
            near = np.flatnonzero(_ones(unlike) <= differ)
            yield (text.take(near).astype(np.int64) << 32) | record.take(near)


def _automaton(runs: list[tuple[int, ...]]):
    """Automaton over word runs, and for each different run the numbers of all that equal it."""
    import ahocorasick

    same: dict[tuple[int, ...], list[int]] = {}
    for i, r in enumerate(runs):
        same.setdefault(r, []).append(i)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for number, r in enumerate(same):
        automaton.add_word(r, number)
    if same:
        automaton.make_automaton()
    return automaton, list(same.values())


_kept: dict[str, Index] = {}  # a worker keeps its last shard


def _scan(value, name: str, threshold: float):
    """Pairs of a record of the shard and a training class that can be near-same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            if own is None:
                if name not in _kept:
                    _kept.clear()
                    _kept[name] = Index(value.value, threshold)
                own = _kept[name]
            for begin in range(0, batch.num_rows, LOOKED_UP):
                part = batch.slice(begin, LOOKED_UP)
                texts, records = own.candidates(part)
                if len(texts):
                    columns = [own.cls.take(pa.array(records)), part.column(0).take(pa.array(texts))]
                    yield pa.RecordBatch.from_arrays(columns, names=["eval_cls", "train_cls"])

    return run


class Record:
    """Automaton over all passages of one evaluation text."""

    def __init__(self, words: np.ndarray, k: int):
        self.k, self.length, self.passages = k, len(words), sh.shingles(words, k)
        low = words.astype(np.uint32)
        self.automaton, self.same = _automaton([tuple(low[i : i + k].tolist()) for i in range(len(self.passages))])
        self.distinct = len(sh.distinct(self.passages))

    def matched(self, words: np.ndarray) -> tuple[float, np.ndarray]:
        """Similarity with a text, and the merged intervals of the record's words that the text has too: begin and end, in turn."""
        others = sh.shingles(words, self.k)
        if not len(self.passages) or not len(others):
            return 0.0, np.empty(0, np.int64)
        met, edge = set(), np.zeros(self.length + 1, np.int64)
        for end, number in self.automaton.iter(tuple(words.astype(np.uint32).tolist())):
            passage = others[end - self.k + 1]
            if passage in met:
                continue
            for at in self.same[number]:
                if self.passages[at] == passage:  # 32 bits a word could agree by chance
                    met.add(passage)
                    edge[at] += 1
                    edge[at + self.k] -= 1
        inside = np.concatenate([[False], np.cumsum(edge)[:-1] > 0, [False]])
        return len(met) / (self.distinct + len(sh.distinct(others)) - len(met)), np.flatnonzero(inside[1:] != inside[:-1])


def _verify(k: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, record = None, None
        for batch in batches:
            keep, scores, lengths, spans = [], [], [], []
            classes, texts, others = (batch.column(c).to_pylist() for c in (0, 2, 3))
            for i, words in enumerate(sh.batch_word_ids(others)):
                if classes[i] != last:
                    last, record = classes[i], Record(sh.batch_word_ids([texts[i]])[0], k)
                similarity, intervals = record.matched(words)
                if similarity >= threshold:
                    keep.append(i)
                    scores.append(similarity)
                    lengths.append(record.length)
                    spans.append(intervals.astype(np.int32))
            part = batch.select([0, 1]).take(pa.array(keep, pa.int64()))
            columns = [*part.columns, pa.array(scores, pa.float64()), pa.array(lengths, pa.int32()), pa.array(spans, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["eval_cls", "train_cls", "similarity", "words", "spans"])

    return run


@dataclass
class SplitOverlap:
    #: (id, cls) of the evaluation and of the training rows that have a text.
    eval_rows: DataFrame
    train_rows: DataFrame
    #: (eval_cls, train_cls, similarity, words, spans): pairs of different classes at or above the threshold, with the
    #: length of the evaluation text in words and its matched intervals (begin and end, in turn).
    matches: DataFrame

    def pairs(self) -> DataFrame:
        """(eval_id, train_id, similarity, coverage), once per pair of rows; equal classes have 1 and 1."""
        e = self.eval_rows.toDF("eval_id", "eval_cls")
        t = self.train_rows.toDF("train_id", "train_cls")
        one = F.lit(1.0)
        same = e.join(t, F.col("eval_cls") == F.col("train_cls")).select(
            "eval_id",
            "train_id",
            one.alias("similarity"),
            one.alias("coverage")
        )
        span = F.sequence(F.lit(0), F.size("spans") - 1, F.lit(2))
        covered = F.aggregate(F.when(F.size("spans") > 0, span).otherwise(F.array().cast("array<int>")), F.lit(0), lambda s, k: s + F.get("spans", k + 1) - F.get("spans", k))
        pairs = self.matches.withColumn("coverage", F.coalesce(F.try_divide(covered, "words"), F.lit(0.0)))
        near = pairs.join(e, "eval_cls").join(t, "train_cls").select("eval_id", "train_id", "similarity", "coverage")
        both = same.unionByName(near).groupBy("eval_id", "train_id")
        return both.agg(F.max("similarity").alias("similarity"), F.max("coverage").alias("coverage"))

    def records(self) -> DataFrame:
        """(id, coverage, train_classes): each evaluation row that has an equal or near-same training text, with the share of
        its words in the union of the intervals matched by all of them; 1 if one is equal.

        Words are made distinct per text before they are counted, so a record that many training texts match stays small.
        """
        pair = F.posexplode(F.transform(F.sequence(F.lit(0), F.size("spans") - 1, F.lit(2)), lambda k: F.sequence(F.get("spans", k), F.get("spans", k + 1) - 1)))
        spans = self.matches.where("size(spans) > 0").select("eval_cls", pair.alias("k", "at")).select("eval_cls", F.explode("at").alias("at"))
        covered = spans.distinct().groupBy("eval_cls").agg(F.count("*").alias("covered"))
        found = self.matches.groupBy("eval_cls").agg(F.max("words").alias("words"), F.count("*").alias("near"))
        equal = self.eval_rows.select("cls").distinct().join(self.train_rows.select("cls").distinct(), "cls").select(F.col("cls").alias("eval_cls"), F.lit(1).alias("equal"))
        every = found.join(covered, "eval_cls", "left").join(equal, "eval_cls", "full")
        share = F.when(F.col("equal") == 1, 1.0).otherwise(F.coalesce(F.try_divide("covered", "words"), F.lit(0.0)))
        count = F.coalesce("near", F.lit(0)) + F.coalesce("equal", F.lit(0))
        own = self.eval_rows.withColumnRenamed("cls", "eval_cls")
        return own.join(every.select("eval_cls", share.alias("coverage"), count.alias("train_classes")), "eval_cls").drop("eval_cls")

    def linked(self) -> DataFrame:
        """(side, id, cls, copies, links): each row with its class of equal texts, how many rows of the other side
        share it, and to how many other classes of the other side it is linked. Linear in the rows."""
        sides = []
        for side, own, other, key in (
            ("evaluation", self.eval_rows, self.train_rows, "eval_cls"),
            ("training", self.train_rows, self.eval_rows, "train_cls"),
        ):
            copies = other.groupBy("cls").agg(F.count("*").alias("copies"))
            links = self.matches.groupBy(F.col(key).alias("cls")).agg(F.count("*").alias("links"))
            rows = own.join(copies, "cls", "left").join(links, "cls", "left")
            counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("copies", "links")]
            sides.append(rows.select(F.lit(side).alias("side"), "id", F.lower(F.hex("cls")).alias("cls"), *counts))
        return sides[0].unionByName(sides[1])


def split_overlap(
    evaluation: DataFrame, training: DataFrame, id_col: str, text_col: str, *, shingle: int = 5, threshold: float = 0.8, shard: int = SHARD
) -> SplitOverlap:
    """All pairs of an evaluation and a training text whose sets of ``shingle``-word runs have Jaccard similarity >= ``threshold``, or are equal.

    No pair is missed: sets of a and b runs must share o = threshold / (1 + threshold) x (a + b); in one order of all
    runs, the first shared one is followed by all others, so a - i >= o and b - j >= o for its places i and j.
    Texts of one class (equal run sets) are matched by the alphabetically first
    of them, so coverage does not depend on the order of rows. NULL ids or texts
    take no part; texts of fewer words match equal texts only. Repeated rows stay
    rows of their own. Empty tables give empty results. Other columns are ignored, whatever their names.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is above 0 and at most 1")
    spark = evaluation.sparkSession
    kind = evaluation.schema[id_col].dataType.simpleString()

    def prepared(df: DataFrame, name: str) -> DataFrame:
        own = picked(df, id=id_col, text=text_col).withColumn("id", F.col("id").cast(kind)).where("id is not null and text is not null")
        return written(spread(own).mapInArrow(_classes(shingle), f"id {kind}, cls binary, text string"), name)

    ev, tr = prepared(evaluation, "evaluation"), prepared(training, "training")
    # one text per class: copies are scanned and matched once
    ev_texts, tr_texts = (d.where("text is not null").groupBy("cls").agg(F.min("text").alias("text")) for d in (ev, tr))
    ev_texts = written(ev_texts, "evaluation-texts")
    counts = ev_texts.mapInArrow(_counts(shingle), "bucket int, held bigint").groupBy("bucket").agg(F.sum("held").alias("held")).toArrow()
    level = np.zeros(1 << BUCKETS, np.uint8)
    level[counts.column("bucket").to_numpy()] = np.minimum(255, np.ceil(8 * np.log2(1 + counts.column("held").to_numpy())))
    levels = spark.sparkContext.broadcast(level)
    front = "cls binary, n int, passages array<int>, at array<int>, bits binary"
    tr_front = written(tr_texts.mapInArrow(_fronts(levels, shingle, threshold, False), front), "training-fronts")
    dealt = written(ev_texts.mapInArrow(_fronts(levels, shingle, threshold, True), front), "evaluation-fronts")
    levels.destroy()
    size = dealt.agg(F.sum(F.size("passages"))).first()[0] or 0
    shards = max(1, math.ceil(size / (shard * 0.8)))  # shares by hash differ a little
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("cls"), F.lit(shards)))
    if shards > 1:
        dealt = written(dealt.repartitionByRange("shard").sortWithinPartitions("shard"), "shards")  # so that a read skips the others

    candidates = []
    for s in range(shards):
        value = spark.sparkContext.broadcast(dealt.where(F.col("shard") == s).drop("shard").toArrow())
        found = tr_front.mapInArrow(_scan(value, f"{value._jbroadcast.id()}-{s}", threshold), "eval_cls binary, train_cls binary")
        candidates.append(written(found.where("eval_cls <> train_cls"), "candidates"))
        value.destroy()
    found = candidates[0]
    for more in candidates[1:]:
        found = found.unionByName(more)

    def of(rows: DataFrame, key: str, text: str) -> DataFrame:
        own = rows.join(found.select(F.col(key).alias("cls")).distinct(), "cls", "left_semi").groupBy("cls").agg(F.min("text").alias(text))
        return own.withColumnRenamed("cls", key)

    near = found.join(
        of(tr.where("text is not null"), "train_cls", "train_text"),
        "train_cls"
    ).join(of(ev_texts, "eval_cls", "eval_text"), "eval_cls")
    near = near.select("eval_cls", "train_cls", "eval_text", "train_text").sortWithinPartitions("eval_cls")  # one automaton a record
    result = "eval_cls binary, train_cls binary, similarity double, words int, spans array<int>"
    matches = written(near.mapInArrow(_verify(shingle, threshold), result), "matches")
    return SplitOverlap(ev.select("id", "cls"), tr.select("id", "cls"), matches)
