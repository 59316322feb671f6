"""What the operators write does not grow with the square of the rows."""

import itertools
import random
import time
import types

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tamarack import runtime
from tamarack.llm import _shingles as sh
from tamarack.llm import near_duplicates, split_overlap


def phrased(n, seed=5):
    """Texts of stock phrases, few of them near-same; every eighth is edited from one before."""
    r = random.Random(seed)
    phrases = [" ".join(f"w{r.randrange(200)}" for _ in range(6)) for _ in range(60)]
    texts = []
    for i in range(n):
        own = texts[r.randrange(i)].split() if i % 8 == 7 else " ".join(r.choices(phrases, k=10)).split()
        own[r.randrange(len(own))] = f"x{i}"
        texts.append(" ".join(own))
    return texts


def test_band_join_drops_what_the_sketches_exclude(spark, monkeypatch):
    plans, counts = [], {}

    def noted(df, name):
        plans.append((name, df._jdf.queryExecution().optimizedPlan().toString()))
        out = runtime.written(df, name)
        counts[name] = counts.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(near_duplicates, "written", noted)
    monkeypatch.setattr(near_duplicates, "SLICE_BANDS", 50)  # 143 bands, three slices
    texts = phrased(300)
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    r = near_duplicates.near_duplicates(df, "id", "text", shingle=3, threshold=0.5, recall=0.9999)
    found = {tuple(p) for p in r.pairs().collect()}
    sets = [sh.shingle_set(t, 3) for t in texts]
    assert found == {(i, j) for i, j in itertools.combinations(range(300), 2) if sh.jaccard(sets[i], sets[j]) >= 0.5}
    joined = [line for _, p in plans for line in p.splitlines() if "Join" in line and "bit_count" in line]
    assert len(joined) == 3 and all("key#" in line for line in joined)  # by the join by band itself, not on rows shuffled after it
    assert counts["likely"] <= 3 * len(found) + 300


def test_shuffle_files_of_a_written_table_are_removed(spark):
    def files():
        all_files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f for f in all_files.mkString("\n").split("\n") if "shuffle_" in f}

    before = files()
    out = runtime.written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counted")
    end = time.time() + 20
    while (left := files() - before) and time.time() < end:
        time.sleep(0.2)
    assert not left and out.count() == 7


def test_shards_read_only_training_texts_that_can_match(spark, monkeypatch):
    counts = {}

    def noted(df, name):
        out = runtime.written(df, name)
        counts.setdefault(name, []).append(out)
        return out

    monkeypatch.setattr(split_overlap, "written", noted)
    r = random.Random(3)
    evaluation = [t + " " + " ".join(r.choices("abcdefgh", k=9)) for t in phrased(40)]
    others = [" ".join(f"z{r.randrange(500)}" for _ in range(60)) for _ in range(400)]
    near = [" ".join(t.split()[:-6] + ["new", "end"]) for t in evaluation[::2]]
    training = others + near
    ev, tr = (spark.createDataFrame(list(enumerate(t)), "id bigint, text string") for t in (evaluation, training))
    found = split_overlap.split_overlap(ev, tr, "id", "text", shingle=3, threshold=0.5, shard=300)
    sets = [[sh.shingle_set(t, 3) for t in side] for side in (evaluation, training)]
    want = {(i, j) for i, a in enumerate(sets[0]) for j, b in enumerate(sets[1]) if sh.jaccard(a, b) >= 0.5}
    assert {(p.eval_id, p.train_id) for p in found.pairs().collect()} == want and len(want) >= len(near)
    assert len(counts["candidates"]) > 3  # shards
    scanned = [t for name, own in counts.items() if name.startswith("training-") for t in own]
    assert sum(t.count() for t in scanned) <= len(near)


def test_index_loses_no_pair():
    r = random.Random(11)
    for _ in range(40):
        k, threshold, letters, longest = r.choice([1, 2, 3]), r.choice([0.1, 0.3, 0.5, 0.8, 0.9, 1.0]), r.choice([8, 40, 400]), r.choice([4, 12, 60, 400])
        records = [" ".join(f"w{r.randrange(letters)}" for _ in range(r.randrange(longest))) for _ in range(25)]
        texts = []
        for _ in range(75):
            own = r.choice(records).split()
            for _ in range(r.randrange(1 + len(own) // 2)):
                at = r.randrange(len(own))
                own[at : at + r.randrange(2)] = [f"w{r.randrange(letters)}"] * r.randrange(2)
                own = own or ["w"]
            texts.append(" ".join(own))
        sides = [pa.record_batch([pa.array([b"%d" % i for i in range(len(t))]), pa.array(t)], names=["cls", "text"]) for t in (records, texts)]
        counts = next(split_overlap._counts(k)(iter(sides[:1])))
        level = np.zeros(1 << split_overlap.BUCKETS, np.uint8)
        level[counts.column(0).to_numpy()] = np.minimum(255, counts.column(1).to_numpy())
        fronts = [list(split_overlap._fronts(types.SimpleNamespace(value=level), k, threshold, i == 0)(iter([b]))) for i, b in enumerate(sides)]
        index = split_overlap.Index(pa.Table.from_batches(fronts[0], fronts[0][0].schema), threshold)
        got = set()
        for batch in fronts[1]:
            rows, found = index.candidates(batch)
            got |= {(int(index.cls[e].as_py()), int(batch.column(0)[t].as_py())) for t, e in zip(rows.tolist(), found.tolist())}
        sets = [[sh.shingle_set(t, k) for t in side] for side in (records, texts)]
        assert {(i, j) for i, a in enumerate(sets[0]) for j, b in enumerate(sets[1]) if len(a) and len(b) and sh.jaccard(a, b) >= threshold} <= got
