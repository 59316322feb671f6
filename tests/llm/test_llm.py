"""Every operator against brute force, SQL or a round trip, and its defined results at the edges."""

import itertools
import math
import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamarack.llm import _shingles as sh
from tamarack.llm import canonical, look_alike, mixing, near_duplicates, packing, quota_sample, registry, split_overlap, truncation
from tamarack.llm._ranked import lowest
from tamarack.llm.tokens import count_tokens, with_tokens
from tamarack.runtime import table
from tests.compare import same

ALL, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ALL))
def test_query(spark, data, name):
    df = ALL[name](spark, data)
    if name in SQL:
        same(df, SQL[name], data)
    else:
        df.collect()


def plain_words(text):
    bare = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")
    return re.findall(r"[^\W_]+", bare)


def runs(text, k=3):
    w = plain_words(text)
    return set(zip(*[w[i:] for i in range(k)]))


def near(a, b, k=3, t=0.5):
    x, y = runs(a, k), runs(b, k)
    return a == b or bool(x | y) and len(x & y) >= t * len(x | y)


def test_batch_words_are_the_words_of_each_text():
    many = ["", "  ", "Été n°2", "İstanbul ǅ ß", "한국어 été", "a_b c-d", "\udc00x", "ΣΑΣ σας", "x" * 300_000 + " y", "é̂ x", "\u0301", "e\u0301te ete"] * 3
    seen = {}
    for text, ids in zip(many, sh.batch_word_ids(many)):
        own = sh.words(text)
        assert len(own) == len(ids)
        for word, i in zip(own, ids.tolist()):
            assert seen.setdefault(word, i) == i
    assert len(set(seen.values())) == len(seen)


def test_words():
    for text in ("Équipe d'été n°2, ŒUVRE", "été", "", "İzmir", "日本語 テスト"):
        assert sh.words(text) == plain_words(text)
    a, b = "un deux trois quatre", "un deux trois cinq"
    assert sh.jaccard(sh.shingle_set(a, 3), sh.shingle_set(b, 3)) == pytest.approx(1 / 3)


def texts(n=60, seed=1):
    rng, words = random.Random(seed), [f"mot{i}" for i in range(200)]
    base = [" ".join(rng.choices(words, k=rng.randint(20, 60))) for _ in range(n // 4)]
    out = []
    for i in range(n):
        w = base[i % len(base)].split()
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append(" ".join(w) if i % 9 else base[i % len(base)])
    return out


EDGES = ["", "", "   ", "un", "un", "un deux", None, None, "Mot " * 30_000, "mot " * 30_000]
DOC = "id long, text string, ID string, cls string, Text string, key int"


def docs(spark, rows, first=0):
    return spark.createDataFrame([(first + i, t, "x", "y", "z", 1) for i, t in enumerate(rows)], DOC)


def test_near_duplicates_are_brute_force(spark):
    rows = texts() + EDGES + texts()[:5]
    r = near_duplicates.near_duplicates(docs(spark, rows), "id", "text", shingle=3, threshold=0.5, recall=0.9999)
    want = {(i, j) for (i, a), (j, b) in itertools.combinations(enumerate(rows), 2) if a is not None and b is not None and near(a, b)}
    assert {(p.id_a, p.id_b) for p in r.pairs().collect()} == want
    assert r.linked().count() == sum(t is not None for t in rows)
    none = near_duplicates.near_duplicates(docs(spark, rows).limit(0), "id", "text")
    assert none.pairs().count() == 0 and none.linked().count() == 0


def components(pairs):
    """{id: lowest id of its connected component}"""
    lead = {}

    def of(x):
        while lead.setdefault(x, x) != x:
            x = lead[x]
        return x

    for a, b in pairs:
        a, b = sorted((of(a), of(b)))
        lead[b] = a
    return {x: of(x) for x in lead}


def test_groups_are_the_components_of_the_pairs(spark):
    chain = [" ".join(f"mot{j}" for j in range(i, i + 12)) for i in range(0, 90, 3)]  # each like the next only
    rows = chain + texts() + EDGES + texts()[:5]
    several = [(40, "ici un tout autre texte"), (41, None), (42, chain[7])]  # ids with several texts
    df = spark.createDataFrame([*enumerate(rows), *several], "id long, text string")
    r = near_duplicates.near_duplicates(df, "id", "text", shingle=3, threshold=0.5, recall=0.9999)
    want = components((p.id_a, p.id_b) for p in r.pairs().collect())
    assert len({want[i] for i in range(len(chain))}) == 1 and want[42] == want[0]
    got = {}
    for x in r.linked().collect():
        got.setdefault(x.group, set()).add(x.id)
    ids = {i for own in got.values() for i in own}
    assert sum(map(len, got.values())) == len(ids)  # an id is in one group
    assert sorted(map(sorted, got.values())) == sorted(sorted(i for i in ids if want.get(i, i) == lead) for lead in {want.get(i, i) for i in ids})


def test_hot_group_of_copies_and_repeated_ids(spark):
    rows = spark.range(3000).select((F.col("id") % 2000).alias("id"), F.when(F.col("id") % 3 == 0, F.lit("un texte que beaucoup de lignes portent mot pour mot")).otherwise(F.concat(F.lit("texte à part numéro "), F.col("id"), F.lit(" avec ses propres mots "), F.col("id") * 7)).alias("text"))
    r = near_duplicates.near_duplicates(rows, "id", "text", shingle=3, threshold=0.5)
    assert r.members.groupBy("cls").count().agg(F.max("count")).first()[0] == 1000
    assert near_duplicates.bands_for(0.5, 0.99, 4) == 72


def test_overlap_is_brute_force(spark):
    every = texts(80, 2) + EDGES
    ev, tr = every[::3] + ["un", ""], every[1::3] + every[2::3] + ["un", ""]
    r = split_overlap.split_overlap(docs(spark, ev), docs(spark, tr, 1000), "id", "text", shingle=3, threshold=0.5, shard=50)
    want = {(i, 1000 + j) for i, a in enumerate(ev) for j, b in enumerate(tr) if a is not None and b is not None and near(a, b)}
    got = r.pairs().collect()
    assert {(p.eval_id, p.train_id) for p in got} == want and all(0 <= p.coverage <= 1 for p in got)
    rows = {(x.side, x.id): x for x in r.linked().collect()}
    assert len(rows) == sum(t is not None for t in ev + tr)
    for side, at in (("evaluation", 0), ("training", 1)):
        cls = {i: x.cls for (s, i), x in rows.items() if s == side}
        for i in cls:
            mine = [p[1 - at] for p in want if p[at] == i]
            other = {j: rows["training" if side == "evaluation" else "evaluation", j].cls for j in mine}
            assert rows[side, i].copies == sum(c == cls[i] for c in other.values())
            assert rows[side, i].links == len({c for c in other.values() if c != cls[i]})
    for a, b in ((docs(spark, ev).limit(0), docs(spark, tr)), (docs(spark, ev), docs(spark, tr).limit(0))):
        empty = split_overlap.split_overlap(a, b, "id", "text")
        assert empty.pairs().count() == 0 and empty.records().count() == 0


def test_coverage_merges_intervals(spark):
    a, b = sh.batch_word_ids(["a b c d e f g h", "x b c d e y f g h"])
    similarity, spans = split_overlap.Record(a, 3).matched(b)
    assert similarity == pytest.approx(3 / 10) and spans.tolist() == [1, 8]
    again = sh.batch_word_ids(["a b c x a b c"])[0]
    similarity, spans = split_overlap.Record(again, 3).matched(sh.batch_word_ids(["a b c"])[0])
    assert similarity == pytest.approx(1 / 4) and spans.tolist() == [0, 3, 4, 7]
    record = "a b c d e f g h i j"
    train = ["a b c d e f g x y z", "v w x d e f g h i j", "q r s t"]  # 7 words from the left, 7 from the right
    r = split_overlap.split_overlap(docs(spark, [record, "q r s t", "o p"]), docs(spark, train, 100), "id", "text", shingle=3, threshold=0.4)
    assert sorted(p.coverage for p in r.pairs().where("eval_id = 0").collect()) == [pytest.approx(0.7)] * 2
    assert {x.id: (x.coverage, x.train_classes) for x in r.records().collect()} == {0: (1.0, 2), 1: (1.0, 1)}


CANON = [(1, "contract", "cdi", "CDI"), (2, "contract", "cdi", "Contrat à durée indéterminée"), (3, "contract", "cdd", "Contrat à durée déterminée"), (4, "contract", "stage", "Stage"), (5, "contract", "remote", "Remote"), (6, "contract", "occasional", "Occasional remote work"), (None, None, None, None)]


def test_canonical(spark):
    ref = spark.createDataFrame(CANON, "ref_id int, field string, code string, form string")
    cases = {
        "C.D.I.": "cdi", " cdi ": "cdi", "Contrat : CDI": "cdi", "contrat a duree determinee (6 mois)": "cdd", "Contrat à durée indétreminée": "cdi", "durée déterminée à Contrat": "cdd", "CONTRATÀ DURÉE DÉTERMINÉE": "cdd",
        "stgae": "stage", "Ocasional remote wrok": "occasional", "remote possible": "remote", "N/A": "unmatched", "???": "unmatched", "x" * 100_000: "unmatched", "Occas1onal remote work": "occasional",
    }
    rows = [(i, (v,), "p") for i, v in enumerate([*cases, "", "  ", None, "cdi", "stgae"])] + [(99, None, "p")]
    df = spark.createDataFrame(rows, "id int, prediction struct<c:string>, Prediction string")
    got = canonical.canonical_codes(df, "id", {"contract": "prediction.c"}, ref).collect()
    assert {r.value: r.code for r in got} == cases and len(got) == len(cases) + 1
    assert {r.code for r in canonical.canonical_codes(df, "id", {"contract": "prediction.c"}, ref.limit(0)).collect()} == {"unmatched"}
    assert canonical.canonical_codes(df.limit(0), "id", {"contract": "prediction.c"}, ref).count() == 0


def test_index_misses_no_close_string():
    rng, letters = random.Random(4), "abcde"
    strings = list({"".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(300)})
    index = canonical.Index(strings)
    for _ in range(200):
        value = "".join(rng.choices(letters, k=rng.randint(1, 9)))
        for least in (0.7, 0.75):
            want = {i for i, s in enumerate(strings) if canonical.closeness(value, s, least) > 0}
            assert {i for i, _ in index.near(value, least)} == want


def test_forms_among_other_words():
    matcher = canonical.Matcher([("alternance", "Alternance"), ("cdi", "Contrat à durée indéterminée"), ("hybrid", "Télétravail partiel"), ("stage", "Stage")])
    for value, code in (("poste en altrenance ouvert", "alternance"), ("contrat a duree indetermine poste ouvert", "cdi"), ("teletravaille partiel deux jours", "hybrid"), ("stade municipal", "unmatched"), ("à voir", "unmatched")):
        assert matcher.code(value)[0] == code


def test_edits():
    assert canonical.edits("abc", "acb", 3) == 1 and canonical.edits("", "abc", 3) == 3 and canonical.edits("abc", "abc", 0) == 0 and canonical.edits("kitten", "sitting", 9) == 3


def test_truncated_values(data, spark):
    x = truncation.ending("Titre\nSociété\n\nVous devrez planifier les comptes de (suite sur le site)")
    assert x["mark"] == "said" and truncation.ending("a etc...")["mark"] == "dots" and truncation.ending("Fin.")["mark"] is None
    good = [(i, "s", 40, f"Titre {i}\n\nNous cherchons une personne calme.\nCandidature par courrier.", "x") for i in range(200)]
    body = "Titre\n\nNous cherchons une pers"
    rows = good + [(500, "s", None, body, "x"), (501, "t", 900, good[0][3], "x"), (502, None, None, None, "x"), (503, None, None, "", "x"), (504, "s", 900, "", "x"), (500, "s", None, body, "x"), (505, "s", None, "mot " * 50_000 + ".", "x")]
    df = spark.createDataFrame(rows, "id int, source string, stated int, text string, Source string")
    r = truncation.truncated(df, "id", "source", "text", "stated")
    got = {c.id: set(c.evidence) for c in r.cut.collect()}
    assert got == {500: {"prefix"}, 501: {"length"}, 504: {"length"}}
    assert {s.source: (s.texts, s.cut) for s in r.by_source.collect()} == {"s": (203, 2), "t": (1, 1), None: (1, 0)}
    empty = truncation.truncated(df.limit(0), "id", "source", "text", "stated")
    assert empty.cut.count() == 0 and empty.by_source.count() == 0


def test_limit_of_a_source(spark):
    rng = random.Random(3)
    words = [f"parole{i}" for i in range(400)]
    rows = []
    for i in range(300):
        text = " ".join(rng.choices(words, k=rng.randint(20, 60))) + "."
        rows.append((i, "s", None, text[:300]))
    r = truncation.truncated(spark.createDataFrame(rows, "id int, source string, stated int, text string"), "id", "source", "text", "stated")
    assert {c.id for c in r.cut.collect()} >= {i for i, _, _, t in rows if not t.endswith(".")}


def test_lowest_takes_exactly_the_budget(spark):
    rows = spark.range(10_000).select("id", (F.col("id") % 3 == 0).cast("string").alias("g"), F.lit(0.25).alias("tied"), ((F.col("id") * 7919) % 10_007 / 10_007).alias("u"))
    budgets = spark.createDataFrame([("true", 100.0), ("false", 7.0), ("none", 5.0)], "g string, budget double")
    for key in ("tied", "u"):
        got = lowest(rows, ["g"], key, "id", budgets)
        assert {r.g: r["count"] for r in got.groupBy("g").count().collect()} == {"true": 100, "false": 7}
    want = sorted(((r.u, r.id) for r in rows.where("g = 'true'").collect()))[:100]
    assert sorted((r.u, r.id) for r in lowest(rows, ["g"], "u", "id", budgets).where("g = 'true'").collect()) == want


def test_rake_meets_both_margins():
    cells = {(a, b): 10 + a * 7 + b * 3 for a in range(3) for b in range(4)}
    rows = {a: ([c for c in cells if c[0] == a], s) for a, s in enumerate((0.5, 0.3, 0.2))}
    columns = {b: ([c for c in cells if c[1] == b], s) for b, s in enumerate((0.4, 0.3, 0.2, 0.1))}
    w = quota_sample.rake(cells, [rows, columns])
    total = sum(w[c] * n for c, n in cells.items())
    for margin in (rows, columns):
        for own, share in margin.values():
            assert sum(w[c] * cells[c] for c in own) / total == pytest.approx(share, abs=1e-6)


def test_quota_sample(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") < 900, "big").when(F.col("id") < 903, "tiny").when(F.col("id") < 950, "mid").alias("kind"), F.lit(1).alias("weight"))
    targets = spark.createDataFrame([(1, "s", "big", 0.5, 1), (2, "s", "tiny", 0.1, 5), (3, "s", "mid", 0.3, 2), (4, "s", "absent", 0.1, 1)], "target_id int, target_set string, kind string, target_share double, min_rows int")
    r = quota_sample.quota_sample(rows, targets, ["kind"])
    report = {x.target_id: (x.available, x.quota, x.short) for x in r.report.collect()}
    assert report == {1: (900, 50, False), 2: (3, 3, True), 3: (47, 30, False), 4: (0, 0, True)}
    assert {x.target_id: x["count"] for x in r.sample.groupBy("target_id").count().collect()} == {1: 50, 2: 3, 3: 30}
    assert r.sample.select("id").distinct().count() == 83
    # short is measured on the sample: without it, what is left out counts as lacking
    fewer = quota_sample.QuotaSample(r.sample.where("target_id <> 3"), r.plan).report.where("target_id = 3").first()
    assert fewer.drawn == 0 and fewer.share_gap == pytest.approx(0.3)
    for a, b in ((rows.limit(0), targets), (rows, targets.limit(0))):
        assert quota_sample.quota_sample(a, b, ["kind"]).sample.count() == 0


def test_both_margins_shape_the_sample(spark):
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 4 > 0, "a").otherwise("b").alias("kind"), F.when(F.col("id") % 10 > 0, "x").otherwise("y").alias("word"))
    both = [(1, "s", "a", None, 0.5, 1), (2, "s", "b", None, 0.5, 1), (3, "t", None, "x", 0.5, 1), (4, "t", None, "y", 0.5, 1)]
    targets = spark.createDataFrame(both, "target_id int, target_set string, kind string, word string, target_share double, min_rows int")
    r = quota_sample.quota_sample(rows, targets, ["kind", "word"], fraction=0.05)
    drawn = r.sample.where("target_set = 's'")
    assert drawn.count() == 1000 and drawn.where("kind = 'b'").count() == 500
    assert 400 < drawn.where("word = 'y'").count() < 600  # a tenth of the rows, raked to half


def test_quota_sample_draws_rows_with_an_open_null_category(spark):
    rows = spark.range(300).select("id", F.when(F.col("id") < 30, "a").when(F.col("id") < 290, "b").alias("kind"), F.when(F.col("id") % 3 > 0, "k").alias("word"))
    targets = spark.createDataFrame([(1, "s", "a", None, 0.5, 30), (2, "s", "b", None, 0.5, 1), (3, "t", "a", "k", 1.0, 20)], "target_id int, target_set string, kind string, word string, target_share double, min_rows int")
    r = quota_sample.quota_sample(rows, targets, ["kind", "word"], fraction=0.2)
    drawn = {}
    for x in r.sample.collect():
        drawn.setdefault(x.target_id, set()).add((x.id, x.word))
    assert {i for i, _ in drawn[1]} == set(range(30)) and any(w is None for _, w in drawn[2]) and all(w == "k" for _, w in drawn[3])
    report = {x.target_id: x for x in r.report.collect()}
    assert {i: x.drawn for i, x in report.items()} == {i: len(own) for i, own in drawn.items()} == {i: x.quota for i, x in report.items()}
    assert report[1].drawn_share == pytest.approx(len(drawn[1]) / (len(drawn[1]) + len(drawn[2])))


def best(sizes, capacity):
    """Fewest containers, by trying all."""
    sizes, found = sorted(sizes, reverse=True), [len(sizes)]

    def place(k, rooms):
        if len(rooms) >= found[0]:
            return
        if k == len(sizes):
            found[0] = len(rooms)
            return
        for room in set(rooms):
            if room >= sizes[k]:
                left = list(rooms)
                left.remove(room)
                place(k + 1, [*left, room - sizes[k]])
        place(k + 1, [*rooms, capacity - sizes[k]])

    place(0, [])
    return found[0]


def test_dominance_keeps_the_best_packing():
    rng = random.Random(5)
    for k in range(400):
        capacity = rng.randint(10, 40)
        sizes = [rng.randint(1 if k % 2 else max(1, capacity // 5), capacity) for _ in range(rng.randint(1, 9))]
        left = packing._Sizes(sizes)
        fixed = packing.reduce_by_dominance(left, capacity)
        rest = [s for s, items in left.items.items() for _ in items]
        assert all(sum(sizes[i] for i in c) <= capacity for c in fixed)
        assert len(fixed) + (best(rest, capacity) if rest else 0) == best(sizes, capacity)
        place, certain = packing.pack(sizes, capacity)
        assert sum(certain) == sum(map(len, fixed))
        assert packing.lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity) <= best(sizes, capacity)
        assert all(sum(s for s, p in zip(sizes, place) if p == c) <= capacity for c in set(place))


def test_pack(spark):
    sizes = [5, 5, 3, 7, 10, 25, 0, 1, 1, 20]
    sized = spark.createDataFrame([(i, s, 1) for i, s in enumerate(sizes)], "id int, tokens long, capacity int")
    limits = spark.createDataFrame([(10,), (None,), (0,), (10,)], "c int")
    got = packing.pack_tokens(sized, limits, block=4).collect()
    assert {r.capacity for r in got} == {10}
    for i, s in enumerate(sizes):
        own = [r for r in got if r.id == i]
        assert sum(r.tokens for r in own) == s and len(own) == max(1, -(-s // 10)) == own[0].parts and {r.part for r in own} == set(range(len(own)))
    full = {}
    for r in got:
        full[r.container] = full.get(r.container, 0) + r.tokens
    assert max(full.values()) <= 10
    assert packing.pack_tokens(sized.limit(0), limits).count() == 0
    hot = spark.range(4000).select(F.lit(None).cast("int").alias("id"), F.lit(3).cast("long").alias("tokens"))
    blocks = packing.pack_tokens(hot, limits, block=500).groupBy(F.shiftright("container", 32)).count().collect()
    assert sum(r["count"] for r in blocks) == 4000 and max(r["count"] for r in blocks) < 700


def test_fill(spark, data):
    fill = packing.containers(registry._packed(spark, data)).collect()
    assert len(fill) == 3 and all(r.fill > 0.9 and r.lower_bound <= r.containers <= 1.02 * r.lower_bound + 1 for r in fill)
    assert all(r.fixed > 0 for r in fill)


def test_temper():
    sizes = {"a": 1000.0, "b": 100.0, "c": 10.0, "none": 0.0}
    assert mixing.tempered(sizes, 1)["a"] == pytest.approx(1000 / 1110)
    e = mixing.exponent_for_entropy(sizes, 0.8)
    assert mixing.entropy(mixing.tempered(sizes, e)) == pytest.approx(0.8, abs=1e-6)
    x = mixing.exponent_for_repeats(sizes, 1110, {s: 4 for s in sizes})
    shares = mixing.tempered(sizes, x)
    assert max(p * 1110 / (4 * sizes[s]) for s, p in shares.items()) == pytest.approx(1, abs=1e-6) and 0 < x < 1


def test_what_is_lacking_is_filled_along_the_tempered_path():
    sizes, weights, total = {"a": 600.0, "b": 300.0, "c": 20.0}, {"a": 0.3, "b": 0.6, "c": 0.1}, 1000.0
    given, x = mixing.budgets(sizes, weights, {"a": 1, "b": 3, "c": 2}, total)
    assert x == 1.0 and given == pytest.approx({"a": 320, "b": 640, "c": 40})
    given, x = mixing.budgets(sizes, weights, {"a": 1, "b": 2.1, "c": 2}, total)  # b has room for 30 of the 40 it would get
    assert 0 < x < 1 and given == pytest.approx({"a": 330, "b": 630, "c": 40}, abs=1e-3)
    given, x = mixing.budgets(sizes, weights, {"a": 1, "b": 2, "c": 2}, total)
    assert given == pytest.approx({"a": 360, "b": 600, "c": 40})
    given, _ = mixing.budgets(sizes, weights, {"a": 0, "b": 1, "c": 1}, total)
    assert given == {"a": 0, "b": 300, "c": 20}


def test_mix(spark):
    rows = [(i, "mot " * 50, "a" if i < 60 else "b" if i < 90 else "c" if i < 92 else None) for i in range(100)] + [(200, None, "a"), (201, "", "b")]
    df = spark.createDataFrame(rows, "id int, text string, source string").withColumn("tokens", F.lit("x"))
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.6, 3), ("c", 0.05, 2), ("d", 0.05, 9)], "source string, target_weight double, max_repeats int")
    m = mixing.mix_sources(df, "id", "text", "source", targets)
    report = {r.source: r for r in m.report.collect()}
    assert {s: r.short for s, r in report.items()} == {"a": False, "b": False, "c": True, "d": True}
    uses = [r for r in m.documents.collect() if r.tokens]
    count = {s: sum(r.source == s for r in uses) for s in "abc"}
    assert count == {"a": 32, "b": 64, "c": 4}
    for s in "abc":
        assert report[s].given_tokens == sum(r.tokens for r in uses if r.source == s)
        assert report[s].actual_share == pytest.approx(count[s] / 100)
    repeats = {r.id: r.repeats for r in m.repeats.collect() if r.tokens}
    assert max(repeats[i] for i in range(60) if i in repeats) == 1 and {repeats[i] for i in range(60, 90)} == {2, 3} and repeats[90] == repeats[91] == 2
    # each pass is a permutation: positions 1 .. n, another order of blocks in each
    every = m.documents.where("source = 'b'").collect()
    orders = {}
    for p in {r["pass"] for r in every}:
        own = sorted((r for r in every if r["pass"] == p), key=lambda r: r.position)
        assert [r.position for r in own] == list(range(1, len(own) + 1)) and [r.block for r in own] == sorted(r.block for r in own)
        orders[p] = [r.id for r in own]
    assert sorted(orders[1]) == sorted(orders[2]) == [*range(60, 90), 201] and orders[1] != orders[2]
    free = mixing.mix_sources(df, "id", "text", "source", targets.withColumns({"target_weight": F.lit(None).cast("double"), "max_repeats": F.lit(2)}))
    assert not [r for r in free.report.where("source <> 'd'").collect() if r.short and r.share_exponent < 1e-9]
    assert mixing.mix_sources(df.limit(0), "id", "text", "source", targets).documents.count() == 0
    assert mixing.mix_sources(df, "id", "text", "source", targets.limit(0)).documents.count() == 0


def test_mix_keeps_repeated_rows(spark):
    rows = [(1, "mot " * 10, "a"), (1, "mot " * 5, "a"), (1, "mot " * 5, "a"), (None, "mot", "a")]
    df = spark.createDataFrame(rows, "id int, text string, source string")
    targets = spark.createDataFrame([("a", 1.0, 2)], "source string, target_weight double, max_repeats int")
    m = mixing.mix_sources(df, "id", "text", "source", targets, total=1e9)
    whole = 2 * sum(count_tokens(t) for _, t, _ in rows)
    assert m.documents.agg(F.sum("tokens")).first()[0] == m.report.first().given_tokens == whole and m.documents.count() == 8


def test_tempered_entropy(spark, data):
    free = spark.createDataFrame([("france_travail", None, 50), ("agregio", None, 50), ("jobtilia", None, 50)], "source string, target_weight double, max_repeats int")
    r = mixing.mix_sources(table(spark, data, "documents"), "doc_id", "text", "source", free, target_entropy=1.05).report.collect()
    assert -sum(x.target_weight * math.log(x.target_weight) for x in r) == pytest.approx(1.05, abs=1e-6)
    assert -sum(x.actual_share * math.log(x.actual_share) for x in r) == pytest.approx(1.05, abs=0.03)


def test_tokens(spark):
    df = spark.createDataFrame([(1, "bonjour le monde"), (2, ""), (3, None), (4, "x" * 150_000)], "id int, text string")
    got = {r.id: r.tokens for r in with_tokens(df, ["id"], "text").collect()}
    assert got[1] == count_tokens("bonjour le monde") > 0 and got[2] == got[3] == 0 and 1000 < got[4] < 150_000


ALIKE = [
    ("café ﬁn", "café fin"), ("ｆｕｌｌ　ｗｉｄｔｈ", "full width"), ("a​b­c﻿", "abc"), ("x y z w", "x y z w"), ("сора", "copa"), ("Ο Α", "O A"), ("е́", "é"), ("ё", "ë"), ("ﬃ", "ffi"),
    ("𝐂𝐃𝐈", "CDI"), ("Ⅳ", "IV"), ("ｶﾞ", "ガ"), ("mi‑temps", "mi-temps"), ("㎏", "kg"), ("ℓ", "l"), ("ſ", "s"), ("Ꭺ", "A"), ("µ", "μ"), ("𝟏", "1"), ("ĳ", "ij"),
]
DIFFERENT = [("²", "2"), ("½", "1/2"), ("É", "é"), ("e", "é"), ("Été", "été"), ("a1", "a2"), ("a\nb", "a b"), ("–", "-"), ("œ", "oe"), ("①", "1"), ("ₐ", "a"), ("ª", "a"), ("´", "'"), ("…", "...")]


def test_forms(spark):
    both = ALIKE + DIFFERENT
    df = spark.createDataFrame([(2 * i + k, t, 0) for i, p in enumerate(both) for k, t in enumerate(p)] + [(900, None, 0), (901, "", 0), (901, "é", 0)], "id int, text string, form int")
    form = [(r.id, r.form) for r in look_alike.consistent_form(df, "id", "text").collect()]
    by = dict(form)
    assert len(form) == 2 * len(both) + 3 and by[900] is None and [f for i, f in form if i == 901] == ["", "é"]
    for i, (a, b) in enumerate(both):
        assert (by[2 * i] == by[2 * i + 1]) == (i < len(ALIKE)), (a, b)
    again = spark.createDataFrame(form, "id int, text string")
    assert all(r.text == r.form for r in look_alike.consistent_form(again, "id", "text").collect())


def test_pairs_of_forms(spark):
    rows = ["abc", "abc", "ab​c", "ａbc", "x", "x", None, None, "", "​", "é" * 50_000, "é" * 50_000]
    df = docs(spark, rows)
    form = {i: None if t is None else unicodedata.normalize("NFKC", t).replace("​", "") for i, t in enumerate(rows)}
    want = {(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if form[i] is not None and form[i] == form[j] and rows[i] != rows[j]}
    assert {(r.id_a, r.id_b) for r in look_alike.look_alike_pairs(df, "id", "text").collect()} == want
    assert look_alike.look_alike_pairs(df.limit(0), "id", "text").count() == 0


def test_found_columns(spark, data):
    want = {"p1_found": ["posting_id"], "p2_found": ["posting_id_a", "posting_id_b"], "p3_found": ["test_split_seq", "train_split_seq"], "p4_found": ["pred_id", "field", "code"], "p5_found": ["target_id"], "p6_found": ["doc_id"], "p7_found": ["source"], "p8_found": ["doc_id_a", "doc_id_b"]}
    assert {n: ALL[n](spark, data).columns for n in want} == want


def test_overlap_of_tables(spark, data):
    a, b = (table(spark, data, t).select("split_seq", "raw_text", "posting_id").collect() for t in ("test", "train"))
    want = {(x.split_seq, y.split_seq) for x in a for y in b if x.posting_id == y.posting_id or near(x.raw_text, y.raw_text)}
    assert {tuple(r) for r in ALL["p3_found"](spark, data).collect()} == want
