import json

import pytest
from pyspark.sql import functions as F

from tamarack.operators import dedupe, partition, records, score, split, stats
from tamarack.schemas import FIELDS, POSTING, RAW
from tamarack.sources import jsonl, paged
from tamarack.streaming import labelling


def test_short_first_copy_hides_later_ones(spark):
    rows = spark.createDataFrame([("a", 1, 10, "h1", "b"), ("a", 2, 500, "h2", "b"), ("c", 3, 300, "h3", "b"), ("d", 4, 300, "h3", "b")], "posting_id string, seq int, description_chars int, text_hash string, bucket string")
    flags = dedupe.ingest_flags(rows, "posting_id", ["seq"])
    assert [r.posting_id for r in flags.where("kept").collect()] == ["c"]
    assert dedupe.ingest_summary(flags).collect() == [("b", 2, 1, 1)]


def test_leakage(spark):
    a = spark.createDataFrame([("1", "x")], "posting_id string, text_hash string")
    for other in (("1", "y"), ("2", "x")):
        with pytest.raises(ValueError):
            dedupe.assert_no_leakage(a, spark.createDataFrame([other], a.schema))
    dedupe.assert_no_leakage(a, spark.createDataFrame([("2", "y"), (None, None)], a.schema))


def test_allocation(spark):
    sizes = spark.createDataFrame([("a", 349, 0), ("b", 2, 1), ("c", 140, 2), ("d", 151, 3)], "bucket string, n bigint, first_seen bigint")
    assert {r.bucket: r.alloc for r in split.allocate(sizes, 100).collect()} == {"a": 54, "b": 0, "c": 22, "d": 24}


def test_split_is_disjoint_and_exact(spark):
    rows = spark.range(500).select(F.col("id").cast("string").alias("posting_id"), F.when(F.col("id") % 7 == 0, None).otherwise((F.col("id") % 3).cast("string")).alias("bucket"), F.col("id").alias("seq"), (F.col("id") % 5 > 0).alias("valid"), F.lit(None).cast("string").alias("labeller"))
    train, test = split.train_test(rows.unionByName(rows), "posting_id", "bucket", "seq", 100)
    a, b = {r.posting_id for r in train.collect()}, {r.posting_id for r in test.collect()}
    assert len(b) == 100 and not a & b
    held = split.holdout(rows, "posting_id", 0.05)
    assert held.where("held_out").count() == 25 and held.count() == 500


def test_partition(spark):
    import hashlib

    ids = [f"x:{i}" for i in range(50)]
    got = spark.createDataFrame([(i,) for i in ids], "id string").select("id", partition.hash_partition(F.col("id"), 5).alias("p")).collect()
    assert {r.id: r.p for r in got} == {i: int(hashlib.sha256(i.encode()).hexdigest(), 16) % 5 for i in ids}


def pair(spark, gold, predicted, valid=True):
    full = lambda r: None if r is None else tuple(r.get(f) for f in FIELDS)
    return score.verdict_columns(spark.createDataFrame([("p", full(gold), full(predicted), valid)], f"posting_id string, gold {POSTING}, predicted {POSTING}, valid boolean"))


@pytest.mark.parametrize(
    "gold, predicted, field, want",
    [
        ({"title": "T"}, {"title": "T"}, "title", "tp"),
        ({"title": "T"}, {"title": "t"}, "title", "fp"),
        ({"title": "T"}, None, "title", "fn"),
        ({"title": "T"}, {"title": "T", "company": "c"}, "company", "fp"),
        ({"title": "T"}, {"title": "T"}, "company", "tn"),
        ({"required_skills": ["SQL", "Python"]}, {"required_skills": ["python", "sql"]}, "required_skills", "tp"),
        ({"required_skills": ["SQL"]}, {"required_skills": ["sql", "x"]}, "required_skills", "fp"),
        ({"required_skills": []}, {"required_skills": None}, "required_skills", "fn"),
        ({"education_level": "Bac+5 ou école"}, {"education_level": "Bac+5, école"}, "education_level", "tp"),
        ({"education_level": "Bac+5"}, {"education_level": "Bac+3"}, "education_level", "fp"),
    ],
)
def test_verdicts(spark, gold, predicted, field, want):
    assert pair(spark, gold, predicted).select(f"v_{field}").first()[0] == want


def test_no_rows_scored(spark):
    none = pair(spark, {"title": "T"}, None).limit(0)
    assert score.score_summary(none).collect() == [(0, 0.0, 0.0, 0.0)]
    fields = score.field_scores(none).collect()
    assert len(fields) == 14 and all(r.f1 is None for r in fields)
    assert "n/a" in score.report_text(score.score_summary(none).first().asDict(), [r.asDict() for r in fields])


def test_order_statistics(spark):
    df = spark.range(20).select(F.lit("g").alias("g"), F.col("id").cast("double").alias("v")).unionByName(spark.createDataFrame([("h", 1.0), ("h", None), (None, 2.0)], "g string, v double"))
    got = {r.g: (r.n, r.median, r.p95) for r in stats.latency_stats(df.where("g is not null"), ["g"], "v").collect()}
    assert got == {"g": (20, 10.0, 19.0), "h": (1, 1.0, 1.0)}


def test_upsert_and_first_open(spark):
    kind = "posting_id string, pred_id int, v string"
    old, new = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("z", 3, "z")], kind), spark.createDataFrame([("a", 4, "w")], kind)
    candidates = spark.createDataFrame([("b", 0), ("a", 1), ("c", 2)], "posting_id string, seq int")
    assert [(r.posting_id, r.v) for r in dedupe.upsert(old, new, "posting_id", "pred_id", candidates, "seq").orderBy("position").collect()] == [("b", "y"), ("a", "w")]
    assert dedupe.first_open(candidates, old, "posting_id", "seq").first()[0] == 2
    assert dedupe.first_open(candidates, candidates, "posting_id", "seq").first()[0] is None


def test_form(spark):
    df = spark.createDataFrame([({"title": " T ", "company": " ", "duration_months": "6", "years_experience_min": "six", "required_skills": "a, ,b"},)], "form map<string,string>")
    r = df.select(records.form_payload(F.col("form")).alias("p")).first().p
    assert (r.title, r.company, r.duration_months, r.years_experience_min, r.required_skills, r.location) == (" T ", None, 6, None, ["a", "b"], None)


def test_jsonl(spark, tmp_path):
    path = f"{tmp_path}/x.jsonl"
    assert jsonl.read_jsonl_if_exists(spark, path, RAW).count() == 0
    with open(path, "w") as f:
        f.write('{"posting_id": "é"}\n\n  \n{"posting_id": "b"}\n')
    assert jsonl.read_jsonl_if_exists(spark, path, RAW).count() == 2
    assert [r[0] for r in jsonl.first_lines(spark, path, 2).collect()] == ['{"posting_id": "é"}', ""]
    jsonl.write_jsonl(spark.createDataFrame([("é", None)], "a string, b string"), f"{tmp_path}/out")
    assert spark.read.text(f"{tmp_path}/out").first()[0] == '{"a":"é","b":null}'
    with open(path, "a") as f:
        f.write("{broken\n")
    with pytest.raises(Exception):
        jsonl.read_jsonl(spark, path, RAW).collect()


def test_paging():
    service = paged.TableTransport({"rows": json.dumps({"k": [{"id": i} for i in range(320)]})})
    search = lambda a, b: service.search("k", a, b)
    assert len(list(paged.pages(search, 150, 1150, None))) == 320 and len(list(paged.pages(search, 150, 300, None))) == 300 and len(list(paged.pages(search, 150, 1150, 7))) == 7
    assert paged.count(service, "k") == 320 and paged.count(service, "none") == 0
    answers, waited = iter([(429, None, None, "7"), (503, None, None), (200, {}, None)]), []
    assert paged.with_retries(lambda: next(answers), 5, 2.0, waited.append)[0] == 200 and waited == [7.0, 4.0]
    assert paged.wait_seconds(429, "Wed, 21 Oct", 0, 2.0) == 2.0
    with pytest.raises(paged.SourceError):
        paged.with_retries(lambda: (500,), 2, 0.0, waited.append)


def test_codes(spark):
    paged.register(spark)
    codes = json.dumps({"types": [{"code": "CDI", "libelle": "x"}]})
    assert spark.read.format("paged_codes").options(transport="tamarack.sources.paged:TableTransport", table="types", codes=codes).load().collect() == [("CDI", "x")]


def test_self_correction():
    answers = iter(["prose", '```json\n{"title": "T"}\n```'])
    asked = []
    got = labelling.extract(lambda m: asked.append(len(m)) or next(answers), "text")
    assert (got["valid"], got["attempts"], asked) == (True, 2, [2, 4])
    failed = labelling.extract(lambda m: "{}", "text")
    assert (failed["valid"], failed["attempts"], failed["prediction"]) == (False, 3, None) and failed["error"].startswith("schema_violation")


def test_stream(spark, tmp_path):
    class Fixed:
        def __call__(self):
            return lambda m: '{"title": "T"}'

    src, out, ck = (f"{tmp_path}/{n}" for n in ("in", "out", "ck"))
    spark.createDataFrame([("a", "x"), ("b", None)], "posting_id string, raw_text string").write.json(src)
    for _ in range(2):
        labelling.stream(spark.readStream.schema("posting_id string, raw_text string").json(src), Fixed(), "fixed", out, ck).awaitTermination(60)
    assert spark.read.json(out).count() == 2
