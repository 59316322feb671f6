"""Contracts at the seams: complete scoring, leakage, fences, transport of labellers, ownership, forms."""

import json

import pytest
from pyspark.sql import functions as F

from tamarack.functions import text as T
from tamarack.functions.parse import parse_stripped
from tamarack.operators import dedupe, records, score, split, stats
from tamarack.schemas import FIELDS, POSTING
from tamarack.streaming import labelling, transport


def posting(**fields):
    return tuple(fields.get(f) for f in FIELDS)


@pytest.fixture(scope="module")
def judged(spark):
    gold = spark.createDataFrame([(i, posting(title=f"t{i}", company="c")) for i in ("a", "b", "c")], f"posting_id string, gold {POSTING}")
    rows = [("a", posting(title="ta", company="c"), True), ("b", posting(title="x"), True), ("z", posting(title="z"), True)]
    return gold, spark.createDataFrame(rows, f"posting_id string, predicted {POSTING}, valid boolean")


def test_scoring_demands_every_gold_posting(judged):
    gold, predicted = judged
    with pytest.raises(ValueError, match="'c'"):
        score.score(gold, predicted)
    with pytest.raises(ValueError, match="ignore"):
        score.score(gold, predicted, missing="ignore")


def test_a_missing_prediction_counts_as_invalid(judged):
    gold, predicted = judged
    r = score.score(gold, predicted, missing="invalid")
    s = r.summary.first()
    assert (s.n_postings, s.json_validity_rate, s.exact_match_rate) == (3, pytest.approx(2 / 3), pytest.approx(1 / 3))
    title = r.fields.where("field = 'title'").first()
    assert (title.tp, title.fp, title.fn, title.tn) == (1, 1, 1, 0)
    assert "n/a" in r.text() and "postings 3" in r.text()
    complete = score.score(gold.where("posting_id <> 'c'"), predicted).summary.first()
    assert complete.n_postings == 2


def test_every_model_is_asked_for_every_posting(judged):
    gold, predicted = judged
    named = predicted.withColumn("labeller", F.when(F.col("posting_id") == "a", "m").otherwise("n"))
    pairs = score.scored_models(gold, named, "labeller", ["m", "n"], missing="invalid")
    assert {r.labeller: (r["count"], r.valid) for r in pairs.groupBy("labeller").agg(F.count("*").alias("count"), F.count_if("valid").alias("valid")).collect()} == {"m": (3, 1), "n": (3, 1)}
    with pytest.raises(ValueError, match="without a prediction"):
        score.scored_models(gold, named, "labeller", ["m", "n"])


@pytest.mark.parametrize(
    "answer, bare",
    [
        ('```json\n{"title": "a"}\n```', '{"title": "a"}'),
        ('```json{"title":"x"}```', '{"title":"x"}'),
        ('```\n{"title": "a"}```', '{"title": "a"}'),
        ('{"title": "a\\n```"}', '{"title": "a\\n```"}'),
        ("{}", "{}"),
        (' ```json\n{}', "```json\n{}"),
    ],
)
def test_one_fence_rule(spark, answer, bare):
    df = spark.createDataFrame([(answer,)], "v string")
    assert T.without_fences(answer) == bare == df.select(T.strip_fences(F.col("v"))).first()[0]


def test_a_fenced_line_is_an_answer():
    got = labelling.extract(lambda m: '```json{"title":"x"}```', "text")
    assert got["valid"] and got["attempts"] == 1 and got["prediction"]["title"] == "x"


def rows_of(spark):
    rows = spark.range(60).select(F.col("id").cast("string").alias("posting_id"), F.lit("b").alias("bucket"), F.col("id").alias("seq"), F.lit(True).alias("valid"), F.lit(None).cast("string").alias("labeller"))
    return rows.withColumn("text_hash", F.when(F.col("seq") == 7, None).otherwise((F.col("seq") / 2).cast("int").cast("string")))


def test_leakage_is_checked_at_the_split(spark):
    rows = rows_of(spark)
    args = (rows, "posting_id", "bucket", "seq", 10)
    with pytest.raises(ValueError, match="overlap"):
        split.train_test(*args, hash_col="text_hash")
    train, test = split.train_test(*args, hash_col="text_hash", leakage="drop")
    dedupe.assert_no_leakage(train, test)
    whole = split.train_test(*args)[0]
    assert test.count() == 10 and whole.count() == 50 and 40 <= train.count() < 50


def reply(text):
    return 200, {}, json.dumps({"choices": [{"message": {"content": text}}]})


def test_busy_and_failing_services_are_asked_again():
    answers, waited = iter([(429, {"Retry-After": "7"}, ""), (429, {}, ""), (503, {}, ""), OSError("unreachable"), reply("{}")]), []

    def send(payload):
        a = next(answers)
        if isinstance(a, OSError):
            raise a
        return a

    assert transport.content_of(transport.sent(send, {}, 5, waited.append)) == "{}" and waited == [7.0, 10.0, 9.0, 12.0]
    with pytest.raises(transport.TransportError, match="status 503 after 2"):
        transport.sent(lambda p: (503, {}, ""), {}, 2, waited.append)
    with pytest.raises(transport.TransportError, match="status 401"):
        transport.sent(lambda p: (401, {}, ""), {}, 5, waited.append)


@pytest.mark.parametrize("body", ["<html>", "{}", '{"choices": []}', '{"choices": [{"message": {"content": null}}]}', "[1]"])
def test_a_malformed_answer_is_refused_and_asked_again(body):
    assert parse_stripped(transport.content_of(body))[1] == "schema_violation"
    answers, seen = iter([(200, {}, body), reply('{"title": "T"}')]), []

    def send(payload):
        seen.append(payload)
        return next(answers)

    service = transport.Service(lambda: send, transport.Settings("m"), interval=0.0)
    got = labelling.extract(service(), "text", examples=[("asked", "answered")])
    assert (got["valid"], got["attempts"]) == (True, 2)
    assert (seen[0]["model"], seen[0]["temperature"], seen[0]["response_format"]) == ("m", 0.0, {"type": "json_object"})
    assert [m["role"] for m in seen[0]["messages"][:4]] == ["system", "user", "assistant", "user"]


class Down:
    def __call__(self):
        def chat(messages):
            raise transport.TransportError("status 401")

        return chat


class Fine:
    def __call__(self):
        return lambda messages: json.dumps({"title": messages[-2]["content"] if len(messages) > 2 else "none"})


def test_a_service_that_is_down_fails_rows_not_the_job(spark):
    postings = spark.createDataFrame([("a", "x"), ("b", None)], "posting_id string, raw_text string")
    got = labelling.label(postings, Down(), "down").collect()
    assert [(r.valid, r.error, r.attempts) for r in got] == [(False, "transport: status 401", 1)] * 2


def test_providers_own_disjoint_parts(spark):
    postings = spark.range(40).select(F.col("id").cast("string").alias("posting_id"), F.lit("x").alias("raw_text"))
    done = postings.where("posting_id < '2'")
    providers = [transport.Provider(n, f"{n}-1", Fine(), active=n != "spare") for n in ("one", "two", "three", "spare")]
    run = lambda name, **k: {(r.posting_id, r.labeller) for r in labelling.run_provider(postings, done, providers, name, examples=[("q", "shown")], **k).collect()}
    parts = [run(n) for n in ("one", "two", "three")]
    todo = {r.posting_id for r in postings.collect()} - {r.posting_id for r in done.collect()}
    assert sum(map(len, parts)) == len(todo) and {i for p in parts for i, _ in p} == todo
    assert not run("spare") and {i for i, _ in run("spare", mop_up=True)} == todo
    with pytest.raises(ValueError, match="no provider"):
        run("other")


def test_examples_are_those_of_the_column(spark):
    shown = [("q1", "a1"), ("q2", "a2")]
    column = spark.createDataFrame([("text",)], "t string").select(records.build_messages(F.col("t"), shown).alias("m")).first().m
    assert [m.asDict() for m in column] == labelling.messages_of("text", shown)
    retry = spark.createDataFrame([("no",)], "a string").select(records.retry_messages(F.array(records.message("user", F.lit("t"))), F.col("a"), F.lit("bad")).alias("m")).first().m
    assert retry[-1].content == records.correction("bad") and retry[-2].content == "no"


def test_form_body(spark):
    body = "title=D%C3%A9v+H%2FF&company=&title=second&required_skills=a%2C+b&broken&=x"
    got = spark.createDataFrame([(body,), ("",), (None,)], "b string").select(records.form_values(F.col("b")).alias("v")).collect()
    assert got[0].v == {"title": "Dév H/F", "required_skills": "a, b"} and got[1].v == {} and got[2].v is None


def test_order_statistics_of_tied_values(spark):
    df = spark.range(9000).select((F.col("id") % 3).alias("g"), F.when(F.col("id") < 6000, 5.0).otherwise(F.col("id").cast("double")).alias("v"))
    values = {}
    for r in df.collect():
        values.setdefault(r.g, []).append(r.v)
    got = {r.g: (r.n, r.median, r.p95) for r in stats.latency_stats(df, ["g"], "v").collect()}
    assert got == {g: (len(v), sorted(v)[len(v) // 2], sorted(v)[int(len(v) * 0.95)]) for g, v in values.items()}


def test_holdout_is_exact_and_by_hash(spark):
    import hashlib

    rows = spark.range(3000).select(F.col("id").cast("string").alias("i"))
    held = {r.i for r in split.holdout(rows, "i", 0.1).where("held_out").collect()}
    assert held == set(sorted((str(i) for i in range(3000)), key=lambda i: hashlib.sha256(f"42:{i}".encode()).hexdigest())[:300])


@pytest.mark.parametrize(
    "text, want",
    [
        ("<!-- a --><p>x</p>", "\nx"),
        ("<ul><li>a<li class='x>y'>b</ul>", "\na\nb"),
        ("1 < 2 <b>et</b> 3", "1 < 2 et 3"),
        ("a<br/>b<BR>c", "a\nb\nc"),
        ("<style>p > a {}</style>x", "p > a {}x"),
        ("x<div", "x"),
        ("<p>R&D et plus", "\nR&D et plus"),
        ("<!DOCTYPE html><?x y?>z", "z"),
    ],
)
def test_markup_pieces(text, want):
    assert T.html_text(text) == want
