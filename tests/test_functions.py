import hashlib
import html
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tamarack.functions import normalize as N
from tamarack.functions import text as T
from tamarack.functions.parse import check_posting, parse_stripped
from tamarack.functions.text import html_text


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_text_hash_is_pythons(spark):
    texts = ["A  b\n", "a B", "a\x1cb", "x y", "", None, "É è"]
    want = [None if t is None else hashlib.sha256(re.sub(r"\s+", " ", t).strip().lower().encode()).hexdigest() for t in texts]
    assert column(spark, texts, T.text_hash) == want


def test_pii(spark):
    cases = {"a@mail5.example.com": "[email].com", "hé.19@x.fr": "[email]", "990123456789012": "99[téléphone]012", "+33 6 12 34 56 78": "[téléphone]", "rien": "rien"}
    assert column(spark, list(cases), T.strip_pii) == list(cases.values())


def test_markup(spark):
    cases = {"<h1>A</h1><h2>B</h2>": "AB", "x<script>var t='<p>';</script>y": "xvar t='<p>';y", "<p>tail R&D": "", "<p>&amp;lt;b": "<b", "&amp;lt;b": "&lt;b", "a<br>b<div>c": "a\nb\nc", "l&eacute": "lé"}
    assert column(spark, list(cases), T.clean_description) == list(cases.values())
    assert html_text("a &lt; b") == "a < b"


@given(st.text(max_size=200))
@settings(max_examples=50, deadline=None)
def test_markup_without_tags_is_unescaped_once(text):
    assert "<" in text or html_text(text) == html.unescape(text)


def test_whitespace(spark):
    cases = {"a\r\nb\rc": "a\nb\nc", "a \t b": "a b", " a \n  b ": "a\nb", "a\n\n\n\nb": "a\n\nb", " a \nb": "a\nb", "a b": "a b"}
    assert column(spark, list(cases), T.normalize_whitespace) == list(cases.values())


def test_free_text(spark):
    a = column(spark, ["Bac+5 ou école d'ingénieur", "Bac+5, école ingénieur", "Bac+3", "qu'il"], T.normalize_free_text)
    assert a[0] == a[1] != a[2] and a[3] == "qu'il"


def test_content_range(spark):
    assert column(spark, ["offres 0-149/1234", "offres */0", None], T.content_range) == [(0, 149, 1234), None, None]


def test_scalars_and_lists(spark):
    assert column(spark, ["N/A", "  ", "not specified", "non précisé", " x "], N.clean_scalar) == [None, None, None, None, "x"]
    assert column(spark, ["Apprenticeship", "Internship", "Permanent", "unheard", None], N.contract_type) == ["alternance", "stage", "cdi", "other", None]
    assert column(spark, ["télétravail", "unheard", None], N.remote_policy) == ["remote", None, None]
    assert column(spark, [["Python", "python", " SQL "], ["", "  "], [], None, [None, "a"]], N.clean_list, "array<string>") == [["Python", "SQL"], None, None, None, ["a"]]


def test_parse():
    ok = check_posting({"title": "T", "years_experience_min": 0, "duration_months": "12", "contract_type": 5, "remote_policy": "x", "alternance_rhythm": "1/1"})
    assert (ok["years_experience_min"], ok["duration_months"], ok["contract_type"], ok["remote_policy"], ok["alternance_rhythm"]) == (0, 12, "other", None, None)
    assert check_posting({"title": "T", "years_experience_min": None})["years_experience_min"] is None
    for value, whole in (("+5", 5), ("1_0", 10), ("3.0", 3), (3.0, 3), (True, 1)):
        assert check_posting({"title": "T", "duration_months": value})["duration_months"] == whole
    for bad in ({}, {"title": "N/A"}, {"title": "T", "more": 1}, {"title": "T", "years_experience_min": -1}, {"title": "T", "duration_months": 3.5}, {"title": "T", "duration_months": "six"}, {"title": 5}, {"title": "T", "required_skills": "N/A"}, [1]):
        with pytest.raises(ValueError):
            check_posting(bad)
    assert parse_stripped("prose")[1] == "invalid_json" and parse_stripped('{"a":1} x')[1] == "invalid_json" and parse_stripped('{"title": "a", "title": "b"}')[0]["title"] == "b"
    assert parse_stripped(None)[1] == "invalid_json"


def test_fences(spark):
    assert column(spark, ['```json\n{"title": "a"}\n```', "{}"], T.strip_fences) == ['{"title": "a"}', "{}"]
