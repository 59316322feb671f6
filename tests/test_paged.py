"""The paged source against a replayed service; no query, as it reads no table."""

import json

from tamarack.plans import queries
from tamarack.sources import paged


def test_paged_source(spark):
    paged.register(spark)
    offers = {"tri": [{"id": str(i), "intitule": f"Poste {i}", "description": "x" * 250} for i in range(320)], "paie": []}
    plan = [[0, "autres_metiers", "tri", 170], [1, "autres_metiers", "paie", None]]
    got = spark.read.format("paged_search").options(transport="tamarack.sources.paged:TableTransport", plan=json.dumps(plan), rows=json.dumps(offers), interval_seconds="0").load()
    assert sorted((r.plan_idx, r.result_idx, r.id) for r in got.collect()) == [(0, i, str(i)) for i in range(170)]


def test_a_replay_of_invented_offers_is_no_query():
    assert "paged_source" not in queries.queries()


def test_filters_over_the_plan_leave_out_queries(spark):
    paged.register(spark)
    offers = {k: [{"id": f"{k}{i}", "intitule": "x"} for i in range(3)] for k in ("a", "b", "c")}
    plan = [[i, "u" if k == "c" else "v", k, None] for i, k in enumerate(offers)]
    reader = paged._Reader({"plan": json.dumps(plan)})
    left = list(reader.pushFilters([paged.EqualTo(("bucket",), "v"), paged.In(("keyword",), ("b", "c")), paged.EqualTo(("id",), "b0")]))
    assert [f.attribute for f in left] == [("id",)] and [q.keyword for q in reader.partitions()] == ["b"]
    options = {"transport": "tamarack.sources.paged:TableTransport", "plan": json.dumps(plan), "rows": json.dumps(offers), "interval_seconds": "0"}
    df = spark.read.format("paged_search").options(**options).load()
    assert {r.id for r in df.where("keyword = 'b'").collect()} == {"b0", "b1", "b2"}
    assert df.where("keyword = 'none'").count() == 0 and df.where("bucket = 'v' and id like '%1'").count() == 2


class Guarded(paged.TableTransport):
    def authorize(self, token):
        self.token = token

    def search(self, keyword, first, last):
        assert self.token == "t1"
        return super().search(keyword, first, last)


def fetch(options):
    return lambda: ("t1", 3600.0)


def test_a_token_is_fetched_and_used(spark):
    paged.register(spark)
    reader = paged._Reader({"transport": "tests.test_paged:Guarded", "token": "tests.test_paged:fetch", "plan": "[]", "rows": json.dumps({"a": [{"id": "1"}]}), "interval_seconds": "0"})
    assert len(list(reader.read(paged._Query(0, "u", "a", None)))) == 1
    now, given = [0.0], iter([("one", 100.0), ("two", 100.0)])
    token = paged.Token(lambda: next(given), lambda: now[0])
    assert token.get() == token.get() == "one"
    now[0] = 71.0
    assert token.get() == "two"


def test_exploration_goes_on_after_a_failure():
    service = paged.TableTransport({"rows": json.dumps({"k": [{"id": 1}]}), "codes": json.dumps({"types": [{"code": "CDI"}], "bad": {"x": 1}})})
    rows = paged.exploration(service, ["types", "bad"], ["k", "none"])
    assert rows[0] == ("codes", "types", "1 codes, first CDI", None) and rows[1][2] is None and rows[1][3].startswith("KeyError")
    assert rows[2:] == [("sample", "k", '{"id": 1}', None), ("count", "k", "1", None), ("count", "none", "0", None)]
