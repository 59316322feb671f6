"""A paged search service as a Spark data source.

``spark.read.format("paged_search")`` with options
  transport  "module:factory"; factory(options) gives an object with
             ``search(keyword, first, last) -> (status, body, content_range)``
  plan       JSON list of [plan_idx, bucket, keyword, cap or null]
  page_size, max_rows, interval_seconds, attempts
  token      optional "module:factory"; factory(options) gives a function that
             fetches (token, seconds it lasts). The transport's ``authorize``
             gets the token before each call; it is fetched again when it ends
Filters on keyword, bucket and plan_idx leave out whole queries of the plan. One partition per query of the plan: pages depend on the total of the page
before. A rate limit per key therefore needs one query at a time per key.
"""

from __future__ import annotations

import importlib
import json
import re
import time
from collections.abc import Callable, Iterator, Sequence

import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from tamarack.schemas import OFFERS

_RANGE = re.compile(r"(\d+)-(\d+)/(\d+)$")


class SourceError(RuntimeError):
    pass


def content_range(header: str | None) -> tuple[int, int, int] | None:
    m = _RANGE.search(header or "")
    return tuple(map(int, m.groups())) if m else None


def wait_seconds(status: int, retry_after: str | None, attempt: int, step: float) -> float:
    """What a busy service asks for, if it is a number; else longer each time."""
    try:
        if status == 429 and retry_after:
            return max(0.0, float(retry_after))
    except ValueError:
        pass
    return step * (attempt + 1)


def with_retries(call: Callable[[], tuple], attempts: int, step: float, sleep: Callable[[float], None] = time.sleep) -> tuple:
    """``call`` until its status (first item) is neither 429 nor 5xx; the fourth item, if any, is Retry-After."""
    answer: tuple = (0,)
    for k in range(attempts):
        answer = call()
        if answer[0] != 429 and answer[0] < 500:
            return answer
        if k < attempts - 1:
            sleep(wait_seconds(answer[0], answer[3] if len(answer) > 3 else None, k, step))
    raise SourceError(f"status {answer[0]} after {attempts} attempts")


class Throttle:
    """At least ``interval`` seconds between calls of one process."""

    def __init__(self, interval: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.interval, self.clock, self.sleep, self.last = interval, clock, sleep, None

    def wait(self) -> None:
        if self.last is not None and (rest := self.interval - (self.clock() - self.last)) > 0:
            self.sleep(rest)
        self.last = self.clock()


class Token:
    """A token that is fetched again 30 seconds before it ends."""

    def __init__(self, fetch: Callable[[], tuple[str, float]], clock: Callable[[], float] = time.monotonic):
        self.fetch, self.clock, self.value, self.ends = fetch, clock, None, 0.0

    def get(self) -> str:
        if self.value is None or self.clock() >= self.ends - 30:
            self.value, life = self.fetch()
            self.ends = self.clock() + life
        return self.value


def pages(search: Callable[[int, int], tuple], page_size: int, max_rows: int, cap: int | None) -> Iterator[dict]:
    """Rows of one query until the cap, the total, the ceiling or an empty page. 204 is an empty page."""
    first = given = 0
    while first < max_rows:
        status, body, header, *_ = search(first, min(first + page_size, max_rows) - 1)
        if status == 204:
            return
        if status not in (200, 206):
            raise SourceError(f"status {status}")
        rows = (body or {}).get("resultats") or []
        if not rows:
            return
        for row in rows:
            if cap is not None and given >= cap:
                return
            given += 1
            yield row
        total = content_range(header)
        first += page_size
        if total and first >= total[2]:
            return


def count(transport, keyword: str) -> int:
    """Total the service states, read from the first page's metadata; 0 without one."""
    _, _, header, *_ = transport.search(keyword, 0, 0)
    found = content_range(header)
    return found[2] if found else 0


def _load(options: dict, name: str):
    module, _, factory = options[name].partition(":")
    return getattr(importlib.import_module(module), factory)(dict(options))


def load_transport(options: dict):
    return _load(options, "transport")


def exploration(transport, code_tables: Sequence[str], keywords: Sequence[str]) -> list[tuple[str, str, str | None, str | None]]:
    """(kind, name, value, error) for each code table (its size and first code), a sample offer and the count of each
    keyword. A probe that fails is a row with its error, and the others go on."""

    def codes(name: str) -> str:
        rows = transport.codes(name)
        return f"{len(rows)} codes" + (f", first {rows[0].get('code')}" if rows else "")

    def sample(keyword: str) -> str | None:
        _, body, *_ = transport.search(keyword, 0, 0)
        rows = (body or {}).get("resultats") or []
        return json.dumps(rows[0], ensure_ascii=False) if rows else None

    probes = [("codes", n, codes) for n in code_tables]
    probes += [("sample", k, sample) for k in list(keywords)[:1]]
    probes += [("count", k, lambda k: str(count(transport, k))) for k in keywords]
    out = []
    for kind, name, probe in probes:
        try:
            out.append((kind, name, probe(name), None))
        except Exception as e:  # what a service raises is its own
            out.append((kind, name, None, f"{type(e).__name__}: {e}"[:300]))
    return out


class _Query(InputPartition):
    def __init__(self, plan_idx: int, bucket: str, keyword: str, cap: int | None):
        self.plan_idx, self.bucket, self.keyword, self.cap = plan_idx, bucket, keyword, cap


class _Reader(DataSourceReader):
    #: Columns that a query of the plan has as a whole, and their place in it.
    PLAN = {("plan_idx",): 0, ("bucket",): 1, ("keyword",): 2}

    def __init__(self, options: dict):
        self.options, self.wanted = dict(options), []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality and membership over columns of the plan; the rest is left to Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute in self.PLAN:
                at = self.PLAN[f.attribute]
                allowed = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted.append(lambda row, at=at, allowed=allowed: row[at] in allowed)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        plan = json.loads(self.options["plan"])
        own = [_Query(*row) for row in plan if all(want(row) for want in self.wanted)]
        return own or [_Query(-1, "", "", 0)]

    def read(self, query: _Query) -> Iterator[tuple]:
        if query.cap == 0:
            return
        transport = load_transport(self.options)
        token = Token(_load(self.options, "token")) if "token" in self.options else None
        throttle = Throttle(float(self.options.get("interval_seconds", "0.4")))
        tries = int(self.options.get("attempts", "5"))

        def search(first: int, last: int) -> tuple:
            def call() -> tuple:
                throttle.wait()
                if token is not None:
                    transport.authorize(token.get())
                return transport.search(query.keyword, first, last)

            return with_retries(call, tries, 2.0)

        sub = lambda row, outer, inner: ((row.get(outer) or {}).get(inner),)
        for k, r in enumerate(pages(search, int(self.options.get("page_size", "150")), int(self.options.get("max_rows", "1150")), query.cap)):
            yield (
                query.plan_idx, k, query.bucket, query.keyword, r.get("id"), r.get("intitule"), sub(r, "entreprise", "nom"), sub(r, "lieuTravail", "libelle"), r.get("description"), sub(r, "origineOffre", "urlOrigine"),
                r.get("alternance"), r.get("typeContrat"), r.get("typeContratLibelle"), r.get("natureContrat"), r.get("experienceLibelle"), sub(r, "salaire", "libelle"), r.get("dureeTravailLibelle"), r.get("romeLibelle"), r.get("dateCreation"),
            )


class PagedSearch(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_search"

    def schema(self) -> str:
        return OFFERS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _CodeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def read(self, partition) -> Iterator[tuple]:
        for row in load_transport(self.options).codes(self.options["table"]):
            yield (row.get("code"), row.get("libelle"))


class PagedCodes(DataSource):
    """Code tables of the same service; option ``table`` names one."""

    @classmethod
    def name(cls) -> str:
        return "paged_codes"

    def schema(self) -> str:
        return "code STRING, libelle STRING"

    def reader(self, schema) -> DataSourceReader:
        return _CodeReader(self.options)


class TableTransport:
    """Serves rows given as JSON in the option ``rows`` ({keyword: [offers]}): for tests and replays."""

    def __init__(self, options: dict):
        self.rows = json.loads(options.get("rows", "{}"))
        self.code_tables = json.loads(options.get("codes", "{}"))

    def search(self, keyword: str, first: int, last: int) -> tuple:
        own = self.rows.get(keyword, [])
        if first >= len(own):
            return 204, None, None
        part = own[first : last + 1]
        return (200 if len(part) == len(own) else 206), {"resultats": part}, f"offres {first}-{first + len(part) - 1}/{len(own)}"

    def codes(self, table: str) -> list[dict]:
        return self.code_tables.get(table, [])


class ParquetTransport:
    """Serves the rows of a Parquet table of postings (option ``path``), in order of arrival: to replay what a service gave.
    The path is read by each task, so all executors must see it."""

    def __init__(self, options: dict):
        self.path, self.keyword, self.rows = options["path"], None, []

    def search(self, keyword: str, first: int, last: int) -> tuple:
        if keyword != self.keyword:
            found = pq.read_table(
                self.path,
                columns=["posting_id", "title", "raw_text", "source_url", "seq"],
                filters=[("matched_keyword", "=", keyword)]
            )
            rows = sorted(found.to_pylist(), key=lambda r: r["seq"])
            self.keyword = keyword
            self.rows = [
                {
                    "id": r["posting_id"],
                    "intitule": r["title"],
                    "description": r["raw_text"],
                    "origineOffre": {"urlOrigine": r["source_url"]}
                } for r in rows
            ]
        if first >= len(self.rows):
            return 204, None, None
        part = self.rows[first : last + 1]
        return (
            200 if len(part) == len(self.rows) else 206
        ), {"resultats": part}, f"offres {first}-{first + len(part) - 1}/{len(self.rows)}"


def register(spark) -> None:
    """Makes the sources known to the session, and lets filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedSearch)
    spark.dataSource.register(PagedCodes)
