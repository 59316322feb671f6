"""Texts cut off by field limits or mid-transfer (problem 1).

Two Arrow passes: one measures each text and its end, one counts words, word
pairs and line beginnings of the whole corpus. The vocabulary trie has two
levels: the letters of words and the words of phrases. It is a table of its
nodes (proper prefixes with the occurrences below them), so that it grows with
the cluster. Evidence of a cut, in this order of weight:

length      the source names a longer text than it delivered
limit       many different texts of the source have exactly this length, or
            a mark of omission at this length, most of them without an end
prefix      the last token is no word of the corpus but a proper prefix of some,
            or an entity stops before its name is whole
unfinished  the last word, or last two, are a proper prefix of phrases: they go
            on everywhere else, and lines that begin like the last one do not
            usually close a text
mark        the text ends in a mark of omission that says so

Length evidence is checked by the other kinds: a text of exactly a source's
limit is whole if the source names full lengths and this one is reached, or if
it ends as texts that are not at the limit do. "unfinished" does not count where
several sources deliver the same end and a share of the texts with its last two
words stops there. Counts are judged by shares with their margin of error, so
evidence needs the same certainty in a small corpus as in a large one.
"""

from __future__ import annotations

import html
import html.entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarack.llm import _shingles as sh
from tamarack.runtime import broadcast_if_small, picked, spread, written

# Marks of omission that say so, and the bare one, which whole texts use as well.
MARK = re.compile(
    r"\s*(?:[\[(]\s*(?:\.{3}|…)\s*[\])]|(?:\.{3}|…)?\s*[\[(]?\s*(?:lire la suite|voir la suite|suite sur le site|read more|see more|more on the site)\s*[\])]?)\s*\Z",
    re.I
)
DOTS = re.compile(r"\s*(?:\.{3}|…)\s*\Z")

#: Letters and digits, or a character that closes a sentence or line.
_TOKEN = re.compile(r"[^\W_]+|[.!?…)\n]")
_WORD = re.compile(r"[^\W_]+")
#: An entity, and the beginning of one at the end.
_ENTITY, _HALF_ENTITY = re.compile(r"&[A-Za-z]{2,8};"), re.compile(r"&([A-Za-z]{1,7})\Z")
#: A word, or a sign by itself.
_SIGN = re.compile(r"[^\W_]+|[^\w\s]")
#: A number within a code at the end is no number of the text.
_CODE = re.compile(r"[^\W_]-[^\W_]*\d[^\W_]*\Z")
_HEAD = re.compile(r"\n[ \t\xa0]*\n")

#: Longer than this by description_chars is missing text, not another way to count.
TOLERANCE = 8
#: A length is a limit if this many different texts have it (fewer can agree by chance), if they are so many deviations and
#: so many times above what lengths around it have, and this share of the source.
LIMIT_TEXTS, LIMIT_SIGMAS, LIMIT_TIMES, LIMIT_SHARE = 3, 6, 10, 0.003
#: Marks stand within so many characters below a limit (a word's length, for cuts between words).
MARK_WIDTH = 24
#: A token is no word if it stands this many times less often than words that begin with it (typing errors are not
#: vocabulary), and those stand at least so often.
PREFIX_RARER, PREFIX_LEAST = 500, 20
#: Share of its occurrences at which a word or pair may close a sentence or line and still count as going on. Three
#: more closings than counted are assumed: as many can be missed with 95 % certainty.
WORD_CLOSES, PAIR_CLOSES, UNSEEN = 0.005, 0.015, 3
#: Share of the occurrences of the last two words at which texts stop there by themselves: a cut hits a given occurrence far less often.
END_SHARE = 0.01
#: Share of the texts closed by lines of one beginning that end like this one, from which it is an end.
CLOSING_SHARE = 0.05

MEASURES = ("chars", "text_chars", "bytes", "text_bytes")


def word_keys(ids: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return sh.mix(ids.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return sh.mix(sh.mix(first.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + second.view(np.uint64)).view(np.int64)


def _key(kind: int, text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), kind) - (1 << 63)


def line_start(line: str) -> str:
    """First two tokens, numbers masked."""
    return " ".join(["#" if m[0].isdigit() else m[0].lower() for m in islice(_WORD.finditer(line), 2)])


def line_end(line: str) -> str:
    """Last three tokens or signs; numbers and codes, and names, masked."""
    return " ".join("#" if any(map(str.isdigit, w)) else "X" if w[0].isupper() else w for w in _SIGN.findall(line)[-3:])


def last_words(text: str, n: int) -> list[str]:
    """The last n words without accents; reads only as much of the end as it takes."""
    width = 16 * n
    while True:
        found = _WORD.findall(sh.fold(_plain(text[-width:])))
        if len(found) > n or width >= len(text):
            return found[-n:]
        width *= 4


def _plain(text: str) -> str:
    """Without entities, whose names would pass for words."""
    return html.unescape(text) if "&" in text else text


def half_entity(text: str) -> bool:
    """Ends inside an entity's name. Texts that write no entities may use the sign itself."""
    m = _HALF_ENTITY.search(text, max(0, len(text) - 8))
    if not m or m[1] in html.entities.html5 or m[1] + ";" in html.entities.html5:
        return False
    return any(name.startswith(m[1]) for name in html.entities.html5) and _ENTITY.search(text) is not None


def ending(text: str) -> dict:
    """What the end of a text shows, by itself."""
    stripped = text.rstrip()
    tail = max(0, len(stripped) - 60)  # a mark is shorter
    said = MARK.search(stripped, tail)
    dots = None if said else DOTS.search(stripped, tail)
    cut = (said or dots).start() if said or dots else len(stripped)
    body = text[:cut].rstrip()
    head = m.end() if (m := _HEAD.search(text)) else 0
    line = _plain(body.rsplit("\n", 1)[-1])
    words = _WORD.findall(line.lower())
    open_end = bool(body) and (body[-1].isalnum() or body[-1] in ",'’�(-")
    goes = open_end and not _CODE.search(line)
    return {
        "chars": len(text),
        "text_chars": len(text) - head,
        "bytes": len(text.encode("utf-8", "surrogatepass")),
        "text_bytes": len(text[head:].encode("utf-8", "surrogatepass")),
        "mark": "said" if said else "dots" if dots else None,
        "mark_at": max(0, cut - head),
        "open_end": open_end,
        "broken": stripped.endswith("�"),
        "entity": half_entity(stripped),
        "last": words[-1] if words and open_end and words[-1].isalpha() and body[-1].isalnum() else None,
        "last_id": sh._ids[words[-1]] if words and goes else 0,
        "before_id": sh._ids[words[-2]] if len(words) > 1 and goes else 0,
        "padded": len(stripped) < len(text),
        "line_key": _key(3, line_start(line)) if words else None,
        "same": _key(5, "".join(text.split())),
        "end_key": _key(4, " ".join(last_words(body, 8))),
        "closing": _key(6, line_start(line) + "|" + line_end(line)),
    }


_ENDING = "chars bigint, text_chars bigint, bytes bigint, text_bytes bigint, mark string, mark_at bigint, open_end boolean, padded boolean, broken boolean, entity boolean, last string, last_key bigint, pair_key bigint, line_key bigint, same bigint, end_key bigint, closing bigint"


def _endings(kinds: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [ending(t) for t in batch.column(3).to_pylist()]
            last, before = (np.array([r.pop(k) for r in rows], np.int64) for k in ("last_id", "before_id"))
            for r, w, p, has, two in zip(rows, word_keys(last).tolist(), pair_keys(before, last).tolist(), last != 0, before != 0):
                r["last_key"], r["pair_key"] = w if has else None, p if two else None
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], *[pa.array([r[f.name] for r in rows], f.type) for f in kinds]],
                names=["id", "source", "stated", *kinds.names]
            )

    return run


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, key, word, n, closed) of each batch: words and pairs with how many close a sentence or line;
    line beginnings with how many open a text's last line. A text's own end is not counted among them."""
    for batch in batches:
        parts: list[np.ndarray] = []
        ids: list[int] = []
        names: dict[int, str] = {}
        lines, finals = Counter(), Counter()
        for text in batch.column(0).to_pylist():
            body = _plain(text.rstrip())
            found = _TOKEN.findall(body.lower())
            while found and not found[-1][0].isalnum():
                found.pop()
            found = found[:-1]  # the last word may be half a word
            for w in set(found):
                if w[0].isalnum():
                    names[sh._ids[w]] = w
            ids += [sh._ids[w] if w[0].isalnum() else 1 for w in found]
            ids.append(0)  # no pair reaches over the end of a text
            if len(ids) > 50_000:  # numbers of Python take five times the room
                parts.append(np.array(ids, np.int64))
                ids = []
            starts = [k for line in body.split("\n") if (k := line_start(line))]
            if starts:
                finals[starts.pop()] += 1
                lines.update(starts)
        a = np.concatenate([*parts, np.array(ids, np.int64)])
        word = (a != 0) & (a != 1)
        nxt = np.append(a[1:], 0)
        out = []
        w, closes = a[word], (nxt[word] == 1)
        keys, at = np.unique(w, return_inverse=True)
        out.append(
            (
                1,
                word_keys(keys),
                [names[k] for k in keys.tolist()],
                np.bincount(at, minlength=len(keys)),
                np.bincount(at, weights=closes, minlength=len(keys)).astype(np.int64)
            )
        )
        pair = word[:-1] & word[1:]
        keys, at = np.unique(pair_keys(a[:-1][pair], a[1:][pair]), return_inverse=True)
        out.append(
            (
                2,
                keys,
                [None] * len(keys),
                np.bincount(at, minlength=len(keys)),
                np.bincount(at, weights=(nxt[1:] == 1)[pair], minlength=len(keys)).astype(np.int64)
            )
        )
        starts = list(lines.keys() | finals.keys())
        out.append(
            (
                3,
                [_key(3, s) for s in starts],
                [None] * len(starts),
                [lines[s] + finals[s] for s in starts],
                [finals[s] for s in starts]
            )
        )
        for kind, key, words, n, closed in out:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([kind] * len(words), pa.int32()),
                    pa.array(key, pa.int64()),
                    pa.array(words, pa.string()),
                    pa.array(n, pa.int64()),
                    pa.array(closed, pa.int64())
                ],
                names=["kind", "key", "word", "n", "closed"]
            )


@dataclass
class Truncation:
    #: (id, source, evidence): one row per id that is cut, with all kinds of evidence found on any of its rows.
    cut: DataFrame
    #: (source, texts, cut, share and cut by each kind of evidence): ids per source.
    by_source: DataFrame


def _limits(rows: DataFrame) -> DataFrame:
    """(source, measure, value): lengths at which a source cuts."""
    texts = rows.dropDuplicates(["source", "same"])
    measured = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in MEASURES])
    each = texts.select("source", "open_end", F.explode(measured).alias("m")).select("source", "open_end", "m.*")
    counts = each.groupBy("source", "measure", "value").agg(F.count("*").alias("n"), F.count_if("open_end").alias("open"))
    own = Window.partitionBy("source", "measure")
    near = own.orderBy("value").rangeBetween(-25, 25)
    counts = counts.withColumns({"around": (F.sum("n").over(near) - F.col("n")) / 50, "all": F.sum("n").over(own)})
    beyond = F.col("n") - F.col("around") >= LIMIT_SIGMAS * F.sqrt(F.col("around") + 0.1)
    many = (F.col("n") >= LIMIT_TEXTS) & (F.col("n") >= LIMIT_TIMES * F.col("around")) & (F.col("n") >= LIMIT_SHARE * F.col("all"))
    found = counts.where(beyond & many & (F.col("open") >= 0.5 * F.col("n")))
    # texts cut by one measure bunch in the others as well: the measure with most of them is the source's
    by_measure = found.groupBy("source", "measure").agg(F.sum("n").alias("cut"), F.collect_list("value").alias("values"))
    best = by_measure.groupBy("source").agg(F.max_by(F.struct("measure", "values"), F.struct("cut", "measure")).alias("m"))
    return best.select("source", "m.measure", F.explode("m.values").alias("value"))


def _mark_places(rows: DataFrame) -> DataFrame:
    """(source, mark_to): the length below which most of a source's marks stand, if they stand together."""
    marked = rows.where("mark is not null").dropDuplicates(["source", "same"]).groupBy("source", "mark_at").agg(F.count("*").alias("n"))
    own = Window.partitionBy("source")
    near = own.orderBy("mark_at").rangeBetween(-MARK_WIDTH, 0)
    counted = marked.withColumns({"together": F.sum("n").over(near), "all": F.sum("n").over(own)})
    best = counted.withColumn("k", F.row_number().over(own.orderBy(F.desc("together"), F.desc("mark_at")))).where("k = 1")
    return best.where(
        (F.col("together") >= LIMIT_TEXTS) & (F.col("together") >= 0.3 * F.col("all"))
    ).select("source", F.col("mark_at").alias("mark_to"))


def _at_limit() -> Column:
    """The text has a limit's length. In bytes, a character that did not fit is dropped (at most two bytes are free
    then, three for the rare ones of four bytes) or left as a replacement mark of three."""
    at = F.lit(False)
    for m in MEASURES:
        exact = F.array_contains(f"at_{m}", F.col(m))
        if "bytes" in m:
            dropped = F.exists(f"at_{m}", lambda v: (v - F.col(m)).between(1, 2)) & F.col("open_end")
            marked = F.exists(f"at_{m}", lambda v: F.abs(v - F.col(m)) <= 3) & F.col("broken")
            exact = exact | dropped | marked
        at = at | F.coalesce(exact, F.lit(False))
    return at


def _stated_by(rows: DataFrame) -> DataFrame:
    """(source, counts_by): the measure that a source's stated lengths agree with most often."""
    agree = rows.where("stated is not null").groupBy("source").agg(*[F.count_if(F.col("stated") == F.col(m)).alias(m) for m in MEASURES])
    best = F.array_max(F.array(*[F.struct(F.col(m).alias("n"), F.lit(m).alias("measure")) for m in MEASURES]))
    return agree.select("source", best.alias("b")).where("b.n > 0").select("source", F.col("b.measure").alias("counts_by"))


def _with_source(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Joined by source, NULL being one as well. ``table`` has a row a source."""
    named = broadcast_if_small(table.withColumnRenamed("source", "_source"))
    return rows.join(named, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")


def truncated(df: DataFrame, id_col: str, source_col: str, text_col: str, stated_col: str) -> Truncation:
    """Ids whose text was cut, and how many per source.

    ``stated_col`` is the length the source gives, in characters or bytes of the
    text or of its part after the first blank line; NULL gives no evidence. NULL
    ids or texts take no part; an empty text is only cut if a length is stated
    for it. NULL sources are one source. Repeated rows of an id count once and
    pool their evidence. An empty table gives empty results. Other columns are ignored, whatever their names.
    """
    docs = picked(df, id=id_col, source=source_col, stated=stated_col, text=text_col)
    docs = spread(docs.withColumn("stated", F.col("stated").cast("bigint")).where("id is not null and text is not null"))
    id_type = docs.schema["id"].dataType.simpleString()
    names = [c.split() for c in _ENDING.split(", ")]
    kinds = pa.schema([(n, {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[t]) for n, t in names])
    rows = written(docs.mapInArrow(_endings(kinds), f"id {id_type}, source string, stated bigint, {_ENDING}"), "endings")
    counts = docs.select("text").mapInArrow(_counts, "kind int, key bigint, word string, n bigint, closed bigint")
    counts = counts.groupBy("kind", "key").agg(F.max("word").alias("word"), F.sum("n").alias("n"), F.sum("closed").alias("closed"))
    counts = written(counts, "counts")

    # The trie of letters: every proper prefix of a word is a node, n its occurrences below. Nodes that end no text go first.
    ends = written(rows.where("last is not null").select("last").distinct(), "last")
    word = counts.where("kind = 1")
    prefixes_of = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", F.lit(1), i))
    nodes = word.where("length(word) > 1").select("n", F.explode(prefixes_of).alias("last"))
    below = nodes.join(broadcast_if_small(ends), "last", "left_semi").groupBy("last").agg(F.sum("n").alias("below"))
    known = word.select(F.col("word").alias("last"), F.col("n").alias("seen"))
    rare = (F.col("below") >= PREFIX_LEAST) & (F.coalesce("seen", F.lit(0)) * PREFIX_RARER < F.col("below"))
    prefixes = written(below.join(known, "last", "left").where(rare).select("last", F.lit(True).alias("prefix")), "prefixes")

    # The trie of words: nodes of one and two words, with how often they close a sentence or line.
    wanted = rows.select(F.explode(F.array("last_key", "pair_key", "line_key")).alias("key")).where("key is not null").distinct()
    of = written(counts.select("kind", "key", "n", "closed").join(wanted, "key"), "wanted")
    closes = F.col("closed") + UNSEEN
    inner = ((F.col("kind") == 1) & (closes < WORD_CLOSES * F.col("n"))) | ((F.col("kind") == 2) & (closes < PAIR_CLOSES * F.col("n")))
    goes_on = written(of.where(inner).select("key", F.lit(True).alias("on")), "goes-on")
    seen_words = written(of.where("kind = 1").select(F.col("key").alias("last_key"), F.lit(True).alias("word_known")), "words")
    closers = written(
        of.where("kind = 3 and closed >= 3 and closed >= 0.5 * n").select(
            F.col("key").alias("line_key"),
            F.lit(True).alias("closer")
        ),
        "closers"
    )

    # an end that several sources deliver alike is the text's own, if texts stop there in a share of the places that have its last two words
    stops = rows.where("open_end and pair_key is not null").groupBy("pair_key").agg(F.count("*").alias("stops"))
    places = of.where("kind = 2").select(F.col("key").alias("pair_key"), "n")
    often = F.col("stops") >= END_SHARE * (F.coalesce("n", F.lit(0)) + F.col("stops"))
    usual = stops.join(places, "pair_key", "left").where(often).select("pair_key")
    alike = rows.where("open_end").groupBy("end_key", "pair_key").agg(
        F.min("source").alias("a"),
        F.max("source").alias("b")
    ).where("a <> b")
    shared_ends = written(alike.join(usual, "pair_key").select("end_key", F.lit(True).alias("own_end")).distinct(), "ends")

    # at most 1 / LIMIT_SHARE lengths a source and measure
    lists = [F.collect_list(F.when(F.col("measure") == m, F.col("value"))).alias(f"at_{m}") for m in MEASURES]
    limits = written(_limits(rows).groupBy("source").agg(*lists), "limits")
    r = _with_source(_with_source(rows, limits), written(_mark_places(rows), "marks"))
    r = _with_source(r, written(_stated_by(rows), "stated")).withColumn("at_limit", _at_limit())
    stands = F.coalesce(F.col("mark_at").between(F.col("mark_to") - MARK_WIDTH, F.col("mark_to")), F.lit(False))
    r = r.withColumn("at_mark", F.col("mark").isNotNull() & stands)
    states = F.coalesce(*[F.when(F.col("counts_by") == m, F.col(m)) for m in MEASURES])
    r = r.withColumn("beyond", F.col("stated") - states)
    r = written(r.drop(*[f"at_{m}" for m in MEASURES], "mark_to", "counts_by", *MEASURES[:1], MEASURES[2]), "placed")

    # sources that name full lengths: most of their texts at the limit are stated longer
    full = r.where("at_limit and beyond is not null").groupBy("source").agg(
        (F.count_if(F.col("beyond") > 0) >= 0.5 * F.count("*")).alias("full")
    )
    # ends of texts that are not at a limit, as shares of the lines of their beginning
    final = r.where("not at_limit and not at_mark and line_key is not null").groupBy("line_key", "closing").agg(F.count("*").alias("n"))
    lines = final.groupBy("line_key").agg(F.sum("n").alias("all"))
    closings = final.join(lines, "line_key").where(
        F.col("n") >= CLOSING_SHARE * F.col("all")
    ).select("closing", F.lit(True).alias("ends_so")).distinct()
    closings = written(closings.join(r.where("at_limit").select("closing").distinct(), "closing", "left_semi"), "closings")

    r = _with_source(r, written(full, "full"))
    r = r.join(broadcast_if_small(prefixes), "last", "left")
    for key in ("last_key", "pair_key"):
        r = r.join(broadcast_if_small(goes_on.toDF(key, f"{key}_on")), key, "left")
    r = r.join(broadcast_if_small(closers), "line_key", "left").join(broadcast_if_small(shared_ends), "end_key", "left")
    r = r.join(broadcast_if_small(closings), "closing", "left").join(broadcast_if_small(seen_words), "last_key", "left")

    yes: dict[str, Column] = {}
    bare = F.col("mark").isNull()
    yes["length"] = F.col("stated") > F.greatest("text_chars", "text_bytes") + TOLERANCE
    yes["prefix"] = (F.coalesce("prefix", F.lit(False)) | F.col("entity")) & bare
    yes["unfinished"] = bare & F.col("open_end") & (
        F.col("last_key_on") | F.col("pair_key_on")
    ) & F.col("closer").isNull() & F.col("own_end").isNull()
    yes = {k: F.coalesce(c, F.lit(False)) for k, c in yes.items()}
    reached = F.coalesce(F.col("full") & (F.col("beyond") <= 0), F.lit(False))
    on = F.coalesce(F.col("last_key_on"), F.lit(False)) | F.coalesce(F.col("pair_key_on"), F.lit(False))
    ended = F.col("closer").isNotNull() & F.col("ends_so").isNotNull() & ~F.col("padded") & ~on & (
        F.col("last").isNull() | F.col("word_known").isNotNull()
    )
    ended = ended & ~F.coalesce(F.col("full") & (F.col("beyond") > 0), F.lit(False))
    yes["limit"] = (F.col("at_limit") & ~reached & ~(ended & ~yes["prefix"])) | F.col("at_mark")
    yes["mark"] = F.coalesce(F.col("mark") == "said", F.lit(False))
    # one row per id; sources are few, so a hot one is combined before the shuffle
    flags = r.select("id", "source", *[c.alias(k) for k, c in yes.items()])
    per_id = flags.groupBy("id").agg(F.min("source").alias("source"), *[F.max(k).alias(k) for k in yes])
    per_id = written(per_id.withColumn("cut", F.greatest(*[F.col(k) for k in yes])), "judged")
    evidence = F.array_compact(F.array(*[F.when(F.col(k), F.lit(k)) for k in yes]))
    cut = per_id.where("cut").select("id", "source", evidence.alias("evidence"))
    by_source = per_id.groupBy("source").agg(
        F.count("*").alias("texts"),
        F.count_if("cut").alias("cut"),
        *[F.count_if(k).alias(f"cut_by_{k}") for k in yes]
    )
    return Truncation(cut, by_source.withColumn("share", F.col("cut") / F.col("texts")))
