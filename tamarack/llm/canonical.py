"""Free-entered values mapped to a canonical list (problem 4).

A multi-pattern automaton over the folded names and aliases finds embedded
mentions; the longest that do not overlap count. Values without a mention, or
whose mention is only a part of a longer form that the value misspells, go to
token-set similarity. Its candidates come from an index of letter pairs, so a
value is compared only with forms it can resemble. Matching depends on the value
alone, so there is no shuffle: every task keeps what it has matched already.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm._shingles import fold
from tamarack.runtime import BROADCAST_BYTES, picked, spread

UNMATCHED = "unmatched"

#: Similarity from which a misspelt value counts as an entry, and from which a form counts that stands among other words.
THRESHOLD, AMONG_OTHERS = 0.75, 0.85
#: Closeness of two words that may be one, and letters of the shortest form sought among other words.
SAME_WORD, LONG = 0.7, 8

#: Letters of the shortest form that may be misspelt: between shorter ones, one letter is all the difference.
SHORTEST = 5

# Digits typed for letters.
DIGITS_FOR_LETTERS = str.maketrans("01345", "oieas")

_TOKEN = re.compile(r"[^\W_]+")


def tokens(value: str) -> list[str]:
    """Folded letters-and-digits runs; digits inside a word are read as the letters they resemble."""
    found = _TOKEN.findall(fold(unicodedata.normalize("NFKC", value)))
    return [
        t.translate(DIGITS_FOR_LETTERS) if not t.isdigit() and sum(
            map(str.isdigit, t)
        )== 1 and len(t) > 3 and not t[-1].isdigit() and not t[0].isdigit() or re.fullmatch(
            r"[01][a-z]{4,}",
            t
        ) else t for t in found
    ]


def edits(a: str, b: str, most: int) -> int:
    """Edits (insert, delete, replace, swap of neighbours) from a to b; ``most`` + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


def closeness(a: str, b: str, least: float) -> float:
    """1 - edits / longer length; 0 if below ``least``."""
    longest = max(len(a), len(b)) or 1
    d = edits(a, b, int((1 - least) * longest + 1e-9))
    return s if (s := 1 - d / longest) >= least else 0.0


class Index:
    """Strings by their pairs of neighbouring letters."""

    def __init__(self, strings: Sequence[str]):
        self.strings, self.lengths = list(strings), np.array([len(s) for s in strings], np.int64)
        found: dict[str, list[int]] = {}
        for i, s in enumerate(self.strings):
            for pair in self._pairs(s):
                found.setdefault(pair, []).append(i)
        self.having = {pair: np.array(own) for pair, own in found.items()}

    @staticmethod
    def _pairs(s: str) -> set[str]:
        s = f" {s} "
        return {s[i : i + 2] for i in range(len(s) - 1)}

    def near(self, value: str, least: float) -> list[tuple[int, float]]:
        """(number, closeness) of the strings at least so close.

        None is missed: an edit breaks at most three pairs of the longer string,
        and a repeated pair counts once, which is allowed for.
        """
        pairs = self._pairs(value)
        lists = [self.having[p] for p in pairs if p in self.having]
        if not lists:
            return []
        numbers, shared = np.unique(np.concatenate(lists), return_counts=True)
        longest = np.maximum(self.lengths[numbers], len(value))
        repeated = len(value) + 1 - len(pairs)
        may = shared >= np.maximum(1, longest + 1 - repeated - 3 * np.floor((1 - least) * longest + 1e-9))
        scored = ((int(i), closeness(value, self.strings[i], least)) for i in numbers[may])
        return [(i, c) for i, c in scored if c > 0]


class Matcher:
    """Matches the values of one field. Entries: (code, form); a code is a form of itself."""

    def __init__(self, entries: Sequence[tuple[str, str]], threshold: float = THRESHOLD):
        self.threshold, self.seen = threshold, {}
        forms: dict[tuple[str, ...], str] = {}
        for code, form in entries:
            forms.setdefault(tuple(tokens(form)), code)
        for code, _ in entries:
            forms.setdefault(tuple(tokens(code)), code)
        forms.pop((), None)
        self.forms = list(forms.items())
        self.exact = {"".join(f): code for f, code in reversed(self.forms)}
        self.sorted = {tuple(sorted(f)): code for f, code in reversed(self.forms)}
        self.automaton = ahocorasick.Automaton()
        for i, (f, _) in enumerate(self.forms):
            self.automaton.add_word(f" {' '.join(f)} ", i)
            if len(f) == 1 and len(f[0]) < SHORTEST:  # C.D.I.
                self.automaton.add_word(f" {' '.join(f[0])} ", i)
        self.automaton.make_automaton()
        self.compact = Index(["".join(f) for f, _ in self.forms])
        self.words = Index(list(dict.fromkeys(t for f, _ in self.forms for t in f)))
        self.with_word: dict[str, list[int]] = {}
        for i, (f, _) in enumerate(self.forms):
            for t in dict.fromkeys(f):
                self.with_word.setdefault(t, []).append(i)
        self.partners: dict[str, list[tuple[str, float]]] = {}

    def within_longer(self, number: int) -> bool:
        """Whether another form has all words of this one and more."""
        own = set(self.forms[number][0])
        rarest = min((self.with_word[t] for t in own), key=len)
        return any(own < set(self.forms[i][0]) for i in rarest)

    def partners_of(self, word: str) -> list[tuple[str, float]]:
        """Words of forms that this word may be."""
        if word not in self.partners:
            if len(self.partners) > 200_000:
                self.partners.clear()
            near = [(word, 1.0)] if word in self.with_word else []
            if len(word) >= SHORTEST:
                near += [(self.words.strings[i], c) for i, c in self.words.near(word, SAME_WORD) if c < 1]
            self.partners[word] = near
        return self.partners[word]

    def mentions(self, value: Sequence[str]) -> list[int]:
        """Forms mentioned in the value: the longest first, none overlapping."""
        text = f" {' '.join(value)} "
        found = sorted(
            ((end - len(" ".join(self.forms[i][0])) - 1, end, i) for end, i in self.automaton.iter(text)),
            key=lambda m: (m[0] - m[1], m[0])
        )
        taken, kept = [False] * len(text), []
        for start, end, i in found:
            if not any(taken[max(0, start + 1) : end]):
                kept.append(i)
                taken[max(0, start + 1) : end] = [True] * (end - max(0, start + 1))
        return kept

    def token_sets(self, value: Sequence[str]) -> dict[int, float]:
        """Similarity of each form that shares words with the value: letters of the form's words met, each word by its
        closest partner, of the letters of the larger of both; or of the form's own, if it is long and stands among other words."""
        partners: dict[int, list[tuple[float, int, str]]] = {}
        for k, word in enumerate(value):
            for t, c in self.partners_of(word):
                for i in self.with_word[t]:
                    partners.setdefault(i, []).append((c, k, t))
        size, found = sum(map(len, value)), {}
        for i, pairs in partners.items():
            open_words = Counter(self.forms[i][0])
            used: set[int] = set()
            met = 0.0
            for c, k, t in sorted(pairs, key=lambda p: (-p[0], -len(p[2]), p[1])):
                if k not in used and open_words[t]:
                    used.add(k)
                    open_words[t] -= 1
                    met += c * len(t)
            own = int(self.compact.lengths[i])
            similarity = met / max(own, size)
            if similarity < self.threshold and own >= LONG and met / own >= AMONG_OTHERS:
                similarity = self.threshold * met / own  # below any form that is the whole value
            found[i] = similarity
        return found

    def similar(self, value: Sequence[str], around: set[str] | None = None) -> tuple[float, int]:
        """Best similarity and its form (the longest of equals, then the first); (0, -1) if none is similar. With
        ``around``, only forms that have all these words and more. All letters in order, spaces aside, count as well."""
        scores = self.token_sets(value)
        for i, c in self.compact.near("".join(value), self.threshold):
            scores[i] = max(scores.get(i, 0.0), c)
        least = self.threshold * AMONG_OTHERS
        fit = [
            (s, int(self.compact.lengths[i]), -i)
            for i, s in scores.items()
            if s >= least and self.compact.lengths[i] >= SHORTEST and (around is None or around < set(self.forms[i][0]))
        ]
        score, _, number = max(fit, default=(0.0, 0, 1))
        return score, -number

    def code(self, value: str) -> tuple[str, str]:
        """(code, how): how is exact, mention, similar or none."""
        if value in self.seen:
            return self.seen[value]
        if len(self.seen) > 200_000:
            self.seen.clear()
        self.seen[value] = found = self._code(tokens(value))
        return found

    def _code(self, value: list[str]) -> tuple[str, str]:
        if not value or not self.forms:
            return UNMATCHED, "none"
        if code := self.exact.get("".join(value)) or self.sorted.get(tuple(sorted(value))):
            return code, "exact"
        kept = self.mentions(value)
        if kept:
            # "ocasional remote work" mentions "remote", but is a misspelt longer form around it
            score, i = self.similar(value, set(self.forms[kept[0]][0])) if self.within_longer(kept[0]) else (0.0, -1)
            return (self.forms[i][1], "similar") if i >= 0 else (self.forms[kept[0]][1], "mention")
        score, i = self.similar(value)
        return (self.forms[i][1], "similar") if i >= 0 else (UNMATCHED, "none")


def canonical_codes(df: DataFrame, id_col: str, values: dict[str, str], reference: DataFrame) -> DataFrame:
    """(id, field, value, code, how) for each row and field whose value is neither NULL nor blank nor exactly a code.

    ``values`` names the column of each field's typed value, or a dotted path into a struct column; ``reference``
    has ``field``, ``code`` and ``form``. ``code`` is ``unmatched`` where the
    value means no entry. Of several mentions the longest wins, then the first;
    of equally similar forms, the first listed. Repeated rows each get a result;
    NULLs in ``reference`` are ignored; with an empty one all is unmatched. The list is
    sent to every task: one above ``BROADCAST_BYTES`` is an error, never cut.
    """
    order = "ref_id" if "ref_id" in reference.columns else "form"
    listed = picked(
        reference,
        field="field",
        code="code",
        form="form",
        _order=order
    ).where("field is not null and code is not null and form is not null")
    size = listed.agg(F.sum(F.octet_length("code") + F.octet_length("form") + 64)).first()[0] or 0
    if size > BROADCAST_BYTES:
        raise ValueError(f"the reference list takes {size} bytes, more than the {BROADCAST_BYTES} that may be sent to every task")
    entries: dict[str, list[tuple[str, str]]] = {field: [] for field in values}
    for r in listed.where(F.col("field").isin(*values)).orderBy(F.col("_order").asc_nulls_last(), "form").collect():
        entries[r.field].append((r.code, r.form))
    codes = {field: {c for c, _ in own} for field, own in entries.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers = {field: Matcher(own) for field, own in entries.items()}
        for batch in batches:
            keep, out = [], []
            for k, (field, value) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                if value is not None and value.strip() and value not in codes[field]:
                    keep.append(k)
                    out.append(matchers[field].code(value))
            part = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array([c for c, _ in out], pa.string()), pa.array([h for _, h in out], pa.string())],
                names=["id", "field", "value", "code", "how"]
            )

    roots = {f"v{i}": path.split(".")[0] for i, path in enumerate(values.values())}
    each = []
    for v, (field, path) in zip(roots, values.items()):
        value = F.col(v)
        for name in path.split(".")[1:]:
            value = value.getField(name)
        each.append(F.struct(F.lit(field).alias("field"), value.cast("string").alias("value")))
    rows_in = spread(picked(df, id=id_col, **roots)).select(
        "id",
        F.explode(F.array(*each)).alias("t")
    ).select("id", "t.field", "t.value").where("value is not null")
    id_type = rows_in.schema["id"].dataType.simpleString()
    return rows_in.mapInArrow(run, f"id {id_type}, field string, value string, code string, how string")
