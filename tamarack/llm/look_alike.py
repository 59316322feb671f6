"""One consistent form for texts that look the same (problem 8).

Each Arrow partition is handed to an embedded DuckDB, whose SQL strips
invisible characters, unifies spaces, opens joined letters, maps compatibility
forms and look-alike letters, and composes accents. Compatibility forms are
those of the Unicode character database. Documents then compare equal by the
hash of that form.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.runtime import picked, spread, written

# Letters of other alphabets that look like a Latin letter, and that letter.
LOOK_ALIKES = {
    # Cyrillic
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ԛ": "Q", "Ѕ": "S", "Т": "T", "Ѵ": "V", "Ԝ": "W", "Х": "X", "У": "Y", "Ү": "Y", "Ԍ": "G",
    # Greek
    "α": "a", "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x", "γ": "y", "ϲ": "c", "ϳ": "j", "κ": "k",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    # a hyphen of its own width
    "‐": "-",
    # Armenian, Cherokee and Latin extensions
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "ı": "i", "ɡ": "g", "ɑ": "a",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꮢ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
}

# Characters without a glyph, and the kinds of space, as classes of RE2.
INVISIBLE = r"[\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{E0000}-\x{E0FFF}]"
SPACES = r"[\x{00A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"

#: Decompositions that keep the look; raised, lowered, circled characters and fractions do not.
SAME_LOOK = {"<font>", "<wide>", "<narrow>", "<noBreak>", "<compat>", "<square>", "<initial>", "<medial>", "<final>", "<isolated>"}


def compatible() -> dict[str, str]:
    """Compatibility forms of letters, numbers and symbols, and what they look like. Signs of their own width keep it
    only if wide or narrow; spaces and accents that stand alone are left."""
    table = {}
    for point in range(0x80, 0x110000):
        char = chr(point)
        kind = unicodedata.decomposition(char).split(" ", 1)[0]
        if kind in SAME_LOOK and (unicodedata.category(char)[0] in "LN" or unicodedata.category(char) == "So" or kind in ("<wide>", "<narrow>", "<noBreak>")):
            plain = unicodedata.normalize("NFKC", char)
            if plain != char and not plain.startswith(" "):
                table[char] = plain
    return table


def _tables() -> tuple[dict[str, str], dict[str, str]]:
    """What becomes one character (compatibility forms, look-alikes, look-alikes that carry a composed accent) and what becomes several."""
    single, several = dict(LOOK_ALIKES), {}
    for char, plain in compatible().items():
        if char not in single:
            plain = "".join(LOOK_ALIKES.get(c, c) for c in plain)
            (single if len(plain) == 1 else several)[char] = plain
    for c in (*range(0x370, 0x530), *range(0x1F00, 0x2000)):
        base, *marks = unicodedata.normalize("NFD", chr(c))
        if marks and base in LOOK_ALIKES:
            # the Greek tonos is drawn as an acute accent; NFD gives that one too
            composed = unicodedata.normalize("NFC", LOOK_ALIKES[base] + "".join(marks))
            if len(composed) == 1:
                single.setdefault(chr(c), composed)
    return single, several


SINGLE, SEVERAL = _tables()


def _ranges(chars: Iterable[str]) -> str:
    """The characters as the inside of an RE2 class."""
    out: list[list[int]] = []
    for point in sorted(map(ord, chars)):
        if out and out[-1][1] == point - 1:
            out[-1][1] = point
        else:
            out.append([point, point])
    return "".join(f"\\x{{{a:04X}}}-\\x{{{b:04X}}}" for a, b in out)


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def consistent_form_sql(column: str) -> str:
    """DuckDB expression of the consistent form of a text column."""
    e = f"regexp_replace({column}, '{INVISIBLE}', '', 'g')"
    e = f"regexp_replace({e}, '{SPACES}', ' ', 'g')"
    parts = f"MAP {{{', '.join(f'{_quoted(c)}: {_quoted(p)}' for c, p in SEVERAL.items())}}}"
    opened = f"array_to_string(list_transform(regexp_extract_all({e}, '(?s).'), lambda c: coalesce({parts}[c], c)), '')"
    e = f"CASE WHEN regexp_matches({column}, '[{_ranges(SEVERAL)}]') THEN {opened} ELSE {e} END"
    # composed first, so that a base letter and its marks meet the table as one letter; then again for what the table made of them
    return f"nfc_normalize(translate(nfc_normalize({e}), {_quoted(''.join(SINGLE))}, {_quoted(''.join(SINGLE.values()))}))"


def _plain() -> str:
    """Characters that no step changes: of Latin letters, general punctuation and currency signs, those of no table that
    composition leaves."""
    hidden = re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: f"\\U{m[1]:0>8}", f"{INVISIBLE}|{SPACES}"))
    own = (chr(c) for c in (*range(0x250), *range(0x2010, 0x20D0)))
    return _ranges(c for c in own if c not in SINGLE and c not in SEVERAL and not hidden.match(c) and unicodedata.normalize("NFC", c) == c)


#: Texts of nothing but these characters are their own consistent form; most texts are.
PLAIN = f"[{_plain()}]*"


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import duckdb

    con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "512MB"})
    sql = f"SELECT row, {consistent_form_sql('text')} AS form FROM part WHERE NOT regexp_full_match(text, '{PLAIN}')"
    for batch in batches:
        texts = batch.column(1)
        con.register("part", pa.table({"row": pa.array(range(len(texts)), pa.int64()), "text": texts}))
        rows, changed = (c.to_pylist() for c in con.sql(sql).to_arrow_table().columns)
        con.unregister("part")
        if rows:
            forms = texts.to_pylist()
            for r, form in zip(rows, changed):
                forms[r] = form
            texts = pa.array(forms, pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], names=["id", "text", "form"])


def consistent_form(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, form): each row's text and its consistent form.

    NULL texts have a NULL form, empty ones an empty form. The form keeps case,
    digits, accents, raised digits and fractions, line breaks and the number of
    spaces, for they are seen. It is idempotent. Other columns are ignored, whatever
    their names, and repeated ids are rows of their own.
    """
    docs = spread(picked(df, id=id_col, text=text_col))
    id_type = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(_forms, f"id {id_type}, text string, form string")


def look_alike_pairs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_a < id_b): each pair of rows of one consistent form but different texts.

    Rows meet as classes: equal texts collapse first, and only forms with
    several different texts are joined, so plain copies, however many, are
    never compared. NULL texts take no part.
    """
    forms = consistent_form(df, id_col, text_col).where("text is not null and id is not null")
    hashes = [F.unhex(F.sha2(c, 256)).alias(c) for c in ("form", "text")]
    hashed = written(forms.select("id", *hashes), "forms")  # the texts are read and normalised once
    # min and max differ where a form has several texts: a fixed-size state, combined before the shuffle
    several = hashed.groupBy("form").agg(F.min("text").alias("lo"), F.max("text").alias("hi")).where("lo <> hi").select("form")
    rows = hashed.join(several, "form", "left_semi")
    classes = rows.select("form", "text").distinct()
    x, y = classes.toDF("form", "text_x"), classes.toDF("form", "text_y")
    pairs = x.join(y, "form").where("text_x < text_y").drop("form")
    a, b = rows.select(F.col("id").alias("a"), F.col("text").alias("text_x")), rows.select(F.col("id").alias("b"), F.col("text").alias("text_y"))
    return pairs.join(a, "text_x").join(b, "text_y").select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))
