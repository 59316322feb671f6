"""Projections between the stages: offers, records, results, messages, review forms."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.functions.text import clean_description, strip, strip_pii, text_hash
from tamarack.schemas import FIELDS, INT_MINIMUM, LIST_FIELDS, META_FIELDS


def header(title: Column, company: Column, location: Column) -> Column:
    """Title, then a line of company and place if either is there."""
    second = F.concat_ws(" — ", F.nullif(company, F.lit("")), F.nullif(location, F.lit("")))
    return F.concat(title, F.when(second != "", F.concat(F.lit("\n"), second)).otherwise(""))


def build_record(offers: DataFrame, source: str = "france_travail") -> DataFrame:
    """Raw postings of source offers (see ``schemas.OFFERS``); contact data is never projected."""
    title = strip(F.coalesce("intitule", F.lit("")))
    described = offers.withColumn("_description", strip_pii(clean_description(F.coalesce("description", F.lit("")))))
    raw = F.concat(header(title, F.col("entreprise.nom"), F.col("lieuTravail.libelle")), F.lit("\n\n"), F.col("_description"))
    meta = F.struct(*[(F.col("salaire.libelle") if f == "salaireLibelle" else F.col(f)).alias(f) for f in META_FIELDS])
    return described.select(
        F.concat(F.lit(f"{source}:"), "id").alias("posting_id"), F.lit(source).alias("source"), F.col("origineOffre.urlOrigine").alias("source_url"), "bucket", F.col("keyword").alias("matched_keyword"),
        title.alias("title"), raw.alias("raw_text"), text_hash(raw).alias("text_hash"), F.char_length("_description").alias("description_chars"), meta.alias("reference_metadata"), "plan_idx", "result_idx",
    )


def gold_record(candidates: DataFrame, corrected: DataFrame) -> DataFrame:
    """Reviewed records: the baseline's prediction beside the correction."""
    return candidates.select(
        "posting_id",
        "source",
        "bucket",
        "title",
        "raw_text",
        "text_hash",
        F.col("prediction").alias("groq_prediction")
    ).join(corrected.select("posting_id", "corrected"), "posting_id")


def prefill(*records: Column) -> Column:
    """The first record there is, whole, not field by field."""
    return F.coalesce(*records)


def metadata_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key/value rows of the reference metadata without NULLs."""
    each = F.array(*[F.struct(F.lit(f).alias("key"), F.col(f"reference_metadata.{f}").cast("string").alias("value")) for f in META_FIELDS])
    return df.select(*keys, F.explode(each).alias("m")).select(*keys, "m.key", "m.value").where("value is not null")


def form_payload(form: Column) -> Column:
    """Struct of a submitted form (a map of texts): blank is NULL, numbers are read if they are ones, lists split at commas."""
    out = []
    for f in FIELDS:
        v = F.try_element_at(form, F.lit(f))
        blank = strip(v) == ""
        if f in LIST_FIELDS:
            items = F.filter(F.transform(F.split(v, ","), strip), lambda x: x != "")
            c = F.when(F.size(items) > 0, items)
        elif f in INT_MINIMUM:
            c = F.when(~blank, strip(v).try_cast("bigint"))
        else:
            c = F.when(~blank, v)
        out.append(c.alias(f))
    return F.struct(*out)


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


SCHEMA_JSON = json.dumps(
    {
        "type": "object",
        "additionalProperties": False,
        "required": ["title"],
        "properties": {
            f: {
                "type": ["array", "null"],
                "items": {"type": "string"}
            }if f in LIST_FIELDS else {
                "type": ["integer", "null"],
                "minimum": INT_MINIMUM[f]
            } if f in INT_MINIMUM else {"type": "string"} if f == "title" else {"type": ["string", "null"]} for f in FIELDS
        }
    },
    ensure_ascii=False
)
SYSTEM_PROMPT = f"Extract the posting's fields as one JSON object. Use null for what the text does not state; never guess. Schema: {SCHEMA_JSON}"


def build_messages(raw_text: Column, examples: list[tuple[str, str]], system: str = SYSTEM_PROMPT) -> Column:
    """System, one user and assistant pair per example, then the text."""
    fixed = [message("system", F.lit(system))]
    for asked, answered in examples:
        fixed += [message("user", F.lit(asked)), message("assistant", F.lit(answered))]
    return F.array(*fixed, message("user", raw_text))


def to_contents(messages: Column) -> Column:
    """The same without the system message, as role/parts; assistant is called model."""
    rest = F.filter(messages, lambda m: m["role"] != "system")
    return F.transform(
        rest,
        lambda m: F.struct(
            F.when(m["role"] == "assistant", "model").otherwise(m["role"]).alias("role"),
            F.array(F.struct(m["content"].alias("text"))).alias("parts")
        )
    )


def correction(error: str) -> str:
    """What is said to a model whose answer was refused."""
    return f"Your answer could not be used ({error}). Send the corrected object alone, without any other text."


def retry_messages(messages: Column, answer: Column, error: Column) -> Column:
    """The conversation with the refused answer and :func:`correction`."""
    before, after = correction("\0").split("\0")
    said = message("user", F.concat(F.lit(before), error, F.lit(after)))
    return F.concat(messages, F.array(message("assistant", answer), said))


def form_values(body: Column) -> Column:
    """Map of a submitted form body (a=b&c=d, encoded as browsers do): the first value of each name, blank ones left out."""
    fields = F.filter(F.split(body, "&"), lambda p: p.rlike("^[^=]+=."))
    decoded = F.transform(
        fields,
        lambda p: F.struct(
            *[F.try_url_decode(F.regexp_extract(p, "^([^=]+)=(.*)$", k)).alias(n) for k, n in ((1, "key"), (2, "value"))]
        )
    )
    known = F.filter(decoded, lambda p: p["key"].isNotNull())
    names = F.transform(known, lambda p: p["key"])
    return F.map_from_entries(F.filter(known, lambda p, i: F.array_position(names, p["key"]) == i + 1))


def chat_example(raw_text: Column, prediction: Column, system: str = SYSTEM_PROMPT) -> Column:
    """Training example; the target keeps its NULLs."""
    return F.array(
        message("system", F.lit(system)),
        message("user", raw_text),
        message("assistant", F.to_json(prediction, {"ignoreNullFields": "false"}))
    )
