"""Model output parsed and validated against the closed posting schema.

JSON's lenient corners (last of repeated keys, NaN, trailing text refused) and
the coercions differ from Spark's JSON readers, so this is an Arrow UDF.
"""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tamarack.functions.text import strip_fences
from tamarack.schemas import CONTRACT_SYNONYMS, FIELDS, INT_MINIMUM, LIST_FIELDS, POSTING, REMOTE_SYNONYMS, SENTINELS

_INT = re.compile(r"\s*[+-]?[0-9]+(_[0-9]+)*(\.0+)?\s*", re.A)


class Violation(ValueError):
    pass


def _stated(value):
    if isinstance(value, str):
        value = value.strip()
        return None if value.lower() in SENTINELS else value
    return value


def _items(value):
    if not isinstance(value, list):
        return value
    kept: dict[str, str] = {}
    for item in value:
        if isinstance(item, str) and (s := _stated(item)) is not None:
            kept.setdefault(s.lower(), s)
    return list(kept.values()) or None


def _whole(field: str, value) -> int:
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, float) and math.isfinite(value) and value.is_integer() and abs(value) < 2**63:
        return int(value)
    if isinstance(value, str) and _INT.fullmatch(value):
        value = int(value.strip().split(".")[0].replace("_", ""))
    if isinstance(value, int) and -(2**63) <= value < 2**63:
        return value
    raise Violation(f"{field}: not a whole number")


def check_posting(payload) -> dict:
    """The posting a payload states; raises :class:`Violation`. Values are cleaned before they are judged."""
    if not isinstance(payload, dict):
        raise Violation("not an object")
    if extra := [k for k in payload if k not in FIELDS]:
        raise Violation(f"{extra[0]}: no such field")
    out = {f: _items(payload.get(f)) if f in LIST_FIELDS else _stated(payload.get(f)) for f in FIELDS}
    if out["contract_type"] is not None:
        out["contract_type"] = CONTRACT_SYNONYMS.get(str(out["contract_type"]).strip().lower(), "other")
    if out["remote_policy"] is not None:
        out["remote_policy"] = REMOTE_SYNONYMS.get(str(out["remote_policy"]).strip().lower())
    if out["title"] is None:
        raise Violation("title: missing")
    for f, value in out.items():
        if value is None:
            continue
        if f in LIST_FIELDS:
            if not isinstance(value, list):
                raise Violation(f"{f}: not a list")
        elif f in INT_MINIMUM:
            out[f] = _whole(f, value)
            if out[f] < INT_MINIMUM[f]:
                raise Violation(f"{f}: below {INT_MINIMUM[f]}")
        elif not isinstance(value, str):
            raise Violation(f"{f}: not a text")
    if out["contract_type"] != "alternance":
        out["alternance_rhythm"] = None
    return out


def parse_stripped(text: str | None) -> tuple[dict | None, str | None, str | None]:
    """(posting, error kind, error) of a text without fences."""
    try:
        return check_posting(json.loads(text or "")), None, None
    except Violation as e:
        return None, "schema_violation", f"schema_violation: {e}"
    except (ValueError, RecursionError) as e:
        return None, "invalid_json", f"invalid_json: {e}"


def _parse(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_stripped(t) for t in texts], columns=["posting", "error_kind", "error"], dtype=object)


def parse_posting(raw: Column) -> Column:
    """posting, error_kind and error of a model's answer; NULL is invalid JSON."""
    return pandas_udf(_parse, f"STRUCT<posting {POSTING}, error_kind STRING, error STRING>")(strip_fences(raw))
