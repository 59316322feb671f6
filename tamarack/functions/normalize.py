"""Normalisation of extracted fields: NULL is "not stated", never zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.functions.text import strip
from tamarack.schemas import CONTRACT_SYNONYMS, FIELDS, INT_MINIMUM, LIST_FIELDS, REMOTE_SYNONYMS, SENTINELS


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def clean_scalar(c: Column) -> Column:
    """Stripped; NULL if it only says "not stated"."""
    s = strip(c)
    return F.when(~F.lower(s).isin(*SENTINELS), s)


def clean_list(c: Column) -> Column:
    """Stripped stated items, the first spelling of each, in order; NULL if none is left."""
    items = F.filter(F.transform(c, clean_scalar), lambda x: x.isNotNull())
    lowered = F.transform(items, F.lower)
    kept = F.filter(items, lambda x, i: F.array_position(lowered, F.lower(x)) == i + 1)
    return F.when(F.size(kept) > 0, kept)


def contract_type(c: Column) -> Column:
    """Code of a wording; ``other`` for one without a code."""
    return F.when(c.isNotNull(), F.coalesce(_lookup(CONTRACT_SYNONYMS, F.lower(strip(c))), F.lit("other")))


def remote_policy(c: Column) -> Column:
    """Code of a wording; NULL for one without a code."""
    return _lookup(REMOTE_SYNONYMS, F.lower(strip(c)))


def rhythm(contract: Column, c: Column) -> Column:
    return F.when(contract == "alternance", c)


def normalize_posting(df: DataFrame, struct: str) -> DataFrame:
    """``df`` with the posting struct normalised; a NULL struct stays NULL.

    Integers below their minimum become NULL here; the parser reports them instead.
    """
    of = lambda f: F.col(f"{struct}.{f}")
    out = {f: clean_list(of(f)) if f in LIST_FIELDS else of(f) if f in INT_MINIMUM else clean_scalar(of(f)) for f in FIELDS}
    out["contract_type"], out["remote_policy"] = contract_type(out["contract_type"]), remote_policy(out["remote_policy"])
    out["alternance_rhythm"] = rhythm(out["contract_type"], out["alternance_rhythm"])
    for f, least in INT_MINIMUM.items():
        out[f] = F.when(of(f) >= least, of(f))
    return df.withColumn(struct, F.when(F.col(struct).isNotNull(), F.struct(*[c.alias(f) for f, c in out.items()])))
