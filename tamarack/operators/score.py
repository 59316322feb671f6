"""Field-level scoring of predictions against gold records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.functions.text import normalize_free_text, strip
from tamarack.schemas import FIELDS, FREE_TEXT_FIELDS, LIST_FIELDS


def _as_set(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.lower(strip(x)))))


def values_match(field: str, gold: Column, predicted: Column) -> Column:
    if field in LIST_FIELDS:
        return _as_set(gold) == _as_set(predicted)
    if field in FREE_TEXT_FIELDS:
        return normalize_free_text(gold) == normalize_free_text(predicted)
    return gold == predicted


def verdict(field: str, gold: Column, predicted: Column) -> Column:
    """tp, fp, fn or tn; a wrong value is an fp only."""
    return (
        F.when(gold.isNull() & predicted.isNull(), "tn")
        .when(gold.isNotNull() & predicted.isNotNull() & values_match(field, gold, predicted), "tp")
        .when(predicted.isNotNull(), "fp")
        .otherwise("fn")
    )


def missing_predictions(gold: DataFrame, predicted: DataFrame, key: str = "posting_id") -> DataFrame:
    return gold.select(key).distinct().join(predicted.select(key), key, "left_anti")


def assert_complete(gold: DataFrame, predicted: DataFrame, key: str = "posting_id") -> None:
    missing = [r[0] for r in missing_predictions(gold, predicted, key).orderBy(key).limit(5).collect()]
    if missing:
        raise ValueError(f"gold postings without a prediction, among them {missing}")


def scored(gold: DataFrame, predicted: DataFrame, key: str = "posting_id", *, missing: str = "error") -> DataFrame:
    """Every gold posting beside its prediction, with a verdict column per field.

    ``gold`` has the key and a struct ``gold``, ``predicted`` the key, a struct
    ``predicted`` and ``valid``; both one row a key. A gold posting without a
    prediction is an error that names up to five; with ``missing="invalid"`` it
    counts as an invalid answer. Predictions of other postings are ignored.
    """
    if missing == "error":
        assert_complete(gold, predicted, key)
    elif missing != "invalid":
        raise ValueError(f"missing is {missing!r}, not error or invalid")
    pairs = gold.join(predicted, key, "left")
    return verdict_columns(pairs.withColumn("valid", F.coalesce("valid", F.lit(False))))


def scored_models(gold: DataFrame, predicted: DataFrame, model: str, models: list[str], key: str = "posting_id", *, missing: str = "error") -> DataFrame:
    """:func:`scored` for each of ``models``, named by the column ``model`` of ``predicted``: every model is asked for every posting."""
    every = gold.withColumn(model, F.explode(F.array(*[F.lit(m) for m in models]).cast("array<string>")))
    both = [key, model]
    if missing == "error":
        lacking = every.join(predicted.select(*both), both, "left_anti")
        shown = [tuple(r) for r in lacking.select(*both).orderBy(*both).limit(5).collect()]
        if shown:
            raise ValueError(f"gold postings without a prediction, among them {shown}")
    pairs = every.join(predicted, both, "left").withColumn("valid", F.coalesce("valid", F.lit(False)))
    return verdict_columns(pairs)


@dataclass
class Scores:
    #: One row: n_postings, json_validity_rate, exact_match_rate, macro_f1.
    summary: DataFrame
    #: One row per field: counts, precision, recall, f1.
    fields: DataFrame

    def text(self) -> str:
        return report_text(self.summary.first().asDict(), [r.asDict() for r in self.fields.collect()])


def score(gold: DataFrame, predicted: DataFrame, key: str = "posting_id", *, missing: str = "error") -> Scores:
    """Joins, checks and scores predictions against gold records; see :func:`scored`."""
    pairs = scored(gold, predicted, key, missing=missing)
    return Scores(score_summary(pairs), field_scores(pairs))


def verdict_columns(pairs: DataFrame, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """``pairs`` (gold and predicted structs) with one verdict column per field, ``v_<field>``."""
    return pairs.withColumns({f"v_{f}": verdict(f, F.col(f"{gold}.{f}"), F.col(f"{predicted}.{f}")) for f in FIELDS})


def verdicts(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Long form: keys, field, verdict."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"v_{f}").alias("verdict")) for f in FIELDS])
    return scored.select(*keys, F.explode(each).alias("v")).select(*keys, "v.field", "v.verdict")


def rates(counts: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    signal = tp + fp + fn > 0
    out = counts.withColumns(
        {"precision": F.when(signal, zero(F.try_divide(tp, tp + fp))), "recall": F.when(signal, zero(F.try_divide(tp, tp + fn)))}
    )
    return out.withColumn(
        "f1",
        F.when(signal, zero(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))))
    )


def field_scores(scored: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Per group and field: counts, precision, recall, f1 (NULL without signal).

    All 14 fields are counted in one aggregation of fixed width before they are
    turned into rows, so nothing is multiplied by 14 before the shuffle. Without groups all
    fields are there even for no rows.
    """
    groups = groups or []
    kinds = ("tp", "fp", "fn", "tn")
    counted = scored.groupBy(*groups).agg(*[F.count_if(F.col(f"v_{f}") == k).alias(f"{f}_{k}") for f in FIELDS for k in kinds])
    each = F.array(*[F.struct(F.lit(f).alias("field"), *[F.col(f"{f}_{k}").alias(k) for k in kinds]) for f in FIELDS])
    return rates(counted.select(*groups, F.explode(each).alias("c")).select(*groups, "c.*"))


def score_summary(scored: DataFrame, groups: list[str] | None = None, valid: str = "valid") -> DataFrame:
    """Per group: n_postings, json_validity_rate, exact_match_rate, macro_f1; 0.0 where there are no rows."""
    groups = groups or []
    exact = F.lit(True)
    for f in FIELDS:
        exact = exact & F.col(f"v_{f}").isin("tp", "tn")
    mean = lambda c: F.coalesce(F.avg(F.coalesce(c, F.lit(False)).cast("int")), F.lit(0.0))
    totals = scored.groupBy(*groups).agg(
        F.count("*").alias("n_postings"),
        mean(F.col(valid)).alias("json_validity_rate"),
        mean(exact).alias("exact_match_rate")
    )
    macro = field_scores(scored, groups).groupBy(*groups).agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"))
    return totals.join(macro, groups) if groups else totals.crossJoin(macro)  # one row each


def report_text(summary: dict, fields: list[dict]) -> str:
    """The printed report; n/a where there is no signal."""
    show = lambda v: "n/a" if v is None else f"{v:.3f}"
    head = [
        f"postings {summary['n_postings']}",
        f"JSON valid {summary['json_validity_rate']:.1%}",
        f"exact match {summary['exact_match_rate']:.1%}",
        f"macro F1 {summary['macro_f1']:.3f}"
    ]
    return "\n".join(
        [*head, *[f"{r['field']:24} P {show(r['precision']):>6} R {show(r['recall']):>6} F1 {show(r['f1']):>6}" for r in fields]]
    )
