"""Queries of the core operators over the given tables."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.functions import normalize as N
from tamarack.functions import text as T
from tamarack.functions.parse import parse_posting
from tamarack.operators import dedupe, partition, records, score, split, stats
from tamarack.runtime import kept, shared_folder, spread, table
from tamarack.schemas import FIELDS, META_FIELDS, OFFERS, RESULT
from tamarack.sources import jsonl, paged
from tamarack.streaming import labelling

OWNERS = 5
TEST_ROWS = 100
PROVIDERS = ["north", "south", "east", "west"]
#: Labellers compared at once.
MODELS = 1000


def _postings(s: SparkSession, d: str) -> DataFrame:
    """Postings with their length, counted where the source gives none, and their own hash."""
    p = spread(table(s, d, "postings").select("posting_id", "bucket", "matched_keyword", "seq", "description_chars", "raw_text"))
    return p.withColumns(
        {
            "description_chars": F.coalesce("description_chars", F.char_length("raw_text")),
            "text_hash": T.text_hash(F.col("raw_text"))
        }
    )


def text_hash_dedupe(s, d):
    flags = dedupe.ingest_flags(_postings(s, d).select("posting_id", "seq", "description_chars", "text_hash"), "posting_id", ["seq"])
    return flags.where("kept").select("posting_id", "seq", "text_hash")


def pii_scrub(s, d):
    return spread(table(s, d, "documents").select("doc_id", "text")).select("doc_id", T.strip_pii(F.col("text")).alias("scrubbed"))


def text_normalize(s, d):
    return spread(table(s, d, "documents").select("doc_id", "text")).select(
        "doc_id",
        T.text_hash(F.col("text")).alias("text_hash"),
        F.char_length(T.normalize_text(F.col("text"))).alias("chars")
    )


def html_clean(s, d):
    return spread(table(s, d, "postings").select("seq", "raw_text")).select("seq", T.clean_description(F.col("raw_text")).alias("cleaned"))


def build_record(s, d):
    """Records rebuilt from labelled postings: title, employer and place of the label over the scrubbed text."""
    t = spread(table(s, d, "train").where("prediction is not null").select("split_seq", "title", "prediction", "raw_text"))
    body = t.withColumn("_body", T.strip_pii(T.normalize_whitespace(F.col("raw_text"))))
    raw = F.concat(
        records.header(T.strip(F.col("title")), F.col("prediction.company"), F.col("prediction.location")),
        F.lit("\n\n"),
        F.col("_body")
    )
    return body.select(
        "split_seq",
        raw.alias("raw_text"),
        F.sha2(T.normalize_text(raw), 256).alias("text_hash"),
        F.char_length("_body").alias("description_chars")
    )


def id_dedupe_first_wins(s, d):
    """First row of each id in plan order, then order of arrival, before the length filter."""
    plan = table(s, d, "keyword_plan").select("plan_idx", F.col("keyword").alias("matched_keyword"))
    rows = _postings(s, d).select("posting_id", "matched_keyword", "seq", "description_chars").join(plan, "matched_keyword")
    return dedupe.first_per_key(
        rows,
        ["posting_id"],
        F.col("plan_idx"),
        F.col("seq")
    ).where("description_chars >= 200").select("posting_id", "plan_idx", "seq")


def plan_counts(s, d):
    """Rows each query of the plan gave, and how many its cap lets through."""
    plan = table(s, d, "keyword_plan")
    got = table(s, d, "postings").groupBy(F.col("matched_keyword").alias("keyword")).agg(F.count("*").alias("found"))
    joined = plan.join(got, "keyword", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return joined.select(
        "plan_idx",
        "bucket",
        "keyword",
        "found",
        F.least("found", F.coalesce("cap", "found")).cast("bigint").alias("fetched")
    )


def hash_partition(s, d):
    return table(s, d, "postings").select("seq", partition.hash_partition(F.col("posting_id"), OWNERS).alias("part"))


def partition_balance(s, d):
    return hash_partition(s, d).groupBy("part").agg(F.count("*").alias("rows"))


def resume_anti_join(s, d):
    return partition.remaining(table(s, d, "postings").select("posting_id", "seq"), table(s, d, "predictions"), "posting_id")


def bucket_counts(s, d):
    return split.bucket_sizes(table(s, d, "postings"), "bucket", "seq")


def ingest_summary(s, d):
    return dedupe.ingest_summary(
        dedupe.ingest_flags(
            _postings(s, d).select("posting_id", "bucket", "seq", "description_chars", "text_hash"),
            "posting_id",
            ["seq"]
        )
    )


def provider_parts(s, d):
    """The provider that owns each posting not labelled yet."""
    todo = partition.remaining(table(s, d, "postings").select("posting_id", "seq"), table(s, d, "predictions"), "posting_id")
    parts = [partition.owned(todo, "posting_id", PROVIDERS, p).withColumn("provider", F.lit(p)) for p in PROVIDERS]
    return reduce(DataFrame.unionByName, parts)


def search_scan(s, d):
    """The plan's queries against the postings as a paged service: pages of 150, at most 1,150 rows or the cap of each."""
    paged.register(s)
    plan = [
        list(r) for r in table(s, d, "keyword_plan").select(
            "plan_idx",
            "bucket",
            "keyword",
            "cap"
        ).orderBy("plan_idx").limit(10_000).collect()
    ]
    options = {
        "transport": "tamarack.sources.paged:ParquetTransport",
        "path": f"{d}/postings.parquet",
        "plan": json.dumps(plan),
        "interval_seconds": "0"
    }
    return s.read.format("paged_search").options(**options).load().select("plan_idx", "result_idx", "bucket", "keyword", "id", "intitule")


def jsonl_round_trip(s, d):
    """Predictions written as JSON Lines with explicit nulls and read back by their schema."""
    rows = table(s, d, "predictions").select(
        "pred_id",
        "posting_id",
        "prediction",
        "valid",
        "error",
        "attempts",
        "latency_seconds",
        "labeller"
    )
    path = f"{shared_folder(s)}/jsonl-{uuid.uuid4().hex}"
    jsonl.write_jsonl(rows, path)
    kept(s, path)
    read = jsonl.read_jsonl(s, path, f"pred_id BIGINT, posting_id STRING, {RESULT}")
    return read.select(
        "pred_id",
        "posting_id",
        "prediction.title",
        "prediction.duration_months",
        F.array_join("prediction.required_skills", "|").alias("skills"),
        "valid",
        "error",
        "attempts",
        "latency_seconds",
        "labeller"
    )


def review_neighbours(s, d):
    """The test postings before and after each one."""
    rows = table(s, d, "test").select("posting_id", "split_seq")
    return dedupe.neighbours(rows, "posting_id", "split_seq")


def form_fields(s, d):
    """Labels sent as form bodies and read back: blank is NULL, numbers and lists are parsed."""
    names = ("title", "company", "duration_months", "required_skills")
    texts = [
        F.coalesce(
            F.array_join(f"prediction.{n}", ", ") if n == "required_skills" else F.col(f"prediction.{n}").cast("string"),
            F.lit("")
        ) for n in names
    ]
    body = F.array_join(F.array(*[F.concat(F.lit(f"{n}="), F.url_encode(t)) for n, t in zip(names, texts)]), "&")
    form = records.form_payload(records.form_values(body))
    return table(s, d, "train").select("split_seq", form.alias("p")).select(
        "split_seq",
        "p.title",
        "p.company",
        "p.duration_months",
        F.array_join("p.required_skills", "|").alias("skills")
    )


def retry_conversation(s, d):
    """The conversation of each failed prediction, with what was wrong."""
    failed = table(s, d, "predictions").where("not valid and error is not null")
    m = records.retry_messages(F.array(records.message("user", F.col("posting_id"))), F.lit("{}"), F.col("error"))
    return failed.select("pred_id", F.posexplode(m).alias("pos", "m")).select("pred_id", "pos", "m.role", "m.content")


def _labelled(s, d):
    """One row per posting: its latest prediction beside the posting's first row."""
    first = dedupe.first_per_key(_postings(s, d).select("posting_id", "bucket", "seq", "text_hash"), ["posting_id"], F.col("seq"))
    return first.join(
        dedupe.last_per_key(
            table(s, d, "predictions").select("posting_id", "pred_id", "valid", "labeller"),
            ["posting_id"],
            "pred_id"
        ),
        "posting_id"
    )


def largest_remainder_allocation(s, d):
    return split.allocate(split.bucket_sizes(_labelled(s, d), "bucket", "seq"), TEST_ROWS).select("bucket", "n", "alloc")


def test_split(s, d):
    return split.train_test(_labelled(s, d), "posting_id", "bucket", "seq", TEST_ROWS)[1].select("posting_id", "bucket", "valid")


def train_split(s, d):
    """What is left for training, without the texts that a test posting has under another id."""
    parts = split.train_test(_labelled(s, d), "posting_id", "bucket", "seq", TEST_ROWS, hash_col="text_hash", leakage="drop")
    return parts[0].select("posting_id", "bucket", "valid")


def holdout_split(s, d):
    return split.holdout(
        dedupe.last_per_key(table(s, d, "train").select("posting_id", "split_seq"), ["posting_id"], "split_seq"),
        "posting_id",
        0.05
    ).select("posting_id", "held_out")


def leakage_overlap(s, d):
    a, b = (table(s, d, t).withColumn("text_hash", T.text_hash(F.col("raw_text"))) for t in ("train", "test"))
    return dedupe.overlap(a, b, "posting_id").select(F.lit("posting_id").alias("kind"), F.col("posting_id").alias("value")).unionByName(
        dedupe.overlap(a, b, "text_hash").select(F.lit("text_hash").alias("kind"), F.col("text_hash").alias("value"))
    )


def normalize_contract(s, d):
    return table(s, d, "predictions").select(
        "pred_id",
        N.contract_type(N.clean_scalar(F.col("prediction.contract_type"))).alias("contract_type")
    )


def normalize_remote(s, d):
    return table(s, d, "predictions").select(
        "pred_id",
        N.remote_policy(N.clean_scalar(F.col("prediction.remote_policy"))).alias("remote_policy")
    )


def sentinel_null(s, d):
    return table(s, d, "predictions").select(
        "pred_id",
        N.clean_scalar(F.col("prediction.remote_policy")).alias("remote_policy"),
        N.clean_scalar(F.col("prediction.contract_type")).alias("contract_type")
    )


def list_clean(s, d):
    both = F.concat(
        F.coalesce("prediction.required_skills", F.array().cast("array<string>")),
        F.coalesce("prediction.nice_to_have_skills", F.array().cast("array<string>"))
    )
    return table(s, d, "train").select("split_seq", F.array_join(N.clean_list(both), "|").alias("skills"))


def rhythm_rule(s, d):
    return N.normalize_posting(table(s, d, "predictions"), "prediction").select(
        "pred_id",
        "prediction.contract_type",
        "prediction.alternance_rhythm"
    )


def free_text_normalize(s, d):
    return table(s, d, "postings").select("seq", T.normalize_free_text(F.col("title")).alias("title"))


def _pairs(s, d, per_labeller: bool = False):
    gold = dedupe.last_per_key(
        table(s, d, "train").select("posting_id", "split_seq", F.col("prediction").alias("gold")),
        ["posting_id"],
        "split_seq"
    )
    keys = ["posting_id", "labeller"] if per_labeller else ["posting_id"]
    pred = dedupe.last_per_key(
        table(s, d, "predictions").select("posting_id", "labeller", "pred_id", "valid", F.col("prediction").alias("predicted")),
        keys,
        "pred_id"
    )
    if per_labeller:  # labellers are few; each is asked for every gold posting
        models = [
            r[0] for r in pred.select("labeller").where(
                "labeller is not null"
            ).distinct().orderBy("labeller").limit(MODELS).collect()
        ]
        return score.scored_models(gold, pred, "labeller", models, missing="invalid")
    return score.scored(gold, pred.drop("labeller"), missing="invalid")


def field_verdicts(s, d):
    return score.verdicts(_pairs(s, d), ["posting_id"])


def field_scores(s, d):
    return _rounded(score.field_scores(_pairs(s, d)), "precision", "recall", "f1")


def score_summary(s, d):
    return _rounded(score.score_summary(_pairs(s, d)), "json_validity_rate", "exact_match_rate", "macro_f1")


def model_comparison(s, d):
    return _rounded(score.score_summary(_pairs(s, d, True), ["labeller"]), "json_validity_rate", "exact_match_rate", "macro_f1")


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 9) for c in columns})


def missing_predictions(s, d):
    return score.missing_predictions(table(s, d, "train"), table(s, d, "predictions"))


def latency_stats(s, d):
    return _rounded(stats.latency_stats(table(s, d, "predictions"), ["labeller"]), "mean")


def labelling_counts(s, d):
    return labelling.progress(table(s, d, "predictions"))


def upsert_last_wins(s, d):
    """Corrections (the later half by pred_id) over earlier rows, for the test candidates, in their order."""
    p = table(s, d, "predictions").select("posting_id", "pred_id", "labeller")
    candidates = table(s, d, "test").select("posting_id", "split_seq")
    return dedupe.upsert(p.where("pred_id % 2 = 0"), p.where("pred_id % 2 = 1"), "posting_id", "pred_id", candidates, "split_seq")


def first_uncorrected(s, d):
    return dedupe.first_open(table(s, d, "test"), table(s, d, "predictions"), "posting_id", "split_seq")


def gold_records(s, d):
    corrected = dedupe.last_per_key(
        table(s, d, "predictions").where("prediction is not null").select(
            "posting_id",
            "pred_id",
            F.col("prediction").alias("corrected")
        ),
        ["posting_id"],
        "pred_id"
    )
    return records.gold_record(table(s, d, "test"), corrected).select(
        "posting_id",
        "title",
        F.col("groq_prediction.title").alias("baseline_title"),
        F.col("corrected.title").alias("corrected_title")
    )


def review_prefill(s, d):
    saved = dedupe.last_per_key(
        table(s, d, "predictions").where("valid").select("posting_id", "pred_id", F.col("prediction").alias("saved")),
        ["posting_id"],
        "pred_id"
    )
    rows = table(s, d, "test").join(saved, "posting_id", "left").withColumn("shown", records.prefill(F.col("saved"), F.col("prediction")))
    return rows.select("split_seq", F.col("shown.title").alias("title"), F.col("shown.company").alias("company"))


def metadata_rows(s, d):
    return records.metadata_rows(table(s, d, "postings"), ["seq"])


def preview_text(s, d):
    return table(s, d, "documents").select("doc_id", T.preview(F.col("text"), 300).alias("preview"))


_EXAMPLE = [("Développeur H/F\nSociété Exemple — Ville\n\nCDI.", '{"title": "Développeur H/F", "contract_type": "cdi"}')]


def chat_messages(s, d):
    m = records.build_messages(F.col("raw_text"), _EXAMPLE)
    return table(s, d, "train").select("split_seq", F.posexplode(m).alias("pos", "m")).select("split_seq", "pos", "m.role", "m.content")


def chat_contents(s, d):
    m = records.to_contents(records.build_messages(F.col("raw_text"), _EXAMPLE))
    return table(s, d, "train").select("split_seq", F.posexplode(m).alias("pos", "m")).select(
        "split_seq",
        "pos",
        "m.role",
        F.col("m.parts")[0]["text"].alias("text")
    )


def chat_examples(s, d):
    m = records.chat_example(F.col("raw_text"), F.col("prediction"))
    return table(s, d, "train").select("split_seq", F.element_at(m, -1)["content"].alias("target"))


def parse_llm_json(s, d):
    """Every prediction written as a fenced answer, on lines of its own or on one, and read back."""
    line = F.when(F.col("pred_id") % 2 == 0, "\n").otherwise("")
    answer = F.concat(F.lit("```json"), line, F.to_json("prediction", {"ignoreNullFields": "false"}), line, F.lit("```"))
    p = table(s, d, "predictions").select("pred_id", parse_posting(F.coalesce(answer, F.lit("no answer"))).alias("p"))
    return p.select(
        "pred_id",
        "p.error_kind",
        "p.posting.title",
        "p.posting.contract_type",
        "p.posting.duration_months",
        F.size("p.posting.required_skills").alias("skills")
    )


def content_range_parse(s, d):
    """Ranges as a service writes them: with a total, with an unknown one, of another unit, cut off."""
    first, total = (F.col("seq") % 7 * 150).cast("string"), F.col("description_chars").cast("string")
    kinds = ["offres ", "items ", "offres ", "offres */"]
    head = F.concat(
        F.element_at(F.array(*map(F.lit, kinds)), (F.col("seq") % 4 + 1).cast("int")),
        first,
        F.lit("-"),
        (F.col("seq") % 7 * 150 + 149).cast("string")
    )
    header = F.concat(head, F.when(F.col("seq") % 4 == 2, "/*").otherwise(F.concat(F.lit("/"), total)))
    p = table(s, d, "postings").select("seq", T.content_range(header).alias("r"))
    return p.select("seq", "r.first_index", "r.last_index", "r.max_results")


class _Echo:
    """Answers with the first line as the title: stands in for a model."""

    def __call__(self):
        return lambda messages: json.dumps({"title": messages[1]["content"].split("\n", 1)[0]}, ensure_ascii=False)


def labelling_run(s, d):
    """Postings without a prediction, labelled by a stand-in."""
    return labelling.resume(
        table(s, d, "postings"),
        table(s, d, "predictions"),
        _Echo(),
        "echo"
    ).select("posting_id", "valid", "attempts", "prediction.title")


def offer_records(s, d):
    """Postings turned back into source offers, and projected into records."""
    p = table(s, d, "train").withColumns(
        {
            "plan_idx": F.lit(0),
            "result_idx": F.col("split_seq").cast("int"),
            "keyword": F.col("matched_keyword"),
            "id": F.col("split_seq").cast("string"),
            "intitule": F.col("title"),
            "entreprise": F.struct(F.col("prediction.company").alias("nom")),
            "lieuTravail": F.struct(F.col("prediction.location").alias("libelle")),
            "description": F.col("raw_text"),
            "origineOffre": F.struct(F.col("source_url").alias("urlOrigine")),
            "salaire": F.struct(F.col("reference_metadata.salaireLibelle").alias("libelle"))
        }
    )
    meta = {f: F.col(f"reference_metadata.{f}") for f in META_FIELDS if f != "salaireLibelle"}
    names = [f.name for f in s.createDataFrame([], OFFERS).schema]
    made = records.build_record(p.withColumns(meta).select(*names))
    every = F.concat_ws("|", *[F.coalesce(F.col(f"reference_metadata.{f}").cast("string"), F.lit("-")) for f in META_FIELDS])
    return made.select("posting_id", "title", "source_url", "raw_text", "text_hash", "description_chars", every.alias("metadata"))


def queries() -> dict:
    """The queries of the core by name."""
    own = (
        text_hash_dedupe, text_normalize, pii_scrub, html_clean, build_record, offer_records, id_dedupe_first_wins,
        plan_counts, hash_partition, partition_balance, resume_anti_join, bucket_counts, ingest_summary,
        largest_remainder_allocation, test_split, train_split, holdout_split, leakage_overlap, normalize_contract,
        normalize_remote, sentinel_null, list_clean, rhythm_rule, free_text_normalize, field_verdicts, field_scores,
        score_summary, model_comparison, missing_predictions, latency_stats, labelling_counts, upsert_last_wins,
        first_uncorrected, gold_records, review_prefill, metadata_rows, preview_text, chat_messages, chat_contents,
        chat_examples, parse_llm_json, content_range_parse, labelling_run, provider_parts, search_scan,
        jsonl_round_trip, review_neighbours, form_fields, retry_conversation,
    )
    assert len(FIELDS) == 14
    return {f.__name__: f for f in own}
