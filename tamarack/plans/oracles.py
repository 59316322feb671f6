"""SQL for DuckDB with the results of the core queries."""

from __future__ import annotations

import html.entities

from tamarack.plans.queries import _EXAMPLE, OWNERS, PROVIDERS, TEST_ROWS
from tamarack.operators.records import SYSTEM_PROMPT
from tamarack.schemas import CONTRACT_SYNONYMS, FIELDS, FREE_TEXT_FIELDS, LIST_FIELDS, META_FIELDS, REMOTE_SYNONYMS, SENTINELS

WS = r"[\s\x1c-\x1f\x85\p{Z}]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(e: str) -> str:
    return f"regexp_replace({e}, '^{WS}+|{WS}+$', '', 'g')"


def norm(e: str) -> str:
    return f"lower(trim(regexp_replace({e}, '{WS}+', ' ', 'g'), ' '))"


def scalar(e: str) -> str:
    return f"CASE WHEN lower({strip(e)}) NOT IN ({', '.join(map(q, SENTINELS))}) THEN {strip(e)} END"


def lookup(table: dict[str, str], e: str) -> str:
    return f"CASE lower({strip(e)}) {' '.join(f'WHEN {q(k)} THEN {q(v)}' for k, v in table.items())} END"


def contract(e: str) -> str:
    return f"CASE WHEN {e} IS NOT NULL THEN coalesce({lookup(CONTRACT_SYNONYMS, e)}, 'other') END"


def pii(e: str) -> str:
    e = rf"regexp_replace({e}, '[\p{{L}}\p{{N}}\p{{M}}_.+-]+@[\p{{L}}\p{{N}}\p{{M}}_-]+\.[a-zA-Z]{{2,}}', '[email]', 'g')"
    return rf"regexp_replace({e}, '(?:(?:\+33|0033)\s?[1-9]|0[1-9])(?:[\s\x{{00a0}}.\-]?[0-9]{{2}}){{4}}', '[téléphone]', 'g')"


def lines(e: str) -> str:
    e = rf"regexp_replace({e}, '\r\n?', chr(10), 'g')"
    e = rf"regexp_replace({e}, '[ \t]+', ' ', 'g')"
    inner = r"[ \t\r\f\v\x1c-\x1f\x85\p{Z}]*"
    e = f"regexp_replace({e}, '{inner}\\n{inner}', chr(10), 'g')"
    return strip(rf"regexp_replace({e}, '\n{{3,}}', chr(10) || chr(10), 'g')")


def entities(e: str) -> str:
    """The entities of Latin-1 letters, whose semicolon may be missing; & last."""
    for name, code in sorted(html.entities.name2codepoint.items()):
        if 192 <= code < 256:
            e = f"regexp_replace({e}, '&{name};?', chr({code}), 'g')"
    return e


def free_text(e: str) -> str:
    e = f"lower({e})"
    for pattern, kept in ((r"(^|[^\p{L}\p{N}_])(ou|et|and|or)($|[^\p{L}\p{N}_])", r"\1 \3"), (r"(^|[^\p{L}\p{N}_])[dlcjnmst]''", r"\1 ")):
        for _ in range(2):
            e = f"regexp_replace({e}, '{pattern}', '{kept}', 'g')"
    return f"trim(regexp_replace(regexp_replace({e}, '[,.;:]', ' ', 'g'), '{WS}+', ' ', 'g'), ' ')"


def as_set(e: str) -> str:
    return f"list_sort(list_distinct(list_transform(coalesce({e}, []), lambda x: lower({strip('x')}))))"


def match(f: str) -> str:
    g, p = f"gold.{f}", f"pred.{f}"
    if f in LIST_FIELDS:
        return f"{as_set(g)} = {as_set(p)}"
    return f"{free_text(g)} = {free_text(p)}" if f in FREE_TEXT_FIELDS else f"{g} = {p}"


def verdict(f: str) -> str:
    return f"CASE WHEN gold.{f} IS NULL AND pred.{f} IS NULL THEN 'tn' WHEN gold.{f} IS NOT NULL AND pred.{f} IS NOT NULL AND {match(f)} THEN 'tp' WHEN pred.{f} IS NOT NULL THEN 'fp' ELSE 'fn' END"


def pairs(per_labeller: bool = False) -> str:
    keys = "posting_id, labeller" if per_labeller else "posting_id"
    models = "(SELECT DISTINCT labeller FROM predictions WHERE labeller IS NOT NULL)"
    every = f"g CROSS JOIN {models} LEFT JOIN p USING (posting_id, labeller)" if per_labeller else "g LEFT JOIN p USING (posting_id)"
    return f"""
        g AS (SELECT posting_id, prediction AS gold FROM train QUALIFY row_number() OVER (PARTITION BY posting_id ORDER BY split_seq DESC) = 1),
        p AS (SELECT posting_id, labeller, valid, prediction AS pred FROM predictions QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY pred_id DESC) = 1),
        s AS (SELECT posting_id, labeller, valid, {', '.join(f'{verdict(f)} AS v_{f}' for f in FIELDS)} FROM {every}),
        l AS (SELECT posting_id, labeller, replace(name, 'v_', '') AS field, verdict FROM s UNPIVOT (verdict FOR name IN ({', '.join(f'v_{f}' for f in FIELDS)})))"""


def scores(groups: str = "") -> str:
    by = f"{groups}, " if groups else ""
    return f"""
        c AS (SELECT {by}field, count(*) FILTER (verdict = 'tp') AS tp, count(*) FILTER (verdict = 'fp') AS fp, count(*) FILTER (verdict = 'fn') AS fn, count(*) FILTER (verdict = 'tn') AS tn FROM l GROUP BY {by}field),
        r AS (SELECT *, CASE WHEN tp + fp + fn > 0 THEN coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) END AS precision, CASE WHEN tp + fp + fn > 0 THEN coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) END AS recall FROM c),
        f AS (SELECT *, CASE WHEN tp + fp + fn > 0 THEN coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) END AS f1 FROM r)"""


def summary(groups: str = "") -> str:
    by, join, comma = (f"GROUP BY {groups}", f"JOIN m USING ({groups})", f"{groups}, ") if groups else ("", "CROSS JOIN m", "")
    exact = " AND ".join(f"v_{f} IN ('tp', 'tn')" for f in FIELDS)
    return f"""WITH {pairs(bool(groups))}, {scores(groups)},
        m AS (SELECT {comma}round(coalesce(avg(f1), 0), 9) AS macro_f1 FROM f {by}),
        t AS (SELECT {comma}count(*) AS n_postings, round(coalesce(avg(coalesce(valid, false)::INT), 0), 9) AS json_validity_rate, round(coalesce(avg(({exact})::INT), 0), 9) AS exact_match_rate FROM s {by})
        SELECT {comma}n_postings, json_validity_rate, exact_match_rate, macro_f1 FROM t {join}"""


POSTINGS = f"po AS (SELECT * REPLACE (coalesce(description_chars, length(raw_text)) AS description_chars, sha256({norm('raw_text')}) AS text_hash) FROM postings)"
FLAGS = f"""{POSTINGS},
    first AS (SELECT *, description_chars >= 200 AS long FROM po QUALIFY row_number() OVER (PARTITION BY posting_id ORDER BY seq) = 1),
    flags AS (SELECT *, long AND row_number() OVER (PARTITION BY text_hash, long ORDER BY seq) = 1 AS kept FROM first)"""
LABELLED = f"""first AS (SELECT posting_id, bucket, seq, sha256({norm('raw_text')}) AS hash FROM postings QUALIFY row_number() OVER (PARTITION BY posting_id ORDER BY seq) = 1),
    latest AS (SELECT posting_id, valid, labeller FROM predictions QUALIFY row_number() OVER (PARTITION BY posting_id ORDER BY pred_id DESC) = 1),
    lab AS (SELECT first.posting_id, bucket, seq, hash, valid, coalesce(labeller, 'groq') LIKE 'groq%' AS base FROM first JOIN latest USING (posting_id))"""


def allocation(pool: str) -> str:
    return f"""sizes AS (SELECT bucket, count(*) AS n, min(seq) AS first_seen FROM {pool} GROUP BY bucket),
    raw AS (SELECT *, (n * {TEST_ROWS})::DOUBLE / sum(n) OVER () AS raw FROM sizes),
    based AS (SELECT *, floor(raw) AS base_n FROM raw),
    alloc AS (SELECT bucket, n, (base_n + CASE WHEN row_number() OVER (ORDER BY raw - base_n DESC, first_seen) <= {TEST_ROWS} - sum(base_n) OVER () THEN 1 ELSE 0 END)::BIGINT AS alloc FROM based)"""


SPLIT = f"""WITH {LABELLED}, pool AS (SELECT * FROM lab WHERE base), {allocation('pool')},
    ranked AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY sha256('42:' || posting_id), posting_id) AS k FROM pool),
    picked AS (SELECT ranked.posting_id FROM ranked JOIN alloc ON ranked.bucket IS NOT DISTINCT FROM alloc.bucket WHERE k <= alloc)"""
HASH = "sha256(posting_id)"
PART = f"list_reduce(list_prepend(0::BIGINT, list_transform(range(16), lambda i: ('0x' || substr({HASH}, i::INT * 4 + 1, 4))::BIGINT)), lambda a, b: (a * 65536 + b) % {OWNERS})"
MESSAGES = "[" + ", ".join(f"{{'role': {q(r)}, 'content': {c}}}" for r, c in (("system", q(SYSTEM_PROMPT)), ("user", q(_EXAMPLE[0][0])), ("assistant", q(_EXAMPLE[0][1])), ("user", "raw_text"))) + "]"
HEADER = f"{strip('title')} || CASE WHEN concat_ws(' — ', nullif(prediction.company, ''), nullif(prediction.location, '')) <> '' THEN chr(10) || concat_ws(' — ', nullif(prediction.company, ''), nullif(prediction.location, '')) ELSE '' END"
BOTH = "list_concat(coalesce(prediction.required_skills, []), coalesce(prediction.nice_to_have_skills, []))"
CLEANED = f"list_filter(list_transform({BOTH}, lambda x: {scalar('x')}), lambda x: x IS NOT NULL)"


def oracle_sql() -> dict[str, str]:
    return {
        "text_hash_dedupe": f"WITH {FLAGS} SELECT posting_id, seq, text_hash FROM flags WHERE kept",
        "text_normalize": f"SELECT doc_id, sha256({norm('text')}) AS text_hash, length({norm('text')}) AS chars FROM documents",
        "pii_scrub": f"SELECT doc_id, {pii('text')} AS scrubbed FROM documents",
        "html_clean": f"SELECT seq, {lines(entities('raw_text'))} AS cleaned FROM postings",
        "build_record": f"WITH b AS (SELECT split_seq, {pii(lines('raw_text'))} AS body, {HEADER} AS head FROM train WHERE prediction IS NOT NULL) SELECT split_seq, head || chr(10) || chr(10) || body AS raw_text, sha256({norm('head || chr(10) || chr(10) || body')}) AS text_hash, length(body) AS description_chars FROM b",
        "offer_records": f"""WITH b AS (SELECT *, {pii(lines(entities('raw_text')))} AS body, {HEADER} AS head FROM train), r AS (SELECT *, head || chr(10) || chr(10) || body AS raw FROM b)
            SELECT 'france_travail:' || split_seq AS posting_id, {strip('title')} AS title, source_url, raw AS raw_text, sha256({norm('raw')}) AS text_hash, length(body) AS description_chars,
                concat_ws('|', {', '.join(f"coalesce(reference_metadata.{f}::VARCHAR, '-')" for f in META_FIELDS)}) AS metadata FROM r""",
        "id_dedupe_first_wins": f"WITH {POSTINGS}, r AS (SELECT po.*, k.plan_idx FROM po JOIN keyword_plan k ON k.keyword = po.matched_keyword QUALIFY row_number() OVER (PARTITION BY posting_id ORDER BY plan_idx, seq) = 1) SELECT posting_id, plan_idx, seq FROM r WHERE description_chars >= 200",
        "plan_counts": "SELECT plan_idx, k.bucket, keyword, count(posting_id) AS found, least(count(posting_id), coalesce(any_value(cap), count(posting_id)))::BIGINT AS fetched FROM keyword_plan k LEFT JOIN postings p ON p.matched_keyword = k.keyword GROUP BY ALL",
        "hash_partition": f"SELECT seq, {PART} AS part FROM postings",
        "partition_balance": f"SELECT {PART} AS part, count(*) AS rows FROM postings GROUP BY 1",
        "resume_anti_join": "SELECT posting_id, seq FROM postings WHERE posting_id NOT IN (SELECT posting_id FROM predictions)",
        "bucket_counts": "SELECT bucket, count(*) AS n, min(seq) AS first_seen FROM postings GROUP BY bucket",
        "ingest_summary": f"WITH {FLAGS} SELECT bucket, count(*) FILTER (long) AS kept_before_hash_dedupe, count(*) FILTER (NOT long) AS dropped_short, count(*) FILTER (long AND NOT kept) AS dropped_hash_dupes FROM flags GROUP BY bucket",
        "largest_remainder_allocation": f"WITH {LABELLED}, {allocation('lab')} SELECT bucket, n, alloc FROM alloc",
        "test_split": f"{SPLIT} SELECT posting_id, bucket, valid FROM lab WHERE posting_id IN (FROM picked)",
        "train_split": f"{SPLIT} SELECT posting_id, bucket, valid FROM lab WHERE posting_id NOT IN (FROM picked) AND valid AND (hash IS NULL OR hash NOT IN (SELECT hash FROM lab WHERE hash IS NOT NULL AND posting_id IN (FROM picked)))",
        "holdout_split": "WITH u AS (SELECT DISTINCT posting_id FROM train) SELECT posting_id, row_number() OVER (ORDER BY sha256('42:' || posting_id), posting_id) <= floor((SELECT count(*) FROM u) * 0.05::DOUBLE) AS held_out FROM u",
        "leakage_overlap": f"""SELECT 'posting_id' AS kind, posting_id AS value FROM (SELECT posting_id FROM train INTERSECT SELECT posting_id FROM test)
            UNION ALL SELECT 'text_hash', h FROM (SELECT sha256({norm('raw_text')}) AS h FROM train INTERSECT SELECT sha256({norm('raw_text')}) FROM test)""",
        "normalize_contract": f"WITH v AS (SELECT pred_id, {scalar('prediction.contract_type')} AS v FROM predictions) SELECT pred_id, {contract('v')} AS contract_type FROM v",
        "normalize_remote": f"WITH v AS (SELECT pred_id, {scalar('prediction.remote_policy')} AS v FROM predictions) SELECT pred_id, {lookup(REMOTE_SYNONYMS, 'v')} AS remote_policy FROM v",
        "sentinel_null": f"SELECT pred_id, {scalar('prediction.remote_policy')} AS remote_policy, {scalar('prediction.contract_type')} AS contract_type FROM predictions",
        "list_clean": f"WITH c AS (SELECT split_seq, {CLEANED} AS c FROM train) SELECT split_seq, CASE WHEN len(c) > 0 THEN array_to_string(list_filter(c, lambda x, i: list_position(list_transform(c, lambda y: lower(y)), lower(x)) = i), '|') END AS skills FROM c",
        "rhythm_rule": f"WITH v AS (SELECT pred_id, {scalar('prediction.contract_type')} AS v, {scalar('prediction.alternance_rhythm')} AS a FROM predictions) SELECT pred_id, {contract('v')} AS contract_type, CASE WHEN {contract('v')} = 'alternance' THEN a END AS alternance_rhythm FROM v",
        "free_text_normalize": f"SELECT seq, {free_text('title')} AS title FROM postings",
        "field_verdicts": f"WITH {pairs()} SELECT posting_id, field, verdict FROM l",
        "field_scores": f"WITH {pairs()}, {scores()} SELECT field, tp, fp, fn, tn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM f",
        "score_summary": summary(),
        "model_comparison": summary("labeller"),
        "missing_predictions": "SELECT DISTINCT posting_id FROM train WHERE posting_id NOT IN (SELECT posting_id FROM predictions)",
        "latency_stats": "WITH v AS (SELECT labeller, list_sort(list(latency_seconds)) AS v, count(latency_seconds) AS n, avg(latency_seconds) AS mean FROM predictions WHERE latency_seconds IS NOT NULL GROUP BY labeller) SELECT labeller, n, round(mean, 9) AS mean, v[(n // 2 + 1)::BIGINT] AS median, v[floor(n * 0.95::DOUBLE)::BIGINT + 1] AS p95 FROM v",
        "labelling_counts": "SELECT labeller, count(*) AS done, count(*) FILTER (valid) AS valid, count(*) FILTER (NOT coalesce(valid, false)) AS failed FROM predictions GROUP BY labeller",
        "upsert_last_wins": "WITH m AS (SELECT posting_id, pred_id, labeller FROM predictions QUALIFY row_number() OVER (PARTITION BY posting_id ORDER BY pred_id DESC) = 1) SELECT m.posting_id, pred_id, m.labeller, split_seq AS position FROM m JOIN test USING (posting_id)",
        "first_uncorrected": "SELECT min(split_seq) AS first_open FROM test WHERE posting_id NOT IN (SELECT posting_id FROM predictions)",
        "gold_records": "WITH m AS (SELECT posting_id, prediction AS c FROM predictions WHERE prediction IS NOT NULL QUALIFY row_number() OVER (PARTITION BY posting_id ORDER BY pred_id DESC) = 1) SELECT posting_id, test.title, test.prediction.title AS baseline_title, c.title AS corrected_title FROM test JOIN m USING (posting_id)",
        "review_prefill": "WITH m AS (SELECT posting_id, prediction AS c FROM predictions WHERE valid QUALIFY row_number() OVER (PARTITION BY posting_id ORDER BY pred_id DESC) = 1), s AS (SELECT split_seq, CASE WHEN c IS NOT NULL THEN c ELSE prediction END AS r FROM test LEFT JOIN m USING (posting_id)) SELECT split_seq, r.title AS title, r.company AS company FROM s",
        "metadata_rows": " UNION ALL ".join(f"SELECT seq, {q(f)} AS key, reference_metadata.{f}::VARCHAR AS value FROM postings WHERE reference_metadata.{f} IS NOT NULL" for f in META_FIELDS),
        "preview_text": "SELECT doc_id, substring(text, 1, 300) AS preview FROM documents",
        "chat_messages": f"WITH m AS (SELECT split_seq, unnest({MESSAGES}) AS m, generate_subscripts({MESSAGES}, 1) - 1 AS pos FROM train) SELECT split_seq, pos, m.role AS role, m.content AS content FROM m",
        "chat_contents": f"WITH m AS (SELECT split_seq, unnest({MESSAGES}) AS m, generate_subscripts({MESSAGES}, 1) - 2 AS pos FROM train) SELECT split_seq, pos, CASE m.role WHEN 'assistant' THEN 'model' ELSE m.role END AS role, m.content AS text FROM m WHERE pos >= 0",
        "content_range_parse": """WITH k AS (SELECT seq, (seq % 7 * 150)::INT AS a, description_chars AS n, seq % 4 <> 2 AND description_chars IS NOT NULL AS known FROM postings)
            SELECT seq, CASE WHEN known THEN a END AS first_index, CASE WHEN known THEN a + 149 END AS last_index, CASE WHEN known THEN n END AS max_results FROM k""",
        "provider_parts": f"WITH t AS (SELECT posting_id, seq, {PART.replace(f'% {OWNERS}', f'% {len(PROVIDERS)}')} AS part FROM postings WHERE posting_id NOT IN (SELECT posting_id FROM predictions)) SELECT posting_id, seq, list_extract({PROVIDERS}, part::INT + 1) AS provider FROM t",
        "search_scan": """SELECT plan_idx, (row_number() OVER (PARTITION BY plan_idx ORDER BY seq) - 1)::INT AS result_idx, k.bucket, keyword, posting_id AS id, title AS intitule
            FROM keyword_plan k JOIN postings p ON p.matched_keyword = k.keyword QUALIFY row_number() OVER (PARTITION BY plan_idx ORDER BY seq) <= least(coalesce(cap, 1150), 1150)""",
        "jsonl_round_trip": "SELECT pred_id, posting_id, prediction.title AS title, prediction.duration_months AS duration_months, array_to_string(prediction.required_skills, '|') AS skills, valid, error, attempts, latency_seconds, labeller FROM predictions",
        "review_neighbours": "SELECT posting_id, split_seq, lag(posting_id) OVER w AS previous, lead(posting_id) OVER w AS following FROM test WINDOW w AS (ORDER BY split_seq, posting_id)",
        "form_fields": f"""WITH t AS (SELECT split_seq, prediction AS p, list_filter(list_transform(list_filter(coalesce(prediction.required_skills, []), lambda x: x IS NOT NULL), lambda x: {strip('x')}), lambda x: x <> '') AS s FROM train)
            SELECT split_seq, CASE WHEN {strip('p.title')} <> '' THEN p.title END AS title, CASE WHEN {strip('p.company')} <> '' THEN p.company END AS company, p.duration_months AS duration_months, CASE WHEN len(s) > 0 THEN array_to_string(s, '|') END AS skills FROM t""",
        "retry_conversation": f"""WITH f AS (SELECT pred_id, posting_id, error FROM predictions WHERE NOT valid AND error IS NOT NULL)
            SELECT pred_id, 0 AS pos, 'user' AS role, posting_id AS content FROM f UNION ALL SELECT pred_id, 1, 'assistant', '{{}}' FROM f
            UNION ALL SELECT pred_id, 2, 'user', 'Your answer could not be used (' || error || '). Send the corrected object alone, without any other text.' FROM f""",
        "chat_examples": "SELECT split_seq, CASE WHEN prediction IS NOT NULL THEN to_json(prediction)::VARCHAR END AS target FROM train",
        "parse_llm_json": f"""WITH v AS (SELECT pred_id, prediction AS p, {scalar('prediction.title')} AS title, {scalar('prediction.contract_type')} AS c FROM predictions),
            k AS (SELECT *, CASE WHEN p IS NULL THEN 'invalid_json' WHEN title IS NULL OR p.duration_months < 1 OR p.years_experience_min < 0 THEN 'schema_violation' END AS error_kind FROM v),
            z AS (SELECT *, list_filter(list_transform(coalesce(p.required_skills, []), lambda x: {scalar('x')}), lambda x: x IS NOT NULL) AS s FROM k)
            SELECT pred_id, error_kind, CASE WHEN error_kind IS NULL THEN title END AS title, CASE WHEN error_kind IS NULL THEN {contract('c')} END AS contract_type,
                CASE WHEN error_kind IS NULL THEN p.duration_months END AS duration_months, CASE WHEN error_kind IS NULL AND len(s) > 0 THEN len(list_distinct(list_transform(s, lambda x: lower(x))))::INT ELSE NULL END AS skills FROM z""",
        "labelling_run": f"""WITH t AS (SELECT posting_id, {scalar("split_part(coalesce(raw_text, ''), chr(10), 1)")} AS title FROM postings WHERE posting_id NOT IN (SELECT posting_id FROM predictions))
            SELECT posting_id, title IS NOT NULL AS valid, CASE WHEN title IS NULL THEN 3 ELSE 1 END AS attempts, title FROM t""",
    }
