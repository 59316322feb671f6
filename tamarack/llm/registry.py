"""Queries of the llm operators and the SQL they are checked with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm import canonical, look_alike, mixing, near_duplicates, packing, quota_sample, split_overlap, truncation
from tamarack.runtime import table

#: Similarity of p2 and p3 as TESTDATA.md states it.
SIMILAR = {"shingle": 3, "threshold": 0.5}
FIELDS = {"contract_type": "prediction.contract_type", "remote_policy": "prediction.remote_policy"}


def _truncated(spark: SparkSession, d: str) -> truncation.Truncation:
    return truncation.truncated(table(spark, d, "postings"), "posting_id", "source", "raw_text", "description_chars")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Postings whose text was cut."""
    return _truncated(spark, d).cut.select(F.col("id").alias("posting_id"))


def p1_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Postings, cut postings and the evidence for them per source."""
    return _truncated(spark, d).by_source


def _near(spark: SparkSession, d: str) -> near_duplicates.NearDuplicates:
    return near_duplicates.near_duplicates(table(spark, d, "postings"), "posting_id", "raw_text", **SIMILAR)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of postings with the same or nearly the same text."""
    return _near(spark, d).pairs().toDF("posting_id_a", "posting_id_b")


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    """Group of the same advert, class of equal texts, copies and links of every posting."""
    return _near(spark, d).linked().withColumnRenamed("id", "posting_id")


def p2_members(spark: SparkSession, d: str) -> DataFrame:
    """The advert of every posting: the lowest posting_id of its group."""
    own = _near(spark, d).linked().select(F.col("id").alias("posting_id"), "group").distinct()
    names = own.groupBy("group").agg(F.min("posting_id").alias("advert"))
    return own.join(names, "group").select("posting_id", "advert")


def _overlap(spark: SparkSession, d: str) -> split_overlap.SplitOverlap:
    return split_overlap.split_overlap(table(spark, d, "test"), table(spark, d, "train"), "split_seq", "raw_text", **SIMILAR)


def _overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs by text, with coverage, and pairs of one posting_id; once per pair."""
    test, train = (table(spark, d, n).select("posting_id", F.col("split_seq").alias(f"{n}_split_seq")) for n in ("test", "train"))
    near = _overlap(spark, d).pairs().select(
        F.col("eval_id").alias("test_split_seq"),
        F.col("train_id").alias("train_split_seq"),
        "coverage"
    )
    same = test.join(train, "posting_id").select("test_split_seq", "train_split_seq", F.lit(None).cast("double").alias("coverage"))
    both = near.withColumn("same_id", F.lit(0)).unionByName(same.withColumn("same_id", F.lit(1)))
    return both.groupBy("test_split_seq", "train_split_seq").agg(F.max("coverage").alias("coverage"), F.max("same_id").alias("same_id"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a test and a train row of one posting or the same or nearly the same text."""
    return _overlap_pairs(spark, d).select("test_split_seq", "train_split_seq")


def p3_by_split(spark: SparkSession, d: str) -> DataFrame:
    """Per split and source of the test row: overlapping pairs, those of one posting_id, those of near-same texts, test rows concerned."""
    rows = table(spark, d, "test").select(F.col("split_seq").alias("test_split_seq"), "split", "source")
    return (
        _overlap_pairs(spark, d)
        .join(rows, "test_split_seq")
        .groupBy("split", "source")
        .agg(
            F.count("*").alias("pairs"),
            F.sum("same_id").alias("same_id_pairs"),
            F.count("coverage").alias("near_pairs"),
            F.count_distinct("test_split_seq").alias("test_rows"),
        )
    )


def p3_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Share of each test row's words that its equal or near-same training texts cover together, and how many these are."""
    found = _overlap(spark, d).records()
    return found.select(F.col("id").alias("test_split_seq"), F.round("coverage", 6).alias("coverage"), "train_classes")


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every row of test and train with its class of equal texts, its copies and links on the other side."""
    return _overlap(spark, d).linked().withColumnRenamed("id", "split_seq")


def _codes(spark: SparkSession, d: str) -> DataFrame:
    return canonical.canonical_codes(table(spark, d, "predictions"), "pred_id", FIELDS, table(spark, d, "canonical_values"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The code each typed value means."""
    return _codes(spark, d).select(F.col("id").alias("pred_id"), "field", "code")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Values that mean no entry, with how often each was typed."""
    return _codes(spark, d).where(F.col("code") == canonical.UNMATCHED).groupBy("field", "value").agg(F.count("*").alias("typed"))


def _sample(spark: SparkSession, d: str) -> quota_sample.QuotaSample:
    first = quota_sample.first_rows(table(spark, d, "postings"), "posting_id", "seq", ["bucket", "matched_keyword"])
    rows = first.withColumn("bucket", quota_sample.normal_category(F.col("bucket")))
    targets = table(spark, d, "sample_targets").withColumn("bucket", quota_sample.normal_category(F.col("bucket")))
    return quota_sample.quota_sample(rows, targets, ["bucket", "matched_keyword"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Targets with fewer postings than needed."""
    return _sample(spark, d).report.where("short").select("target_id")


def p5_sample(spark: SparkSession, d: str) -> DataFrame:
    """The postings drawn for each set of targets."""
    return _sample(spark, d).sample.withColumnRenamed("id", "posting_id")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Every target: available, needed, drawn, gap."""
    return _sample(spark, d).report


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "pack_limits").select("capacity_tokens"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents longer than a container of 2,048 tokens."""
    return _packed(spark, d).where("capacity = 2048 and parts > 1").select(F.col("id").alias("doc_id")).distinct()


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    """The container of each document, or of each of its parts, for each capacity."""
    return _packed(spark, d).withColumnRenamed("id", "doc_id")


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are."""
    return packing.containers(_packed(spark, d))


def _mixture(spark: SparkSession, d: str) -> mixing.Mixture:
    return mixing.mix_sources(table(spark, d, "documents"), "doc_id", "text", "source", table(spark, d, "mix_targets"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources too small for their weight even at most repeats."""
    return _mixture(spark, d).report.where("short").select("source")


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    """Every use of a document, in the order of its source's passes."""
    return _mixture(spark, d).documents.withColumnRenamed("id", "doc_id")


def p7_repeats(spark: SparkSession, d: str) -> DataFrame:
    """How often each document is used."""
    return _mixture(spark, d).repeats.withColumnRenamed("id", "doc_id")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of each source."""
    return _mixture(spark, d).report


def p7_tempered(spark: SparkSession, d: str) -> DataFrame:
    """The shares without target weights: natural ones, tempered to the repeat limits."""
    free = table(spark, d, "mix_targets").withColumn("target_weight", F.lit(None).cast("double"))
    return mixing.mix_sources(table(spark, d, "documents"), "doc_id", "text", "source", free).report


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents that look the same but differ in their characters."""
    return look_alike.look_alike_pairs(table(spark, d, "documents"), "doc_id", "text").toDF("doc_id_a", "doc_id_b")


def p8_forms(spark: SparkSession, d: str) -> DataFrame:
    """The consistent form of every text."""
    return look_alike.consistent_form(table(spark, d, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id"), "form")


def queries() -> dict:
    own = (
        p1_found, p1_by_source, p2_found, p2_groups, p2_members, p3_found, p3_by_split, p3_coverage, p3_classes, p4_found,
        p4_report, p5_found, p5_report, p5_sample, p6_found, p6_packed, p6_fill, p7_found, p7_report, p7_mixture,
        p7_repeats, p7_tempered, p8_found, p8_forms,
    )
    return {f.__name__: f for f in own}


_FIRST = "f AS (SELECT posting_id, lower(trim(arg_min(coalesce(bucket, chr(0)), seq))) AS bucket, arg_min(matched_keyword, seq) AS kw FROM postings WHERE posting_id IS NOT NULL GROUP BY posting_id)"


def _classes(rows: str) -> str:
    """t: rows with the id of their class; e: the shingles of each class. ``rows`` gives (side, id, raw_text)."""
    return f"""
        r AS ({rows}),
        w AS (SELECT side, id, raw_text, regexp_extract_all(strip_accents(lower(raw_text)), '[\\p{{L}}\\p{{N}}]+') AS w FROM r WHERE raw_text IS NOT NULL AND id IS NOT NULL),
        g AS (SELECT side, id, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS s, raw_text FROM w),
        k AS (SELECT side, id, s, CASE WHEN len(s) = 0 THEN raw_text END AS own FROM g),
        c AS (SELECT s, own, row_number() OVER () AS cls FROM (SELECT DISTINCT s, own FROM k)),
        t AS (SELECT DISTINCT k.side, k.id, c.cls FROM k JOIN c ON k.s = c.s AND k.own IS NOT DISTINCT FROM c.own),
        e AS (SELECT cls, unnest(s) AS g, len(s) AS n FROM c)"""


def _near_sql(sides: str) -> str:
    """l: pairs of different classes at or above the similarity, both ways around."""
    return f"""l AS (SELECT a.cls AS x, b.cls AS y FROM e a JOIN e b ON a.g = b.g AND a.cls {sides} b.cls GROUP BY a.cls, b.cls HAVING count(*) >= 0.5 * (any_value(a.n) + any_value(b.n) - count(*)))"""


def _forms_sql() -> str:
    """f: the form of each document, character by character: what is not seen is dropped, what decomposes is looked up, what is left is composed."""
    import unicodedata

    kept = ("super", "sub", "fraction", "circle", "vertical", "small")
    entries = []
    for point in range(0x80, 0x110000):
        char, how = chr(point), unicodedata.decomposition(chr(point))
        kind = how[1:].split(">")[0] if how.startswith("<") else ""
        folded = unicodedata.normalize("NFKD", char)
        seen = unicodedata.category(char)
        if unicodedata.category(char) == "Zs":
            entries.append((point, " "))
        elif kind and kind not in kept and folded[0] != " " and (seen[0] not in "PSM" or seen == "So" or kind in ("wide", "narrow", "noBreak")):
            entries.append((point, "".join(look_alike.LOOK_ALIKES.get(c, c) for c in unicodedata.normalize("NFC", folded))))
        elif char in look_alike.LOOK_ALIKES:
            entries.append((point, look_alike.LOOK_ALIKES[char]))
        elif how and not kind and folded[0] in look_alike.LOOK_ALIKES and point < 0x2000:
            entries.append((point, look_alike.LOOK_ALIKES[folded[0]] + folded[1:]))
    values = ", ".join(f"({p}, {look_alike._quoted(t)})" for p, t in entries)
    return f"""m(point, shown) AS (VALUES {values}),
        d AS (SELECT doc_id, text, nfc_normalize(regexp_replace(text, '{look_alike.INVISIBLE}', '', 'g')) AS t FROM documents),
        x AS (SELECT DISTINCT unnest(regexp_extract_all(t, '[^\\x00-\\x7F]')) AS c FROM d WHERE t IS NOT NULL),
        y AS (SELECT c, coalesce(shown, c) AS shown FROM x LEFT JOIN m ON ord(c) = point WHERE coalesce(shown, c) <> c),
        u AS (SELECT map_from_entries(list((c, shown))) AS of FROM y),
        f AS (SELECT doc_id, text, nfc_normalize(array_to_string(list_transform(regexp_extract_all(t, '(?s).'), lambda c: coalesce(u.of[c], c)), '')) AS form FROM d, u)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": f"""
            WITH {_classes("SELECT 0 AS side, posting_id AS id, raw_text FROM postings")}, {_near_sql("<")}
            SELECT DISTINCT least(a.id, b.id) AS posting_id_a, greatest(a.id, b.id) AS posting_id_b
            FROM (SELECT x, y FROM l UNION ALL SELECT cls, cls FROM c) p JOIN t a ON a.cls = p.x JOIN t b ON b.cls = p.y WHERE a.id <> b.id""",
        "p2_members": f"""
            WITH RECURSIVE {_classes("SELECT 0 AS side, posting_id AS id, raw_text FROM postings")}, {_near_sql("<")},
            pair AS (SELECT DISTINCT a.id AS x, b.id AS y FROM (SELECT x, y FROM l UNION SELECT y, x FROM l UNION ALL SELECT cls, cls FROM c) p JOIN t a ON a.cls = p.x JOIN t b ON b.cls = p.y),
            reach AS (SELECT x AS id, y AS other FROM pair UNION SELECT reach.id, pair.y FROM reach JOIN pair ON pair.x = reach.other)
            SELECT id AS posting_id, min(other) AS advert FROM reach GROUP BY id""",
        "p3_found": f"""
            WITH {_classes("SELECT 0 AS side, split_seq AS id, raw_text FROM test UNION ALL SELECT 1, split_seq, raw_text FROM train")}, {_near_sql("<>")}
            SELECT DISTINCT a.id AS test_split_seq, b.id AS train_split_seq
            FROM (SELECT x, y FROM l UNION ALL SELECT cls, cls FROM c) p JOIN t a ON a.cls = p.x AND a.side = 0 JOIN t b ON b.cls = p.y AND b.side = 1
            UNION SELECT a.split_seq, b.split_seq FROM test a JOIN train b USING (posting_id)""",
        "p3_by_split": f"""
            WITH {_classes("SELECT 0 AS side, split_seq AS id, raw_text FROM test UNION ALL SELECT 1, split_seq, raw_text FROM train")}, {_near_sql("<>")},
            near AS (SELECT DISTINCT a.id AS t, b.id AS r FROM (SELECT x, y FROM l UNION ALL SELECT cls, cls FROM c) p JOIN t a ON a.cls = p.x AND a.side = 0 JOIN t b ON b.cls = p.y AND b.side = 1),
            ids AS (SELECT a.split_seq AS t, b.split_seq AS r FROM test a JOIN train b USING (posting_id)),
            every AS (SELECT t, r, near.t IS NOT NULL AS by_text, ids.t IS NOT NULL AS by_id FROM near FULL JOIN ids USING (t, r))
            SELECT split, source, count(*) AS pairs, count(*) FILTER (by_id) AS same_id_pairs, count(*) FILTER (by_text) AS near_pairs, count(DISTINCT t) AS test_rows
            FROM every JOIN test ON split_seq = t GROUP BY split, source""",
        "p5_found": f"""
            WITH {_FIRST}, n AS (SELECT count(*) AS n FROM f),
            have AS (SELECT t.target_id, any_value(t.min_rows) AS least, any_value(t.target_share) AS share, count(f.posting_id) AS available
                     FROM sample_targets t LEFT JOIN f ON f.bucket = lower(trim(t.bucket)) AND (t.matched_keyword IS NULL OR f.kw = t.matched_keyword) GROUP BY t.target_id)
            SELECT target_id FROM have, n WHERE available < greatest(least, share * 0.1 * n)""",
        # a token has about four characters: TESTDATA.md has no case near the limit
        "p6_found": "SELECT doc_id FROM documents WHERE length(text) > 2048 * 4",
        "p7_found": """
            WITH n AS (SELECT source, sum(length(text)) AS size FROM documents GROUP BY source)
            SELECT m.source FROM mix_targets m LEFT JOIN n USING (source) WHERE max_repeats * coalesce(size, 0) < target_weight * (SELECT sum(size) FROM n)""",
        "p8_forms": f"WITH {_forms_sql()} SELECT doc_id, form FROM f",
        "p8_found": f"""
            WITH {_forms_sql()}
            SELECT least(a.doc_id, b.doc_id) AS doc_id_a, greatest(a.doc_id, b.doc_id) AS doc_id_b FROM f a JOIN f b ON a.form = b.form AND a.doc_id < b.doc_id AND a.text <> b.text""",
    }
