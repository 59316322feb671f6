"""Evidence of a cut does not vanish with single occurrences elsewhere."""

import pytest

from tamarack.llm import truncation

WHOLE = "Poste {i}\n\nNous cherchons une personne calme pour traiter les demandes urgentes.\nCandidature par courrier."


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, "s", None, WHOLE.format(i=i)) for i in range(1200)]
    rows.append((2000, "s", None, "Poste\n\nIl faut traiter les demandes.\nCandidature par courrier."))  # closes the pair once in 1,201
    half = "Poste\n\nNous cherchons une personne calme pour traiter les demandes"
    word = "Poste\n\nNous cherchons une pers"
    rows += [(3000, "s", None, half), (3001, "t", None, half), (3010, "s", None, word), (3011, "t", None, word)]
    rows += [(3020, "s", None, "Poste\n\nUn m&eacute;tier pour une personne calm&eac")]
    df = spark.createDataFrame(rows, "id int, source string, stated int, text string")
    return {c.id: set(c.evidence) for c in truncation.truncated(df, "id", "source", "text", "stated").cut.collect()}


def test_a_pair_that_closes_once_is_still_evidence(found):
    assert {3000, 3001} <= set(found) and "unfinished" in found[3000]


def test_a_cut_word_counts_whatever_other_sources_deliver(found):
    assert "prefix" in found[3010] and "prefix" in found[3011]


def test_half_an_entity(found):
    assert "prefix" in found[3020]
    assert truncation.half_entity("Un m&eacute;tier calm&eac") and not truncation.half_entity("service r&d") and not truncation.half_entity("m&eacute;tier &eacute")


def test_whole_texts_are_not_cut(found):
    assert all(i >= 3000 for i in found)


def limited(spark, stated):
    """A source that cuts at 120 characters after the head, and whole texts of exactly that length."""
    rows = []
    for i in range(400):
        body = f"Nous cherchons une personne numéro {i} pour traiter les demandes {'urgentes ' * (i % 13)}du service. "
        body = body + "Le poste est stable. " * 3 + "\nVotre candidature sera lue sous 9 jours."
        whole = f"Titre\n\n{body}"
        kept = whole[: 7 + 120] if i % 2 and len(whole) > 137 else whole
        rows.append((i, "s", len(whole) - 7 if stated else None, kept))
    end = "\nVotre candidature sera lue sous 9 jours."
    for i in range(5):
        body = f"Texte entier {i} ".ljust(120 - len(end), "x") + end
        rows.append((1000 + i, "s", 120 if stated else None, f"Titre\n\n{body}"))
    return spark.createDataFrame(rows, "id int, source string, stated int, text string"), {r[0] for r in rows if r[0] < 1000 and not r[3].endswith("jours.")}


@pytest.mark.parametrize("stated", [True, False])
def test_whole_texts_of_exactly_the_limit(spark, stated):
    df, cut = limited(spark, stated)
    found = {c.id: set(c.evidence) for c in truncation.truncated(df, "id", "source", "text", "stated").cut.collect()}
    assert set(found) == cut and all("limit" in e or "length" in e for e in found.values())


def test_evidence_of_a_small_source(spark):
    """A limit that three texts of a small source share counts among many texts of another."""
    df, cut = limited(spark, False)
    small = [(5000 + i, "t", None, f"Titre\n\nAnnonce {w}, {'avec ses mots à elle ' * 9}"[:100]) for i, w in enumerate(("une", "cinq", "quatorze"))]
    r = truncation.truncated(df.unionByName(spark.createDataFrame(small, df.schema)), "id", "source", "text", "stated")
    assert {5000, 5001, 5002} <= {c.id for c in r.cut.collect()}


def test_last_words_read_as_far_as_needed():
    assert truncation.last_words("un deux " + "x" * 500 + " trois.", 2) == ["x" * 500, "trois"]
    assert truncation.last_words("un", 8) == ["un"] and truncation.last_words("", 8) == []
    assert truncation.line_start("  12 Petits mots " + "x" * 200) == "# petits"
    assert truncation.line_end("demandez le poste KT28-92.") == "- # ."
