"""Relations, field classes and the fixed values of the extraction schema."""

from __future__ import annotations

# The fields of the relations.
POSTING = """STRUCT<title STRING, company STRING, contract_type STRING, duration_months BIGINT, start_date STRING,
 location STRING, remote_policy STRING, required_skills ARRAY<STRING>, nice_to_have_skills ARRAY<STRING>,
 years_experience_min BIGINT, education_level STRING, language_requirements ARRAY<STRING>,
 salary_range STRING, alternance_rhythm STRING>"""
META = "STRUCT<alternance BOOLEAN, typeContrat STRING, typeContratLibelle STRING, natureContrat STRING, experienceLibelle STRING, salaireLibelle STRING, dureeTravailLibelle STRING, romeLibelle STRING, dateCreation STRING>"
META_FIELDS = ("alternance", "typeContrat", "typeContratLibelle", "natureContrat", "experienceLibelle", "salaireLibelle", "dureeTravailLibelle", "romeLibelle", "dateCreation")
OFFERS = """plan_idx INT, result_idx INT, bucket STRING, keyword STRING, id STRING, intitule STRING, entreprise STRUCT<nom STRING>,
 lieuTravail STRUCT<libelle STRING>, description STRING, origineOffre STRUCT<urlOrigine STRING>, alternance BOOLEAN, typeContrat STRING,
 typeContratLibelle STRING, natureContrat STRING, experienceLibelle STRING, salaire STRUCT<libelle STRING>, dureeTravailLibelle STRING,
 romeLibelle STRING, dateCreation STRING"""
RAW = f"posting_id STRING, source STRING, source_url STRING, bucket STRING, matched_keyword STRING, title STRING, raw_text STRING, text_hash STRING, description_chars INT, reference_metadata {META}"
RESULT = f"prediction {POSTING}, valid BOOLEAN, error STRING, attempts INT, latency_seconds DOUBLE, labeller STRING"
LABELLED = f"{RAW}, {RESULT}"

# The fields of the schema, and their classes.
FIELDS = ("title", "company", "contract_type", "duration_months", "start_date", "location", "remote_policy", "required_skills", "nice_to_have_skills", "years_experience_min", "education_level", "language_requirements", "salary_range", "alternance_rhythm")
LIST_FIELDS = ("required_skills", "nice_to_have_skills", "language_requirements")
FREE_TEXT_FIELDS = ("education_level", "salary_range", "start_date", "alternance_rhythm")
INT_MINIMUM = {"duration_months": 1, "years_experience_min": 0}

# How each code of contract_type is written.
CONTRACT_SYNONYMS = {
    "alternance": "alternance", "apprenticeship": "alternance", "apprentissage": "alternance", "contrat d'apprentissage": "alternance", "contrat de professionnalisation": "alternance",
    "stage": "stage", "internship": "stage", "stagiaire": "stage",
    "cdi": "cdi", "permanent": "cdi", "full-time": "cdi", "full time": "cdi",
    "cdd": "cdd", "fixed-term": "cdd", "fixed term": "cdd", "temporary": "cdd",
    "freelance": "freelance", "contractor": "freelance", "independent": "freelance", "indépendant": "freelance",
}
# How each code of remote_policy is written.
REMOTE_SYNONYMS = {
    "on_site": "on_site", "onsite": "on_site", "on-site": "on_site", "on site": "on_site", "in office": "on_site", "in-office": "on_site", "presentiel": "on_site", "présentiel": "on_site",
    "hybrid": "hybrid", "hybride": "hybrid",
    "remote": "remote", "full remote": "remote", "full-remote": "remote", "télétravail": "remote", "teletravail": "remote", "distanciel": "remote",
}
# Texts that mean "not stated".
SENTINELS = ("", "n/a", "na", "none", "null", "not stated", "not specified", "not mentioned", "unspecified", "unknown", "-", "tbd", "non précisé", "non precise", "non renseigné", "non renseigne", "non spécifié", "non specifie")
