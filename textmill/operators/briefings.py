"""Pitches and briefings: templates by configuration, strict pitches, anonymising, claims and their support."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text
from . import cases

# Fixed values.
STRICT_WORDS, LEAD_WORDS, TITLE_TERMS = 70, 20, 6
SECTIONS = {"fixed_form": ["Title", "Lead", "Body", "Source"], "direct": ["Text"], "rules_retrieval": ["Summary", "Confirmed", "Missing", "Questions", "Evidence"]}
EXPECTED = ["who", "what", "when", "where", "unit"]


def pitches(articles: DataFrame, label: str, per_label: int, key: str = "doc_id") -> DataFrame:
    """The best articles of each label as short requests, with what a reporter should find out.

    Quality is the length of title, first sentence and body, the last up to 500. Fields that the article lacks are
    ``missing``.
    """
    quality = F.length("title") + F.length(text.first_sentence(F.col("body"))) + F.least(F.length("body"), F.lit(500))
    place = F.row_number().over(Window.partitionBy(label).orderBy(quality.desc(), F.col(key)))
    rows = articles.withColumn("_place", place).where(F.col("_place") <= per_label)
    expected = {"who": F.col("environment"), "what": F.col("title"), "when": F.col("published"), "where": F.lit(""), "unit": F.col("unit")}
    missing = F.filter(F.array(*(F.when(F.coalesce(F.trim(c), F.lit("")) == "", f) for f, c in expected.items())), lambda f: f.isNotNull())
    pitch = F.concat(F.lit("Write about: "), text.first_sentence(F.col("body")))
    return rows.select(key, label, F.col("_place").alias("place"), pitch.alias("pitch"), missing.alias("missing"), *(F.coalesce(c, F.lit("")).alias(f"expected_{f}") for f, c in expected.items()))


def briefings(pitched: DataFrame, key: str = "doc_id", most_questions: int = 5) -> DataFrame:
    """Each pitch in three configurations: a form, the plain text, and rules with missing fields and questions."""
    config = F.explode(F.array(*map(F.lit, SECTIONS)))
    rows = pitched.withColumn("configuration", config)
    asked = F.when(F.col("configuration") == "rules_retrieval", F.transform(cases.questions(F.col("missing"), most_questions), lambda q: q["question"])).otherwise(F.array().cast("array<string>"))
    confirmed = F.concat_ws("; ", *(F.when(F.col(f"expected_{f}") != "", F.concat(F.lit(f"{f}: "), F.col(f"expected_{f}"))) for f in EXPECTED))
    body = (
        F.when(F.col("configuration") == "fixed_form", F.concat_ws("\n", F.concat(F.lit("Title: "), "expected_what"), F.concat(F.lit("Lead: "), "pitch"), F.concat(F.lit("Body: "), confirmed), F.concat(F.lit("Source: "), "expected_who")))
        .when(F.col("configuration") == "direct", F.concat(F.lit("Text: "), "pitch"))
        .otherwise(F.concat_ws("\n", F.concat(F.lit("Summary: "), "pitch"), F.concat(F.lit("Confirmed: "), confirmed), F.concat(F.lit("Missing: "), F.array_join("missing", ", "))))
    )
    return rows.select(key, "configuration", body.alias("briefing"), asked.alias("questions"), "missing", *(f"expected_{f}" for f in EXPECTED))


def scores(written: DataFrame, key: str = "doc_id") -> DataFrame:
    """Completeness (expected values in the text), structure (sections present) and question relevance of each briefing."""
    known = F.filter(F.array(*(F.when(F.col(f"expected_{f}") != "", F.lower(f"expected_{f}")) for f in EXPECTED)), lambda v: v.isNotNull())
    low = F.lower("briefing")
    found = F.size(F.filter(known, lambda v: F.contains(low, v)))
    sections = F.create_map(*(x for c, names in SECTIONS.items() for x in (F.lit(c), F.array(*map(F.lit, names)))))
    wanted = F.try_element_at(sections, F.col("configuration"))
    structure = F.size(F.filter(wanted, lambda s: F.contains(F.col("briefing"), F.concat(s, F.lit(":"))))) / F.size(wanted)
    relevance = F.when(F.size("missing") == 0, 1.0).otherwise(F.least(F.lit(1.0), F.size("questions") / F.size("missing")))
    return written.select(key, "configuration", F.round(F.when(F.size(known) == 0, 0.0).otherwise(found / F.size(known)), 4).alias("completeness"), F.round(structure, 4).alias("structure"), F.round(relevance, 4).alias("relevance"))


def strict_pitch(title: Column, lead: Column, body: Column, prefix: str = "Write about: ") -> Column:
    """A request that gives nothing away: lead or three sentences, without title, its long terms, dates, mail, numbers, quotes and names."""
    start = F.when(F.size(F.split(text.collapse(lead), " ")) >= LEAD_WORDS, text.collapse(lead)).otherwise(F.array_join(F.slice(text.sentences(body), 1, 3), " "))
    bare = text.redact(start, F.array(title), "", 3)
    terms = F.slice(F.filter(F.array_distinct(text.tokens(title)), lambda t: F.length(t) >= 7), 1, TITLE_TERMS)
    bare = F.reduce(terms, bare, lambda t, w: F.regexp_replace(t, F.concat(F.lit(r"(?iu)\b"), w, F.lit(r"\b")), F.lit("")))
    for pattern in (r"\b\d{1,2}/\d{1,2}/\d{2,4}\b", r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b", r"\b\d{4,}\b", r"[\"“][^\"”]*[\"”]", r"\b\p{Lu}\p{Ll}+\s+\p{Lu}\p{Ll}+\b"):
        bare = F.regexp_replace(bare, pattern, "")
    return F.concat(F.lit(prefix), F.array_join(F.slice(F.split(text.collapse(bare), " "), 1, STRICT_WORDS), " "))


def anonymize(x: Column, institution: str, units: list[str], protected: list[str]) -> Column:
    """Addresses, mail, the institution, its units and persons become placeholders; protected phrases stay."""
    t = text.filled(x)
    for i, phrase in enumerate(protected):
        t = F.replace(t, F.lit(phrase), F.lit(f"\x02{i}\x03"))
    steps = [(r"https?://\S+", "[URL]"), (r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b", "[EMAIL]"), (rf"(?i)\b{re.escape(institution)}\b", "[INSTITUTION]"), *((rf"(?i)\b{re.escape(u)}\b", "[UNIT]") for u in units), (r"\b\p{Lu}\p{Ll}+(?:\s+(?:d[aeo]s?\s+)?\p{Lu}\p{Ll}+)+\b", "[PERSON]")]
    for pattern, by in steps:
        t = F.regexp_replace(t, pattern, by)
    for i, phrase in enumerate(protected):
        t = F.replace(t, F.lit(f"\x02{i}\x03"), F.lit(phrase))
    return t


def claims(briefing: Column) -> Column:
    """Lines that state something: without bullets; no headings, questions or notes on missing information."""
    lines = F.transform(F.split(text.filled(briefing), "\n"), lambda s: F.trim(F.regexp_replace(s, r"^\s*(?:[-*•]|\d+[.)])\s*", "")))
    return F.filter(lines, lambda s: (s != "") & ~F.endswith(s, F.lit(":")) & ~F.endswith(s, F.lit("?")) & ~F.startswith(s, F.lit("#")) & ~F.startswith(F.lower(s), F.lit("missing")))


def audit_claims(rows: DataFrame, key: str, briefing: str, evidence: str) -> DataFrame:
    """Claims of each briefing and how many the evidence supports."""
    each = rows.select(key, F.col(evidence).alias("evidence"), F.explode_outer(claims(F.col(briefing))).alias("claim"))
    ok = F.col("claim").isNotNull() & cases.claim_supported(F.col("claim"), F.coalesce("evidence", F.lit("")))
    counted = each.groupBy(key).agg(F.count("claim").alias("claims"), F.count_if(ok).alias("supported"))
    return counted.withColumn("precision", F.when(F.col("claims") == 0, 1.0).otherwise(F.round(F.col("supported") / F.col("claims"), 4)))


def flatten_questions(written: DataFrame, key: str = "doc_id", n: int = 100) -> DataFrame:
    """The first questions of all briefings, one a row."""
    return written.select(key, "configuration", F.posexplode("questions").alias("position", "question")).orderBy(key, "configuration", "position").limit(n)
