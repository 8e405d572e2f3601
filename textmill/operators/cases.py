"""Evaluation cases: ground truth, masking, pitches, extraction, missing fields, questions, scores, audits, checkpoints."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text, values
from ..functions.values import FIELDS

# Fixed values.
LABELS = {"who": "Responsavel", "what": "Assunto", "when": "Data confirmada", "where": "Local", "why": "Motivo", "how": "Participacao", "source": "Fonte", "unit": "Unidade"}
ENDING = "Solicita-se complementar as informacoes ausentes antes da divulgacao."
CUES = {"who": ["quem", "responsavel"], "when": ["quando", "data"], "where": ["onde", "local"], "why": ["por que", "motivo"], "how": ["como", "participacao"], "source": ["fonte", "link"], "unit": ["unidade", "campus"], "what": ["assunto"]}
QUESTIONS = {"who": "Who is responsible?", "what": "What is it about?", "when": "When does it take place?", "where": "Where does it take place?", "why": "Why is it held?", "how": "How can one take part?", "source": "Which document confirms it?", "unit": "Which unit signs it?"}
NEVER_MASKED = "what"
CONFIGURATIONS = ["fixed_form", "direct", "rules_retrieval", "model_retrieval"]


def ground_truth(**fields: Column) -> Column:
    """A map of all fields; missing ones are empty."""
    return F.create_map(*(x for f in FIELDS for x in (F.lit(f), F.coalesce(F.trim(fields.get(f, F.lit("")).cast("string")), F.lit("")))))


def masked(cases: DataFrame, truth: str, seed: int, key: str, depth: str) -> DataFrame:
    """Adds removed_fields, available (map) and mask_depth.

    Present fields are taken in the order of a hash of seed, id and field until ``depth`` are removed; a field whose
    value equals a removed one goes too. One field is never removed.

    What lambdas read is exploded from an array of one, as it would else be computed for each element of each lambda.
    """
    once = lambda x: F.explode(F.array(x))
    order = F.array_sort(F.transform(F.filter(F.array(*map(F.lit, FIELDS)), lambda f: (F.try_element_at(truth, f) != "") & (f != NEVER_MASKED)), lambda f: F.struct(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), f).cast("binary"), 256).alias("h"), f.alias("f"))))
    chosen = F.transform(F.slice(F.col("_order"), F.lit(1), F.col(depth)), lambda x: x["f"])
    gone = F.transform(F.col("_chosen"), lambda f: F.lower(F.try_element_at(truth, f)))
    removed = F.filter(F.array(*map(F.lit, FIELDS)), lambda f: (f != NEVER_MASKED) & (F.try_element_at(truth, f) != "") & F.array_contains(F.col("_gone"), F.lower(F.try_element_at(truth, f))))
    rows = cases.withColumn(truth, once(F.col(truth))).withColumn("_order", order).withColumn("_chosen", chosen).withColumn("_gone", once(gone)).withColumn("removed_fields", once(removed))
    available = F.map_filter(truth, lambda f, v: (v != "") & ~F.array_contains(F.col("removed_fields"), f))
    return rows.withColumns({"available": available, "mask_depth": F.size("removed_fields")}).drop("_order", "_chosen", "_gone")


def pitch(available: Column) -> Column:
    """``Label: value.`` for each available field in the fixed order, and the fixed ending."""
    labels = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))
    lines = F.transform(F.filter(F.array(*map(F.lit, FIELDS)), lambda f: F.map_contains_key(available, f)), lambda f: F.concat(F.try_element_at(labels, f), F.lit(": "), F.try_element_at(available, f), F.lit(".")))
    return F.concat_ws(" ", F.array_join(lines, " "), F.lit(ENDING))


def extract(pitch_text: Column) -> Column:
    """Fields by their labels: each value runs up to the next label or the ending."""
    stops = "|".join(map(re.escape, [*(f"{v}:" for v in LABELS.values()), ENDING[:17]]))
    found = F.create_map(*(x for f, label in LABELS.items() for x in (F.lit(f), F.trim(F.regexp_extract(pitch_text, rf"(?s){re.escape(label)}: (.*?)\.?\s*(?={stops}|$)", 1)))))
    return F.map_filter(found, lambda _, v: v != "")


def missing(pitch_text: Column, extracted: Column) -> Column:
    """Fields that are absent, in the fixed order."""
    return F.filter(F.array(*map(F.lit, FIELDS)), lambda f: ~F.map_contains_key(extracted, f))


def cued(pitch_text: Column) -> Column:
    """Fields whose cue words the text holds."""
    key = text.text_key(pitch_text)
    table = F.create_map(*(x for f, words in CUES.items() for x in (F.lit(f), F.array(*map(F.lit, words)))))
    return F.filter(F.array(*map(F.lit, FIELDS)), lambda f: F.exists(F.try_element_at(table, f), lambda w: F.contains(key, w)))


def questions(fields: Column, most: int = 5) -> Column:
    """One question for each missing field, at most ``most``, each field once."""
    table = F.create_map(*(F.lit(x) for pair in QUESTIONS.items() for x in pair))
    return F.transform(F.slice(F.array_distinct(fields), 1, most), lambda f: F.struct(f.alias("field"), F.try_element_at(table, f).alias("question")))


def score(removed: Column, detected: Column, asked: Column, claims: Column, supported: Column) -> dict[str, Column]:
    """Measures of one output; no claims are wholly precise."""
    share = lambda a, b, none: F.when(b == 0, none).otherwise(F.round(a / b, 4))
    hit = F.size(F.array_intersect(removed, detected))
    relevant = F.size(F.filter(asked, lambda q: F.array_contains(removed, q)))
    covered = F.size(F.array_intersect(removed, asked))
    return {
        "completeness": share(F.lit(len(FIELDS)) - F.size(removed), F.lit(len(FIELDS)), 0.0), "factual_precision": share(supported, claims, 1.0), "hallucination_rate": share(claims - supported, claims, 0.0),
        "question_relevance": share(relevant, F.size(asked), 0.0), "question_coverage": share(covered, F.size(removed), 1.0), "question_redundancy": share(F.size(asked) - F.size(F.array_distinct(asked)), F.size(asked), 0.0),
        "missing_detected": share(hit, F.size(removed), 1.0),
    }


def claim_supported(claim: Column, evidence: Column) -> Column:
    """Literal, or sharing enough content tokens; dates and addresses must be literal."""
    literal = F.contains(F.lower(evidence), F.lower(F.trim(claim)))
    exact_only = claim.rlike(r"https?://|\d{1,2}/\d{1,2}/\d{2,4}|\d{4}-\d{2}-\d{2}")
    tokens = text.content_tokens(claim, text.BASELINE_STOPWORDS)
    need = F.greatest(F.lit(1), F.least(F.lit(3), F.ceil(0.6 * F.size(tokens))))
    return F.when(literal, True).when(exact_only, False).otherwise(F.size(F.array_intersect(tokens, text.content_tokens(evidence, text.BASELINE_STOPWORDS))) >= need)


def compare(scores: DataFrame, measures: list[str]) -> DataFrame:
    """Means of each configuration in the fixed order; absent ones are left out."""
    order = F.array_position(F.array(*map(F.lit, CONFIGURATIONS)), F.col("configuration"))
    return scores.groupBy("configuration").agg(*(F.round(F.avg(m), 4).alias(m) for m in measures), F.count("*").alias("cases")).withColumn("place", order.cast("int"))


def audit(outputs: DataFrame, configurations: list[str] = CONFIGURATIONS) -> DataFrame:
    """(check_name, offending): cases without all configurations, repeated outputs, failed or unparsed ones."""
    by_case = outputs.groupBy("case_id").agg(F.count_distinct("configuration").alias("kinds"), F.count("*").alias("n"), F.count_if(F.col("status") != "ok").alias("failed"), F.count_if(F.coalesce("parse_error", F.lit("")) != "").alias("unparsed"))
    tests = {"incomplete_cases": F.col("kinds") < len(configurations), "repeated_outputs": F.col("n") > F.col("kinds"), "failed_cases": F.col("failed") > 0, "unparsed_cases": F.col("unparsed") > 0}
    wide = by_case.agg(*(F.count_if(t).alias(n) for n, t in tests.items()))
    return wide.select(F.expr("stack({}, {}) as (check_name, offending)".format(len(tests), ", ".join(f"'{n}', `{n}`" for n in tests))))


def checkpoint_conflicts(saved: DataFrame, key: str, *content: str) -> DataFrame:
    """Keys saved with different contents: a repeated identical save is none."""
    digest = values.fingerprint(*content)
    return saved.select(key, digest.alias("digest")).groupBy(key).agg(F.count_distinct("digest").alias("versions"), F.count("*").alias("saves")).where("versions > 1")


def incomplete(outputs: DataFrame, scores: DataFrame, configurations: list[str] = CONFIGURATIONS) -> DataFrame:
    """(case_id, problem) for each case without exactly one output and one score of each configuration, or with one that failed.

    Repeated, unknown and missing configurations count as problems of outputs or of scores.
    """
    known = lambda: F.count_distinct(F.when(F.col("configuration").isin(configurations), F.col("configuration")))
    given = outputs.groupBy("case_id").agg(F.count("*").alias("n"), known().alias("kinds"), F.bool_or(~F.col("status").eqNullSafe("ok")).alias("failed"), F.bool_or(F.coalesce("parse_error", F.lit("")) != "").alias("unparsed"))
    scored = scores.groupBy("case_id").agg(F.count("*").alias("s"), known().alias("scored_kinds"))
    rows = given.join(scored, "case_id", "full")
    whole = lambda n, kinds: F.coalesce((F.col(n) == len(configurations)) & (F.col(kinds) == len(configurations)), F.lit(False))
    problems = F.array(F.when(~whole("n", "kinds"), "outputs"), F.when(F.col("failed"), "not ok"), F.when(F.col("unparsed"), "parse error"), F.when(~whole("s", "scored_kinds"), "scores"))
    return rows.select("case_id", F.explode(F.filter(problems, lambda p: p.isNotNull())).alias("problem"))
