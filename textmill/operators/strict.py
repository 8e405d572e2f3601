"""Strict briefings: cases whose source no search can find, three configurations of each, their scores and means.

A case has (case_id, pitch, predicted_type, source_type, source_unit, expected), where ``expected`` maps fields to the
values that a reporter should find out. Passages are (case_id, rank, title, type, unit): what a search for the pitch found
in an index without the sources of all cases. Each claim is audited against the pitch and expected values of its own case
and against the passages that its own configuration saw.

Defined results: null texts count as empty; a case without passages, expected values, questions or claims scores 0 there;
``same_unit5`` is null where the source has no unit; ranks above PASSAGES are left out; repeated cases stay repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text
from ..functions.questions import ANY_FIELD
from ..functions.values import FIELDS

PASSAGES, BEST, NAMED, EXTRAS, ENOUGH = 10, 5, 3, 2, 3
FIXED, DIRECT, REPORTER = "fixed_form_baseline", "direct_generation_baseline", "virtual_reporter"
UNCLASSIFIED = "not_classified"
MEASURES = ["completeness", "structure", "missing_detected", "question_relevance", "n_questions", "same_type5", "same_unit5", "precision", "hallucination"]

# Fixed values (the name of the institution in a question is left out; no score depends on it).
SECTIONS = ["suggested_title", "confirmed_information", "missing_information", "suggested_questions", "similar_news", "notes_for_journalist"]
QUESTIONS = {
    "who": "Quem e o responsavel direto pela informacao ou atividade?",
    "what": "Qual e o fato principal que deve ser divulgado?",
    "when": "Qual e a data ou periodo exato da atividade, inscricao ou publicacao?",
    "where": "Onde a atividade acontece ou qual unidade da instituicao esta envolvida?",
    "why": "Qual e o objetivo ou justificativa da divulgacao?",
    "how": "Como o publico deve participar, se inscrever ou acessar o servico?",
    "source": "Qual link oficial, edital, formulario ou documento deve ser usado como fonte?",
    "unit": "Qual campus, reitoria ou unidade deve assinar a informacao?",
}
EXTRA_QUESTIONS = {
    "edital_selection": ["Qual e o prazo de inscricao e onde esta publicado o edital?", "Quais sao os requisitos, vagas e etapas do processo seletivo?"],
    "event": ["Qual e a programacao, horario e local do evento?", "O evento exige inscricao previa ou tem limite de vagas?"],
    "service_announcement": ["Quem sera afetado pelo comunicado e por quanto tempo?", "Existe canal de atendimento para duvidas da comunidade?"],
    "research": ["Quem coordena a pesquisa e quais resultados devem ser destacados?"],
    "extension": ["Qual publico externo sera atendido pela acao de extensao?"],
}
SIGNS = {
    "when": ["data", "periodo", "prazo", "horario", "tempo"],
    "where": ["onde", "local", "campus", "unidade"],
    "source": ["link", "edital", "formulario", "documento", "fonte"],
    "who": ["quem", "responsavel", "coordena"],
    "how": ["como", "participar", "inscricao", "acessar", "etapas"],
    "why": ["objetivo", "justificativa", "resultados", "requisitos"],
}
ALWAYS_MISSING = ["when", "where", "source"]
FORM_HEAD, FORM_LINE = "Registro do formulario:", "Descricao informada: "
DIRECT_HEAD, DIRECT_LINE = "Briefing preliminar", "Resumo: "
DIRECT_NOTE = "Pendencias: confirmar data, local, unidade responsavel, link oficial e contato."
REPORTER_TITLE = "suggested_title: Noticia institucional a confirmar"
REPORTER_NOTE = "notes_for_journalist: validar dados ausentes com a unidade demandante antes de redigir a noticia final."
UNCLAIMED = ["missing_information:", "notes_for_journalist:"]


def actual_missing(expected: Column, pitch: Column) -> Column:
    """Fields with an expected value of which the pitch holds too few tokens: all, or three of more. The fact itself never is."""

    def open_fields(held: Column) -> Column:
        def absent(f: Column) -> Column:
            value = F.coalesce(F.try_element_at(expected, f), F.lit(""))
            few = text.let(F.array_distinct(text.tokens(value)), lambda t: F.size(F.array_intersect(t, held)) < F.greatest(F.lit(1), F.least(F.lit(ENOUGH), F.size(t))))
            return (value != "") & few

        return F.filter(F.array(*(F.lit(f) for f in FIELDS if f != "what")), absent)

    return text.let(text.tokens(pitch), open_fields)


def inferred(question: Column) -> Column:
    """Fields that the words of a question stand for."""
    return text.let(
        F.array_join(text.tokens(question), " "),
        lambda t: F.filter(F.array(*(F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(t, w)), f) for f, words in SIGNS.items())), lambda f: f.isNotNull()),
    )


def asked(predicted: Column, missing: Column) -> Column:
    """Array of (field, question): the template of each missing field, then at most two of the predicted type."""
    table = F.create_map(*(F.lit(x) for pair in QUESTIONS.items() for x in pair))
    extra = F.create_map(*(x for kind, qs in EXTRA_QUESTIONS.items() for x in (F.lit(kind), F.array(*map(F.lit, qs[:EXTRAS])))))
    one = lambda f, q: F.struct(f.alias("field"), q.alias("question"))
    templates = F.transform(F.filter(missing, lambda f: F.map_contains_key(table, f)), lambda f: one(f, F.try_element_at(table, f)))
    more = F.coalesce(F.try_element_at(extra, F.coalesce(predicted, F.lit(""))), F.array().cast("array<string>"))
    return F.concat(templates, F.transform(more, lambda q: text.let(inferred(q), lambda fs: one(F.when(F.size(fs) == 0, ANY_FIELD).otherwise(F.array_join(fs, "+")), q))))


def question_score(question: Column, missing: Column, present: Column) -> Column:
    """1 for a question on a missing field, a quarter for one on none in particular; 0 on one that is known."""

    def scored(fields: Column) -> Column:
        return F.when(F.arrays_overlap(fields, present), 0.0).when(F.arrays_overlap(fields, missing), 1.0).when(question["field"] == ANY_FIELD, 0.25).otherwise(0.0)

    return text.let(F.array_union(F.split(question["field"], r"\+"), inferred(question["question"])), scored)


def field_supported(field: Column, confirmed: Column, expected: Column) -> Column:
    """A confirmed value counts if it shares a token with the expected one or holds it; any confirmed fact does."""
    want = text.tokens(expected)
    alike = (F.size(want) > 0) & (F.arrays_overlap(text.tokens(confirmed), want) | F.contains(confirmed, expected))
    return F.when(F.coalesce(confirmed, F.lit("")) == "", False).when(field == "what", True).otherwise(alike)


def claims(briefing: Column) -> Column:
    """Lines that state something: no bullets, no headings of questions, no notes on what is missing."""
    lines = F.transform(F.split(text.filled(briefing), "\n"), lambda s: text.strip(s))
    silent = lambda s: F.startswith(s, F.lit("- ")) | (F.lower(s) == "suggested_questions:") | F.startswith(F.lower(s), F.lit(UNCLAIMED[0])) | F.startswith(F.lower(s), F.lit(UNCLAIMED[1]))
    return F.filter(lines, lambda s: (s != "") & ~silent(s))


def supported(claim: Column, support: Column) -> Column:
    """All content tokens of the claim, or three of more, are among those of the support; a claim without any is."""
    return text.let(text.content_tokens(claim), lambda t: F.size(F.array_intersect(t, support)) >= F.least(F.lit(ENOUGH), F.size(t)))


def evidence(passages: DataFrame) -> DataFrame:
    """The passages of each case in one row, by rank: PASSAGES at most."""
    one = F.struct("rank", *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("title", "type", "unit")))
    return passages.where(F.col("rank") <= PASSAGES).groupBy("case_id").agg(F.array_sort(F.collect_list(one)).alias("passages"))


def _listed(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(items, lambda i: F.concat(F.lit("'"), i, F.lit("'"))), ", "), F.lit("]"))


def outputs(cases: DataFrame, passages: DataFrame) -> DataFrame:
    """Three rows for each case: what each configuration asks, confirms and writes, and the passages that it saw."""
    rows = cases.join(evidence(passages), "case_id", "left")
    none = F.array().cast("array<struct<rank:int,title:string,type:string,unit:string>>")
    rows = rows.withColumns({"pitch": text.filled(F.col("pitch")), "passages": F.coalesce(F.col("passages").cast("array<struct<rank:int,title:string,type:string,unit:string>>"), none)})
    rows = rows.withColumn("actual_missing", actual_missing(F.col("expected"), F.col("pitch")))
    rows = rows.withColumn("_asked", asked(F.col("predicted_type"), F.col("actual_missing")))
    filled = lambda **fields: F.map_filter(F.create_map(*(x for f, c in fields.items() for x in (F.lit(f), F.coalesce(c, F.lit(""))))), lambda _, v: v != "")
    pitch, predicted = F.col("pitch"), F.coalesce("predicted_type", F.lit(""))
    both = filled(what=pitch, why=F.try_element_at("expected", F.lit("why")))
    silent, unasked = F.array().cast("array<string>"), F.array().cast("array<struct<field:string,question:string>>")
    titles = F.transform(F.slice("passages", 1, NAMED), lambda p: p["title"])
    report = F.concat_ws(
        "\n", F.lit(REPORTER_TITLE), F.concat(F.lit("predicted_type: "), predicted), F.concat(F.lit("confirmed_information: {'what': '"), pitch, F.lit("'}")),
        F.concat(F.lit("missing_information: "), _listed(F.col("actual_missing"))), F.lit("suggested_questions:"), F.transform("_asked", lambda q: F.concat(F.lit("- "), q["question"])),
        F.concat(F.lit("similar_news: "), _listed(titles)), F.lit(REPORTER_NOTE),
    )

    def row(name: str, kind: Column, found: Column, questions: Column, confirmed: Column, missing: Column, briefing: Column) -> Column:
        parts = {"configuration": F.lit(name), "predicted": kind, "retrieved": found, "questions": questions, "confirmed": confirmed, "missing": missing, "briefing": briefing}
        return F.struct(*(c.alias(n) for n, c in parts.items()))

    each = F.array(
        row(FIXED, F.lit(UNCLASSIFIED), none, unasked, filled(what=pitch), silent, F.concat(F.lit(f"{FORM_HEAD}\n{FORM_LINE}"), pitch)),
        row(DIRECT, F.lit(UNCLASSIFIED), none, unasked, both, F.array(*map(F.lit, ALWAYS_MISSING)), F.concat(F.lit(f"{DIRECT_HEAD}\n{DIRECT_LINE}"), pitch, F.lit(f"\n{DIRECT_NOTE}"))),
        row(REPORTER, predicted, F.col("passages"), F.col("_asked"), both, F.col("actual_missing"), report),
    )
    return rows.select("case_id", "pitch", "expected", "source_type", "source_unit", "actual_missing", F.explode(each).alias("o")).select("case_id", "pitch", "expected", "source_type", "source_unit", "actual_missing", "o.*")


def scores(written: DataFrame) -> DataFrame:
    """(case_id, configuration, MEASURES) of each output."""
    share = lambda hits, all_of: F.when(all_of == 0, 0.0).otherwise(hits / all_of)
    known = F.filter(F.map_entries("expected"), lambda e: F.coalesce(e["value"], F.lit("")) != "")
    right = F.filter(known, lambda e: field_supported(e["key"], F.try_element_at("confirmed", e["key"]), e["value"]))
    relevance = F.reduce(F.transform("questions", lambda q: question_score(q, F.col("actual_missing"), F.map_keys("confirmed"))), F.lit(0.0), lambda a, b: a + b)
    best = F.slice("retrieved", 1, BEST)
    support = F.concat_ws(" ", "pitch", F.transform(F.map_values("expected"), text.filled), F.transform(best, lambda p: p["title"]))
    held = written.withColumns({"_claims": claims(F.col("briefing")), "_support": F.array_distinct(text.tokens(support))})
    precision = share(F.size(F.filter("_claims", lambda c: supported(c, F.col("_support")))), F.size("_claims"))
    unit = F.coalesce("source_unit", F.lit(""))
    measures = {
        "completeness": F.round(share(F.size(right), F.size(known)), 4),
        "structure": F.round(F.size(F.filter(F.array(*map(F.lit, SECTIONS)), lambda s: F.contains(F.col("briefing"), s))) / len(SECTIONS), 4),
        "missing_detected": F.round(share(F.size(F.array_intersect("missing", "actual_missing")), F.size("actual_missing")), 4),
        "question_relevance": F.round(share(relevance, F.size("questions")), 4), "n_questions": F.size("questions"),
        "same_type5": F.exists(best, lambda p: p["type"] == F.coalesce("source_type", F.lit(""))).cast("int"),
        "same_unit5": F.when(unit != "", F.exists(best, lambda p: p["unit"] == unit).cast("int")),
        "precision": F.round(precision, 4), "hallucination": F.round(1 - precision, 4),
    }
    return held.select("case_id", "configuration", *(c.alias(n) for n, c in measures.items()))


def aggregate(scored: DataFrame) -> DataFrame:
    """Cases and means of each configuration; the mean of ``same_unit5`` is over sources with a unit."""
    return scored.groupBy("configuration").agg(F.count("*").alias("cases"), *(F.round(F.avg(m), 2 if m == "n_questions" else 4).alias(m) for m in MEASURES))
