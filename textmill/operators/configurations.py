"""Four configurations of the same cases: a form, a model alone, rules with passages, and a model with both.

A case has (case_id, pitch, predicted_type, ground_truth map, removed_fields); passages are (case_id, rank, article_id,
title, lead, preview). Two configurations need a model: :func:`prompts` states what it is asked and :func:`outputs` takes
its answers. Nothing here calls it.

Defined results: null texts are empty; a case without passages has none as evidence; an answer that is no usable object
counts as a parse error and the fourth configuration falls back on its rules.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import questions, text
from ..functions.answers import parse_answer
from ..sources.models import NO_MODEL, OK
from . import cases as pilot

FIXED, DIRECT, RULES, MODEL = "fixed_form_baseline", "direct_llm_baseline", "virtual_reporter", "virtual_reporter_llm_rag"
CONFIGURATIONS = [FIXED, DIRECT, RULES, MODEL]
ASKING = [DIRECT, MODEL]
PASSAGES, NAMED, SHOWN, LEAD_CHARS = 5, 3, 2, 260
UNCLASSIFIED = "not_classified"

# Fixed values.
FIELDS = ["what", "who", "when", "where", "why", "how", "source", "unit"]
DEMAND, FACT, CONTEXT = "Demanda recebida para divulgacao institucional.", "Fato informado: ", "Contexto informado: "
NO_FACT = "noticia institucional a apurar"
PENDING = "Dados ainda nao confirmados: data, local/unidade responsavel, fonte oficial/link e contato."
LABELS = {"what": "Fato informado", "who": "Responsavel confirmado", "when": "Data confirmada", "where": "Local confirmado", "why": "Contexto confirmado", "how": "Como confirmado", "source": "Fonte confirmada", "unit": "Unidade confirmada"}
CUES = {"when": ["data"], "where": ["local"], "unit": ["unidade"], "source": ["fonte", "link"], "who": ["contato", "responsavel"]}
QUESTIONS = {
    "who": "Quem e o responsavel direto pela informacao ou atividade?",
    "when": "Qual e a data ou periodo exato da atividade, inscricao ou publicacao?",
    "where": "Onde a atividade acontece ou qual local deve ser informado?",
    "why": "Qual e o objetivo ou justificativa da divulgacao?",
    "how": "Como o publico deve participar, se inscrever ou acessar o servico?",
    "source": "Qual link oficial, edital, formulario, documento ou contato deve ser usado como fonte?",
    "unit": "Qual campus, reitoria ou unidade institucional deve assinar a informacao?",
}
TYPED = {
    "edital_selection": [(["when", "source"], "Qual e o prazo de inscricao e onde esta publicado o edital?"), (["how"], "Quais sao os requisitos, vagas e etapas do processo seletivo?")],
    "event": [(["when", "where"], "Qual e a programacao, horario e local do evento?"), (["how"], "O evento exige inscricao previa ou tem limite de vagas?")],
    "service_announcement": [(["who", "when"], "Quem sera afetado pelo comunicado e por quanto tempo?"), (["source"], "Existe canal de atendimento ou documento oficial para duvidas da comunidade?")],
    "research": [(["who", "why"], "Quem coordena a pesquisa e quais resultados devem ser destacados?")],
    "extension": [(["who", "how"], "Qual publico externo sera atendido pela acao de extensao?")],
}
ASKED_HOW = ["edital_selection", "event", "extension"]

#: What a model is told. The last is added when an answer before could not be read.
TASK = (
    "You help a newsroom to complete a request. Use only what follows and state nothing that it does not confirm. Answer with one JSON object and nothing else. Keys: "
    "confirmed_information (object, fields {0}), missing_information (list of fields), suggested_questions (at most 3), factual_claims (at most 3)."
)
WITH_SIGNALS = "The signals come from rules; articles among them show style and context and confirm nothing about this request."
SHORTER = "SHORT_JSON: the last answer was no complete JSON object. Keep it under 350 tokens, with two questions and two claims of 120 characters at most."

_QUESTION = "array<struct<field:string,question:string>>"


def _ordered(values: Column) -> Column:
    """The non-empty entries of a map, in the order of FIELDS."""
    entries = F.filter(F.transform(F.array(*map(F.lit, FIELDS)), lambda f: F.struct(f.alias("key"), F.coalesce(F.try_element_at(values, f), F.lit("")).alias("value"))), lambda e: e["value"] != "")
    return F.map_from_entries(entries)


def pilot_cases(articles: DataFrame) -> DataFrame:
    """Cases of (case_id, title, lead, body, author, unit, published, url, how): what is true, and a request that leaves most of it out."""
    n = lambda c: text.normalize_space(text.filled(F.col(c)))
    rows = articles.select("*", text.first_sentence(F.when(n("lead") != "", n("lead")).otherwise(n("body"))).alias("_why"))
    truth = {"what": n("title"), "who": F.when(n("author") != "", n("author")).otherwise(n("unit")), "when": n("published"), "where": n("unit"), "why": F.col("_why"), "how": n("how"), "source": n("url"), "unit": n("unit")}
    rows = rows.withColumn("ground_truth", F.create_map(*(x for f, c in truth.items() for x in (F.lit(f), c))))
    secret = F.array(*(F.try_element_at("ground_truth", F.lit(f)) for f in ("when", "unit", "source", "who")))
    rows = rows.withColumns({"_title": text.redact(n("title"), secret, "[FIELD REMOVED]", 4), "_context": text.redact(F.col("_why"), secret, "[FIELD REMOVED]", 4)})
    fact = F.concat(F.lit(FACT), F.when(F.col("_title") != "", F.col("_title")).otherwise(NO_FACT), F.lit("."))
    context = F.when((F.col("_context") != "") & (F.col("_context") != F.col("_title")), F.concat(F.lit(CONTEXT), "_context", F.lit(".")))
    told = F.when(F.col("_context") != "", F.array(F.lit("what"), F.lit("why"))).otherwise(F.array(F.lit("what")))
    removed = F.filter(F.array(*map(F.lit, FIELDS)), lambda f: (F.try_element_at("ground_truth", f) != "") & ~F.array_contains(told, f))
    return rows.select("case_id", text.normalize_space(F.concat_ws(" ", F.lit(DEMAND), fact, context, F.lit(PENDING))).alias("pitch"), "ground_truth", removed.alias("removed_fields"))


def extract(pitch: Column) -> Column:
    """Fields by their labels; where there are none, the context, an address and a date."""
    stops = "|".join(map(re.escape, LABELS.values()))
    ends = rf"(?=\.\s+(?:{stops}|Ha informacoes)|$)"
    trimmed = lambda c: text.normalize_space(F.regexp_replace(c, r"\.+$", ""))
    labelled = _ordered(F.create_map(*(x for f, label in LABELS.items() for x in (F.lit(f), trimmed(F.regexp_extract(pitch, rf"(?i){re.escape(label)}:\s*(.+?){ends}", 1))))))
    context = trimmed(F.regexp_extract(pitch, rf"{CONTEXT.strip()}\s*(.+?)(?:\.\s+Dados ainda|$)", 1))
    address = F.regexp_replace(F.regexp_extract(pitch, r"https?://\S+", 0), r"[.,)]+$", "")
    date = F.regexp_extract(pitch, r"\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}/\d{1,2}/\d{2,4}\b", 0)
    others = _ordered(F.create_map(F.lit("why"), context, F.lit("source"), address, F.lit("when"), date))
    return text.let(labelled, lambda m: F.when(F.size(m) > 0, m).otherwise(others))


def missing(pitch: Column, confirmed: Column) -> Column:
    """Fields that are not confirmed or whose cue words the text holds, in order."""
    low = F.lower(pitch)
    cued = {f: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)) for f, words in CUES.items()}
    return F.filter(F.array(*(F.when(~F.map_contains_key(confirmed, f) | cued.get(f, F.lit(False)), f) for f in FIELDS)), lambda f: f.isNotNull())


def adaptive(predicted: Column, open_fields: Column) -> Column:
    """Questions of the type on fields that no question before covers, then one for each field left."""
    spec = lambda fields, q: F.struct(F.array(*map(F.lit, fields)).alias("fields"), F.lit(q).alias("question"))
    none = F.array().cast("array<struct<fields:array<string>,question:string>>")
    typed = none
    for kind, specs in TYPED.items():
        typed = F.when(predicted == kind, F.array(*(spec(f, q) for f, q in specs))).otherwise(typed)
    single = F.filter(F.array(*(spec([f], QUESTIONS[f]) for f in FIELDS if f in QUESTIONS)), lambda s: F.array_contains(open_fields, s["fields"][0]))
    start = F.struct(F.array().cast(_QUESTION).alias("asked"), F.array().cast("array<string>").alias("covered"))

    def step(state: Column, s: Column) -> Column:
        new = F.filter(F.array(*map(F.lit, FIELDS)), lambda f: F.array_contains(s["fields"], f) & F.array_contains(open_fields, f))
        return F.when(F.size(F.array_except(new, state["covered"])) == 0, state).otherwise(
            F.struct(F.concat(state["asked"], F.array(F.struct(F.array_join(new, "+").alias("field"), s["question"].alias("question")))).alias("asked"), F.array_union(state["covered"], new).alias("covered"))
        )

    return F.reduce(F.concat(typed, single), start, step, lambda state: state["asked"])


def signals(cases: DataFrame, passages: DataFrame) -> DataFrame:
    """Cases with passages, confirmed, missing and asked: what the rules find."""
    one = F.struct("rank", *(text.filled(F.col(c).cast("string")).alias(c) for c in ("article_id", "title", "lead", "preview")))
    found = passages.where(F.col("rank") <= PASSAGES).groupBy("case_id").agg(F.array_sort(F.collect_list(one)).alias("passages"))
    rows = cases.join(found, "case_id", "left")
    rows = rows.withColumns({"pitch": text.filled(F.col("pitch")), "predicted_type": text.filled(F.col("predicted_type")), "passages": F.coalesce("passages", F.array().cast(found.schema["passages"].dataType))})
    rows = rows.withColumn("confirmed", extract(F.col("pitch"))).withColumn("missing", missing(F.col("pitch"), F.col("confirmed")))
    open_fields = F.when(F.col("predicted_type").isin(ASKED_HOW), F.col("missing")).otherwise(F.array_remove("missing", "how"))
    return rows.withColumn("asked", adaptive(F.col("predicted_type"), open_fields))


def prompts(rows: DataFrame, shorter: bool = False) -> DataFrame:
    """(case_id, configuration, prompt) for the two configurations with a model; only the second sees what the rules found."""
    task, more = TASK.format(", ".join(FIELDS)), [F.lit(SHORTER)] if shorter else []
    shown = F.transform(F.slice("passages", 1, SHOWN), lambda p: F.struct(p["rank"].alias("rank"), p["title"].alias("title"), F.left(text.normalize_space(p["lead"]), F.lit(LEAD_CHARS)).alias("lead")))
    context = F.to_json(F.struct("predicted_type", "confirmed", "missing", "asked", shown.alias("articles")))
    direct = F.concat_ws("\n\n", F.lit(task), F.concat(F.lit("Request:\n"), "pitch"), *more)
    ruled = F.concat_ws("\n\n", F.lit(task), F.lit(WITH_SIGNALS), F.concat(F.lit("Request:\n"), "pitch"), F.concat(F.lit("Signals:\n"), context), *more)
    pair = F.array(*(F.struct(F.lit(c).alias("configuration"), p.alias("prompt")) for c, p in ((DIRECT, direct), (MODEL, ruled))))
    return rows.select("case_id", F.inline(pair))


def _lines(confirmed: Column) -> Column:
    return F.transform(F.map_entries(confirmed), lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), e["value"]))


def outputs(rows: DataFrame, answered: DataFrame) -> DataFrame:
    """Four rows for each case of :func:`signals`; ``answered`` has (case_id, configuration, response, status, status_reason, attempts)."""
    by_case = answered.groupBy("case_id").agg(*(F.any_value(F.when(F.col("configuration") == c, F.struct("response", "status", "status_reason", "attempts")), True).alias(c) for c in ASKING))
    rows = rows.join(by_case, "case_id", "left").withColumns({f"_{c}": parse_answer(F.coalesce(F.col(c)["response"], F.lit(""))) for c in ASKING})
    pitch, confirmed, absent, asked, found = (F.col(c) for c in ("pitch", "confirmed", "missing", "asked", "passages"))
    titles = F.filter(F.transform(F.slice(found, 1, NAMED), lambda p: p["title"]), lambda t: t != "")
    evidence = F.concat(F.array(pitch), F.transform(found, lambda p: text.normalize_space(F.concat_ws("\n", p["title"], p["lead"], p["preview"]))))
    values = lambda m: F.filter(F.map_values(m), lambda v: v != "")
    plain = lambda qs: F.transform(qs, lambda q: F.struct(F.lit(questions.ANY_FIELD).alias("field"), q.alias("question")))
    templates = F.transform(F.filter(absent, lambda f: F.map_contains_key(_TEMPLATES(), f)), lambda f: F.struct(f.alias("field"), F.try_element_at(_TEMPLATES(), f).alias("question")))
    unasked, nothing, unknown = F.array().cast(_QUESTION), F.array().cast("array<string>"), F.create_map().cast("map<string,string>")

    def written(head: list, confirmed: Column, missing_: Column, qs: Column, similar: bool, note: str) -> Column:
        news = [F.lit("similar_news:"), F.transform(titles, lambda t: F.concat(F.lit("- "), t))] if similar else []
        return F.concat_ws("\n", *head, F.lit("confirmed_information:"), _lines(confirmed), F.concat(F.lit("missing_information: "), F.array_join(missing_, ", ")), F.lit("suggested_questions:"), F.transform(qs, lambda q: F.concat(F.lit("- "), q["question"])), *news, F.lit(note))

    def row(configuration, kind, confirmed, missing_, qs, briefing, claims, seen, status=F.lit(OK), why=F.lit(""), error=F.lit(None).cast("string"), attempts=F.lit(0)):
        parts = {
            "configuration": F.lit(configuration), "status": status, "status_reason": why, "predicted": kind, "confirmed": confirmed, "missing": missing_, "questions": qs, "briefing": briefing,
            "claims": F.filter(F.transform(claims, text.normalize_space), lambda c: c != ""), "evidence": seen, "parse_error": error, "attempts": attempts,
        }
        return F.struct(*(c.alias(n) for n, c in parts.items()))

    reporter = [F.lit("suggested_title: Noticia institucional a apurar"), F.concat(F.lit("predicted_type: "), "predicted_type")]
    state = lambda c: (F.coalesce(F.col(c)["status"], F.lit(NO_MODEL)), F.coalesce(F.col(c)["status_reason"], F.lit("")), F.coalesce(F.col(c)["attempts"], F.lit(0)))
    rows = rows.withColumns({
        "_confirmed": _ordered(F.map_concat(F.map_filter(F.col(f"_{MODEL}")["confirmed"], lambda f, _: ~F.map_contains_key(confirmed, f)), confirmed)),
        "_missing": F.filter(F.array(*map(F.lit, FIELDS)), lambda f: F.array_contains(F.array_union(absent, F.col(f"_{MODEL}")["missing"]), f)),
    })
    rows = rows.withColumn("_questions", questions.merged(plain(F.col(f"_{MODEL}")["questions"]), asked, F.col("_missing"), QUESTIONS))
    (direct_status, direct_why, direct_n), (model_status, model_why, model_n) = state(DIRECT), state(MODEL)
    spoke = lambda s, yes, no: F.when(s == OK, yes).otherwise(no)
    d, m = F.col(f"_{DIRECT}"), F.col(f"_{MODEL}")
    fallback = written(reporter, F.col("_confirmed"), F.col("_missing"), F.col("_questions"), True, "notes_for_journalist: fallback deterministico usado; confirmar pendencias antes de publicar.")
    each = F.array(
        row(FIXED, F.lit(UNCLASSIFIED), confirmed, absent, templates, written([F.lit(f"configuration: {FIXED}")], confirmed, absent, templates, False, "notes_for_journalist: preencher apenas campos confirmados pela fonte demandante."), values(confirmed), F.array(pitch)),
        row(DIRECT, F.lit(UNCLASSIFIED), spoke(direct_status, d["confirmed"], unknown), spoke(direct_status, d["missing"], nothing), spoke(direct_status, plain(d["questions"]), unasked), spoke(direct_status, d["briefing"], F.lit("")), spoke(direct_status, d["claims"], nothing), F.array(pitch), direct_status, direct_why, spoke(direct_status, d["reason"], F.lit(None)), direct_n),
        row(RULES, F.col("predicted_type"), confirmed, absent, asked, written(reporter, confirmed, absent, asked, True, "notes_for_journalist: nao transformar exemplos recuperados em fatos do caso atual sem confirmacao."), F.concat(values(confirmed), titles), evidence),
        row(
            MODEL, F.col("predicted_type"), spoke(model_status, F.col("_confirmed"), confirmed), spoke(model_status, F.col("_missing"), absent), spoke(model_status, F.col("_questions"), asked), spoke(model_status, F.when(m["reason"].isNull(), m["briefing"]).otherwise(fallback), F.lit("")),
            spoke(model_status, F.when(F.size(m["claims"]) > 0, m["claims"]).otherwise(values(F.col("_confirmed"))), nothing), evidence, model_status, model_why, spoke(model_status, m["reason"], F.lit(None)), model_n,
        ),
    )
    return rows.select("case_id", "pitch", "ground_truth", "removed_fields", F.explode(each).alias("o")).select("case_id", "pitch", "ground_truth", "removed_fields", "o.*")


def _TEMPLATES() -> Column:
    return F.create_map(*(F.lit(x) for pair in QUESTIONS.items() for x in pair))


def scored(written: DataFrame) -> DataFrame:
    """Outputs with the struct ``scores``; each claim is held against the evidence of its own output."""
    told = F.array_join("evidence", "\n")
    supported = F.size(F.filter("claims", lambda c: pilot.claim_supported(c, told)))
    on = F.filter(F.flatten(F.transform("questions", lambda q: F.split(q["field"], r"\+"))), lambda f: f != questions.ANY_FIELD)
    measures = pilot.score(F.col("removed_fields"), F.col("missing"), on, F.size("claims"), supported)
    measures |= {"claims_total": F.size("claims"), "claims_supported": supported, "questions_total": F.size("questions")}
    return written.withColumn("scores", F.struct(*(c.alias(n) for n, c in measures.items())))
