"""Answers of a model that should be JSON objects: their values, or a typed reason why there are none. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import text
from .values import FIELDS, field_name

NO_JSON, NO_OBJECT, NO_KEYS = "no_json", "not_an_object", "no_known_key"
#: The keys an answer may have, the preferred one of each pair first.
CONFIRMED, MISSING, QUESTIONS, CLAIMS, BRIEFING = ("confirmed_information", "confirmed_fields"), ("missing_information", "missing_fields"), ("suggested_questions", "questions"), ("factual_claims", "claims"), "briefing"


def first_object(x: Column) -> Column:
    """The text from the first brace to the one that closes it; braces within strings do not count. Null if it is never closed."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(0).alias("at"), F.lit(0).alias("first"), F.lit(0).alias("last"))

    def step(s: Column, c: Column) -> Column:
        opens, closes = (c == "{") & ~s["quoted"], (c == "}") & ~s["quoted"] & (s["depth"] > 0)
        depth = s["depth"] + opens.cast("int") - closes.cast("int")
        quote = (c == '"') & ~s["escaped"] & (s["depth"] > 0)
        at = s["at"] + 1
        moved = F.struct(
            depth.alias("depth"), (s["quoted"] != quote).alias("quoted"), ((c == "\\") & s["quoted"] & ~s["escaped"]).alias("escaped"), at.alias("at"),
            F.when(opens & (s["first"] == 0), at).otherwise(s["first"]).alias("first"), F.when(closes & (depth == 0), at).otherwise(F.lit(0)).alias("last"),
        )
        return F.when(s["last"] > 0, s).otherwise(moved)

    end = F.reduce(F.split(x, ""), start, step)
    span = lambda s: F.when(s["last"] > 0, F.substr(x, s["first"], s["last"] - s["first"] + 1))
    # only texts with a brace are walked through
    return F.when(F.contains(x, F.lit("{")), F.get(F.transform(F.array(end), span), F.lit(0)))


def _list(v: Column, keys: tuple[str, ...]) -> Column:
    """The first of the keys that holds a list."""
    return F.coalesce(*(F.try_variant_get(v, f"$.{k}", "array<variant>") for k in keys), F.array().cast("array<variant>"))


def _strings(items: Column, value=lambda i: F.try_variant_get(i, "$", "string")) -> Column:
    return F.filter(F.transform(items, lambda i: text.normalize_space(value(i))), lambda s: F.coalesce(s, F.lit("")) != "")


def parse_answer(x: Column) -> Column:
    """struct(reason, recovered, confirmed, missing, questions, claims, briefing) of an answer.

    ``reason`` is null where the answer is an object with a known key; else the text is the briefing and the rest is
    empty. ``recovered`` tells that the object is part of a longer text. Values of a wrong kind count as absent; fields
    go by their names and aliases, others are left out; a field that stands twice has its first value by key.
    """
    whole = F.try_parse_json(x)
    inner = F.when(whole.isNull(), F.try_parse_json(first_object(x)))
    return F.get(F.transform(F.array(F.struct(F.coalesce(whole, inner).alias("v"), inner.isNotNull().alias("recovered"), x.alias("x"))), lambda s: _answer(s["v"], s["recovered"], s["x"])), F.lit(0))


def _answer(v: Column, recovered: Column, x: Column) -> Column:
    kind = F.coalesce(F.schema_of_variant(v), F.lit(""))
    known = F.lit(False)
    for key in (*CONFIRMED, *MISSING, *QUESTIONS, *CLAIMS, BRIEFING):
        known = known | F.try_variant_get(v, f"$.{key}", "variant").isNotNull()
    reason = F.when(v.isNull(), NO_JSON).when(~F.startswith(kind, F.lit("OBJECT")), NO_OBJECT).when(~known, NO_KEYS)
    entries = F.map_entries(F.coalesce(*(F.try_variant_get(v, f"$.{k}", "map<string,variant>") for k in CONFIRMED)))
    named = F.transform(entries, lambda e: F.struct(field_name(e["key"]).alias("field"), text.normalize_space(F.try_variant_get(e["value"], "$", "string")).alias("value")))
    held = F.filter(named, lambda e: e["field"].isNotNull() & (F.coalesce(e["value"], F.lit("")) != ""))
    ordered = F.transform(F.array(*map(F.lit, FIELDS)), lambda f: F.get(F.filter(held, lambda e: e["field"] == f), F.lit(0)))
    confirmed = F.coalesce(F.map_from_entries(F.filter(ordered, lambda e: e.isNotNull())), F.create_map().cast("map<string,string>"))
    listed = F.transform(_strings(_list(v, MISSING)), field_name)
    missing = F.filter(F.array(*map(F.lit, FIELDS)), lambda f: F.coalesce(F.array_contains(F.filter(listed, lambda i: i.isNotNull()), f), F.lit(False)))
    asked = _strings(_list(v, QUESTIONS), lambda i: F.coalesce(F.try_variant_get(i, "$.question", "string"), F.try_variant_get(i, "$.text", "string"), F.when(~F.startswith(F.schema_of_variant(i), F.lit("OBJECT")), F.try_variant_get(i, "$", "string"))))
    briefing = text.normalize_space(F.try_variant_get(v, f"$.{BRIEFING}", "string"))
    good = reason.isNull()
    none = F.array().cast("array<string>")
    return F.struct(
        reason.alias("reason"), recovered.alias("recovered"), F.when(good, confirmed).otherwise(F.create_map().cast("map<string,string>")).alias("confirmed"), F.when(good, missing).otherwise(none).alias("missing"),
        F.when(good, asked).otherwise(none).alias("questions"), F.when(good, _strings(_list(v, CLAIMS))).otherwise(none).alias("claims"),
        F.when(good & (F.coalesce(briefing, F.lit("")) != ""), briefing).when(good, F.to_json(v)).otherwise(text.normalize_space(x)).alias("briefing"),
    )
