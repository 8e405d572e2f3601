"""Questions as arrays of (field, question). Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import text, values

ANY_FIELD = "type_specific"


def normalized(raw: Column) -> Column:
    """A JSON list of questions, each a string or an object, without empty ones; anything else gives none."""

    def one(item: Column) -> Column:
        is_object = F.startswith(item, F.lit("{"))
        field = F.when(is_object, text.normalize_space(F.get_json_object(item, "$.field"))).otherwise("")
        asked = F.when(is_object, F.get_json_object(item, "$.question")).otherwise(item)
        return F.struct(F.when(field == "", ANY_FIELD).otherwise(field).alias("field"), text.normalize_space(asked).alias("question"))

    return F.filter(F.transform(values.json_list(raw), one), lambda q: q["question"] != "")


def merged(first: Column, second: Column, missing: Column, templates: dict[str, str]) -> Column:
    """Both lists without questions of equal tokens, then the template of each missing field that none of them covers."""
    key = lambda q: F.array_join(text.tokens(q["question"]), " ")

    def unique(asked: Column) -> Column:
        return text.let(F.transform(asked, key), lambda keys: F.filter(asked, lambda q, i: F.array_position(keys, F.get(keys, i)) == i + 1))

    table = F.create_map(*(F.lit(x) for pair in templates.items() for x in pair))
    tidy = F.transform(F.concat(first, second), lambda q: F.struct(F.coalesce(F.nullif(text.normalize_space(q["field"]), F.lit("")), F.lit(ANY_FIELD)).alias("field"), text.normalize_space(q["question"]).alias("question")))

    def filled_up(asked: Column) -> Column:
        open_fields = F.array_except(F.filter(missing, lambda f: F.map_contains_key(table, f)), F.transform(asked, lambda q: q["field"]))
        return unique(F.concat(asked, F.transform(open_fields, lambda f: F.struct(f.alias("field"), F.try_element_at(table, f).alias("question")))))

    return text.let(unique(F.filter(tidy, lambda q: q["question"] != "")), filled_up)
