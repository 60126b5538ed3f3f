"""Strict reading of JSON replies: one object, known keys, right kinds of value."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


def lone_object(text: Column) -> Column:
    """The text where it is one JSON object and nothing else, NULL otherwise."""
    # with a value behind it the array has one more element than without, unless
    # the text itself ends the array: then both stop there and have the same length
    two = F.json_array_length(F.concat(F.lit("["), text, F.lit(", 0]"))) == 2
    one = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    return F.when(two & one & F.json_object_keys(text).isNotNull(), text)


def lax_number(text: Column) -> Column:
    """A number as JSON text, a number written as a string, or a truth value."""
    word = F.lower(F.trim(text))
    return F.when(word == "true", F.lit(1.0)).when(word == "false", F.lit(0.0)).otherwise(
        F.when(word.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$"), word.try_cast("double")))


def lax_whole(text: Column) -> Column:
    """The same where it is whole: 7, 7.0, "7" and true; NULL otherwise."""
    number = lax_number(text)
    return F.when((number == F.floor(number)) & (F.abs(number) < 2**31), number.cast("int"))


# --- the shape of a document --------------------------------------------------------

@dataclass(frozen=True)
class Shape:
    """What a value has to be: text, whole, an object of fields, or a list of items.
    One that may be null may also be left out; an optional one only that."""

    kind: str
    fields: dict[str, Shape] = field(default_factory=dict)
    items: Shape | None = None
    nullable: bool = False
    optional: bool = False


def text_value(nullable: bool = False) -> Shape:
    return Shape("text", nullable=nullable)


def whole_value(nullable: bool = False) -> Shape:
    return Shape("whole", nullable=nullable)


def object_of(nullable: bool = False, **fields: Shape) -> Shape:
    return Shape("object", fields, nullable=nullable)


def list_of(items: Shape, optional: bool = False) -> Shape:
    return Shape("list", items=items, optional=optional)


_NONE = "CAST(array() AS ARRAY<STRING>)"
_NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)(e[+-]?[0-9]+)?$"


def _problems(found: str, shape: Shape, path: str, depth: int) -> str:
    """SQL for the problems of a variant; NULL stands for a key that is not there.
    The variant is bound to a name, so it is taken out of its text once, not once a use."""
    v, name = f"v{depth}", path or "$"
    wrong = f"array('wrong_kind:{name}')"
    kind = f"schema_of_variant({v})"
    if shape.kind == "text":
        inner = f"if({kind} = 'STRING', {_NONE}, {wrong})"
    elif shape.kind == "whole":
        number = f"try_cast(w{depth} AS DOUBLE)"
        plain = f"w{depth} IN ('true', 'false') OR coalesce(w{depth} RLIKE '{_NUMBER}' AND {number} = floor({number}) AND abs({number}) < 2147483648, false)"
        word = f"if({kind} RLIKE '^(ARRAY|OBJECT)', '', lower(trim(try_variant_get({v}, '$', 'string'))))"
        inner = f"if(exists(array({word}), w{depth} -> {plain}), {_NONE}, {wrong})"
    elif shape.kind == "list":
        each = _problems(f"x{depth}", shape.items, f"{path}[]", depth + 1)
        inner = f"if(startswith({kind}, 'ARRAY'), flatten(transform(try_variant_get({v}, '$', 'array<variant>'), x{depth} -> {each})), {wrong})"
    else:
        parts = [_problems(f"try_variant_get({v}, '$.{key}', 'variant')", part, f"{path}.{key}".lstrip("."), depth + 1) for key, part in shape.fields.items()]
        prefix = f"extra_key:{path}." if path else "extra_key:"
        known = ", ".join(f"'{k}'" for k in shape.fields)
        extra = f"transform(array_except(json_object_keys(to_json({v})), array({known})), k{depth} -> '{prefix}' || k{depth})"
        inner = f"if(startswith({kind}, 'OBJECT'), concat({', '.join([extra, *parts])}), {wrong})"
    missing = _NONE if shape.nullable or shape.optional else f"array('missing_key:{name}')"
    null = _NONE if shape.nullable else wrong
    tests = f"CASE WHEN {v} IS NULL THEN {missing} WHEN is_variant_null({v}) THEN {null} ELSE {inner} END"
    return f"get(transform(array({found}), {v} -> {tests}), 0)"


def shape_problems(text: str, shape: Shape) -> Column:
    """Where the JSON text in a column departs from a shape, at any depth:
    ``extra_key:path``, ``missing_key:path`` and ``wrong_kind:path``, once each, in text
    order. A list is walked in the row, so nothing is exploded or shuffled."""
    return F.expr(f"array_sort(array_distinct({_problems(f'try_parse_json(`{text}`)', shape, '', 0)}))")
