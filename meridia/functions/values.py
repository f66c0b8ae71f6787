"""Loosely typed JSON values as columns: presence, kind, printed text and number.

Rules compare values of unknown type.  Two values are equal if both read as
numbers and these are equal, or else if their printed texts are equal.  Ordering
is numeric only.  A missing value makes every comparison false; a JSON null is
present and prints as ``<nil>``.

Known limits: maps and nested lists print as JSON; hexadecimal number texts count
as text; of duplicate keys, the parser rejects the document; a number of 16 digits may
print with a seventeenth.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import let

#: Decimal numbers with optional exponent, and the named ones; no blanks or suffixes.
NUMBER = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity|nan))$"
NIL = "<nil>"


def parse_number(text: Column) -> Column:
    """The number that a text reads as, or null."""
    low = F.lower(text)
    named = (
        F.when(low.rlike(r"^\+?inf(inity)?$"), F.lit(float("inf")))
        .when(low.rlike(r"^-inf(inity)?$"), F.lit(float("-inf")))
        .when(low.rlike(r"^[+-]?nan$"), F.lit(float("nan")))
    )
    return F.when(text.rlike(NUMBER), F.coalesce(named, text.try_cast("double")))


def print_number(x: Column) -> Column:
    """Shortest text of a double: with an exponent of at least two digits below 1e-4 and from 1e6 on."""
    size = F.abs(x)
    # The JVM's own text is not always the shortest: fewer digits do if they read as the same number.
    tries = F.array(*(F.format_string(f"%.{n}e", size) for n in (14, 15, 16)))

    def parts(t: Column) -> Column:
        made = F.when(t[0].cast("double") == size, t[0]).when(t[1].cast("double") == size, t[1]).otherwise(t[2])
        return let(made, lambda m: F.struct(digits_of(m).alias("digits"), F.substring_index(m, "e", -1).cast("int").alias("power")))

    def digits_of(m: Column) -> Column:
        return F.rtrim(F.replace(F.substring_index(m, "e", 1), F.lit("."), F.lit("")), F.lit("0"))

    def laid_out(p: Column) -> Column:
        digits, power = p["digits"], p["power"]
        width = F.abs(power).cast("string")
        long = F.concat(F.when(power < 0, "e-").otherwise("e+"), F.when(F.length(width) < 2, "0").otherwise(""), width)
        return (
            F.when((power < -4) | (power >= 6), F.concat(F.left(digits, F.lit(1)), _tail(digits, F.lit(2)), long))
            .when(power < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits))
            .otherwise(F.concat(F.rpad(F.left(digits, power + 1), power + 1, F.lit("0")), _tail(digits, power + 2)))
        )

    text = (
        F.when(F.isnan(x), "NaN")
        .when(size == float("inf"), F.when(x > 0, "+Inf").otherwise("Inf"))
        .when(x == 0, "0")
        .otherwise(let(let(tries, parts), laid_out))
    )
    return F.concat(F.when(F.startswith(x.cast("string"), F.lit("-")), "-").otherwise(""), text)


def _tail(digits: Column, start: Column) -> Column:
    """The digits from ``start`` on after a point, if there are any."""
    return F.when(F.length(digits) >= start, F.concat(F.lit("."), F.substr(digits, start))).otherwise("")


def _number_text(x: float) -> str:
    """The same for a rule's own number."""
    if not math.isfinite(x):
        return {math.inf: "+Inf", -math.inf: "-Inf"}.get(x, "NaN")
    sign, digits, shift = Decimal(repr(x)).normalize().as_tuple()
    power = len(digits) - 1 + shift
    if x == 0 or -4 <= power < 6:
        return f"{Decimal(repr(x)).normalize():f}"
    rest = "".join(map(str, digits[1:]))
    return f"{'-' * sign}{digits[0]}{'.' + rest if rest else ''}e{power:+03d}"


def literal_text(value: Any) -> str:
    """How a rule's own value prints."""
    if value is None:
        return NIL
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return _number_text(float(value))
    if isinstance(value, list):
        return "[" + " ".join(map(literal_text, value)) + "]"
    if isinstance(value, dict):
        return "map[" + " ".join(f"{k}:{literal_text(v)}" for k, v in sorted(value.items())) + "]"
    return str(value)


def literal_number(value: Any) -> float | None:
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, (int, float)):
        return float(value)
    if isinstance(value, str):
        import re

        return float(value) if re.match(NUMBER, value) else None
    return None


@dataclass
class Value:
    """Columns that describe one value of a row."""

    present: Column
    text: Column
    number: Column
    items: Column | None = None  # array of (text, number) where the value is a list

    def equals(self, other: Any) -> Column:
        return _same(self.text, self.number, other)

    def contains(self, other: Any) -> Column:
        inside = F.contains(self.text, F.lit(literal_text(other)))
        if self.items is None:
            return inside
        member = F.exists(self.items, lambda x: F.coalesce(_same(x["text"], x["number"], other), F.lit(False)))
        return F.when(self.items.isNotNull(), member).otherwise(inside)

    def compare(self, op: str, other: Any) -> Column:
        bound = literal_number(other)
        if bound is None or math.isnan(bound):
            return F.lit(False)
        x = self.number
        test = {"gt": x > bound, "gte": x >= bound, "lt": x < bound, "lte": x <= bound}[op]
        return test & ~F.isnan(x)


def _same(text: Column, number: Column, other: Any) -> Column:
    as_text = text == F.lit(literal_text(other))
    bound = literal_number(other)
    if bound is None:
        return as_text
    equal = F.lit(False) if math.isnan(bound) else (number == F.lit(bound)) & ~F.isnan(number)
    return F.when(number.isNotNull(), equal).otherwise(as_text)


def absent() -> Value:
    nothing = F.lit(None)
    return Value(F.lit(False), nothing.cast("string"), nothing.cast("double"))


def plain(text: Column) -> Value:
    """A text column; the empty text counts as missing."""
    text = F.nullif(text, F.lit(""))
    return Value(text.isNotNull(), text, parse_number(text))


def json_path(parts: list[str]) -> str:
    """A path over object keys; quotes in a key can't be written in a path and never match."""
    return "$" + "".join("['" + p.replace("'", "\x00") + "']" for p in parts)


def json_kind(variant: Column) -> Column:
    """object, array, string, number, bool or null; SQL null where there is no value."""
    shape = F.schema_of_variant(variant)
    return (
        F.when(shape.isNull(), None)
        .when(shape == "VOID", "null")
        .when(shape == "STRING", "string")
        .when(shape == "BOOLEAN", "bool")
        .when(F.startswith(shape, F.lit("ARRAY")), "array")
        .when(F.startswith(shape, F.lit("OBJECT")), "object")
        .otherwise("number")
    )


def _described(variant: Column) -> tuple[Column, Column]:
    """(text, number) of a scalar variant."""
    kind = json_kind(variant)
    string = F.try_variant_get(variant, "$", "string")
    double = F.try_variant_get(variant, "$", "double")
    text = F.when(kind == "null", NIL).when(kind == "number", print_number(double)).otherwise(string)
    number = F.when(kind == "number", double).when(kind == "string", parse_number(string))
    return text, number


def json_value(document: Column, parts: list[str]) -> Value:
    """The value at a key path of a parsed document (variant column)."""
    variant = F.try_variant_get(document, json_path(parts), "variant") if parts else document
    kind = json_kind(variant)
    text, number = _described(variant)
    raw = F.try_variant_get(variant, "$", "array<variant>")

    def described(x: Column) -> Column:
        t, n = _described(x)
        return F.struct(t.alias("text"), n.alias("number"))

    items = F.when(kind == "array", F.transform(raw, described))
    listed = F.concat(F.lit("["), F.array_join(F.transform(items, lambda x: x["text"]), " "), F.lit("]"))
    text = F.when(kind == "array", listed).when(kind == "object", F.to_json(variant)).otherwise(text)
    return Value(kind.isNotNull(), text, number, items)


def parsed(text: Column) -> Column:
    """A JSON text as variant; what isn't JSON counts as an empty object."""
    return F.coalesce(F.try_parse_json(text), F.parse_json(F.lit("{}")))


def json_number(document: Column, key: str) -> Column:
    """The JSON number under a literal top-level key, or null for any other type."""
    variant = F.try_variant_get(document, json_path([key]), "variant")
    return F.when(json_kind(variant) == "number", F.try_variant_get(variant, "$", "double"))
