"""Attribute conditions: the thirteen operators and their error rules.

Every operator is a function of two :class:`Operand` values returning a
boolean column, so new operators are added by extending ``OPERATORS``.  A
missing attribute and any error (NULL from a failed conversion, an invalid
pattern, an unknown operator) make the condition unsatisfied.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from warden.functions import patterns
from warden.functions.attributes import Operand

Operator = Callable[[Operand, Operand], Column]


def _equal(actual: Operand, expected: Operand) -> Column:
    # Typed equality: 3 is not "3", and an int is not a long.
    return F.coalesce((actual.kind == expected.kind) & (actual.text == expected.text), F.lit(False))


def _member(actual: Operand, expected: Operand) -> Column:
    value = F.struct(actual.kind.alias("kind"), actual.text.alias("text"))
    return F.coalesce(F.array_contains(expected.items, value), F.lit(False))


def _full_match(actual: Operand, expected: Operand) -> Column:
    valid = F.lit(True) if expected.valid is None else expected.valid
    return valid & F.rlike(actual.text, patterns.whole(expected.text))


OPERATORS: dict[str, Operator] = {
    "EQUALS": _equal,
    "NOT_EQUALS": lambda a, e: ~_equal(a, e),
    "GREATER_THAN": lambda a, e: a.num > e.num,
    "GREATER_THAN_OR_EQUAL": lambda a, e: a.num >= e.num,
    "LESS_THAN": lambda a, e: a.num < e.num,
    "LESS_THAN_OR_EQUAL": lambda a, e: a.num <= e.num,
    "CONTAINS": lambda a, e: F.contains(a.text, e.text),
    "NOT_CONTAINS": lambda a, e: ~F.contains(a.text, e.text),
    "STARTS_WITH": lambda a, e: F.startswith(a.text, e.text),
    "ENDS_WITH": lambda a, e: F.endswith(a.text, e.text),
    "MATCHES": _full_match,
    "IN": _member,
    "NOT_IN": lambda a, e: ~_member(a, e),
}


def satisfied(
    operator: Column | str | None,
    actual: Operand,
    expected: Operand,
    operators: Mapping[str, Operator] = OPERATORS,
) -> Column:
    """Whether a condition holds; never NULL.

    ``operator`` is a name when the condition is known as the plan is built,
    or a column when conditions are data.
    """
    if operator is None or isinstance(operator, str):
        known = operators.get(operator) if operator else None
        result = known(actual, expected) if known else F.lit(False)
        return F.coalesce(actual.kind.isNotNull() & result, F.lit(False))
    chain = F.when(actual.kind.isNull(), F.lit(False))
    for name, function in operators.items():
        chain = chain.when(operator == name, function(actual, expected))
    return F.coalesce(chain.otherwise(F.lit(False)), F.lit(False))


def expected_operand(value, valid: bool = True) -> Operand:
    """A literal expected value (a row of ``kind, text, items`` or None)."""
    if value is None or value["kind"] is None:
        nothing = F.lit(None).cast("string")
        return Operand(nothing, nothing, F.lit(None).cast("double"), _no_items(), F.lit(valid))
    text = F.lit(value["text"])
    if value["items"] is None:
        items = _no_items()
    else:
        items = F.array(
            *[F.struct(F.lit(i["kind"]).alias("kind"), F.lit(i["text"]).alias("text")) for i in value["items"]]
        ).cast("array<struct<kind:string,text:string>>")
    return Operand(F.lit(value["kind"]), text, text.try_cast("double"), items, F.lit(valid))


def _no_items() -> Column:
    return F.lit(None).cast("array<struct<kind:string,text:string>>")


def expected_column(value: Column, valid: Column | None = None) -> Operand:
    """The same for an expected value held in a struct column."""
    return Operand(value["kind"], value["text"], value["text"].try_cast("double"), value["items"], valid)


def from_variant(value: Column) -> Column:
    """``STRUCT<kind, text, items>`` of a JSON value parsed as a variant.

    Text is the value's printed form: lists print as ``[a, b]``.
    """
    items = F.transform(
        F.try_variant_get(value, "$", "array<variant>"),
        lambda v: F.struct(_kind(v).alias("kind"), _text(v, _kind(v)).alias("text")),
    )
    kind = _kind(value)
    listed = F.concat(F.lit("["), F.array_join(items["text"], ", ", "null"), F.lit("]"))
    return F.struct(
        kind.alias("kind"),
        F.when(kind == "list", listed).otherwise(_text(value, kind)).alias("text"),
        F.when(kind == "list", items).alias("items"),
    )


def _kind(value: Column) -> Column:
    shape = F.schema_of_variant(value)
    number = F.try_variant_get(value, "$", "bigint")
    return (
        F.when(shape == "STRING", F.lit("string"))
        .when(shape == "BOOLEAN", F.lit("bool"))
        .when(shape == "BIGINT", F.when(number.between(-(2**31), 2**31 - 1), F.lit("int")).otherwise(F.lit("long")))
        .when(F.startswith(shape, F.lit("DECIMAL")) | shape.isin("DOUBLE", "FLOAT"), F.lit("double"))
        .when(F.startswith(shape, F.lit("ARRAY")), F.lit("list"))
        .when(F.startswith(shape, F.lit("OBJECT")), F.lit("object"))
    )


def _text(value: Column, kind: Column) -> Column:
    return F.when(kind == "double", F.try_variant_get(value, "$", "double").cast("string")).when(
        kind.isNotNull(), F.try_variant_get(value, "$", "string")
    )
