"""Expression conditions: a boolean SQL expression over flattened attributes.

Policy text is untrusted, so only names, literals, comparisons and the listed
functions get through; every other name becomes an attribute reference.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from warden.functions.attributes import Attribute, expression_value

# Spellings rewritten to SQL, allowed functions and words.
_REWRITES = (
    ("T(java.time.LocalTime).now().getHour()", "currentHour"),
    ("&&", " AND "),
    ("||", " OR "),
    ("#", ""),
)
_FUNCTIONS = frozenset(
    "abs coalesce concat contains endswith greatest if instr least length lower nullif replace "
    "startswith substring trim upper".split()
)
_WORDS = frozenset("AND OR NOT IN IS NULL BETWEEN LIKE TRUE FALSE CASE WHEN THEN ELSE END".split())

_QUOTED = re.compile(r"('(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\")")
_NAME = re.compile(r"(?<![\w.])[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*(\s*\()?")
_PREFIX = "x_"


class RefusedExpression(ValueError):
    """The text uses something policies may not call."""


def to_sql(text: str) -> tuple[str, frozenset[str]]:
    """SQL text over columns ``x_<attribute>`` and the attributes it names."""
    names: set[str] = set()

    def reference(match: re.Match) -> str:
        word, call = match.group(0), match.group(1)
        if call:
            name = word[: -len(call)]
            if name.lower() in _FUNCTIONS or name.upper() in _WORDS:
                return word
            raise RefusedExpression(f"function not allowed: {name}")
        if word.upper() in _WORDS:
            return word
        flat = word.replace(".", "_")
        names.add(flat)
        return f"`{_PREFIX}{flat}`"

    pieces = _QUOTED.split(text)
    for i in range(0, len(pieces), 2):  # odd pieces are quoted literals
        for old, new in _REWRITES:
            pieces[i] = pieces[i].replace(old, new)
        pieces[i] = _NAME.sub(reference, pieces[i])
    return _two_valued("".join(pieces)), frozenset(names)


_TOKEN = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|\w+(?:\.\w+)*|==|!=|<>|<=>|<=|>=|\s+|.", re.S)
_EDGES = frozenset("AND OR NOT WHEN THEN ELSE CASE END , !".split())


def _two_valued(sql: str) -> str:
    """Equality that an absent value takes part in: ``==`` is ``<=>``, ``!=`` and ``<>`` its negation."""
    tokens = _TOKEN.findall(sql)

    def edge(i: int, step: int) -> int:
        """The last place of the operand that begins next to ``i``."""
        depth, last = 0, i
        i += step
        while 0 <= i < len(tokens):
            token = tokens[i]
            if token in "()":
                depth += step if token == "(" else -step
                if depth < 0:
                    break
            if depth == 0 and token.upper() in _EDGES:
                break
            last = i
            i += step
        return last

    before, after = {}, {}
    for i, token in enumerate(tokens):
        if token in ("==", "="):
            tokens[i] = "<=>"
        elif token in ("!=", "<>"):
            left, right = edge(i, -1), edge(i, 1)
            before[left] = before.get(left, "") + " NOT ("
            after[right] = after.get(right, "") + ")"
            tokens[i] = "<=>"
    return "".join(before.get(i, "") + t + after.get(i, "") for i, t in enumerate(tokens))


@contextmanager
def _errors_as_null(spark: SparkSession):
    """Build expressions whose bad casts and divisions give NULL, not a failed job.

    Cast and arithmetic nodes keep the mode they were built with, so the
    setting only needs to hold while the projection is analysed.
    """
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def with_expressions(
    df: DataFrame, expressions: Mapping[str, str], attributes: Mapping[str, Attribute]
) -> DataFrame:
    """Add a boolean column per ``{column: text}``; true only when exactly TRUE."""
    if not expressions:
        return df
    spark = df.sparkSession
    translated = {column: to_sql(text) for column, text in expressions.items()}
    names = sorted(set().union(*(n for _, n in translated.values())))
    keep = df.columns
    with _errors_as_null(spark):
        wide = df.withColumns({f"{_PREFIX}{n}": expression_value(df, n, attributes) for n in names})
        wide = wide.withColumns({c: F.expr(sql) for c, (sql, _) in translated.items()})
    boolean = {c for c in translated if wide.schema[c].dataType.simpleString() == "boolean"}
    return wide.select(
        *keep, *[_exactly_true(c) if c in boolean else F.lit(False).alias(c) for c in translated]
    )


def _exactly_true(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(False)).alias(column)


def usable(spark: SparkSession, texts, sample: DataFrame, attributes) -> dict[str, str | None]:
    """Error message (or None) for each expression, tried on a one-row sample.

    All are tried at once; a group that fails is halved until the bad ones are found.
    """
    texts = list(texts)
    if not texts:
        return {}
    try:
        columns = {f"__x{i}": text for i, text in enumerate(texts)}
        with_expressions(sample, columns, attributes).select(*columns).collect()
        return dict.fromkeys(texts)
    except (RefusedExpression, PySparkException, Py4JJavaError) as error:
        if len(texts) == 1:
            return {texts[0]: str(error)}
        mid = len(texts) // 2
        return usable(spark, texts[:mid], sample, attributes) | usable(spark, texts[mid:], sample, attributes)
