"""Wildcard patterns of policy targets.

``*`` matches everything; a pattern holding ``*`` is a regular expression in
which each ``*`` means ``.*`` and which must cover the whole value; any other
pattern is compared literally.  Patterns are classified once, when policies are
loaded, so that most matches become equality or prefix tests.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column
from pyspark.sql import functions as F

ANY, LITERAL, PREFIX, REGEX = "any", "literal", "prefix", "regex"

# Characters with a meaning in Java regular expressions (besides the star).
_META = r"\\^$.|?+()\[\]{}"
_PLAIN_PREFIX = rf"\A[^{_META}*\n\r\u0085\u2028\u2029]*\*+\z"
_LINE_BREAK = "[\\n\\r\\u0085\\u2028\\u2029]"


def whole(pattern: Column) -> Column:
    """A regular expression that must cover the whole value."""
    return F.concat(F.lit(r"\A(?:"), pattern, F.lit(r")\z"))


def wildcard_regex(pattern: Column) -> Column:
    return F.replace(pattern, F.lit("*"), F.lit(".*"))


def classify(pattern: Column) -> Column:
    """``STRUCT<kind, text, lead, regex>`` for one target pattern.

    ``lead`` is the literal text every match starts with.  It guards the regex
    (a failed prefix test is far cheaper) and routes policies to the paths they
    can match.
    """
    head = F.regexp_extract(pattern, rf"\A[^{_META}*]*", 0)
    after = F.substring(pattern, F.length(head) + 1, F.lit(1))
    lead = (
        F.when(F.contains(pattern, F.lit("|")), F.lit(""))
        .when(
            after.isin("?", "+", "{"),
            F.substring(head, F.lit(1), F.greatest(F.length(head) - 1, F.lit(0))),
        )
        .otherwise(head)
    )
    kind = (
        F.when(pattern == "*", F.lit(ANY))
        .when(~F.contains(pattern, F.lit("*")), F.lit(LITERAL))
        .when(pattern.rlike(_PLAIN_PREFIX), F.lit(PREFIX))
        .otherwise(F.lit(REGEX))
    )
    return F.struct(
        kind.alias("kind"),
        F.when(kind == PREFIX, head).otherwise(pattern).alias("text"),
        F.when(kind == ANY, F.lit("")).when(kind == LITERAL, pattern).otherwise(lead).alias("lead"),
        F.when(kind == REGEX, whole(wildcard_regex(pattern))).alias("regex"),
    )


# A pattern without any of these holds stars, dots and plain text alone: it always compiles.
NOT_PLAIN = r"[\\^$|?+()\[\]{}]"

# Grams: windows of a value in which one character, or none, is left open.  Form 0 keeps all characters, form n leaves
# the n-th open.  A pattern of stars, dots and plain text matches only values that hold each of its grams.
GRAM = 4
_GRAM_FORMS = range(GRAM + 1)


def _windows(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{GRAM}}}))"), F.lit(1))  # overlapping, in one pass


def pattern_grams(pattern: Column) -> Column:
    """Grams (form digit and window) that every value matching the pattern holds; empty where none is sure.

    Each star may stand for anything and each dot for one character, so a window lies between stars and holds a dot at most.
    """
    pieces = F.split(pattern, r"\*")
    windows = F.flatten(F.transform(pieces, _windows))
    marked = F.transform(windows, lambda w: F.concat(F.instr(w, ".").cast("string"), w))
    clear = F.filter(marked, lambda g: F.length(F.replace(g, F.lit("."), F.lit(""))) >= GRAM)
    return F.when(pattern.rlike(NOT_PLAIN), F.array().cast("array<string>")).otherwise(F.array_distinct(clear))


# Words: longest runs of letters and digits.  A pattern holds one for sure where its ends are plain text on both sides,
# or ends of the pattern; then every value that matches has it as a word too.  They stand beside the grams, marked so.
WORD = "w"


def value_words(value: Column) -> Column:
    """Marked words of a value."""
    found = F.regexp_extract_all(value, F.lit("([A-Za-z0-9]+)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda w: F.concat(F.lit(WORD), w)))


def pattern_words(pattern: Column) -> Column:
    """Marked words that every value matching the pattern has; empty where none is sure."""
    found = F.regexp_extract_all(pattern, F.lit(r"(?<![A-Za-z0-9.*])([A-Za-z0-9]+)(?![A-Za-z0-9.*])"), F.lit(1))
    marked = F.array_distinct(F.transform(found, lambda w: F.concat(F.lit(WORD), w)))
    return F.when(pattern.rlike(NOT_PLAIN), F.array().cast("array<string>")).otherwise(marked)


def value_grams(value: Column, forms=_GRAM_FORMS) -> Column:
    """Grams of a value in the given forms."""

    def variants(w: Column) -> Column:
        return F.array(*[
            F.concat(F.lit(str(n)), w) if n == 0 else F.concat(F.lit(str(n)), F.overlay(w, F.lit("."), n, 1)) for n in forms
        ])

    return F.array_distinct(F.flatten(F.transform(_windows(value), variants)))


def single_line(value: Column) -> Column:
    """Whether ``.*`` can run to the end of the value (it stops at line breaks)."""
    return ~value.rlike(_LINE_BREAK)


def matches(value: Column, plain: Column, pattern: Column) -> Column:
    """Match against a classified pattern held in a struct column.

    ``plain`` is :func:`single_line` of the value, computed once per value.
    The caller drops patterns that do not compile.
    """
    return (
        F.when(pattern["kind"] == ANY, F.lit(True))
        .when(pattern["kind"] == LITERAL, value == pattern["text"])
        .when(pattern["kind"] == PREFIX, F.startswith(value, pattern["text"]) & plain)
        .otherwise(F.startswith(value, pattern["lead"]) & F.rlike(value, pattern["regex"]))
    )


def matches_literal(value: Column, plain: Column, pattern) -> Column:
    """The same for a pattern known when the plan is built (compiled once)."""
    if pattern["kind"] == ANY:
        return F.lit(True)
    if pattern["kind"] == LITERAL:
        return value == F.lit(pattern["text"])
    if pattern["kind"] == PREFIX:
        return F.startswith(value, F.lit(pattern["text"])) & plain
    regex = F.rlike(value, F.lit(pattern["regex"]))
    return F.startswith(value, F.lit(pattern["lead"])) & regex if pattern["lead"] else regex


def wildcard_match(value: Column, pattern: Column) -> Column:
    """Wildcard match of two columns (pattern must be a valid expression)."""
    return matches(value, single_line(value), classify(pattern))


def compilable(spark, patterns) -> dict[str, bool]:
    """Which regular expressions Java accepts.

    Constant folding tries each one while the plan is optimised, so no job
    runs; a chunk that fails is halved until the bad ones are found.
    """
    patterns = sorted(set(patterns))
    if not patterns:
        return {}
    probe = spark.createDataFrame([("",)], "v string")

    def check(chunk) -> dict[str, bool]:
        try:
            probe.select(*[F.col("v").rlike(p).alias(f"p{i}") for i, p in enumerate(chunk)]).collect()
            return dict.fromkeys(chunk, True)
        except (PySparkException, Py4JJavaError) as error:
            if "INVALID_PARAMETER_VALUE.PATTERN" not in str(error) and "PatternSyntaxException" not in str(error):
                raise  # no word about the pattern: a lost executor, say
            if len(chunk) == 1:
                return {chunk[0]: False}
            mid = len(chunk) // 2
            return {**check(chunk[:mid]), **check(chunk[mid:])}

    result: dict[str, bool] = {}
    for start in range(0, len(patterns), 100):
        result.update(check(patterns[start : start + 100]))
    return result
