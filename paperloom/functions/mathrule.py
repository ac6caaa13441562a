"""Routing rules: geometry before recognition, content after it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom import schemas as S

# fixed values: what counts as white space and as an operator
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
OPERATORS = r"[=<>+\-×÷*/^√∑∫≤≥≠]"


def tags(width: Column, height: Column, pitch: Column) -> Column:
    """Descriptive tags; they do not change the route."""
    return F.array_compact(F.array(F.when(height < pitch * S.SHORT, "short"), F.when(width > pitch * S.FULL_LINE, "full-line")))


def geometry_route(tall: Column) -> Column:
    return F.when(tall, "diagram").otherwise("text_ocr")


def geometry_reason(tall: Column) -> Column:
    return F.when(tall, "taller than a line").otherwise("line of writing")


def processor(route: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in S.PROCESSORS.items() for x in kv])[route]


def _parts(text: Column) -> tuple[Column, Column, Column]:
    bare = F.regexp_replace(text, SPACE, "")
    n = F.length(bare)
    letters = F.length(F.regexp_replace(bare, r"[^\p{L}]", ""))
    return bare, n, (n - letters) / F.nullif(n, F.lit(0))


def math_word(text: Column) -> Column:
    """First of the fixed words, in their fixed order, that stands in the text as a whole token; null if none."""
    low = F.lower(text)
    found = F.array_intersect(F.array(*[F.lit(w) for w in S.MATH_WORDS]), F.split(low, SPACE + "+"))
    # most lines hold none of the words, so they are not split
    return F.when(low.rlike("|".join(S.MATH_WORDS)), F.get(found, F.lit(0)))


def math_ratio(text: Column) -> Column:
    return _parts(text)[2]


def math_reason(text: Column, least_ratio: float = S.MATH_RATIO) -> Column:
    """empty, word:<w>, no operator, no operand, prose or ratio, in the order in which the tests decide; a null text is empty."""
    text = F.coalesce(text, F.lit(""))
    bare, n, ratio = _parts(text)
    word = math_word(text)
    return (
        F.when(n == 0, "empty")
        .when(word.isNotNull(), F.concat(F.lit("word:"), word))
        .when(~bare.rlike(OPERATORS), "no operator")
        .when(~bare.rlike(r"[\p{L}\p{N}]"), "no operand")
        .when(ratio < least_ratio, "prose")
        .otherwise("ratio")
    )


def is_math(reason: Column) -> Column:
    return reason.startswith("word:") | (reason == "ratio")


def content_route(route: Column, reason: Column) -> Column:
    """A diagram stays one whatever its text; else mathematics wins."""
    return F.when(route == "diagram", route).when(is_math(reason), "math_ocr").otherwise(route)
