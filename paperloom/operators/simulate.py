"""Simulated recognition over the real contract, in SQL: what a line reads depends on its key alone, not on its place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.identity import uniform

# fixed values: shares of failed and empty lines, width of a character
FAILED_RATE = 0.003
EMPTY_RATE = 0.02
PIXELS_PER_CHAR = 25
# Beta(9, 2) is the ninth of ten sorted uniform draws.
DRAWS, RANK = 10, 9
# Half the confidence is lost at this width, in pixels; wide lines lose little.
HALF_WIDTH = 20

# what simulated lines talk about: the weather
WORDS = "rain clouds drift over low hills while cold wind turns north and pale light falls on wet fields until evening".split()


def hashed_status(uid: Column) -> Column:
    """Status drawn from the key's hash."""
    u = uniform(uid)
    return F.when(u < FAILED_RATE, "failed").when(u < FAILED_RATE + EMPTY_RATE, "empty").otherwise("ok")


def _digits(uid: Column, k: int) -> Column:
    """The k-th number under 65536 of the key's hash, after the eight digits that draw the status."""
    return F.conv(F.substring(F.sha2(uid, 256), 9 + 4 * k, 4), 16, 10).cast("int")


def sentence(uid: Column, chars: Column) -> Column:
    """Whole words up to the number of characters, at least a part of one."""
    a, b, c = (_digits(uid, DRAWS + k) % len(WORDS) for k in range(3))
    words = F.transform(F.sequence(F.lit(0), (chars / 3).cast("int") + 1), lambda i: F.get(F.array(*[F.lit(w) for w in WORDS]), (a * i * i + b * i + c) % len(WORDS)))
    text = F.array_join(words, " ")
    whole = F.regexp_extract(F.substring(F.concat(text, F.lit(" ")), F.lit(1), chars + 1), "^(.*) ", 1)
    return F.when(whole != "", whole).otherwise(F.substring(text, F.lit(1), chars))


def simulate(regions: DataFrame) -> DataFrame:
    """(line_uid, status, text, confidence, simulated) of regions (line_uid, tall, width).

    Tall lines are diagrams. Null tall counts as flat, a null width as 0; a
    null line_uid is left out; a repeated region is repeated; an empty table
    gives no rows.
    """
    rows = regions.filter(F.col("line_uid").isNotNull()).select("line_uid", F.coalesce("tall", F.lit(False)).alias("tall"), F.greatest(F.coalesce("width", F.lit(0)), F.lit(0)).alias("width"))
    uid = F.col("line_uid")
    status = F.when(F.col("tall"), "diagram").otherwise(hashed_status(uid))
    draws = F.array_sort(F.array(*[_digits(uid, k) for k in range(DRAWS)]))
    chars = F.greatest(F.lit(1), (F.col("width") / PIXELS_PER_CHAR).cast("int"))
    sure = F.get(draws, F.lit(RANK - 1)) / 65536.0 * (1 - HALF_WIDTH / (2.0 * F.greatest(F.col("width"), F.lit(HALF_WIDTH))))
    confidence = F.when(F.col("status") == "ok", F.round(sure, 3)).when(F.col("status") == "empty", F.round(F.get(draws, F.lit(0)) / 65536.0, 3)).otherwise(0.0)
    text = F.when(F.col("status") == "ok", sentence(uid, chars)).otherwise("")
    return rows.withColumn("status", status).select("line_uid", "status", text.alias("text"), confidence.alias("confidence"), F.lit(True).alias("simulated"))
