"""Joins of boxes on the same page, through bands of the page so that only boxes near each other meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.geometry import ioa, overlap

BAND = 128


def _banded(boxes: DataFrame, prefix: str, key: str) -> DataFrame:
    cols = [F.col(c).alias(f"{prefix}{c}") for c in boxes.columns if c != key]
    top, low = F.floor(F.col("y1") / BAND), F.floor(F.greatest(F.col("y2") - 1, F.col("y1")) / BAND)
    return boxes.filter("x1 is not null and y1 is not null and x2 is not null and y2 is not null").select(key, F.explode(F.sequence(top, low)).alias("_band"), *cols)


def overlapping(a: DataFrame, b: DataFrame, key: str = "page_id", meet: Column | None = None) -> DataFrame:
    """Pairs of boxes of a and b on one page whose intersection has area, columns prefixed a_ and b_, each pair once.

    Boxes meet in the bands of the page they touch; a pair is kept in the
    first band that both touch. A null coordinate meets nothing. `meet`
    restricts which pairs are looked at, over the prefixed columns.
    """
    pairs = _banded(a, "a_", key).join(_banded(b, "b_", key), [key, "_band"])
    first = F.floor(F.greatest("a_y1", "b_y1") / BAND)
    ab, bb = (tuple(F.col(f"{p}{n}") for n in ("x1", "y1", "x2", "y2")) for p in ("a_", "b_"))
    pairs = pairs if meet is None else pairs.filter(meet)
    return pairs.filter((F.col("_band") == first) & (overlap(ab, bb) > 0)).withColumn("ioa", ioa(ab, bb)).drop("_band")


def best_overlap(a: DataFrame, b: DataFrame, a_id: str, b_order: str, carry: list[str], key: str = "page_id") -> DataFrame:
    """Each box of a with the columns of the box of b that covers the greatest share of it; of equals the first in b_order. ioa is 0 and the columns null where nothing meets it."""
    pairs = overlapping(a, b, key)
    top = F.max(F.struct(F.col("ioa"), (-F.col(f"b_{b_order}")).alias("_o"), *[F.col(f"b_{c}").alias(c) for c in carry])).alias("_t")
    best = pairs.groupBy(key, F.col(f"a_{a_id}").alias(a_id)).agg(top).select(key, a_id, "_t.ioa", *[f"_t.{c}" for c in carry])
    clash = [c for c in carry if c in a.columns]
    return a.drop(*clash).join(best, [key, a_id], "left").withColumn("ioa", F.coalesce("ioa", F.lit(0.0)))
