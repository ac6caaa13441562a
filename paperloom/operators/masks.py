"""Masks as relations: runs of ink (key, y, x0, x1), half-open, and the operators on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.operators.segmentation import interval_union


def runs(ink: DataFrame, key: str) -> DataFrame:
    """Runs of inked pixels (key, y, x); pixels given twice count once."""
    w = Window.partitionBy(key, "y").orderBy("x")
    marked = ink.select(key, "y", "x").distinct().withColumn("_r", F.col("x") - F.row_number().over(w))
    return marked.groupBy(key, "y", "_r").agg(F.min("x").alias("x0"), (F.max("x") + 1).alias("x1")).drop("_r")


def opened(r: DataFrame, k: int) -> DataFrame:
    return r.filter(F.col("x1") - F.col("x0") >= k)


def closed(r: DataFrame, key: str, k: int) -> DataFrame:
    """Runs of a row joined where the gap is under k; nothing is joined to the border."""
    w = Window.partitionBy(key, "y").orderBy("x0")
    step = r.withColumn("_s", (F.col("x0") - F.lag("x1").over(w) >= k).cast("int")).withColumn("_g", F.sum(F.coalesce("_s", F.lit(0))).over(w))
    return step.groupBy(key, "y", "_g").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_g")


def ink_pixels(r: DataFrame, key: str) -> DataFrame:
    return r.groupBy(key).agg(F.sum(F.col("x1") - F.col("x0")).alias("ink"))


def covered_pixels(r: DataFrame, boxes: DataFrame, key: str) -> DataFrame:
    """Ink inside the union of boxes (key, x1, y1, x2, y2): per row the union of the pieces of runs inside boxes."""
    rows = boxes.select(key, F.explode(F.sequence(F.col("y1"), F.col("y2") - 1)).alias("y"), F.col("x1").alias("b1"), F.col("x2").alias("b2"))
    cut = r.join(rows, [key, "y"]).select(key, "y", F.greatest("x0", "b1").alias("a"), F.least("x1", "b2").alias("b"))
    return interval_union(cut, [key, "y"]).groupBy(key).agg(F.sum("length").alias("covered"))
