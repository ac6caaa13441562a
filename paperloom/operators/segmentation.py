"""Relational layer of segmentation: components, lines, blocks, rules, spans, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom import schemas as S
from paperloom.functions.geometry import union_box


def is_tall(y1: Column, y2: Column, pitch: Column) -> Column:
    return (y2 - y1) > pitch * S.TALL


def skip_reason(width: Column, height: Column, pitch: Column) -> Column:
    """Why a region is too small to be cropped; null for one that is not. The row is kept."""
    return F.when(height < pitch * S.MIN_HEIGHT, "too low").when(width < pitch * S.MIN_WIDTH, "too narrow")


def nearest_rule(items: DataFrame, rules: DataFrame, keys: list[str], item_id: list[str], value: str = "bottom", rule: str = "rule_y", cell: int = 64) -> DataFrame:
    """Nearest rule of each item on the same page; of two as near the upper one; null on a page without rules.

    As-of in both directions over the sorted union of items and rules: the
    last rule at or before the item and the first after it. Time and memory
    are linear in the page, no pairs are formed.
    """
    w = Window.partitionBy(*keys).orderBy(F.col("_v"), F.col("_rule").desc())
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    ahead = w.rowsBetween(0, Window.unboundedFollowing)
    both = items.withColumn("_v", F.col(value).cast("double")).withColumn("_rule", F.lit(False)).unionByName(
        rules.select(*keys, F.col(rule).cast("double").alias("_v"), F.lit(True).alias("_rule")), allowMissingColumns=True
    )
    r = F.when(F.col("_rule"), F.col("_v"))
    found = both.withColumn("_up", F.last(r, ignorenulls=True).over(back)).withColumn("_down", F.first(r, ignorenulls=True).over(ahead)).filter(~F.col("_rule"))
    nearest = F.when(F.col("_down").isNull() | (F.col("_v") - F.col("_up") <= F.col("_down") - F.col("_v")), F.col("_up")).otherwise(F.col("_down"))
    return found.withColumn(rule, F.coalesce(nearest, "_down")).drop("_v", "_rule", "_up", "_down")


def islands(df: DataFrame, keys: list[str], order: list[str], starts: Column, name: str) -> DataFrame:
    """0-based number of the island each row is in; `starts` says that a row begins a new one (null: goes on)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_s", F.coalesce(starts.cast("int"), F.lit(0))).withColumn(name, F.sum("_s").over(w).cast("int")).drop("_s")


def group_blocks(lines: DataFrame, keys: list[str], order: list[str], pitch: Column, gap: float = S.TALL) -> DataFrame:
    """Blocks of lines: a new one begins where the gap to the previous line's bottom (that line's, not the lowest so far) is over 1.6 pitches."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return islands(lines.withColumn("_g", F.col("y1") - F.lag("y2").over(w)), keys, order, F.col("_g") > pitch * gap, "block").drop("_g")


def block_boxes(lines: DataFrame, keys: list[str]) -> DataFrame:
    return lines.groupBy(*keys, "block").agg(*union_box(), F.count(F.lit(1)).cast("int").alias("n_lines"))


def cluster_1d(df: DataFrame, keys: list[str], value: str, gap: float, *tie: str) -> DataFrame:
    """Clusters of values, a new one where the step from the last member is `gap` or more."""
    w = Window.partitionBy(*keys).orderBy(value, *tie)
    return islands(df.withColumn("_d", F.col(value) - F.lag(value).over(w)), keys, [value, *tie], F.col("_d") >= gap, "cluster").drop("_d")


def cluster_means(clustered: DataFrame, keys: list[str], value: str, most_span: float) -> DataFrame:
    """Mean of each cluster that spans at most `most_span`."""
    return clustered.groupBy(*keys, "cluster").agg(F.avg(value).alias("mean"), (F.max(value) - F.min(value)).alias("span"), F.count(F.lit(1)).cast("int").alias("n")).filter(F.col("span") <= most_span)


def median_pitch(rows: DataFrame, keys: list[str], value: str, low: float, high: float) -> DataFrame:
    """Median step between successive values, of the steps that a rule pitch can have."""
    w = Window.partitionBy(*keys).orderBy(value)
    steps = rows.withColumn("_d", F.col(value) - F.lag(value).over(w)).filter(F.col("_d").between(low, high))
    return steps.groupBy(*keys).agg(F.percentile("_d", 0.5).alias("pitch"), F.count(F.lit(1)).cast("int").alias("n_steps"))


def interval_union(df: DataFrame, keys: list[str], start: str = "a", end: str = "b") -> DataFrame:
    """Total length of the union of half-open intervals per key; overlaps count once, empty intervals nothing."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    seen = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.col(end) - F.greatest(F.col(start), F.coalesce(seen, F.col(start))), F.lit(0))
    return df.filter(F.col(end) > F.col(start)).withColumn("_l", fresh).groupBy(*keys).agg(F.sum("_l").alias("length"))


def ink_coverage(ink: Column, covered: Column, blank: Column | None = None) -> Column:
    """Share of ink inside some region; a page without ink has null, or the option given."""
    return F.when(ink > 0, covered / ink).otherwise(blank if blank is not None else F.lit(None).cast("double"))
