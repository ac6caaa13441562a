"""Routing of regions before and after recognition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom import schemas as S
from paperloom.common import spread
from paperloom.functions import mathrule as M
from paperloom.functions.identity import line_uid


def with_pitch(regions: DataFrame, pages: DataFrame, default: float = S.DEFAULT_PITCH) -> DataFrame:
    """Adds the page's rule_pitch, the default where the page or its pitch is missing. Both sides are keyed by page, so the shuffle serves the reading order too."""
    return regions.join(pages.select("page_id", F.col("rule_pitch").alias("_p")), "page_id", "left").withColumn("rule_pitch", F.coalesce("_p", F.lit(default))).drop("_p")


def reading_order(regions: DataFrame) -> DataFrame:
    """0-based place within the page from top to bottom, then left to right; ties by block and line."""
    w = Window.partitionBy("page_id").orderBy("y1", "x1", "block_id", "line_id")
    return regions.withColumn("reading_order", (F.row_number().over(w) - 1).cast("int"))


def route_regions(regions: DataFrame, pages: DataFrame) -> DataFrame:
    """Regions with a crop, each with line_uid, pitch, reading order, route, reason, tags and processor.

    rule_pitch and page_id are carried on, as later stages need them.
    """
    found = reading_order(with_pitch(regions.filter(F.col("crop").isNotNull()), pages))
    width, height = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return (
        found.withColumn("line_uid", line_uid(F.col("page_id"), F.col("block_id"), F.col("line_id")))
        .withColumn("route", M.geometry_route(F.col("tall")))
        .withColumn("reason", M.geometry_reason(F.col("tall")))
        .withColumn("tags", M.tags(width, height, F.col("rule_pitch")))
        .withColumn("processor", M.processor(F.col("route")))
    )


def spoken(lines: DataFrame) -> DataFrame:
    """(line_uid, text) of lines read well and not empty."""
    return lines.filter((F.col("status") == "ok") & (F.col("text") != "")).select("line_uid", "text")


def reroute(routed: DataFrame, text: DataFrame, least_ratio: float = S.MATH_RATIO) -> DataFrame:
    """Adds text, why and new_route: mathematics is told from the recognised text, diagrams are left alone."""
    why = M.math_reason(F.col("text"), least_ratio)
    return routed.join(text, "line_uid", "left").withColumn("why", why).withColumn("new_route", M.content_route(F.col("route"), F.col("why")))


def route_documents(docs: DataFrame) -> DataFrame:
    """Lines of documents by route and deciding test."""
    rows = spread(docs.select("text")).select(F.explode(F.split("text", "\n")).alias("line")).select(M.math_reason(F.col("line")).alias("why"))
    route = F.when(M.is_math(F.col("why")), "math_ocr").otherwise("text_ocr")
    return rows.groupBy(route.alias("route"), "why").agg(F.count(F.lit(1)).alias("n"))


def select_processor(routed: DataFrame, processor: str) -> tuple[DataFrame, DataFrame]:
    """(regions for the processor, counts of all by processor): nothing is dropped without being counted."""
    named = routed.withColumn("processor", M.processor(F.col("new_route")))
    counts = named.groupBy(F.coalesce("processor", F.lit("unassigned")).alias("processor"), (F.col("processor") == processor).alias("taken")).agg(F.count(F.lit(1)).alias("n"))
    return named.filter(F.col("processor") == processor), counts


def wire(routed: DataFrame, simulated: bool = True) -> DataFrame:
    """Nested form of routed regions for exchange; the simulated flag and pitch travel along."""
    return routed.select(
        "line_uid", "page_id", "student", "cie", F.struct("x1", "y1", "x2", "y2").alias("bbox"), F.col("crop").alias("crop_path"), "processor", "reading_order",
        (F.col("route") == "review").alias("ignored"), F.struct("route", "reason", "tags", "rule_pitch", F.lit(simulated).alias("simulated")).alias("metadata"),
    )
