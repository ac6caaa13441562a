"""Cleaned tables shared by queries, the same in SQL, and the registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.common import latest_lines, norm_key, norm_path, table

_LINE_COLS = ["page_id", "student", "cie", "page", "block_id", "line_id", "bbox", "crop", "text", "confidence", "status", "reading_order", "tall", "engine", "simulated"]


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None):
        def register(f):
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return register


def lines(spark, d) -> DataFrame:
    """Latest reading of each line, keys in one spelling."""
    return latest_lines(table(spark, d, "ocr_lines"), *_LINE_COLS).withColumn("page_id", norm_key(F.col("page_id"))).withColumn("crop", norm_path(F.col("crop")))


def regions(spark, d) -> DataFrame:
    """Live manifest rows, the latest delivery of each key."""
    rest = ["loaded_at", "x1", "y1", "x2", "y2", "width", "height", "tall", "crop", "skipped", "student", "cie", "page"]
    live = table(spark, d, "manifest").filter(F.col("removed_at").isNull() & F.col("page_id").isNotNull())
    crop = norm_path(F.col("crop"))
    best = F.max(F.struct(*[crop.alias("crop") if c == "crop" else F.col(c) for c in rest]))
    return live.groupBy(norm_key(F.col("page_id")).alias("page_id"), "block_id", "line_id").agg(best.alias("b")).select("page_id", "block_id", "line_id", "b.*").drop("loaded_at")


def pages(spark, d) -> DataFrame:
    """Live segmentation rows, the latest delivery of each page."""
    rest = ["loaded_at", "rule_pitch", "rules_removed", "ink_pixels", "ink_covered", "student", "cie", "page", "source", "size", "blocks"]
    live = table(spark, d, "segmentation").filter(F.col("removed_at").isNull() & F.col("page_id").isNotNull())
    return live.groupBy(norm_key(F.col("page_id")).alias("page_id")).agg(F.max(F.struct(*rest)).alias("b")).select("page_id", "b.*").drop("loaded_at").withColumn("source", norm_path(F.col("source")))


def page_lines(spark, d) -> DataFrame:
    """Lines of the nested segmentation: (page_id, rule_pitch, block_id, line_id, x1, y1, x2, y2, parts, tall)."""
    per_block = pages(spark, d).select("page_id", "rule_pitch", F.posexplode("blocks").alias("block_id", "b"))
    per_line = per_block.select("page_id", "rule_pitch", "block_id", F.posexplode("b.lines").alias("line_id", "l"))
    return per_line.select("page_id", "rule_pitch", "block_id", "line_id", *[F.get("l.bbox", F.lit(i)).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))], "l.parts", "l.tall")


_PATH = r"regexp_replace(replace(lower(trim({0})), '\', '/'), '^(\./+)+', '')"

LINES = f"""lines AS (SELECT DISTINCT ON (lower(trim(line_uid))) lower(trim(line_uid)) AS line_uid, lower(trim(page_id)) AS page_id, student, cie, page,
  block_id, line_id, bbox, {_PATH.format("crop")} AS crop, text, confidence, status, reading_order, tall, engine, simulated
  FROM ocr_lines WHERE line_uid IS NOT NULL ORDER BY lower(trim(line_uid)), generated_at DESC)"""
REGIONS = f"""regions AS (SELECT DISTINCT ON (lower(trim(page_id)), block_id, line_id) lower(trim(page_id)) AS page_id, block_id, line_id, student, cie, page,
  x1, y1, x2, y2, width, height, tall, {_PATH.format("crop")} AS crop, skipped
  FROM manifest WHERE removed_at IS NULL AND page_id IS NOT NULL
  ORDER BY lower(trim(page_id)), block_id, line_id, loaded_at DESC NULLS LAST, x1 DESC, y1 DESC, x2 DESC, y2 DESC, width DESC, height DESC, tall DESC, {_PATH.format("crop")} DESC NULLS LAST, skipped DESC NULLS LAST)"""
PAGES = f"""pages AS (SELECT DISTINCT ON (lower(trim(page_id))) lower(trim(page_id)) AS page_id, student, cie, page, {_PATH.format("source")} AS source, size,
  rule_pitch, rules_removed, ink_pixels, ink_covered, blocks
  FROM segmentation WHERE removed_at IS NULL AND page_id IS NOT NULL
  ORDER BY lower(trim(page_id)), loaded_at DESC NULLS LAST, rule_pitch DESC NULLS LAST, rules_removed DESC NULLS LAST, ink_pixels DESC NULLS LAST, ink_covered DESC NULLS LAST)"""
PAGE_LINES = (
    PAGES
    + """, pb AS (SELECT page_id, rule_pitch, unnest(range(len(blocks))) AS block_id, unnest(blocks) AS b FROM pages),
pl AS (SELECT page_id, rule_pitch, block_id, unnest(range(len(b.lines))) AS line_id, unnest(b.lines) AS l FROM pb),
page_lines AS (SELECT page_id, rule_pitch, CAST(block_id AS INT) AS block_id, CAST(line_id AS INT) AS line_id, l.bbox[1] AS x1, l.bbox[2] AS y1, l.bbox[3] AS x2, l.bbox[4] AS y2, l.parts AS parts, l.tall AS tall FROM pl)"""
)
