"""Recognised lines as a stream: the same rules, over arriving files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from paperloom.common import norm_key
from paperloom.functions import mathrule as M


def read_lines(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def first_deliveries(lines: DataFrame, late: str = "1 hour") -> DataFrame:
    """One delivery of each reading; copies that come within the watermark are dropped, state older than it is let go."""
    keyed = lines.withColumn("line_uid", norm_key(F.col("line_uid"))).withColumn("at", F.col("generated_at").cast("timestamp"))
    return keyed.withWatermark("at", late).dropDuplicatesWithinWatermark(["line_uid", "generated_at"])


def route_counts(lines: DataFrame, late: str = "1 hour", window: str = "1 day", timed: bool = False) -> DataFrame:
    """Lines by day of reading and route told from their text; a window is final once the watermark has passed it. timed: `at` and its watermark are there, as after first_deliveries."""
    why = M.math_reason(F.col("text"))
    marked = lines if timed else lines.withColumn("at", F.col("generated_at").cast("timestamp")).withWatermark("at", late)
    route = F.when(M.is_math(why), "math_ocr").otherwise("text_ocr").alias("route")
    return marked.groupBy(F.window("at", window).alias("w"), route).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("day"), "route", "n")
