"""Readers of corpus trees, manifests, page records, labels and keyed maps; every schema is given, none inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom import schemas as S
from paperloom.common import norm_path
from paperloom.functions.identity import page_id, path_part

PAGE_PATH = r"student_(\d+)/cie_(\d+)/page_(\d+)\.png$"


def path_keys(path: Column) -> list[Column]:
    p = norm_path(path)
    nums = [path_part(p, PAGE_PATH, k) for k in (1, 2, 3)]
    return [*[n.alias(c) for n, c in zip(nums, ("student", "cie", "page"), strict=True)], page_id(*nums).alias("page_id")]


def corpus(spark: SparkSession, root: str, covers: bool = True) -> DataFrame:
    """(path, length, modified, student, cie, page, page_id, page_kind) of a tree student_*/cie_*/page_*.png.

    File contents are not read: the listing's columns alone are kept.
    """
    files = spark.read.format("binaryFile").load(f"{root}/student_*/cie_*/page_*.png").select("path", "length", F.col("modificationTime").alias("modified"))
    keyed = files.select("*", *path_keys(F.col("path"))).withColumn("page_kind", F.when(F.col("page") == 1, "cover").otherwise("content"))
    return keyed if covers else keyed.filter("page_kind = 'content'")


def images(spark: SparkSession, root: str, covers: bool = True) -> DataFrame:
    """Decoded grey pages (path, keys, height, width, channels, data); an unreadable file has null data and stays a row."""
    img = spark.read.format("image").option("dropInvalid", "false").load(f"{root}/student_*/cie_*/page_*.png").select("image.*")
    bad = F.col("height") < 0
    out = img.select(
        F.col("origin").alias("path"), *path_keys(F.col("origin")), *[F.when(~bad, F.col(c)).alias(n) for c, n in (("height", "height"), ("width", "width"), ("nChannels", "channels"), ("data", "data"))]
    )
    return out if covers else out.filter("page <> 1 or page is null")


def manifest_csv(spark: SparkSession, path: str) -> DataFrame:
    """Crop manifest; 0/1 becomes boolean and empty strings null at this border."""
    raw = spark.read.schema(S.MANIFEST).option("header", True).option("mode", "FAILFAST").csv(path)
    return raw.withColumn("tall", F.col("tall") == 1).withColumns({c: F.nullif(F.col(c), F.lit("")) for c in ("crop", "skipped")})


def page_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.PAGE_RECORD).option("multiLine", True).option("mode", "FAILFAST").json(path)


def sample_manifest_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.SAMPLE_MANIFEST).option("header", True).option("mode", "FAILFAST").csv(path)


def coco_parts(doc: DataFrame, column: str = "doc") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, annotations, categories) of label documents held as JSON text; other columns are carried along."""
    parsed = doc.withColumn("_d", F.from_json(column, S.COCO)).drop(column)
    rest = [c for c in parsed.columns if c != "_d"]
    return tuple(parsed.select(*rest, F.explode(f"_d.{part}").alias("_x")).select(*rest, "_x.*") for part in ("images", "annotations", "categories"))


def keyed_map(doc: DataFrame, value_type: str, column: str = "doc") -> DataFrame:
    """(key, value) rows of a JSON object, e.g. page transforms or scales."""
    return doc.select(*[c for c in doc.columns if c != column], F.explode(F.from_json(column, f"map<string,{value_type}>")).alias("key", "value"))


def routed_booklets(spark: SparkSession, path: str) -> DataFrame:
    """Routed regions written by booklet; student and cie come from the partition folders and prune the scan."""
    return spark.read.parquet(path)


def maths_rows(doc: DataFrame, column: str = "doc") -> DataFrame:
    """One row per expression of nested maths records held as JSON."""
    schema = "page_id string, line_uid string, engine string, simulated boolean, expressions array<struct<index:int,of:int,bbox:array<int>,latex:string,confidence:double>>"
    flat = doc.select(F.from_json(column, schema).alias("d")).select("d.page_id", "d.line_uid", "d.engine", "d.simulated", F.explode("d.expressions").alias("e"))
    corners = [F.get("e.bbox", F.lit(i)).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))]
    return flat.select("page_id", "line_uid", "e.index", "e.of", *corners, "e.latex", "e.confidence", "engine", "simulated")
