"""Writers: booklet-partitioned tables, flat CSV views, label files, label documents, validated runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom import schemas as S
from paperloom.operators.assembly import validate_run


def by_booklet(df: DataFrame, path: str) -> None:
    """Parquet by student and cie. Rows are spread by booklet and a few salts, so one large booklet is several files, not one task."""
    salt = F.pmod(F.hash("line_uid"), F.lit(8)) if "line_uid" in df.columns else F.lit(0)
    df.repartition("student", "cie", salt).write.mode("overwrite").partitionBy("student", "cie").parquet(path)


def flat_columns(df: DataFrame) -> list[Column]:
    """Columns of the text form: booleans as 0/1, arrays joined by |, nested ones left out."""
    cols: list[Column] = []
    for name, kind in df.dtypes:
        if kind == "boolean":
            cols.append(F.col(name).cast("int").alias(name))
        elif kind.startswith("array<"):
            cols.append(F.array_join(F.col(name).cast("array<string>"), "|").alias(name))
        elif not kind.startswith(("struct", "map")):
            cols.append(F.col(name))
    return cols


def flat_csv(df: DataFrame, path: str) -> None:
    """Text form with a header, null as the empty string."""
    df.select(*flat_columns(df)).write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def flat_views(pages: DataFrame) -> dict[str, DataFrame]:
    """The three flat views of nested page records: pages, blocks and lines."""
    box = lambda c: [F.get(c, F.lit(i)).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))]
    blocks = pages.select("page_id", F.posexplode("blocks").alias("block_id", "b"))
    lines = blocks.select("page_id", "block_id", F.posexplode("b.lines").alias("line_id", "l"))
    n_lines = F.aggregate("blocks", F.lit(0), lambda a, b: a + F.coalesce(F.size(b["lines"]), F.lit(0)))
    return {
        "pages": pages.select("page_id", "student", "cie", "page", "rule_pitch", "rules_removed", "ink_pixels", "ink_covered", F.size("blocks").alias("n_blocks"), n_lines.alias("n_lines")),
        "blocks": blocks.select("page_id", "block_id", *box("b.bbox"), F.size("b.lines").alias("n_lines")),
        "lines": lines.select("page_id", "block_id", "line_id", *box("l.bbox"), "l.parts", "l.tall"),
    }


def page_views(pages: DataFrame, path: str) -> None:
    """Nested records by booklet as JSON, and the flat views as CSV beside them."""
    pages.write.mode("overwrite").json(f"{path}/records")
    for name, view in flat_views(pages).items():
        flat_csv(view, f"{path}/{name}")


def crop_path(page: str = "page_id") -> Column:
    """student_NN/cie_C/page_PP/bBB_lLL.png of a line of a page sNN_cC_pPP; null for other pages."""
    parts = [F.regexp_extract(page, r"^s(\d+)_c(\d+)_p(\d+)$", k) for k in (1, 2, 3)]
    name = F.concat(F.lit("student_"), parts[0], F.lit("/cie_"), parts[1], F.lit("/page_"), parts[2], F.format_string("/b%02d_l%02d.png", "block_id", "line_id"))
    return F.when(parts[0] != "", name)


def crop_manifest(crops: DataFrame) -> DataFrame:
    """One row per line of crops (page_id, block_id, line_id, height, width, data, skipped, error): its path if there is a crop, else why not."""
    there = F.col("data").isNotNull()
    return crops.select("page_id", "block_id", "line_id", "width", "height", F.when(there, crop_path()).alias("crop"), F.coalesce("skipped", "error").alias("skipped"))


def crop_images(crops: DataFrame, path: str) -> None:
    """Crops as Parquet by booklet (their bytes aren't packed again) and their manifest as CSV."""
    keyed = crops.withColumns({"student": F.regexp_extract("page_id", r"^s(\d+)_", 1), "cie": F.regexp_extract("page_id", r"_c(\d+)_", 1)})
    there = keyed.filter("data is not null").withColumn("crop", crop_path()).drop("skipped", "error")
    there.write.mode("overwrite").option("compression", "uncompressed").partitionBy("student", "cie").parquet(f"{path}/crops")
    flat_csv(crop_manifest(crops), f"{path}/manifest")


def maths_records(expressions: DataFrame, engine: str, simulated: bool = True) -> DataFrame:
    """Nested maths records, one per line: (page_id, line_uid, engine, simulated, expressions by index) of (page_id, line_uid, index, of, bbox, latex, confidence)."""
    one = F.struct("index", "of", "bbox", "latex", "confidence")
    per = expressions.groupBy("page_id", "line_uid").agg(F.array_sort(F.collect_list(one)).alias("expressions"))
    return per.select("page_id", "line_uid", F.lit(engine).alias("engine"), F.lit(simulated).alias("simulated"), "expressions")


def maths_run(expressions: DataFrame, engine: str, path: str, simulated: bool = True) -> None:
    """Maths records as JSON and one CSV row per expression, with the time of the run."""
    records = maths_records(expressions, engine, simulated).withColumn("generated_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"))
    records.write.mode("overwrite").json(f"{path}/records")
    flat = records.select("page_id", "line_uid", "engine", "simulated", "generated_at", F.explode("expressions").alias("e")).select("*", "e.*").drop("e")
    flat_csv(flat, f"{path}/expressions")


def side_stats(pages: DataFrame, path: str, column: str = "rule_pitch") -> None:
    """Side-car statistics of a run: a row per page, sorted within files, and one row of totals."""
    pages.select("page_id", column).write.mode("overwrite").json(f"{path}/pages")
    stats(pages, column).write.mode("overwrite").json(f"{path}/summary")


def stats(pages: DataFrame, column: str) -> DataFrame:
    """(n, n_missing, least, mean, most) of a column."""
    c = F.col(column)
    return pages.agg(F.count(c).alias("n"), F.count_if(c.isNull()).alias("n_missing"), F.min(c).alias("least"), F.round(F.avg(c), 6).alias("mean"), F.max(c).alias("most"))


def text_lines(df: DataFrame, path: str) -> None:
    """A one-column table as plain text, such as a review list."""
    df.write.mode("overwrite").text(path)


def data_yaml(files: DataFrame, root: str = ".") -> DataFrame:
    """(place, line) of data.yaml for a training tree: its folders by split and the class names in order."""
    splits = files.select("split").filter("split is not null").distinct()
    folders = splits.select(F.when(F.col("split") == "train", 1).when(F.col("split") == "val", 2).otherwise(3).alias("place"), F.concat("split", F.lit(": images/"), "split").alias("line"))
    spark = files.sparkSession
    fixed = [(0, f"path: {root}"), (10, f"nc: {len(S.CATEGORIES)}"), (11, "names:"), *[(12 + i, f"  {i}: {c}") for i, c in enumerate(S.CATEGORIES)]]
    return folders.unionByName(spark.createDataFrame(fixed, "place int, line string"))


def sample_links(sample: DataFrame) -> DataFrame:
    """(link, target): where each file of the annotation sample is found, by split; one link for a file that comes twice."""
    named = sample.filter("file_name is not null and source is not null")
    return named.groupBy(F.concat(F.coalesce("split", F.lit("none")), F.lit("/"), "file_name").alias("link")).agg(F.min("source").alias("target"))


def label_files(files: DataFrame, path: str) -> None:
    """Label bodies as Parquet rows (file, body) by split, images without boxes included with an empty body, and data.yaml.

    A folder or file per image would be as many as there are images; rows
    keep their names, and those of one split can be unpacked anywhere.
    """
    named = files.select("split", F.regexp_replace("file_name", r"\.png$", ".txt").alias("file"), "body")
    named.write.mode("overwrite").partitionBy("split").parquet(f"{path}/labels")
    data_yaml(files).orderBy("place", "line").select("line").coalesce(1).write.mode("overwrite").text(f"{path}/data.yaml")


def label_document(boxes: DataFrame) -> DataFrame:
    """One JSON document per page: (page_id, doc) with image, annotations by box_id, and the fixed categories.

    A document for the whole corpus would gather it in one row; pages are
    the unit, ids are unique within a page.
    """
    cid = F.array_position(F.array(*[F.lit(c) for c in S.CATEGORIES]), F.col("category")).cast("int")
    one = F.struct("box_id", cid.alias("category_id"), F.array(*[c.cast("double") for c in (F.col("x1"), F.col("y1"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))]).alias("bbox"))
    per = boxes.groupBy("page_id").agg(F.array_sort(F.collect_list(one)).alias("a"), F.max("page_w").alias("w"), F.max("page_h").alias("h"))
    annotations = F.transform("a", lambda x, i: F.struct((i + 1).alias("id"), F.lit(1).alias("image_id"), x["category_id"].alias("category_id"), x["bbox"].alias("bbox")))
    image = F.array(F.struct(F.lit(1).alias("id"), F.concat("page_id", F.lit(".png")).alias("file_name"), F.col("w").alias("width"), F.col("h").alias("height")))
    cats = F.array(*[F.struct(F.lit(i + 1).alias("id"), F.lit(c).alias("name")) for i, c in enumerate(S.CATEGORIES)])
    return per.select("page_id", F.to_json(F.struct(image.alias("images"), annotations.alias("annotations"), cats.alias("categories"))).alias("doc"))


def run_payload(lines: DataFrame, engine: str, path: str, simulated: bool = True) -> int:
    """Validates a run, then writes its lines and its one-row envelope; the simulated flag is on every line. Returns the number of lines."""
    meta = {"schema_version": S.SCHEMA_VERSION, "simulated": simulated, "engine": engine, "pages": True}
    n = validate_run(lines, meta)
    lines.withColumn("simulated", F.lit(simulated)).write.mode("overwrite").parquet(f"{path}/lines")
    head = lines.agg(F.countDistinct("page_id").alias("pages_total"), F.count(F.lit(1)).alias("lines_total"))
    head.select(F.lit(S.SCHEMA_VERSION).alias("schema_version"), F.lit(simulated).alias("simulated"), F.lit(engine).alias("engine"), "*").write.mode("overwrite").json(f"{path}/envelope")
    return n
