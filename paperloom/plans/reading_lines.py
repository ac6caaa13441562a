"""Queries over recognised lines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from paperloom import schemas as S
from paperloom.common import table
from paperloom.functions import identity as I
from paperloom.operators import assembly as A
from paperloom.sources import files, sinks
from paperloom.plans.base import LINES, PAGES, REGIONS, Registry, lines, pages, regions

R = Registry()
_CROP = r"'^student_(\d+)/cie_(\d+)/page_(\d+)/b(\d+)_l(\d+)\.png$'"
_UID = f"""CASE WHEN regexp_matches(crop, {_CROP}) THEN printf('s%02d_c%d_p%02d_b%02d_l%02d', CAST(regexp_extract(crop, {_CROP}, 1) AS INT), CAST(regexp_extract(crop, {_CROP}, 2) AS INT),
  CAST(regexp_extract(crop, {_CROP}, 3) AS INT), CAST(regexp_extract(crop, {_CROP}, 4) AS INT), CAST(regexp_extract(crop, {_CROP}, 5) AS INT)) END"""


@R.add(f"WITH {LINES}, i AS (SELECT line_uid, crop, {_UID} AS crop_uid FROM lines) SELECT line_uid, crop_uid FROM i WHERE crop_uid = line_uid")
def e02_identity(spark, d):
    return A.split_identity(lines(spark, d))[0].select("line_uid", "crop_uid")


@R.add(f"WITH {LINES}, i AS (SELECT line_uid, crop, {_UID} AS u FROM lines) SELECT line_uid, CASE WHEN crop IS NULL THEN 'no crop' WHEN u IS NULL THEN 'unreadable path' ELSE 'other line' END AS reject_reason FROM i WHERE crop IS NULL OR u IS NULL OR u <> line_uid")
def e02_rejects(spark, d):
    return A.split_identity(lines(spark, d))[1].select("line_uid", "reject_reason")


@R.add(r"SELECT file_name, CASE WHEN regexp_matches(file_name, '^s(\d+)_c(\d+)_p(\d+)\.png$') THEN regexp_replace(file_name, '^s(\d+)_c(\d+)_p(\d+)\.png$', 'student_\1/cie_\2/page_\3.png') END AS path FROM sample_manifest WHERE file_name IS NOT NULL")
def e03_file_to_path(spark, d):
    return table(spark, d, "sample_manifest").filter("file_name is not null").select("file_name", I.corpus_path(F.col("file_name")).alias("path"))


@R.add(f"WITH {LINES} SELECT line_uid, CASE WHEN coalesce(trim(text), '') = '' THEN 'empty' ELSE 'ok' END AS found FROM lines")
def e20_text_status(spark, d):
    return lines(spark, d).select("line_uid", A.text_status(F.col("text")).alias("found"))


@R.add("SELECT vec_id, coalesce(round_even(greatest(least(exp(list_avg(list_transform(list_filter(embedding, lambda x: x < 0), lambda x: CAST(x AS DOUBLE)))), 1.0), 0.0), 3), 0.0) AS confidence FROM embeddings")
def e21_sequence_confidence(spark, d):
    v = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", A.sequence_confidence(v, F.transform("embedding", lambda x: x < 0)).alias("confidence"))


@R.add("WITH n AS (SELECT DISTINCT lower(trim(line_uid)) AS line_uid FROM ocr_lines WHERE line_uid IS NOT NULL) SELECT line_uid, CAST(CAST('0x' || substr(sha256(line_uid), 1, 16) AS UBIGINT) AS VARCHAR) AS seed FROM n")
def e25_seed(spark, d):
    return lines(spark, d).select("line_uid", I.seed(F.col("line_uid")).alias("seed"))


@R.add(
    """WITH n AS (SELECT DISTINCT lower(trim(line_uid)) AS line_uid FROM ocr_lines WHERE line_uid IS NOT NULL),
    u AS (SELECT CAST(CAST('0x' || substr(sha256(line_uid), 1, 8) AS UBIGINT) AS DOUBLE) / 4294967296.0 AS u FROM n)
    SELECT CASE WHEN u < 0.003 THEN 'failed' WHEN u < 0.023 THEN 'empty' ELSE 'ok' END AS status, count(*) AS n FROM u GROUP BY 1"""
)
def e22_simulated_status(spark, d):
    from paperloom.operators.simulate import hashed_status

    return lines(spark, d).select(hashed_status(F.col("line_uid")).alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@R.add(f"WITH {LINES} SELECT page_id, line_uid, CAST(row_number() OVER (PARTITION BY page_id ORDER BY reading_order, line_uid) - 1 AS INT) AS reading_order FROM lines WHERE status = 'ok'")
def w03_dense_order(spark, d):
    return A.dense_order(lines(spark, d).filter("status = 'ok'")).select("page_id", "line_uid", "reading_order")


@R.add(f"WITH {LINES}, {PAGES} SELECT l.line_uid, coalesce(p.source, '') AS source, coalesce(p.size[1], 0) AS width, coalesce(p.size[2], 0) AS height FROM lines l LEFT JOIN pages p USING (page_id)")
def j03_page_meta(spark, d):
    p = pages(spark, d).select("page_id", "source", "size")
    return lines(spark, d).join(p, "page_id", "left").select("line_uid", F.coalesce("source", F.lit("")).alias("source"), F.coalesce(F.get("size", F.lit(0)), F.lit(0)).alias("width"), F.coalesce(F.get("size", F.lit(1)), F.lit(0)).alias("height"))


@R.add(f"WITH {LINES}, {REGIONS} SELECT l.line_uid, r.crop IS NOT NULL AS has_image, CASE WHEN r.crop IS NULL THEN 'no image' END AS error FROM lines l LEFT JOIN (SELECT DISTINCT crop FROM regions WHERE crop IS NOT NULL) r ON l.crop = r.crop")
def j17_crop_image(spark, d):
    images = regions(spark, d).filter("crop is not null").select("crop").distinct().withColumn("has_image", F.lit(True))
    j = lines(spark, d).join(images, "crop", "left")
    return j.select("line_uid", F.coalesce("has_image", F.lit(False)).alias("has_image"), F.when(F.col("has_image").isNull(), "no image").alias("error"))


@R.add(f"WITH {LINES}, s(status, place) AS (VALUES ('ok', 0), ('empty', 1), ('diagram', 2), ('failed', 3)) SELECT s.status, s.place, count(l.line_uid) AS n FROM s LEFT JOIN lines l ON l.status = s.status GROUP BY 1, 2")
def a03_by_status(spark, d):
    counts = lines(spark, d).groupBy("status").agg(F.count("line_uid").alias("n"))
    enum = spark.createDataFrame(list(enumerate(S.STATUSES)), "place int, status string")
    return enum.join(counts, "status", "left").select("status", "place", F.coalesce("n", F.lit(0)).alias("n"))


@R.add(f"WITH {LINES}, k AS (SELECT engine, confidence, row_number() OVER (PARTITION BY engine ORDER BY confidence) - 1 AS i, count(*) OVER (PARTITION BY engine) AS n FROM lines WHERE confidence IS NOT NULL) SELECT engine, confidence AS upper_median FROM k WHERE i = n // 2")
def a06_upper_median(spark, d):
    # counts per value first, so that an engine with a third of the rows is a few thousand rows here
    w = Window.partitionBy("engine")
    k = lines(spark, d).filter("confidence is not null").groupBy("engine", "confidence").agg(F.count(F.lit(1)).alias("c"))
    k = k.withColumn("upto", F.sum("c").over(w.orderBy("confidence"))).withColumn("n", F.sum("c").over(w))
    return k.filter(F.col("upto") > F.floor(F.col("n") / 2)).groupBy("engine").agg(F.min("confidence").alias("upper_median"))


@R.add(f"WITH {LINES} SELECT engine, round(coalesce(avg(confidence) FILTER (status = 'ok' AND text <> ''), 0), 4) AS mean_conf FROM lines GROUP BY 1")
def a16_mean_confidence(spark, d):
    real = (F.col("status") == "ok") & (F.col("text") != "")
    return lines(spark, d).groupBy("engine").agg(F.round(F.coalesce(F.avg(F.when(real, F.col("confidence"))), F.lit(0.0)), 4).alias("mean_conf"))


@R.add(f"WITH {LINES} SELECT count(*) AS n_lines, count(*) FILTER (coalesce(text, '') = '') AS n_empty, count(*) FILTER (status = 'failed') AS n_failed FROM lines")
def a17_totals(spark, d):
    return lines(spark, d).agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.coalesce("text", F.lit("")) == "").alias("n_empty"), F.count_if(F.col("status") == "failed").alias("n_failed"))


@R.add(f"WITH {LINES} SELECT engine, count(*) FILTER (confidence < 0.5) AS n_low FROM lines GROUP BY 1")
def a18_low_confidence(spark, d):
    return lines(spark, d).groupBy("engine").agg(F.count_if(F.col("confidence") < 0.5).alias("n_low"))


@R.add(f"WITH {LINES} SELECT count(DISTINCT student) AS n_students, count(DISTINCT page_id) AS n_pages, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM lines")
def a19_distinct_students(spark, d):
    return lines(spark, d).agg(F.countDistinct("student").alias("n_students"), F.countDistinct("page_id").alias("n_pages"), F.sum(F.length("text")).alias("n_chars"))


@R.add(f"WITH {LINES} SELECT page_id, string_agg(text, chr(10) ORDER BY reading_order, line_uid) AS text FROM lines WHERE status = 'ok' AND page_id IS NOT NULL AND text IS NOT NULL GROUP BY 1")
def a22_page_text(spark, d):
    return A.page_text(lines(spark, d))


@R.add(
    f"""WITH {LINES}, p AS (SELECT student, cie, page, string_agg(text, chr(10) ORDER BY reading_order, line_uid) AS t FROM lines WHERE status = 'ok' AND text IS NOT NULL GROUP BY ALL)
    SELECT student, cie, page, coalesce('== page ' || page || ' ==' || chr(10) || t, t) AS text FROM p"""
)
def a23_transcripts(spark, d):
    return A.transcripts(lines(spark, d))


@R.add(f"WITH {LINES} SELECT line_uid, page_id, reading_order FROM lines ORDER BY page_id NULLS LAST, reading_order, line_uid LIMIT 500")
def w17_first_lines(spark, d):
    return lines(spark, d).select("line_uid", "page_id", "reading_order").orderBy(F.asc_nulls_last("page_id"), "reading_order", "line_uid").limit(500)


_VIOLATIONS = """
SELECT 'status' AS rule, line_uid AS key, coalesce(status, 'null') AS detail FROM {0} WHERE status IS NULL OR status NOT IN ('ok','empty','diagram','failed')
UNION ALL SELECT 'unique uid', line_uid, CAST(count(*) AS VARCHAR) FROM {0} GROUP BY line_uid HAVING count(*) > 1
UNION ALL SELECT 'dense order', coalesce(page_id, 'null'), count(DISTINCT reading_order) || '/' || count(*) FROM {0} GROUP BY page_id
  HAVING NOT coalesce(min(reading_order) = 0 AND max(reading_order) = count(*) - 1 AND count(DISTINCT reading_order) = count(*), false)"""


@R.add(f"WITH {LINES} SELECT rule, key, detail FROM (" + _VIOLATIONS.format("lines") + ")")
def pv1_run_violations(spark, d):
    return A.line_violations(lines(spark, d)).filter("rule <> 'confidence'")


@R.add("SELECT line_uid AS key, count(*) AS n FROM ocr_lines WHERE confidence IS NULL OR confidence NOT BETWEEN 0 AND 1 GROUP BY 1")
def pv1_confidence(spark, d):
    return A.line_violations(table(spark, d, "ocr_lines")).filter("rule = 'confidence'").groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@R.add(f"WITH {LINES} SELECT engine, count(*) FILTER (simulated IS NULL) AS n_unmarked, count(*) FILTER (simulated) AS n_simulated FROM lines GROUP BY 1")
def pv10_simulated_flag(spark, d):
    return lines(spark, d).groupBy("engine").agg(F.count_if(F.col("simulated").isNull()).alias("n_unmarked"), F.count_if(F.col("simulated")).alias("n_simulated"))


@R.add(f"WITH {LINES} SELECT line_uid, status, crop FROM lines WHERE status = 'failed'")
def pv7_failed_lines(spark, d):
    return lines(spark, d).filter("status = 'failed'").select("line_uid", "status", "crop")


# Expressions of a line stand between its signs of equality, 25 pixels a character from its left edge on.
_EXPR = f"""{LINES}, parts AS (SELECT line_uid, page_id, bbox, confidence, string_split(text, '=') AS p FROM lines WHERE status = 'ok' AND contains(text, '=') AND bbox IS NOT NULL),
  e AS (SELECT line_uid, page_id, bbox, confidence, i - 1 AS "index", len(p) AS "of", trim(p[i]) AS latex, 25 * (coalesce(list_sum(list_transform(p[1:i - 1], lambda x: length(x) + 1)), 0))::INT AS dx, greatest(25 * length(p[i]), 1)::INT AS w
  FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM parts))"""


def expressions(spark, d):
    """(line_uid, page_id, bbox, confidence, index, of, latex, dx, w) of lines with a sign of equality."""
    got = lines(spark, d).filter("status = 'ok' and contains(text, '=') and bbox is not null").withColumn("p", F.split("text", "="))
    e = got.select("line_uid", "page_id", "bbox", "confidence", "p", F.posexplode("p").alias("index", "part"))
    before = F.aggregate(F.slice("p", 1, F.col("index")), F.lit(0), lambda a, x: a + F.length(x) + 1)
    return e.select("line_uid", "page_id", "bbox", "confidence", "index", F.size("p").alias("of"), F.trim("part").alias("latex"), (before * 25).alias("dx"), F.greatest(F.length("part") * 25, F.lit(1)).alias("w"))


@R.add(f"WITH {_EXPR} SELECT line_uid, CAST(\"index\" AS INT) AS \"index\", bbox[1] + dx AS px1, bbox[2] AS py1, bbox[1] + dx + w AS px2, bbox[4] AS py2 FROM e")
def e13_crop_to_page(spark, d):
    """Boxes of expressions in the page's frame: the crop's origin and the expression's offset in it."""
    e = expressions(spark, d)
    return e.select("line_uid", "index", *[c.alias(n) for c, n in zip(page_box(e), ("px1", "py1", "px2", "py2"), strict=True)])


def page_box(e):
    b = lambda i: F.get("bbox", F.lit(i))
    return b(0) + F.col("dx"), b(1), b(0) + F.col("dx") + F.col("w"), b(3)


@R.add(f"WITH {LINES} SELECT status, CASE WHEN (SELECT count(*) FROM lines) = 0 THEN 0 ELSE 100.0 * count(*) / (SELECT count(*) FROM lines) END AS pct FROM lines GROUP BY 1")
def e26_share_guarded(spark, d):
    w = Window.partitionBy()
    n = lines(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return n.select("status", F.coalesce(F.try_divide(F.lit(100.0) * F.col("n"), F.sum("n").over(w)), F.lit(0.0)).alias("pct"))


@R.add(f"WITH {LINES} SELECT line_uid, page_id, reading_order, CASE WHEN tall THEN 1 WHEN NOT tall THEN 0 END AS tall, array_to_string(bbox, '|') AS bbox, status, text, confidence FROM lines")
def k05_flat_lines(spark, d):
    """The flat view of a run, as it is written in text form."""
    return lines(spark, d).select(*sinks.flat_columns(lines(spark, d).select("line_uid", "page_id", "reading_order", "tall", "bbox", "status", "text", "confidence")))


@R.add(f"WITH {_EXPR} SELECT page_id, line_uid, CAST(\"index\" AS INT) AS \"index\", CAST(\"of\" AS INT) AS \"of\", bbox[1] + dx AS x1, bbox[2] AS y1, bbox[1] + dx + w AS x2, bbox[4] AS y2, latex, confidence, 'simulated' AS engine, true AS simulated FROM e")
def k06_maths_rows(spark, d):
    """Maths records nested by line, as they are written in JSON, read again and laid flat: one row an expression."""
    e = expressions(spark, d)
    boxed = e.select("page_id", "line_uid", "index", "of", F.array(*page_box(e)).alias("bbox"), "latex", "confidence")
    nested = sinks.maths_records(boxed, "simulated").select(F.to_json(F.struct("*")).alias("doc"))
    return files.maths_rows(nested)


QUERIES, SQL = R.queries, R.sql
