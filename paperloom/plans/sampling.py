"""Queries of samples, splits, numbering, folds, joins of the sample manifest, and grey tiles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from paperloom.common import norm_path, table
from paperloom.operators import folds, sampling, simulate
from paperloom.plans.base import LINES, PAGE_LINES, PAGES, REGIONS, Registry, lines, page_lines, pages, regions
from paperloom.plans.routing import _ROUTED, routed

R = Registry()
_NUM = r"CAST(regexp_extract(student_id, '(\d+)') AS INT)"
_SPLIT = "CASE lower(trim(split)) WHEN 'training' THEN 'train' WHEN 'valid' THEN 'val' WHEN 'validation' THEN 'val' ELSE lower(trim(split)) END"
_SAMPLE = rf"""sample AS (SELECT DISTINCT file_name, regexp_replace(replace(lower(trim(source)), '\', '/'), '^(\./+)+', '') AS source,
  CASE WHEN regexp_extract(student_id, '(\d+)') <> '' THEN {_NUM} END AS student, page_kind, {_SPLIT} AS split FROM sample_manifest)"""


def sample(spark, d):
    s = table(spark, d, "sample_manifest")
    low = F.lower(F.trim("split"))
    split = F.when(low == "training", "train").when(low.isin("valid", "validation"), "val").otherwise(low)
    num = F.regexp_extract("student_id", r"(\d+)", 1)
    return s.select("file_name", norm_path(F.col("source")).alias("source"), F.when(num != "", num.cast("int")).alias("student"), "page_kind", split.alias("split")).distinct()


@R.add(f"WITH {_SAMPLE} SELECT file_name, source, student, page_kind, split FROM sample")
def s14_sample_manifest(spark, d):
    return sample(spark, d)


@R.add(f"WITH {_SAMPLE} SELECT split, count(*) AS n_files, count(DISTINCT student) AS n_students, count(*) FILTER (page_kind = 'cover') AS n_covers FROM sample GROUP BY 1")
def a14_per_split(spark, d):
    return sample(spark, d).groupBy("split").agg(F.count(F.lit(1)).alias("n_files"), F.countDistinct("student").alias("n_students"), F.count_if(F.col("page_kind") == "cover").alias("n_covers"))


@R.add(f"WITH {_SAMPLE} SELECT student, count(DISTINCT split) AS n_splits FROM sample WHERE student IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1")
def pv11_split_integrity(spark, d):
    return sample(spark, d).filter("student is not null").groupBy("student").agg(F.countDistinct("split").alias("n_splits")).filter("n_splits > 1")


@R.add(f"WITH {PAGES}, {_SAMPLE}, s AS (SELECT source, min(split) AS split FROM sample WHERE source IS NOT NULL GROUP BY 1) SELECT p.page_id, s.split FROM pages p JOIN s USING (source) WHERE s.split IS NOT NULL")
def j05_images_with_split(spark, d):
    s = sample(spark, d).filter("source is not null").groupBy("source").agg(F.min("split").alias("split")).filter("split is not null")
    return pages(spark, d).join(s, "source").select("page_id", "split")


@R.add(f"WITH {PAGES}, {_SAMPLE} SELECT page_id, 'not in manifest' AS reason FROM pages p WHERE NOT EXISTS (SELECT 1 FROM sample s WHERE s.source = p.source)")
def j05_skipped(spark, d):
    return pages(spark, d).join(sample(spark, d).select("source"), "source", "left_anti").select("page_id", F.lit("not in manifest").alias("reason"))


@R.add(f"WITH {PAGES}, {LINES}, t AS (SELECT page_id, coalesce(rule_pitch, 58.4) / 58.4 AS factor FROM pages) SELECT l.line_uid, t.factor IS NOT NULL AS has_scale, round(l.bbox[1] * t.factor, 3) AS x1 FROM lines l LEFT JOIN t USING (page_id) WHERE l.bbox IS NOT NULL")
def j06_scales(spark, d):
    t = pages(spark, d).select("page_id", (F.coalesce("rule_pitch", F.lit(58.4)) / 58.4).alias("factor"))
    j = lines(spark, d).filter("bbox is not null").join(t, "page_id", "left")
    return j.select("line_uid", F.col("factor").isNotNull().alias("has_scale"), F.round(F.get("bbox", F.lit(0)) * F.col("factor"), 3).alias("x1"))


@R.add(f"WITH {PAGES}, {LINES} SELECT DISTINCT page_id AS missing FROM lines WHERE page_id IS NOT NULL AND page_id NOT IN (SELECT page_id FROM pages)")
def j07_missing_scales(spark, d):
    return lines(spark, d).filter("page_id is not null").join(pages(spark, d).select("page_id"), "page_id", "left_anti").select(F.col("page_id").alias("missing")).distinct()


_HASH = "md5(concat_ws('|', 'split', CAST(student AS VARCHAR)))"


@R.add(f"WITH {PAGES}, s AS (SELECT DISTINCT student FROM pages WHERE student IS NOT NULL), i AS (SELECT student, row_number() OVER (ORDER BY {_HASH}, student) - 1 AS i, count(*) OVER () AS n FROM s) SELECT student, CASE WHEN i < round_even(n * 0.70, 0) THEN 'train' WHEN i < round_even(n * 0.70, 0) + round_even(n * 0.15, 0) THEN 'val' ELSE 'test' END AS split FROM i")
def o04_split_students(spark, d):
    return sampling.split_students(pages(spark, d).filter("student is not null"))


@R.add(
    f"""WITH {PAGES}, h AS (SELECT page_id, student, page, md5(concat_ws('|', 'pages', page_id)) AS h FROM pages),
    c AS (SELECT page_id, student, 'cover' AS page_kind FROM (SELECT *, row_number() OVER (PARTITION BY student ORDER BY h) AS k FROM h WHERE page = 1) WHERE k = 1 ORDER BY h LIMIT 15),
    r AS (SELECT page_id, student, 'content' AS page_kind, row_number() OVER (PARTITION BY student ORDER BY h) AS depth FROM h WHERE page <> 1),
    n AS (SELECT page_id, student, page_kind, row_number() OVER (ORDER BY depth, student) AS k FROM r)
    SELECT * FROM c UNION ALL SELECT page_id, student, page_kind FROM n WHERE k <= 120 - (SELECT count(*) FROM c)"""
)
def o05_choose_pages(spark, d):
    return sampling.choose_pages(pages(spark, d).select("page_id", "student", "page"), 120).select("page_id", "student", "page_kind")


@R.add(f"WITH {PAGES}, r AS (SELECT page_id, student, row_number() OVER (PARTITION BY student ORDER BY cie, page, page_id) AS depth FROM pages WHERE page <> 1) SELECT page_id, student, CAST(depth AS INT) AS depth FROM r ORDER BY depth, student LIMIT 200")
def w11_round_robin(spark, d):
    return sampling.round_robin(pages(spark, d).filter("page <> 1"), "student", ["cie", "page", "page_id"], 200).select("page_id", "student", "depth")


@R.add(f"WITH {_SAMPLE}, c AS (SELECT DISTINCT file_name, student, md5(concat_ws('|', 'covers', file_name)) AS h FROM sample WHERE page_kind = 'cover' AND student IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY student ORDER BY h) AS k FROM c) SELECT file_name, student FROM k WHERE k = 1 ORDER BY h LIMIT 15")
def w18_cover_quota(spark, d):
    c = sample(spark, d).filter("page_kind = 'cover' and student is not null").select("file_name", "student").distinct().withColumn("h", sampling.hash_order("file_name", salt="covers"))
    k = c.withColumn("k", F.row_number().over(Window.partitionBy("student").orderBy("h"))).filter("k = 1")
    return k.orderBy("h").limit(15).select("file_name", "student")


@R.add(f"WITH {PAGES}, i AS (SELECT page_id, row_number() OVER (ORDER BY page_id) - 1 AS i FROM pages) SELECT page_id, i // 400 AS chunk, i % 400 AS place FROM i")
def w12_chunks(spark, d):
    return sampling.chunks(pages(spark, d).select("page_id"), 400, "page_id").select("page_id", "chunk", "place")


@R.add(f"WITH {REGIONS}, i AS (SELECT page_id, block_id, line_id, row_number() OVER (ORDER BY page_id, block_id, line_id) - 1 AS i, count(*) OVER () AS n FROM regions WHERE crop IS NOT NULL) SELECT page_id, block_id, line_id FROM i WHERE i % greatest(n // 40, 1) = 0 AND i < greatest(n // 40, 1) * 40")
def w19_systematic_sample(spark, d):
    return sampling.systematic(regions(spark, d).filter("crop is not null").select("page_id", "block_id", "line_id"), 40, "page_id", "block_id", "line_id")


@R.add(f"WITH {PAGES} SELECT page_id FROM pages ORDER BY page_id LIMIT 50")
def o02_first_pages(spark, d):
    return pages(spark, d).select("page_id").orderBy("page_id").limit(50)


@R.add(f"WITH {_SAMPLE}, c AS (SELECT DISTINCT file_name FROM sample WHERE page_kind = 'cover') SELECT file_name FROM c ORDER BY md5(concat_ws('|', 'template', file_name)) LIMIT 20")
def o06_cover_sample(spark, d):
    c = sample(spark, d).filter("page_kind = 'cover'").select("file_name").distinct()
    return c.orderBy(sampling.hash_order("file_name", salt="template")).limit(20)


@R.add(f"WITH {PAGES} SELECT page_id, student, cie, page FROM pages ORDER BY student, cie, page, page_id")
def o01_total_sort(spark, d):
    return pages(spark, d).select("page_id", "student", "cie", "page").orderBy("student", "cie", "page", "page_id")


@R.add(f"WITH {PAGES} SELECT page_id, 'cover' AS kind FROM pages WHERE page = 1 UNION ALL SELECT page_id, 'content' FROM pages WHERE page <> 1")
def u01_covers_and_content(spark, d):
    p = pages(spark, d)
    return p.filter("page = 1").select("page_id", F.lit("cover").alias("kind")).unionByName(p.filter("page <> 1").select("page_id", F.lit("content").alias("kind")))


@R.add("SELECT file_name FROM sample_manifest WHERE contains(file_name, '_c1_')")
def pl_file_contains(spark, d):
    return table(spark, d, "sample_manifest").filter(F.col("file_name").contains("_c1_")).select("file_name")


@R.add(f"WITH {PAGES} SELECT page_id FROM pages WHERE page_id NOT IN ('s00_c1_p02', 's01_c1_p02')")
def pm_outlier_pages(spark, d):
    out = spark.createDataFrame([("s00_c1_p02",), ("s01_c1_p02",)], "page_id string")
    return pages(spark, d).select("page_id").join(out, "page_id", "left_anti")


@R.add(f"WITH {PAGE_LINES}, e AS (SELECT page_id, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM page_lines GROUP BY 1), p AS (SELECT e.*, size[1] AS w, size[2] AS h FROM e JOIN pages USING (page_id)) SELECT page_id, CASE WHEN (x2 - x1) * (y2 - y1) < 0.5 * w * h THEN 0 ELSE x1 END AS x1, CASE WHEN (x2 - x1) * (y2 - y1) < 0.5 * w * h THEN w ELSE x2 END AS x2 FROM p")
def pn_trim_guard(spark, d):
    e = page_lines(spark, d).groupBy("page_id").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))
    p = e.join(pages(spark, d).select("page_id", F.get("size", F.lit(0)).alias("w"), F.get("size", F.lit(1)).alias("h")), "page_id")
    failed = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) < F.lit(0.5) * F.col("w") * F.col("h")
    return p.select("page_id", F.when(failed, 0).otherwise(F.col("x1")).alias("x1"), F.when(failed, F.col("w")).otherwise(F.col("x2")).alias("x2"))


@R.add(
    f"""WITH RECURSIVE {PAGE_LINES}, v AS (SELECT page_id, block_id * 1000 + line_id AS line_key, (y1 + y2) / 2.0::DOUBLE AS mid FROM page_lines),
    o AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY mid, line_key) AS k FROM v),
    w AS (
      SELECT page_id, line_key, k, mid AS total, 1 AS n, 0 AS cluster FROM o WHERE k = 1
      UNION ALL SELECT o.page_id, o.line_key, o.k, CASE WHEN abs(o.mid - w.total / w.n) <= 35.4::DOUBLE THEN w.total + o.mid ELSE o.mid END, CASE WHEN abs(o.mid - w.total / w.n) <= 35.4::DOUBLE THEN w.n + 1 ELSE 1 END,
        CASE WHEN abs(o.mid - w.total / w.n) <= 35.4::DOUBLE THEN w.cluster ELSE w.cluster + 1 END FROM w JOIN o ON o.page_id = w.page_id AND o.k = w.k + 1)
    SELECT page_id, line_key, cluster FROM w"""
)
def f01_running_mean_lines(spark, d):
    p = page_lines(spark, d).withColumn("at", (F.col("y1") + F.col("y2")) / 2).withColumn("line_key", F.col("block_id") * 1000 + F.col("line_id"))
    return folds.cluster_running_mean(p, "page_id", "at", "line_key", 35.4)


# The tables hold no covers' lines; every cover of the sample stands for one with six printed lines, some of them moved or missing.
_COVER_LINES = [(100, 40, 560), (180, 40, 560), (260, 60, 540), (340, 40, 560), (420, 80, 300), (424, 310, 560)]


@R.add(
    """WITH c AS (SELECT DISTINCT file_name AS example, CAST(CAST('0x' || substr(sha256(file_name), 1, 4) AS UBIGINT) AS INT) AS h FROM sample_manifest WHERE page_kind = 'cover' AND file_name IS NOT NULL),
    l(i, pos, s, e) AS (VALUES (0, 100, 40, 560), (1, 180, 40, 560), (2, 260, 60, 540), (3, 340, 40, 560), (4, 420, 80, 300), (5, 424, 310, 560)),
    x AS (SELECT example, pos + (h + i) % 5 AS pos, s + h % 3 AS s, e - h % 4 AS e FROM c, l WHERE (h + i * 7) % 10 < 8 - i % 3 OR i < 2),
    o AS (SELECT *, row_number() OVER (ORDER BY pos, example, s) AS k FROM x),
    g AS (SELECT o.*, sum(b) OVER (ORDER BY o.k) AS g FROM (SELECT *, CASE WHEN pos - lag(pos) OVER (ORDER BY k) >= 12 THEN 1 ELSE 0 END AS b FROM o) o)
    SELECT 'horizontal' AS axis, median(pos)::DOUBLE AS pos, median(s)::DOUBLE AS "start", median(e)::DOUBLE AS "end", count(DISTINCT example) AS support, (SELECT count(DISTINCT example) FROM x) AS n_examples
    FROM g GROUP BY g HAVING count(DISTINCT example) / (SELECT count(DISTINCT example) FROM x) >= 0.6"""
)
def f02_cover_template(spark, d):
    covers = table(spark, d, "sample_manifest").filter("page_kind = 'cover' and file_name is not null").select(F.col("file_name").alias("example")).distinct()
    h = F.conv(F.substring(F.sha2("example", 256), 1, 4), 16, 10).cast("int")
    printed = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("pos"), F.lit(a).alias("s"), F.lit(b).alias("e")) for i, (p, a, b) in enumerate(_COVER_LINES)])
    x = covers.withColumn("h", h).select("example", "h", F.explode(printed).alias("l")).select("example", "h", "l.*").filter("(h + i * 7) % 10 < 8 - i % 3 or i < 2")
    d_ = lambda c: c.cast("double")
    rows = x.select(F.lit("horizontal").alias("axis"), "example", d_(F.col("pos") + (F.col("h") + F.col("i")) % 5).alias("pos"), d_(F.col("s") + F.col("h") % 3).alias("start"), d_(F.col("e") - F.col("h") % 4).alias("end"))
    return folds.line_template(rows)


_HEX = "CAST(CAST('0x' || substr(sha256(line_uid), {0}, {1}) AS UBIGINT) AS INT)"
_WORDS = "[" + ", ".join(f"'{w}'" for w in simulate.WORDS) + "]"


@R.add(
    f"""{_ROUTED}, r AS (SELECT line_uid, coalesce(tall, false) AS tall, greatest(coalesce(x2 - x1, 0), 0) AS w FROM routed WHERE line_uid IS NOT NULL),
    u AS (SELECT *, CAST(CAST('0x' || substr(sha256(line_uid), 1, 8) AS UBIGINT) AS DOUBLE) / 4294967296.0 AS u, list_sort([{", ".join(_HEX.format(9 + 4 * k, 4) for k in range(10))}]) AS draws,
      {_HEX.format(49, 4)} % 20 AS a, {_HEX.format(53, 4)} % 20 AS b, {_HEX.format(57, 4)} % 20 AS c, greatest(1, CAST(floor(w / 25.0) AS INT)) AS n FROM r),
    s AS (SELECT *, CASE WHEN tall THEN 'diagram' WHEN u < 0.003 THEN 'failed' WHEN u < 0.023 THEN 'empty' ELSE 'ok' END AS status,
      array_to_string(list_transform(range(CAST(floor(n / 3.0) AS INT) + 2), lambda i: {_WORDS}[(a * i * i + b * i + c) % 20 + 1]), ' ') AS t FROM u)
    SELECT line_uid, status, CASE WHEN status <> 'ok' THEN '' ELSE coalesce(nullif(regexp_extract(substr(t || ' ', 1, n + 1), '^(.*) ', 1), ''), substr(t, 1, n)) END AS text,
      CASE status WHEN 'ok' THEN round(draws[9] / 65536.0::DOUBLE * (1 - 20 / (2.0::DOUBLE * greatest(w, 20))), 3) WHEN 'empty' THEN round(draws[1] / 65536.0::DOUBLE, 3) ELSE 0.0::DOUBLE END AS confidence, true AS simulated FROM s"""
)
def f05_simulated_lines(spark, d):
    return simulate.simulate(routed(spark, d).select("line_uid", "tall", (F.col("x2") - F.col("x1")).alias("width")))


@R.add("SELECT vec_id, CAST(len(list_filter(embedding, lambda v: v * 128 + 128 < 180)) AS INT) AS ink FROM embeddings")
def x01_tile_ink(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.size(F.filter("embedding", lambda v: v * 128 + 128 < 180)).alias("ink"))


@R.add("SELECT vec_id, list_sum(list_transform(embedding, lambda v: greatest(least(round((CAST(v AS DOUBLE) * 128 + 128 - 90) * 255 / 125), 255), 0))) AS toned FROM embeddings")
def x13_tile_stretch(spark, d):
    tone = F.transform("embedding", lambda v: F.greatest(F.least(F.round((v.cast("double") * 128 + 128 - 90) * 255 / 125), F.lit(255.0)), F.lit(0.0)))
    return table(spark, d, "embeddings").select("vec_id", F.aggregate(tone, F.lit(0.0), lambda a, x: a + x).alias("toned"))


QUERIES, SQL = R.queries, R.sql
