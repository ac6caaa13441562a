"""Queries of readers and writers, over documents built from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.common import table
from paperloom.operators import annotations as A
from paperloom.plans.base import PAGE_LINES, PAGES, Registry, pages
from paperloom.plans.labelling import _BOXES, sized
from paperloom.plans.sampling import _SAMPLE, sample
from paperloom.sources import files, sinks

R = Registry()
_P = r"regexp_replace(replace(lower(trim(source)), '\', '/'), '^(\./+)+', '')"
_RE = r"'student_(\d+)/cie_(\d+)/page_(\d+)\.png$'"


@R.add(f"SELECT source, CAST(nullif(regexp_extract({_P}, {_RE}, 1), '') AS INT) AS student, CAST(nullif(regexp_extract({_P}, {_RE}, 2), '') AS INT) AS cie, CAST(nullif(regexp_extract({_P}, {_RE}, 3), '') AS INT) AS page FROM sample_manifest")
def s01_corpus_paths(spark, d):
    s = table(spark, d, "sample_manifest")
    return s.select("source", *files.path_keys(F.col("source"))[:3])


@R.add(f"WITH {_BOXES} SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY box_id) AS INT) AS id, list_position(['paragraph','math','figure','table','code','crossed_out'], category)::INT AS category_id, CAST(x1 AS DOUBLE) AS x, CAST(x2 - x1 AS DOUBLE) AS w FROM sized")
def s12_k09_label_documents(spark, d):
    _, ann, _ = files.coco_parts(sinks.label_document(sized(spark, d)))
    return ann.select("page_id", "id", "category_id", F.get("bbox", F.lit(0)).alias("x"), F.get("bbox", F.lit(2)).alias("w"))


def _assignments(spark, d):
    n = F.size("blocks")
    value = F.when(n <= 2, '"skip"').when(n == 3, "not json {").otherwise('{"0+1":"math","2":["table","drop"]}')
    return pages(spark, d).select(F.col("page_id").alias("page"), value.alias("value"))


@R.add(f"""WITH {PAGES}, v(box_key, label, ordinal) AS (VALUES ('0+1', 'math', 0), ('0+1', 'math', 1), ('2', 'table', 2), ('2', 'drop', 2))
SELECT page_id AS page, box_key, label, ordinal FROM pages, v WHERE len(blocks) > 3""")
def s13_assignments(spark, d):
    return A.explode_assignments(_assignments(spark, d))[1]


@R.add(f"WITH {PAGES} SELECT page_id AS page FROM pages WHERE len(blocks) <= 2")
def s13_skipped_pages(spark, d):
    return A.explode_assignments(_assignments(spark, d))[0]


@R.add(f"WITH {PAGES} SELECT student, page_id AS key, coalesce(rule_pitch, 58.4) AS pitch FROM pages WHERE student IS NOT NULL")
def s15_keyed_map(spark, d):
    """Maps of at most fifty page numbers of a booklet each, taken apart again."""
    entry = F.struct("page_id", F.coalesce("rule_pitch", F.lit(58.4)))
    docs = pages(spark, d).filter("student is not null").groupBy("student", "cie", F.expr("page div 50").alias("part")).agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("doc"))
    return files.keyed_map(docs, "double").select("student", "key", F.col("value").alias("pitch"))


@R.add(
    f"""WITH {_BOXES}, {_SAMPLE}, im AS (SELECT p.page_id, min(s.split) AS split FROM pages p JOIN sample s USING (source) WHERE s.split IS NOT NULL GROUP BY 1),
    b AS (SELECT * FROM sized WHERE category = 'table')
    SELECT split, im.page_id || '.png' AS file_name, count(b.box_id) AS n_lines, count(b.box_id) = 0 AS negative FROM im LEFT JOIN b ON b.page_id = im.page_id GROUP BY ALL"""
)
def k08_training_files(spark, d):
    s = sample(spark, d).filter("split is not null and source is not null")
    im = pages(spark, d).join(s, "source").groupBy("page_id").agg(F.min("split").alias("split")).withColumn("file_name", F.concat("page_id", F.lit(".png")))
    got = A.training_files(im, sized(spark, d).filter("category = 'table'"))
    n = F.when(F.col("body") == "", 0).otherwise(F.size(F.split("body", "\n")))
    return got.select("split", "file_name", n.cast("bigint").alias("n_lines"), (F.col("body") == "").alias("negative"))


@R.add(f"WITH {PAGES} SELECT page_id, student, cie, page, rule_pitch, rules_removed, ink_pixels, ink_covered, len(blocks)::INT AS n_blocks, coalesce(list_sum(list_transform(blocks, lambda b: len(b.lines))), 0)::INT AS n_lines FROM pages")
def k01_flat_pages(spark, d):
    return sinks.flat_views(pages(spark, d))["pages"]


@R.add(f"WITH {PAGE_LINES} SELECT page_id, CAST(block_id AS INT) AS block_id, b.bbox[1] AS x1, b.bbox[2] AS y1, b.bbox[3] AS x2, b.bbox[4] AS y2, len(b.lines)::INT AS n_lines FROM pb")
def k01_flat_blocks(spark, d):
    return sinks.flat_views(pages(spark, d))["blocks"]


@R.add(f"WITH {PAGE_LINES} SELECT page_id, block_id, line_id, x1, y1, x2, y2, parts, tall FROM page_lines")
def k01_flat_lines(spark, d):
    return sinks.flat_views(pages(spark, d))["lines"]


@R.add(f"WITH {PAGES} SELECT count(rule_pitch) AS n, count(*) FILTER (rule_pitch IS NULL) AS n_missing, min(rule_pitch) AS least, round(avg(rule_pitch), 6) AS mean, max(rule_pitch) AS most FROM pages")
def k07_side_stats(spark, d):
    return sinks.stats(pages(spark, d), "rule_pitch")


@R.add(f"""WITH {_SAMPLE}, s AS (SELECT DISTINCT split FROM sample WHERE split IS NOT NULL AND source IS NOT NULL), c(i, n) AS (VALUES (0, 'paragraph'), (1, 'math'), (2, 'figure'), (3, 'table'), (4, 'code'), (5, 'crossed_out'))
SELECT CASE split WHEN 'train' THEN 1 WHEN 'val' THEN 2 ELSE 3 END AS place, split || ': images/' || split AS line FROM s
UNION ALL SELECT 0, 'path: .' UNION ALL SELECT 10, 'nc: 6' UNION ALL SELECT 11, 'names:' UNION ALL SELECT 12 + i, '  ' || i || ': ' || n FROM c""")
def k08_data_yaml(spark, d):
    return sinks.data_yaml(sample(spark, d).filter("split is not null and source is not null"))


@R.add(f"WITH {_SAMPLE} SELECT coalesce(split, 'none') || '/' || file_name AS link, min(source) AS target FROM sample WHERE file_name IS NOT NULL AND source IS NOT NULL GROUP BY 1")
def k14_sample_links(spark, d):
    return sinks.sample_links(sample(spark, d))


QUERIES, SQL = R.queries, R.sql
