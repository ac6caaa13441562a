"""Queries of routing: scans, tags, routes, content re-routing, reading order, reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom import schemas as S
from paperloom.common import table
from paperloom.functions import mathrule as M
from paperloom.functions.identity import line_uid
from paperloom.operators import router
from paperloom.plans.base import LINES, PAGES, REGIONS, Registry, lines, pages, regions

R = Registry()

_WS = r"[\s\x1c-\x1f\x{85}\p{Z}]"
_OPS = r"[=<>+\-×÷*/^√∑∫≤≥≠]"


def _rule(t: str) -> str:
    bare = f"regexp_replace(coalesce({t}, ''), '{_WS}', '', 'g')"
    ratio = f"(length({bare}) - length(regexp_replace({bare}, '[^\\p{{L}}]', '', 'g'))) / nullif(length({bare}), 0)"
    words = " ".join(f"WHEN list_contains(regexp_split_to_array(lower(coalesce({t}, '')), '{_WS}+'), '{w}') THEN 'word:{w}'" for w in S.MATH_WORDS)
    return f"CASE WHEN {bare} = '' THEN 'empty' {words} WHEN NOT regexp_matches({bare}, '{_OPS}') THEN 'no operator' WHEN NOT regexp_matches({bare}, '[\\p{{L}}\\p{{N}}]') THEN 'no operand' WHEN {ratio} < 0.40 THEN 'prose' ELSE 'ratio' END"


_ROUTED = f"""WITH {REGIONS}, {PAGES}, routed AS (
  SELECT r.page_id, printf('%s_b%02d_l%02d', r.page_id, r.block_id, r.line_id) AS line_uid, r.student, r.cie, r.page, r.block_id, r.line_id, r.x1, r.y1, r.x2, r.y2, r.tall, r.crop,
    coalesce(p.rule_pitch, 58.4) AS rule_pitch, CASE WHEN r.tall THEN 'diagram' ELSE 'text_ocr' END AS route,
    list_filter([CASE WHEN r.y2 - r.y1 < coalesce(p.rule_pitch, 58.4) * 0.55 THEN 'short' END, CASE WHEN r.x2 - r.x1 > coalesce(p.rule_pitch, 58.4) * 6.0 THEN 'full-line' END], lambda x: x IS NOT NULL) AS tags,
    CAST(row_number() OVER (PARTITION BY r.page_id ORDER BY r.y1, r.x1, r.block_id, r.line_id) - 1 AS INT) AS reading_order
  FROM regions r LEFT JOIN pages p USING (page_id) WHERE r.crop IS NOT NULL)"""

_RETEXT = f"""{_ROUTED}, {LINES}, said AS (
  SELECT line_uid, text FROM lines WHERE status = 'ok' AND text <> ''),
rerouted AS (
  SELECT r.*, t.text, {_rule("t.text")} AS why FROM routed r LEFT JOIN said t USING (line_uid)),
final AS (
  SELECT *, CASE WHEN route = 'diagram' THEN route WHEN why LIKE 'word:%' OR why = 'ratio' THEN 'math_ocr' ELSE route END AS new_route FROM rerouted)"""


def routed(spark, d) -> DataFrame:
    return router.route_regions(regions(spark, d), pages(spark, d))


def rerouted(spark, d) -> DataFrame:
    return router.reroute(routed(spark, d), router.spoken(lines(spark, d)))


@R.add(f"WITH {REGIONS} SELECT page_id, block_id, line_id, x1, y1, x2, y2, tall, crop FROM regions WHERE crop IS NOT NULL")
def s06_crop_manifest(spark, d):
    return regions(spark, d).filter(F.col("crop").isNotNull()).select("page_id", "block_id", "line_id", "x1", "y1", "x2", "y2", "tall", "crop")


@R.add(f"WITH {PAGES} SELECT page_id, rule_pitch FROM pages WHERE rule_pitch IS NOT NULL")
def s08_page_pitch(spark, d):
    return pages(spark, d).select("page_id", "rule_pitch").filter(F.col("rule_pitch").isNotNull())


@R.add(f"WITH {LINES} SELECT line_uid, text FROM lines WHERE status = 'ok' AND text <> ''")
def s10_ok_text(spark, d):
    return router.spoken(lines(spark, d))


@R.add(f"WITH {REGIONS} SELECT page_id, block_id, line_id, printf('%s_b%02d_l%02d', printf('s%02d_c%d_p%02d', student, cie, page), block_id, line_id) AS line_uid, x2 - x1 AS w, y2 - y1 AS h FROM regions")
def e01_keys(spark, d):
    from paperloom.functions.identity import page_id

    uid = line_uid(page_id(F.col("student"), F.col("cie"), F.col("page")), F.col("block_id"), F.col("line_id"))
    return regions(spark, d).select("page_id", "block_id", "line_id", uid.alias("line_uid"), (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"))


@R.add(f"{_ROUTED} SELECT line_uid, list_aggregate(tags, 'string_agg', '|') AS tags, route FROM routed".replace("list_aggregate(tags, 'string_agg', '|')", "array_to_string(tags, '|')"))
def e07_tags_and_route(spark, d):
    return routed(spark, d).select("line_uid", F.array_join("tags", "|").alias("tags"), "route")


@R.add(f"WITH {LINES} SELECT line_uid, {_rule('text')} AS why FROM lines")
def e09_math_rule(spark, d):
    return lines(spark, d).select("line_uid", M.math_reason(F.col("text")).alias("why"))


@R.add(
    f"""WITH docs AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
    ruled AS (SELECT {_rule("line")} AS why FROM docs)
    SELECT CASE WHEN why LIKE 'word:%' OR why = 'ratio' THEN 'math_ocr' ELSE 'text_ocr' END AS route, why, count(*) AS n FROM ruled GROUP BY 1, 2"""
)
def e09_math_rule_documents(spark, d):
    return router.route_documents(table(spark, d, "documents"))


@R.add(f"{_RETEXT} SELECT line_uid, route, new_route, why FROM final")
def e10_reroute(spark, d):
    return rerouted(spark, d).select("line_uid", "route", "new_route", "why")


@R.add(f"{_RETEXT} SELECT line_uid, CASE new_route WHEN 'text_ocr' THEN 'ocr' WHEN 'math_ocr' THEN 'math_ocr' WHEN 'diagram' THEN 'diagram_parser' ELSE 'manual_review' END AS processor FROM final")
def e11_processor(spark, d):
    return rerouted(spark, d).select("line_uid", M.processor(F.col("new_route")).alias("processor"))


@R.add(f"WITH {REGIONS}, {PAGES} SELECT r.page_id, r.block_id, r.line_id, coalesce(p.rule_pitch, 58.4) AS rule_pitch FROM regions r LEFT JOIN pages p USING (page_id)")
def j01_region_pitch(spark, d):
    return router.with_pitch(regions(spark, d), pages(spark, d)).select("page_id", "block_id", "line_id", "rule_pitch")


@R.add(f"{_RETEXT} SELECT line_uid, page_id, student, cie, text IS NOT NULL AS has_text FROM final")
def j02_routed_text(spark, d):
    return rerouted(spark, d).select("line_uid", "page_id", "student", "cie", F.col("text").isNotNull().alias("has_text"))


@R.add(f"{_ROUTED} SELECT route, count(*) AS n FROM routed GROUP BY 1")
def a01_by_route(spark, d):
    return routed(spark, d).groupBy("route").agg(F.count(F.lit(1)).alias("n"))


@R.add(f"{_ROUTED} SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM routed) GROUP BY 1")
def a01_by_tag(spark, d):
    return routed(spark, d).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@R.add(f"{_RETEXT} SELECT route || ' -> ' || new_route AS change, count(*) AS n FROM final WHERE route <> new_route GROUP BY 1")
def a02_route_changes(spark, d):
    change = F.concat_ws(" -> ", "route", "new_route").alias("change")
    return rerouted(spark, d).filter(F.col("route") != F.col("new_route")).groupBy(change).agg(F.count(F.lit(1)).alias("n"))


@R.add(f"WITH {REGIONS} SELECT count(*) FILTER (crop IS NOT NULL) AS routed, count(*) FILTER (crop IS NULL) AS no_crop, count(*) AS found, count(*) FILTER (crop IS NOT NULL) + count(*) FILTER (crop IS NULL) = count(*) AS agrees FROM regions")
def a24_reconcile(spark, d):
    got = regions(spark, d).agg(F.count_if(F.col("crop").isNotNull()).alias("routed"), F.count_if(F.col("crop").isNull()).alias("no_crop"), F.count(F.lit(1)).alias("found"))
    return got.withColumn("agrees", F.col("routed") + F.col("no_crop") == F.col("found"))


@R.add(f"{_ROUTED} SELECT line_uid, reading_order FROM routed")
def w01_reading_order(spark, d):
    return routed(spark, d).select("line_uid", "reading_order")


@R.add(f"""{_ROUTED}, two AS (SELECT page_id, reading_order, row_number() OVER (PARTITION BY page_id ORDER BY block_id, line_id) - 1 AS upstream FROM routed)
SELECT page_id, bool_and(reading_order = upstream) AS agrees FROM two GROUP BY 1""")
def w02_order_agreement(spark, d):
    w = Window.partitionBy("page_id").orderBy("block_id", "line_id")
    return routed(spark, d).withColumn("up", F.row_number().over(w) - 1).groupBy("page_id").agg(F.bool_and(F.col("reading_order") == F.col("up")).alias("agrees"))


@R.add(f"{_ROUTED} SELECT CAST(len(tags) AS INT) AS n_tags, array_to_string(tags, '|') AS tags, count(*) AS n FROM routed GROUP BY 1, 2 ORDER BY n DESC, tags LIMIT 3")
def o03_top_tag_sets(spark, d):
    return routed(spark, d).groupBy(F.size("tags").alias("n_tags"), F.array_join("tags", "|").alias("tags")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tags").limit(3)


@R.add(f"{_RETEXT} SELECT CASE new_route WHEN 'text_ocr' THEN 'ocr' WHEN 'math_ocr' THEN 'math_ocr' WHEN 'diagram' THEN 'diagram_parser' ELSE 'unassigned' END AS processor, new_route = 'text_ocr' AS taken, count(*) AS n FROM final GROUP BY 1, 2")
def pf_processor_selection(spark, d):
    return router.select_processor(rerouted(spark, d), "ocr")[1]


@R.add(f"{_RETEXT} SELECT student, cie, count(*) AS n_regions, count(*) FILTER (new_route = 'math_ocr') AS n_math, min(line_uid) AS first_uid FROM final GROUP BY 1, 2")
def k04_booklet_summary(spark, d):
    return rerouted(spark, d).groupBy("student", "cie").agg(F.count(F.lit(1)).alias("n_regions"), F.count_if(F.col("new_route") == "math_ocr").alias("n_math"), F.min("line_uid").alias("first_uid"))


@R.add(f"{_RETEXT} SELECT line_uid, page_id, rule_pitch, reading_order FROM final WHERE new_route = 'math_ocr'")
def s11_math_regions(spark, d):
    return router.select_processor(rerouted(spark, d), "math_ocr")[0].select("line_uid", "page_id", "rule_pitch", "reading_order")


@R.add(f"{_ROUTED} SELECT line_uid, x1, y1, x2, y2, crop AS crop_path, CASE WHEN tall THEN 'diagram_parser' ELSE 'ocr' END AS processor, route = 'review' AS ignored FROM routed")
def k03_routed_wire(spark, d):
    return router.wire(routed(spark, d)).select("line_uid", "bbox.*", "crop_path", "processor", "ignored")


QUERIES, SQL = R.queries, R.sql
