"""Queries over layout labels. Blocks and lines of the segmentation stand for labelled boxes, recognised lines for predictions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from paperloom import schemas as S
from paperloom.common import norm_path, table
from paperloom.functions import geometry as G
from paperloom.operators import annotations as A
from paperloom.operators.spatial import overlapping
from paperloom.sources import files, sinks
from paperloom.plans.base import LINES, PAGE_LINES, PAGES, Registry, lines, page_lines, pages

R = Registry()

_CAT = "CASE WHEN {0} THEN 'figure' WHEN x2 - x1 < 120 THEN 'crossed_out' WHEN block_id % 4 = 1 THEN 'math' ELSE 'paragraph' END"
_BOXES = f"""{PAGE_LINES}, blk AS (SELECT page_id, CAST(block_id AS INT) AS block_id, b.bbox[1] AS x1, b.bbox[2] AS y1, b.bbox[3] AS x2, b.bbox[4] AS y2 FROM pb),
boxes AS (
  SELECT page_id, block_id * 1000 AS box_id, CASE block_id % 3 WHEN 0 THEN 'paragraph' WHEN 1 THEN 'table' ELSE 'figure' END AS category, x1, y1, x2, y2 FROM blk
  UNION ALL SELECT page_id, block_id * 1000 + line_id + 1, {_CAT.format("tall")}, x1, y1, x2, y2 FROM page_lines),
sized AS (SELECT b.*, p.size[1] AS page_w, p.size[2] AS page_h FROM boxes b JOIN pages p USING (page_id)),
pairs AS (
  SELECT a.page_id, a.box_id AS a_id, b.box_id AS b_id, a.category AS a_cat, b.category AS b_cat,
    CASE WHEN (a.x2 - a.x1) * (a.y2 - a.y1) > 0 THEN greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) / ((a.x2 - a.x1) * (a.y2 - a.y1)) ELSE 0 END AS ioa
  FROM boxes a JOIN boxes b ON a.page_id = b.page_id AND a.box_id <> b.box_id)"""
_PRED = f"{LINES}, pred AS (SELECT page_id, block_id * 1000 + line_id AS ord, bbox[1] AS x1, bbox[2] AS y1, bbox[3] AS x2, bbox[4] AS y2, CASE WHEN tall THEN 'figure' WHEN line_id % 3 = 0 THEN 'math' ELSE 'paragraph' END AS category, confidence AS score FROM lines WHERE page_id IS NOT NULL AND bbox IS NOT NULL)"


def sized(spark, d):
    """Blocks and lines as labelled boxes with the size of their page; the pages are read once."""
    names = ("x1", "y1", "x2", "y2")
    corners = lambda c: [F.get(c, F.lit(i)).alias(n) for i, n in enumerate(names)]
    per_block = pages(spark, d).select("page_id", F.get("size", F.lit(0)).alias("page_w"), F.get("size", F.lit(1)).alias("page_h"), F.posexplode("blocks").alias("block_id", "b"))
    kind = F.element_at(F.array(F.lit("paragraph"), F.lit("table"), F.lit("figure")), F.col("block_id") % 3 + 1)
    line = lambda x, i: F.struct((i + 1).alias("k"), x["bbox"].alias("bbox"), x["tall"].alias("tall"))
    block = F.array(F.struct(F.lit(0).alias("k"), F.col("b.bbox").alias("bbox"), F.lit(None).cast("boolean").alias("tall")))
    parts = per_block.select("page_id", "page_w", "page_h", "block_id", F.explode(F.concat(block, F.coalesce(F.transform("b.lines", line), F.array().cast("array<struct<k:int,bbox:array<int>,tall:boolean>>")))).alias("p"))
    box = parts.select("page_id", "page_w", "page_h", "block_id", F.col("p.k").alias("k"), "p.tall", *corners("p.bbox"))
    cat = F.when(F.col("k") == 0, kind).when(F.col("tall"), "figure").when(F.col("x2") - F.col("x1") < 120, "crossed_out").when(F.col("block_id") % 4 == 1, "math").otherwise("paragraph")
    return box.select("page_id", (F.col("block_id") * 1000 + F.col("k")).alias("box_id"), cat.alias("category"), *names, "page_w", "page_h")


def boxes(spark, d):
    return sized(spark, d).drop("page_w", "page_h")


def predictions(spark, d):
    cat = F.when(F.col("tall"), "figure").when(F.col("line_id") % 3 == 0, "math").otherwise("paragraph")
    got = lines(spark, d).filter("page_id is not null and bbox is not null")
    return got.select("page_id", (F.col("block_id") * 1000 + F.col("line_id")).alias("ord"), *[F.get("bbox", F.lit(i)).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))], cat.alias("category"), F.col("confidence").alias("score"))


def gold_lines(spark, d):
    cat = F.when(F.col("tall"), "figure").when(F.col("line_id") % 3 == 0, "math").otherwise("paragraph")
    return page_lines(spark, d).select("page_id", (F.col("block_id") * 1000 + F.col("line_id")).alias("box_id"), cat.alias("category"), "x1", "y1", "x2", "y2")


@R.add(f"WITH {_BOXES} SELECT page_id, box_id, category, x1 AS x, y1 AS y, x2 - x1 AS w, y2 - y1 AS h FROM boxes")
def e05_xywh(spark, d):
    x, y, w, h = G.xywh(G.box())
    return boxes(spark, d).select("page_id", "box_id", "category", x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


@R.add(f"WITH {_BOXES} SELECT page_id, a_id AS inner_id, b_id AS outer_id, ioa FROM pairs WHERE ioa > 0")
def e17_ioa_pairs(spark, d):
    b = boxes(spark, d)
    return overlapping(b, b).filter("a_box_id <> b_box_id").select("page_id", F.col("a_box_id").alias("inner_id"), F.col("b_box_id").alias("outer_id"), "ioa")


@R.add(f"WITH {_BOXES}, best AS (SELECT page_id, a_id, max(ioa) AS best FROM pairs WHERE a_cat = 'crossed_out' AND b_cat <> 'crossed_out' GROUP BY 1, 2) SELECT b.page_id, b.box_id, coalesce(best.best, 0.0) AS best FROM boxes b LEFT JOIN best ON b.page_id = best.page_id AND b.box_id = best.a_id WHERE b.category = 'crossed_out'")
def j11_overlay(spark, d):
    b = boxes(spark, d)
    crossed, rest = b.filter("category = 'crossed_out'"), b.filter("category <> 'crossed_out'")
    best = overlapping(crossed, rest).groupBy("page_id", F.col("a_box_id").alias("box_id")).agg(F.max("ioa").alias("best"))
    return crossed.select("page_id", "box_id").join(best, ["page_id", "box_id"], "left").select("page_id", "box_id", F.coalesce("best", F.lit(0.0)).alias("best"))


@R.add(f"WITH {_BOXES} SELECT page_id, a_id AS inner_id, b_id AS outer_id FROM pairs WHERE b_cat IN ('figure','table') AND a_cat NOT IN ('figure','table') AND ioa >= 0.80")
def j12_nesting(spark, d):
    b = boxes(spark, d)
    holder = F.col("category").isin("figure", "table")
    return overlapping(b.filter(~holder), b.filter(holder)).filter("ioa >= 0.80").select("page_id", F.col("a_box_id").alias("inner_id"), F.col("b_box_id").alias("outer_id"))


@R.add(
    f"""WITH {_BOXES}, {_PRED}, o AS (
    SELECT b.page_id, b.block_id, p.category, p.score, p.ord, CASE WHEN p.ord IS NULL THEN 0 ELSE greatest(least(b.x2, p.x2) - greatest(b.x1, p.x1), 0) * greatest(least(b.y2, p.y2) - greatest(b.y1, p.y1), 0) / ((b.x2 - b.x1) * (b.y2 - b.y1)) END AS ioa
    FROM blk b LEFT JOIN pred p ON b.page_id = p.page_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY page_id, block_id ORDER BY ioa DESC, ord) AS k FROM o)
    SELECT page_id, block_id, CASE WHEN ioa < 0.35 THEN 'paragraph' ELSE category END AS category, CASE WHEN ioa >= 0.35 THEN score END AS score FROM r WHERE k = 1"""
)
def j13_label_transfer(spark, d):
    blk = boxes(spark, d).filter("box_id % 1000 = 0").select("page_id", F.expr("box_id div 1000").cast("int").alias("block_id"), "x1", "y1", "x2", "y2")
    return A.transfer_labels(blk, predictions(spark, d), "block_id", "ord").select("page_id", "block_id", "category", "score")


@R.add(
    f"""WITH {_BOXES}, human AS (SELECT DISTINCT page_id FROM boxes WHERE category = 'table'),
    u AS (SELECT page_id, 'human' AS origin FROM boxes WHERE category = 'table' UNION ALL SELECT page_id, 'model' FROM boxes WHERE page_id NOT IN (SELECT page_id FROM human))
    SELECT page_id, origin, count(*) AS n FROM u GROUP BY 1, 2"""
)
def j09_human_over_model(spark, d):
    b = boxes(spark, d)
    human = b.filter("category = 'table'").withColumn("origin", F.lit("human"))
    return A.human_or_model(human, b.withColumn("origin", F.lit("model"))).groupBy("page_id", "origin").agg(F.count(F.lit(1)).alias("n"))


# predictions one after the other, with the boxes so far in a list
def _admitted(start: str) -> str:
    ioa = "greatest(least(b.x2, p.x2) - greatest(b.x1, p.x1), 0) * greatest(least(b.y2, p.y2) - greatest(b.y1, p.y1), 0) / ((p.x2 - p.x1) * (p.y2 - p.y1))"
    return f"""{_BOXES.replace("WITH ", "")}, {_PRED},
    start AS (SELECT page_id, list(struct_pack(x1 := x1, y1 := y1, x2 := x2, y2 := y2)) AS have FROM ({start}) GROUP BY 1),
    numbered AS (SELECT pred.*, row_number() OVER (PARTITION BY page_id ORDER BY ord) AS k FROM pred WHERE x1 IS NOT NULL AND x2 IS NOT NULL),
    walk AS (
      SELECT page_id, 0::BIGINT AS k, NULL::INT AS ord, false AS new, coalesce(have, []) AS have FROM (SELECT DISTINCT page_id FROM numbered) LEFT JOIN start USING (page_id)
      UNION ALL SELECT w.page_id, p.k, p.ord, s.new, CASE WHEN s.new THEN list_append(w.have, struct_pack(x1 := p.x1, y1 := p.y1, x2 := p.x2, y2 := p.y2)) ELSE w.have END
      FROM walk w JOIN numbered p ON p.page_id = w.page_id AND p.k = w.k + 1,
      LATERAL (SELECT coalesce(list_max(list_transform(w.have, lambda b: CASE WHEN (p.x2 - p.x1) * (p.y2 - p.y1) > 0 THEN {ioa} ELSE 0 END)), 0) < {S.NEW_REGION_IOA} AS new) s),
    admitted AS (SELECT page_id, CAST(ord AS BIGINT) AS ord FROM walk WHERE new)"""


@R.add(f"WITH RECURSIVE {_admitted("SELECT * FROM boxes WHERE category = 'table'")} SELECT page_id, ord FROM admitted")
def f03_admit_predictions(spark, d):
    blk = boxes(spark, d).filter("category = 'table'")
    return A.admit_predictions(blk, predictions(spark, d))


@R.add(
    f"""WITH RECURSIVE {_admitted("SELECT * FROM blk")},
    human AS (SELECT page_id, category, x1, y1, x2, y2 FROM boxes WHERE category = 'table'),
    o AS (SELECT b.page_id, b.block_id, b.x1, b.y1, b.x2, b.y2, p.category, p.score, p.ord, CASE WHEN p.ord IS NULL THEN 0 ELSE greatest(least(b.x2, p.x2) - greatest(b.x1, p.x1), 0) * greatest(least(b.y2, p.y2) - greatest(b.y1, p.y1), 0) / ((b.x2 - b.x1) * (b.y2 - b.y1)) END AS ioa
      FROM blk b LEFT JOIN pred p ON b.page_id = p.page_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY page_id, block_id ORDER BY ioa DESC, ord) AS k FROM o),
    model AS (SELECT page_id, CASE WHEN ioa < 0.35 THEN 'paragraph' ELSE category END AS category, CASE WHEN ioa >= 0.35 THEN score END AS score, x1, y1, x2, y2, 'block' AS origin FROM r WHERE k = 1
      UNION ALL SELECT page_id, category, score, x1, y1, x2, y2, 'prediction' FROM admitted JOIN pred USING (page_id, ord))
    SELECT page_id, category, NULL::DOUBLE AS score, x1, y1, x2, y2, 'human' AS origin FROM human
    UNION ALL SELECT * FROM model WHERE page_id NOT IN (SELECT page_id FROM human)"""
)
def u06_hybrid_boxes(spark, d):
    """Labels of people where a page has any; elsewhere blocks with transferred labels and, after them, predictions that none of the boxes so far covers."""
    pred = predictions(spark, d)
    every = boxes(spark, d)
    blk = every.filter("box_id % 1000 = 0").select("page_id", F.expr("box_id div 1000").cast("int").alias("block_id"), "x1", "y1", "x2", "y2")
    named = A.transfer_labels(blk, pred, "block_id", "ord")
    new = A.admit_predictions(blk, pred).join(pred, ["page_id", "ord"])
    cols = ["page_id", "category", "score", "x1", "y1", "x2", "y2"]
    model = named.select(*cols, F.lit("block").alias("origin")).unionByName(new.select(*cols, F.lit("prediction").alias("origin")))
    human = every.filter("category = 'table'").withColumn("score", F.lit(None).cast("double")).select(*cols, F.lit("human").alias("origin"))
    return A.human_or_model(human, model)


@R.add(f"WITH {_BOXES} SELECT page_id, box_id FROM sized WHERE category <> 'table' AND y2 - y1 >= 20 AND x2 - x1 >= 0.02::DOUBLE * page_w")
def pk_block_floor(spark, d):
    return sized(spark, d).filter((F.col("category") != "table") & (F.col("y2") - F.col("y1") >= 20) & (F.col("x2") - F.col("x1") >= F.lit(0.02) * F.col("page_w"))).select("page_id", "box_id")


_STAR = f"{_BOXES}, kept AS (SELECT s.*, list_position(['paragraph','math','figure','table','code','crossed_out'], category) AS category_id, row_number() OVER (PARTITION BY page_id ORDER BY box_id) AS ordinal FROM sized s)"


@R.add(f"WITH {_STAR} SELECT page_id, page_id || '.png' AS file_name, CAST(ordinal AS INT) AS ordinal, CAST(category_id AS INT) AS category_id, category, CAST(x1 AS DOUBLE) AS x1, CAST(y2 AS DOUBLE) AS y2, page_w FROM kept")
def j04_star_and_ordinals(spark, d):
    """Label documents taken apart and joined again: images, annotations, categories."""
    images, annotations, _ = files.coco_parts(sinks.label_document(sized(spark, d)))
    return A.star(images, annotations).select("page_id", "file_name", F.col("id").alias("ordinal"), "category_id", "category", "x1", "y2", "page_w")


@R.add(
    f"""WITH {_STAR} SELECT page_id, box_id, printf('%d %.6f %.6f %.6f %.6f', category_id - 1,
      (greatest(least(x1, page_w), 0) + greatest(least(x2, page_w), 0)) / 2.0 / page_w, (greatest(least(y1, page_h), 0) + greatest(least(y2, page_h), 0)) / 2.0 / page_h,
      (greatest(least(x2, page_w), 0) - greatest(least(x1, page_w), 0)) / page_w, (greatest(least(y2, page_h), 0) - greatest(least(y1, page_h), 0)) / page_h) AS line FROM kept"""
)
def e06_yolo_lines(spark, d):
    line = G.yolo_line(A.category_id(F.col("category")) - 1, G.box(), F.col("page_w"), F.col("page_h"))
    return sized(spark, d).select("page_id", "box_id", line.alias("line"))


@R.add(
    f"""WITH {_BOXES}, v AS (
    SELECT 'no area' AS rule, 'error' AS severity, page_id, box_id FROM sized WHERE x2 <= x1 OR y2 <= y1
    UNION ALL SELECT 'outside', 'error', page_id, box_id FROM sized WHERE x2 > x1 AND y2 > y1 AND (x1 < -1 OR y1 < -1 OR x2 > page_w + 1 OR y2 > page_h + 1)
    UNION ALL SELECT 'tiny', 'warning', page_id, box_id FROM sized WHERE x2 > x1 AND y2 > y1 AND category <> 'crossed_out' AND (x2 - x1 < 12 OR y2 - y1 < 12 OR (x2 - x1) * (y2 - y1) < 400)
    UNION ALL SELECT 'overlay', 'error', b.page_id, b.box_id FROM sized b LEFT JOIN (SELECT page_id, a_id, max(ioa) AS m FROM pairs WHERE b_cat <> 'crossed_out' GROUP BY 1, 2) x ON x.page_id = b.page_id AND x.a_id = b.box_id
      WHERE b.category = 'crossed_out' AND b.x2 > b.x1 AND b.y2 > b.y1 AND coalesce(x.m, 0) < 0.30
    UNION ALL SELECT DISTINCT 'nested', 'error', page_id, a_id FROM pairs WHERE b_cat IN ('figure','table') AND a_cat NOT IN ('figure','table','crossed_out') AND ioa >= 0.80)
    SELECT * FROM v"""
)
def pv2_box_violations(spark, d):
    return A.box_violations(sized(spark, d))


@R.add(f"WITH {_BOXES}, c(category) AS (SELECT unnest(['paragraph','math','figure','table','code','crossed_out'])), n AS (SELECT c.category, count(b.box_id) AS n FROM c LEFT JOIN boxes b USING (category) GROUP BY 1) SELECT category, n, n / nullif(sum(n) OVER (), 0) AS share, n > 0 AND n < 30 AS rare, n = 0 AS absent FROM n")
def a13_class_shares(spark, d):
    counts = boxes(spark, d).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    enum = spark.createDataFrame([(c,) for c in S.CATEGORIES], "category string")
    n = F.coalesce("n", F.lit(0))
    all_classes = enum.join(counts, "category", "left").select("category", n.alias("n"))
    return all_classes.select("category", "n", F.try_divide("n", F.sum("n").over(Window.partitionBy())).alias("share"), ((F.col("n") > 0) & (F.col("n") < 30)).alias("rare"), (F.col("n") == 0).alias("absent"))


@R.add(f"WITH {_PRED} SELECT page_id, max(score) AS best, count(*) FILTER (score >= 0.5) AS kept, coalesce(max(score) < 0.35, true) OR count(*) < 2 AS review FROM pred GROUP BY 1")
def a20_page_scores(spark, d):
    p = predictions(spark, d)
    return p.groupBy("page_id").agg(F.max("score").alias("best"), F.count_if(F.col("score") >= 0.5).alias("kept"), (F.coalesce(F.max("score") < 0.35, F.lit(True)) | (F.count(F.lit(1)) < 2)).alias("review"))


@R.add(f"WITH {_PRED}, r AS (SELECT page_id, max(score) AS best, count(*) AS n FROM pred GROUP BY 1 HAVING coalesce(max(score) < 0.35, true) OR count(*) < 2) SELECT page_id || chr(9) || coalesce(printf('%.3f', best), '') || chr(9) || n AS line FROM r")
def k13_review_list(spark, d):
    return A.review_list(predictions(spark, d))


@R.add(
    f"""WITH {_BOXES}, done AS (SELECT DISTINCT page_id FROM lines WHERE status = 'failed'), {LINES},
    c AS (SELECT 'label ' || category AS what, count(*) AS n FROM boxes SEMI JOIN done USING (page_id) GROUP BY 1)
    SELECT what, n, NULL::VARCHAR AS page_id FROM c UNION ALL SELECT 'available', count(*), NULL FROM pages UNION ALL SELECT 'reviewed', count(*), NULL FROM pages SEMI JOIN done USING (page_id)
    UNION ALL SELECT 'next', NULL, min(page_id) FROM pages ANTI JOIN done USING (page_id)""".replace("done AS (SELECT DISTINCT page_id FROM lines WHERE status = 'failed'), " + LINES, LINES + ", done AS (SELECT DISTINCT page_id FROM lines WHERE status = 'failed')")
)
def a28_progress(spark, d):
    """Pages available and reviewed, labels of the reviewed ones, and the next page to look at. A page with a failed line stands for a reviewed one."""
    done = lines(spark, d).filter("status = 'failed' and page_id is not null").select("page_id").distinct()
    return A.progress(pages(spark, d).select("page_id"), boxes(spark, d), done)


@R.add(f"WITH {_PRED} SELECT page_id, ord, category FROM pred WHERE score >= 0.5")
def pi_confident(spark, d):
    return predictions(spark, d).filter("score >= 0.5").select("page_id", "ord", "category")


_SM = r"sm AS (SELECT DISTINCT regexp_replace(replace(lower(trim(source)), '\', '/'), '^(\./+)+', '') AS source FROM sample_manifest WHERE source IS NOT NULL)"


@R.add(f"WITH {PAGES}, {_SM} SELECT 'page only' AS side, source FROM pages WHERE source NOT IN (SELECT source FROM sm) UNION ALL SELECT 'sample only', source FROM sm WHERE source NOT IN (SELECT source FROM pages WHERE source IS NOT NULL)")
def u04_both_ways(spark, d):
    p = pages(spark, d).filter("source is not null").select("page_id", "source")
    s = table(spark, d, "sample_manifest").filter("source is not null").select(norm_path(F.col("source")).alias("source")).distinct()
    a = p.join(s, "source", "left_anti").select(F.lit("page only").alias("side"), "source")
    return a.unionByName(s.join(p.select("source").distinct(), "source", "left_anti").select(F.lit("sample only").alias("side"), "source"))


@R.add(f"WITH {PAGES}, {_SM} SELECT page_id FROM pages WHERE source IN (SELECT source FROM sm)")
def j19_in_sample(spark, d):
    s = table(spark, d, "sample_manifest").select(norm_path(F.col("source")).alias("source"))
    return pages(spark, d).join(s, "source", "left_semi").select("page_id")


@R.add(f"WITH {PAGES}, {_SM} SELECT page_id FROM pages WHERE source NOT IN (SELECT source FROM sm) OR source IS NULL")
def j08_unlabelled(spark, d):
    s = table(spark, d, "sample_manifest").select(norm_path(F.col("source")).alias("source"))
    return pages(spark, d).join(s, "source", "left_anti").select("page_id")


@R.add(f"WITH {_BOXES} (SELECT category FROM boxes EXCEPT SELECT unnest(['paragraph','math','figure'])) UNION ALL (SELECT unnest(['paragraph','math','figure','code']) EXCEPT SELECT category FROM boxes)")
def u03_schema_difference(spark, d):
    used = boxes(spark, d).select("category").distinct()
    known = lambda xs: spark.createDataFrame([(x,) for x in xs], "category string")
    return used.subtract(known(S.CATEGORIES[:3])).unionByName(known([*S.CATEGORIES[:3], "code"]).subtract(used))


@R.add(f"WITH {_BOXES} SELECT page_id FROM pages WHERE page_id NOT IN (SELECT page_id FROM boxes WHERE category = 'figure')")
def pv9_pages_without_boxes(spark, d):
    """Pages without a box, of those labelled as figures."""
    p = pages(spark, d).select("page_id")
    return p.join(boxes(spark, d).filter("category = 'figure'").select("page_id").distinct(), "page_id", "left_anti")


@R.add(
    f"""WITH {_BOXES}, r AS (SELECT page_id, box_id, x1 * 0.5::DOUBLE + 400.0 AS a, y1 * 1.25::DOUBLE AS b, x2 * 0.5::DOUBLE + 400.0 AS c, y2 * 1.25::DOUBLE AS e, page_w, page_h FROM sized)
    SELECT page_id, box_id, greatest(least(a, page_w), 0) AS x1, greatest(least(b, page_h), 0) AS y1, greatest(least(c, page_w), 0) AS x2, greatest(least(e, page_h), 0) AS y2 FROM r"""
)
def e14_remap_scaled(spark, d):
    s = sized(spark, d)
    w, h = F.col("page_w").cast("double"), F.col("page_h").cast("double")
    cut = lambda c, k, o, m: G.clip(F.col(c) * k + o, F.lit(0.0), m)
    return s.select("page_id", "box_id", cut("x1", 0.5, 400.0, w).alias("x1"), cut("y1", 1.25, 0.0, h).alias("y1"), cut("x2", 0.5, 400.0, w).alias("x2"), cut("y2", 1.25, 0.0, h).alias("y2"))


@R.add(
    f"""WITH {_BOXES}, k AS (SELECT *, page_w / 2.0 AS cx, page_h / 2.0 AS cy, cos(radians(1.5)) AS c, sin(radians(1.5)) AS s FROM sized),
    q AS (SELECT page_id, box_id, page_w, page_h, unnest([x1, x2, x2, x1]) AS x, unnest([y1, y1, y2, y2]) AS y, cx, cy, c, s FROM k),
    t AS (SELECT page_id, box_id, page_w, page_h, c * (x - cx) + s * (y - cy) + cx - 3 + 7 AS x, c * (y - cy) - s * (x - cx) + cy - 5 + 11 AS y FROM q),
    m AS (SELECT page_id, box_id, greatest(least(min(x), any_value(page_w)), 0) AS x1, greatest(least(min(y), any_value(page_h)), 0) AS y1, greatest(least(max(x), any_value(page_w)), 0) AS x2, greatest(least(max(y), any_value(page_h)), 0) AS y2 FROM t GROUP BY 1, 2)
    SELECT page_id, box_id, CAST(round(x1) AS INT) AS x1, CAST(round(y1) AS INT) AS y1, CAST(round(x2) AS INT) AS x2, CAST(round(y2) AS INT) AS y2 FROM m WHERE x2 > x1 AND y2 > y1"""
)
def e14_remap_rotated(spark, d):
    s = sized(spark, d)
    size = (F.col("page_w").cast("double"), F.col("page_h").cast("double"))
    new = G.remap_box(G.box(), F.lit(1.5), size, (F.lit(3), F.lit(5)), F.lit(1.0), (F.lit(7), F.lit(11)), size)
    out = s.select("page_id", "box_id", *[v.alias(n) for v, n in zip(new, ("x1", "y1", "x2", "y2"), strict=True)]).filter("x1 is not null")
    return out.select("page_id", "box_id", *[F.round(n).cast("int").alias(n) for n in ("x1", "y1", "x2", "y2")])


@R.add(
    f"""WITH {_BOXES}, r AS (SELECT *, x2 * 1.03::DOUBLE AS e FROM sized)
    SELECT page_id, box_id, x1 * 1.03::DOUBLE AS x1, least(e, page_w) AS x2, e > page_w OR x1 * 1.03 > page_w OR y1 * 1.03 > page_h OR y2 * 1.03 > page_h OR x1 < 0 OR y1 < 0 AS clipped FROM r"""
)
def e16_rescale(spark, d):
    return A.rescale(sized(spark, d), F.lit(1.03), F.col("page_w"), F.col("page_h")).select("page_id", "box_id", "x1", "x2", "clipped")


@R.add(f"WITH {_BOXES} SELECT max(greatest(abs(x1 * 0.03::DOUBLE), abs(y1 * 0.03::DOUBLE), abs(x2 * 0.03::DOUBLE), abs(y2 * 0.03::DOUBLE))) AS max_shift FROM sized")
def a21_max_shift(spark, d):
    return sized(spark, d).agg(F.max(F.greatest(*[F.abs(F.col(c) * 0.03) for c in ("x1", "y1", "x2", "y2")])).alias("max_shift"))


@R.add(f"WITH {_BOXES}, {_PRED}, g AS (SELECT page_id, block_id * 1000 + line_id AS box_id, CASE WHEN tall THEN 'figure' WHEN line_id % 3 = 0 THEN 'math' ELSE 'paragraph' END AS category, x1, y1, x2, y2 FROM page_lines), m AS (SELECT g.page_id, g.box_id, g.category, p.ord, row_number() OVER (PARTITION BY g.page_id, p.ord ORDER BY i / (ga + pa - i) DESC, p.score DESC NULLS LAST, g.box_id DESC) AS k FROM (SELECT *, (x2 - x1) * (y2 - y1) AS ga FROM g) g JOIN (SELECT *, (x2 - x1) * (y2 - y1) AS pa FROM pred) p ON g.page_id = p.page_id AND g.category = p.category, LATERAL (SELECT greatest(least(g.x2, p.x2) - greatest(g.x1, p.x1), 0) * greatest(least(g.y2, p.y2) - greatest(g.y1, p.y1), 0) AS i) WHERE i / (ga + pa - i) >= 0.5), h AS (SELECT category, count(*) AS n_hit FROM (SELECT DISTINCT page_id, box_id, category FROM m WHERE k = 1) GROUP BY 1), gc AS (SELECT category, count(*) AS n_gold FROM g GROUP BY 1), pc AS (SELECT category, count(*) AS n_pred FROM pred GROUP BY 1) SELECT coalesce(gc.category, pc.category) AS category, coalesce(n_gold, 0) AS n_gold, coalesce(n_pred, 0) AS n_pred, coalesce(n_hit, 0) AS n_hit, coalesce(n_hit, 0) / n_pred AS precision, coalesce(n_hit, 0) / n_gold AS recall FROM gc FULL JOIN pc ON gc.category = pc.category LEFT JOIN h ON h.category = coalesce(gc.category, pc.category)")
def a27_precision_recall(spark, d):
    return A.precision_recall(gold_lines(spark, d), predictions(spark, d).withColumnRenamed("ord", "box_id"))


@R.add(
    f"""WITH {_BOXES}, {_PRED}, g AS (SELECT page_id, block_id * 1000 + line_id AS box_id, CASE WHEN tall THEN 'figure' WHEN line_id % 3 = 0 THEN 'math' ELSE 'paragraph' END AS category, x1, y1, x2, y2 FROM page_lines),
    o AS (SELECT p.page_id, p.ord, p.category, p.score, g.box_id, greatest(least(g.x2, p.x2) - greatest(g.x1, p.x1), 0) * greatest(least(g.y2, p.y2) - greatest(g.y1, p.y1), 0) AS i,
      (g.x2 - g.x1) * (g.y2 - g.y1) + (p.x2 - p.x1) * (p.y2 - p.y1) AS u FROM g JOIN pred p ON g.page_id = p.page_id AND g.category = p.category WHERE p.score IS NOT NULL),
    best AS (SELECT *, i / (u - i) AS iou FROM o WHERE i > 0 QUALIFY row_number() OVER (PARTITION BY page_id, ord ORDER BY i / (u - i) DESC, box_id) = 1),
    t AS (SELECT (50 + 5 * k) / 100.0::DOUBLE AS t FROM range(10) r(k)),
    hit AS (SELECT t, category, score FROM best JOIN t ON iou >= t QUALIFY row_number() OVER (PARTITION BY t, page_id, box_id ORDER BY score DESC, ord) = 1),
    seen AS (SELECT t, category, score, count(*) AS n FROM pred, t WHERE score IS NOT NULL GROUP BY ALL),
    s AS (SELECT seen.*, coalesce(h, 0) AS h FROM seen LEFT JOIN (SELECT t, category, score, count(*) AS h FROM hit GROUP BY ALL) x USING (t, category, score)),
    r AS (SELECT *, sum(h) OVER w AS hits, sum(n) OVER w AS total FROM s WINDOW w AS (PARTITION BY t, category ORDER BY score DESC)),
    a AS (SELECT t, category, sum(h * hits / total)::DOUBLE AS area FROM r GROUP BY ALL),
    n AS (SELECT category, count(*) AS n_gold FROM g GROUP BY 1)
    SELECT category, round(coalesce(max(area / n_gold) FILTER (t = 0.5), 0.0)::DOUBLE, 6) AS ap50, round(avg(coalesce(area / n_gold, 0.0))::DOUBLE, 6) AS ap50_95 FROM n LEFT JOIN a USING (category) GROUP BY 1"""
)
def a27_average_precision(spark, d):
    """Of the lines against the segmentation's: matched boxes at overlaps of 0.50 to 0.95."""
    found = A.mean_average_precision(gold_lines(spark, d), predictions(spark, d).withColumnRenamed("ord", "box_id"))
    return found.select("category", F.round("ap50", 6).alias("ap50"), F.round("ap50_95", 6).alias("ap50_95"))


@R.add(f"WITH {_BOXES}, claims AS (SELECT page_id, box_id, CASE WHEN box_id % 1000 < 3 THEN 'a' ELSE CAST(box_id AS VARCHAR) END AS k FROM boxes WHERE box_id < 1000) SELECT page_id, k AS box_key, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM boxes JOIN claims USING (page_id, box_id) GROUP BY 1, 2 UNION ALL SELECT page_id, CAST(box_id AS VARCHAR), x1, y1, x2, y2 FROM boxes WHERE box_id >= 1000")
def j15_merge_and_default(spark, d):
    b = boxes(spark, d).select(F.col("page_id").alias("page"), F.col("box_id").alias("ordinal"), "x1", "y1", "x2", "y2")
    key = F.when(F.col("ordinal") % 1000 < 3, "a").otherwise(F.col("ordinal").cast("string"))
    claims = b.filter("ordinal < 1000").select("page", "ordinal", key.alias("box_key"), F.lit("math").alias("label"))
    return A.apply_assignments(b, claims).select(F.col("page").alias("page_id"), "box_key", "x1", "y1", "x2", "y2")


QUERIES, SQL = R.queries, R.sql
