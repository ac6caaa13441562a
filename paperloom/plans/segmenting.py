"""Queries over segmentation records and manifest geometry."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from paperloom.functions import geometry as G
from paperloom.operators import segmentation as O
from paperloom.operators.router import with_pitch
from paperloom.operators.sampling import exact_quantile
from paperloom.plans.base import PAGE_LINES, PAGES, REGIONS, Registry, page_lines, pages, regions

R = Registry()
_RP = f"WITH {REGIONS}, {PAGES}, rp AS (SELECT r.*, coalesce(p.rule_pitch, 58.4) AS rule_pitch, p.size FROM regions r LEFT JOIN pages p USING (page_id))"


def _rp(spark, d):
    return with_pitch(regions(spark, d), pages(spark, d))


@R.add(f"WITH {PAGE_LINES} SELECT page_id, block_id, line_id, x1, y1, x2, y2, parts, tall FROM page_lines")
def s07_nested_lines(spark, d):
    return page_lines(spark, d).select("page_id", "block_id", "line_id", "x1", "y1", "x2", "y2", "parts", "tall")


@R.add(f"WITH {PAGES} SELECT page_id, page, source FROM pages WHERE page <> 1")
def s02_content_pages(spark, d):
    return pages(spark, d).filter(F.col("page") != 1).select("page_id", "page", "source")


@R.add(f"WITH {PAGES} SELECT count(*) FILTER (page = 1) AS n_covers, count(*) FILTER (page <> 1) AS n_content FROM pages")
def pa_cover_counts(spark, d):
    return pages(spark, d).agg(F.count_if(F.col("page") == 1).alias("n_covers"), F.count_if(F.col("page") != 1).alias("n_content"))


@R.add(f"WITH {PAGES} SELECT page_id, source, CASE WHEN page = 1 THEN 'cover' ELSE 'content' END AS page_kind FROM pages")
def s03_page_kind(spark, d):
    return pages(spark, d).select("page_id", "source", F.when(F.col("page") == 1, "cover").otherwise("content").alias("page_kind"))


@R.add(f"WITH {PAGES} SELECT student, cie, count(*) AS n_pages, min(page) AS first_page, max(page) AS last_page, CAST(max(page) - min(page) + 1 - count(DISTINCT page) AS BIGINT) AS n_missing FROM pages GROUP BY 1, 2")
def s04_booklets(spark, d):
    """Booklets as one row each, whatever their length: pages, the first and last of them, and how many between these are missing."""
    one = pages(spark, d).groupBy("student", "cie", "page").agg(F.count(F.lit(1)).alias("n"))  # combined before the shuffle
    known = F.count("page")
    return one.groupBy("student", "cie").agg(F.sum("n").alias("n_pages"), F.min("page").alias("first_page"), F.max("page").alias("last_page"), (F.max("page") - F.min("page") + 1 - known).cast("bigint").alias("n_missing"))


@R.add(f"{_RP} SELECT page_id, block_id, line_id, CASE WHEN height < rule_pitch * 0.20 THEN 'too low' WHEN width < rule_pitch * 0.08 THEN 'too narrow' END AS reason FROM rp")
def pb_too_small(spark, d):
    return _rp(spark, d).select("page_id", "block_id", "line_id", O.skip_reason(F.col("width"), F.col("height"), F.col("rule_pitch")).alias("reason"))


@R.add(f"{_RP} SELECT page_id, count(*) AS n FROM rp WHERE width * height >= 0.006 * rule_pitch * rule_pitch GROUP BY 1")
def pc_component_area(spark, d):
    p = F.col("rule_pitch")
    return _rp(spark, d).filter(F.col("width") * F.col("height") >= F.lit(0.006) * p * p).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))


@R.add(f"WITH {PAGE_LINES} SELECT page_id, block_id, line_id, (y2 - y1) > coalesce(rule_pitch, 58.4) * 1.6 AS is_tall FROM page_lines")
def pd_tall_flag(spark, d):
    return page_lines(spark, d).select("page_id", "block_id", "line_id", O.is_tall(F.col("y1"), F.col("y2"), F.coalesce("rule_pitch", F.lit(58.4))).alias("is_tall"))


def _rules(spark, d):
    """Ruled rows of a page at whole multiples of its pitch, as many as were removed."""
    p = pages(spark, d).filter("rule_pitch is not null and rules_removed > 0")
    return p.select("page_id", F.explode(F.sequence(F.lit(1), F.col("rules_removed").cast("int"))).alias("k"), "rule_pitch").select("page_id", F.floor(F.col("k") * F.col("rule_pitch")).cast("int").alias("rule_y"))


_RULES = "rules AS (SELECT page_id, CAST(floor(k * rule_pitch) AS INT) AS rule_y FROM (SELECT page_id, rule_pitch, unnest(range(1, rules_removed + 1)) AS k FROM pages WHERE rule_pitch IS NOT NULL AND rules_removed > 0))"


@R.add(
    f"""WITH {PAGE_LINES}, {_RULES}, ranked AS (
    SELECT l.page_id, l.block_id, l.line_id, l.y2, r.rule_y, row_number() OVER (PARTITION BY l.page_id, l.block_id, l.line_id ORDER BY abs(l.y2 - r.rule_y), r.rule_y) AS k
    FROM page_lines l LEFT JOIN rules r USING (page_id))
    SELECT page_id, block_id, line_id, CAST(rule_y AS DOUBLE) AS rule_y FROM ranked WHERE k = 1"""
)
def j10_nearest_rule(spark, d):
    items = page_lines(spark, d).select("page_id", "block_id", "line_id", F.col("y2").alias("bottom"))
    return O.nearest_rule(items, _rules(spark, d), ["page_id"], ["block_id", "line_id"]).select("page_id", "block_id", "line_id", "rule_y")


@R.add(
    f"""WITH {PAGE_LINES}, {_RULES}, ranked AS (
    SELECT l.page_id, l.block_id, l.line_id, l.tall, l.rule_pitch, abs(l.y2 - r.rule_y) AS off, row_number() OVER (PARTITION BY l.page_id, l.block_id, l.line_id ORDER BY abs(l.y2 - r.rule_y), r.rule_y) AS k
    FROM page_lines l LEFT JOIN rules r USING (page_id))
    SELECT page_id, CASE WHEN tall THEN 'tall' WHEN off <= 0.45 * rule_pitch THEN 'snapped' ELSE 'orphan' END AS kind, count(*) AS n FROM ranked WHERE k = 1 GROUP BY 1, 2"""
)
def u02_snapped_orphan_tall(spark, d):
    items = page_lines(spark, d).select("page_id", "block_id", "line_id", "tall", "rule_pitch", F.col("y2").alias("bottom"))
    near = O.nearest_rule(items, _rules(spark, d), ["page_id"], ["block_id", "line_id"])
    off = F.abs(F.col("bottom") - F.col("rule_y"))
    flat = near.filter(~F.col("tall"))
    good = off <= F.lit(0.45) * F.col("rule_pitch")
    parts = [near.filter("tall").withColumn("kind", F.lit("tall")), flat.filter(good).withColumn("kind", F.lit("snapped")), flat.filter(~F.coalesce(good, F.lit(False))).withColumn("kind", F.lit("orphan"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("page_id", "kind").agg(F.count(F.lit(1)).alias("n"))


_BLOCKED = f"""WITH {PAGE_LINES}, g AS (
  SELECT *, y1 - lag(y2) OVER w AS gap FROM page_lines WINDOW w AS (PARTITION BY page_id ORDER BY y1, x1, block_id, line_id)),
blocked AS (SELECT *, CAST(sum(CASE WHEN gap > coalesce(rule_pitch, 58.4) * 1.6 THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY y1, x1, block_id, line_id) AS INT) AS block FROM g)"""


def _blocked(spark, d):
    return O.group_blocks(page_lines(spark, d), ["page_id"], ["y1", "x1", "block_id", "line_id"], F.coalesce("rule_pitch", F.lit(58.4)))


@R.add(f"{_BLOCKED} SELECT page_id, block_id, line_id, block FROM blocked")
def w04_block_grouping(spark, d):
    return _blocked(spark, d).select("page_id", "block_id", "line_id", "block")


@R.add(f"{_BLOCKED} SELECT page_id, block, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, CAST(count(*) AS INT) AS n_lines FROM blocked GROUP BY 1, 2")
def a10_block_boxes(spark, d):
    return O.block_boxes(_blocked(spark, d), ["page_id"])


@R.add(f"WITH {PAGE_LINES} SELECT page_id, count(DISTINCT block_id) AS n_blocks, count(*) AS n_lines, CAST(sum(parts) AS BIGINT) AS n_parts FROM page_lines GROUP BY 1")
def a04_per_page_counts(spark, d):
    return page_lines(spark, d).groupBy("page_id").agg(F.countDistinct("block_id").alias("n_blocks"), F.count(F.lit(1)).alias("n_lines"), F.sum("parts").alias("n_parts"))


@R.add(f"WITH {PAGE_LINES}, c AS (SELECT page_id, count(DISTINCT block_id) AS b, count(*) AS l FROM page_lines GROUP BY 1) SELECT count(*) AS n_pages, CAST(sum(b) AS BIGINT) AS n_blocks, CAST(sum(l) AS BIGINT) AS n_lines FROM c")
def a04_totals(spark, d):
    return a04_per_page_counts(spark, d).agg(F.count(F.lit(1)).alias("n_pages"), F.sum("n_blocks").alias("n_blocks"), F.sum("n_lines").alias("n_lines"))


@R.add(f"WITH {PAGES} SELECT quantile_cont(rule_pitch, 0.5) AS med_pitch, min(rule_pitch) AS min_pitch, max(rule_pitch) AS max_pitch, quantile_cont(ink_covered, 0.5) AS med_covered, min(ink_covered) AS min_covered FROM pages")
def a05_median_range(spark, d):
    p = pages(spark, d).select("rule_pitch", "ink_covered")
    ends = p.agg(F.min("rule_pitch").alias("min_pitch"), F.max("rule_pitch").alias("max_pitch"), F.min("ink_covered").alias("min_covered"))
    return ends.select(F.lit(exact_quantile(p, "rule_pitch", 0.5)).cast("double").alias("med_pitch"), "min_pitch", "max_pitch", F.lit(exact_quantile(p, "ink_covered", 0.5)).cast("double").alias("med_covered"), "min_covered")


@R.add(f"WITH {PAGES}, c AS (SELECT rules_removed AS v, count(*) AS n, min(page_id) AS first_seen FROM pages WHERE rules_removed IS NOT NULL GROUP BY 1) SELECT v AS mode_value, n FROM c ORDER BY n DESC, first_seen LIMIT 1")
def a07_mode_first_seen(spark, d):
    c = pages(spark, d).filter("rules_removed is not null").groupBy(F.col("rules_removed").alias("mode_value")).agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first"))
    return c.orderBy(F.desc("n"), "first").limit(1).select("mode_value", "n")


@R.add(f"WITH {PAGES}, m AS (SELECT quantile_cont(rules_removed, 0.5) AS m FROM pages) SELECT count(*) FILTER (abs(rules_removed - m) <= 2) AS near_median, count(*) AS n FROM pages, m")
def a08_near_median(spark, d):
    p = pages(spark, d)
    med = p.agg(F.percentile("rules_removed", 0.5).alias("m")).first().m  # one number
    near = F.abs(F.col("rules_removed") - F.lit(med)) <= 2
    return p.agg(F.count_if(near).alias("near_median"), F.count(F.lit(1)).alias("n"))


@R.add(f"WITH {PAGES} SELECT quantile_cont(size[1], 0.05) AS width_p05, quantile_cont(size[2], 0.05) AS height_p05 FROM pages")
def a09_paper_size_p05(spark, d):
    return pages(spark, d).agg(F.percentile(F.get("size", F.lit(0)), 0.05).alias("width_p05"), F.percentile(F.get("size", F.lit(1)), 0.05).alias("height_p05"))


@R.add(f"WITH {PAGES} SELECT count(*) FILTER (ink_covered < 0.95) AS under_95, count(*) FILTER (ink_covered < 0.90) AS under_90, count(*) FILTER (ink_covered IS NULL) AS unknown FROM pages")
def a12_coverage_tail(spark, d):
    c = F.col("ink_covered")
    return pages(spark, d).agg(F.count_if(c < 0.95).alias("under_95"), F.count_if(c < 0.90).alias("under_90"), F.count_if(c.isNull()).alias("unknown"))


@R.add(f"WITH {PAGES} SELECT page_id, CASE WHEN ink_pixels > 0 THEN ink_covered END AS covered FROM pages")
def d06_blank_page_coverage(spark, d):
    p = pages(spark, d)
    return p.select("page_id", F.when(F.col("ink_pixels") > 0, F.col("ink_covered")).alias("covered"))


@R.add(
    f"""WITH {PAGE_LINES}, iv AS (SELECT page_id, y1 AS a, y2 AS b FROM page_lines WHERE y2 > y1),
    m AS (SELECT page_id, a, b, max(b) OVER (PARTITION BY page_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM iv)
    SELECT page_id, CAST(sum(greatest(b - greatest(a, coalesce(seen, a)), 0)) AS BIGINT) AS length FROM m GROUP BY 1"""
)
def a11_union_length(spark, d):
    return O.interval_union(page_lines(spark, d).select("page_id", F.col("y1").alias("a"), F.col("y2").alias("b")), ["page_id"])


_CLUSTERED = f"""WITH {PAGE_LINES}, g AS (SELECT *, y2 - lag(y2) OVER w AS step FROM page_lines WINDOW w AS (PARTITION BY page_id ORDER BY y2, block_id, line_id)),
c AS (SELECT *, CAST(sum(CASE WHEN step >= 15 THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY y2, block_id, line_id) AS INT) AS cluster FROM g)"""


@R.add(f"{_CLUSTERED} SELECT page_id, block_id, line_id, cluster FROM c")
def w05_cluster_1d(spark, d):
    return O.cluster_1d(page_lines(spark, d), ["page_id"], "y2", 15, "block_id", "line_id").select("page_id", "block_id", "line_id", "cluster")


@R.add(f"{_CLUSTERED} SELECT page_id, cluster, avg(y2) AS mean, max(y2) - min(y2) AS span, CAST(count(*) AS INT) AS n FROM c GROUP BY 1, 2 HAVING max(y2) - min(y2) <= 6")
def w06_cluster_means(spark, d):
    return O.cluster_means(O.cluster_1d(page_lines(spark, d), ["page_id"], "y2", 15, "block_id", "line_id"), ["page_id"], "y2", 6)


@R.add(f"WITH {PAGE_LINES}, s AS (SELECT page_id, y2 - lag(y2) OVER (PARTITION BY page_id ORDER BY y2) AS step FROM page_lines) SELECT page_id, quantile_cont(step, 0.5) AS pitch, CAST(count(*) AS INT) AS n_steps FROM s WHERE step BETWEEN 29.25 AND 87.75 GROUP BY 1")
def w07_median_pitch(spark, d):
    return O.median_pitch(page_lines(spark, d), ["page_id"], "y2", 29.25, 87.75)


@R.add(f"WITH {PAGE_LINES} SELECT page_id, block_id, line_id, min(x1) OVER (PARTITION BY page_id ORDER BY y1, x1, block_id, line_id ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS low FROM page_lines")
def w08_sliding_min(spark, d):
    w = Window.partitionBy("page_id").orderBy("y1", "x1", "block_id", "line_id").rowsBetween(-4, 4)
    return page_lines(spark, d).select("page_id", "block_id", "line_id", F.min("x1").over(w).alias("low"))


@R.add(
    f"""WITH {PAGE_LINES}, i AS (SELECT page_id, x2 - x1 AS v, row_number() OVER (PARTITION BY page_id ORDER BY y1, x1, block_id, line_id) - 1 AS k FROM page_lines)
    SELECT page_id, coalesce(min(k) FILTER (v >= 300), count(*)) AS first_wide, coalesce(max(k) FILTER (v >= 300), -1) AS last_wide FROM i GROUP BY 1"""
)
def w09_walk_inward(spark, d):
    w = Window.partitionBy("page_id").orderBy("y1", "x1", "block_id", "line_id")
    i = page_lines(spark, d).select("page_id", (F.col("x2") - F.col("x1")).alias("v"), (F.row_number().over(w) - 1).cast("bigint").alias("k"))
    k = F.when(F.col("v") >= 300, F.col("k"))
    return i.groupBy("page_id").agg(F.coalesce(F.min(k), F.count(F.lit(1))).alias("first_wide"), F.coalesce(F.max(k), F.lit(-1)).alias("last_wide"))


@R.add(
    f"""WITH {PAGE_LINES}, g AS (SELECT *, x1 - lag(x1) OVER w - 1 >= 40 AS fresh FROM page_lines WINDOW w AS (PARTITION BY page_id ORDER BY x1, block_id, line_id)),
    s AS (SELECT page_id, x1, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY x1, block_id, line_id) AS span FROM g)
    SELECT page_id, CAST(span AS INT) AS span, min(x1) AS a, max(x1) AS b FROM s GROUP BY 1, 2"""
)
def w10_column_spans(spark, d):
    w = Window.partitionBy("page_id").orderBy("x1", "block_id", "line_id")
    p = page_lines(spark, d)
    s = O.islands(p.withColumn("g", F.col("x1") - F.lag("x1").over(w) - 1), ["page_id"], ["x1", "block_id", "line_id"], F.col("g") >= 40, "span")
    return s.groupBy("page_id", "span").agg(F.min("x1").alias("a"), F.max("x1").alias("b"))


@R.add(f"WITH {PAGE_LINES} SELECT page_id, block_id, line_id, x1 - min(x1) OVER p AS x, y1 - min(y1) OVER p AS y FROM page_lines WINDOW p AS (PARTITION BY page_id)")
def w15_own_origin(spark, d):
    w = Window.partitionBy("page_id")
    return page_lines(spark, d).select("page_id", "block_id", "line_id", (F.col("x1") - F.min("x1").over(w)).alias("x"), (F.col("y1") - F.min("y1").over(w)).alias("y"))


@R.add(
    f"""{_RP}, p AS (SELECT *, CAST(round_even(0.10 * rule_pitch, 0) AS INT) AS pad, coalesce(size[1], 1598) AS w, coalesce(size[2], 2177) AS h FROM rp)
    SELECT page_id, block_id, line_id, greatest(x1 - pad, 0) AS cx1, greatest(y1 - pad, 0) AS cy1, least(x2 + pad, w) AS cx2, least(y2 + pad, h) AS cy2,
      greatest(x1 - pad, 0) - (x1 - pad) AS left_border, (y2 + pad) - least(y2 + pad, h) AS bottom_border FROM p"""
)
def e12_padded_window(spark, d):
    p = regions(spark, d).join(pages(spark, d).select("page_id", "rule_pitch", "size"), "page_id", "left")
    pad = F.bround(F.lit(0.10) * F.coalesce("rule_pitch", F.lit(58.4)), 0).cast("int")
    win = G.pad_window(G.box(), pad, F.coalesce(F.get("size", F.lit(0)), F.lit(1598)), F.coalesce(F.get("size", F.lit(1)), F.lit(2177)))
    names = {"cx1": "cx1", "cy1": "cy1", "cx2": "cx2", "cy2": "cy2", "left": "left_border", "bottom": "bottom_border"}
    return p.select("page_id", "block_id", "line_id", *[win[k].alias(v) for k, v in names.items()])


@R.add(f"{_RP}, w AS (SELECT page_id, block_id, line_id, row_number() OVER (PARTITION BY page_id, block_id ORDER BY line_id) AS i, count(*) OVER (PARTITION BY page_id, block_id) AS n FROM rp) SELECT page_id, block_id, line_id, CAST(i - 1 AS INT) AS idx, n AS of_n FROM w")
def w13_index_of(spark, d):
    p = Window.partitionBy("page_id", "block_id")
    return _rp(spark, d).select("page_id", "block_id", "line_id", (F.row_number().over(p.orderBy("line_id")) - 1).cast("int").alias("idx"), F.count(F.lit(1)).over(p).alias("of_n"))


@R.add(f"WITH {PAGES} SELECT page_id, greatest(least(15 + 15, size[1] - 1), 0) AS start_x, least(1598, size[1] - greatest(least(30, size[1] - 1), 0)) AS extent_x FROM pages")
def e18_crop_anchor(spark, d):
    start, extent = G.crop_extent(F.lit(15), 1598, F.get("size", F.lit(0)))
    return pages(spark, d).select("page_id", start.alias("start_x"), extent.alias("extent_x"))


@R.add(f"WITH {PAGES} SELECT page_id, round_even(size[1] / 1024.0, 6) AS to_full FROM pages")
def e19_downscale(spark, d):
    return pages(spark, d).select("page_id", F.bround(F.get("size", F.lit(0)) / F.lit(1024.0), 6).alias("to_full"))


@R.add(
    f"""WITH {PAGES}, t AS (SELECT *, CASE WHEN size[1] < 0.9 * 1598 OR size[2] < 0.9 * 2177 THEN least(1598 / size[1], 2177 / size[2]) ELSE 1.0 END AS s FROM pages)
    SELECT page_id, s AS page_scale FROM t"""
)
def e15_page_scale(spark, d):
    w, h = F.get("size", F.lit(0)), F.get("size", F.lit(1))
    return pages(spark, d).select("page_id", G.page_scale(w, h, F.lit(1598), F.lit(2177)).alias("page_scale"))


@R.add(
    f"""WITH {PAGE_LINES}, a AS (SELECT page_id, degrees(atan2(y2 - y1, (x2 - x1) * 10)) AS angle FROM page_lines WHERE x2 > x1)
    SELECT page_id, CASE WHEN count(*) FILTER (abs(angle) <= 4) >= 12 THEN quantile_cont(angle, 0.5) FILTER (abs(angle) <= 4) ELSE 0.0 END AS angle FROM a GROUP BY 1"""
)
def a25_agreeing_angle(spark, d):
    angle = F.degrees(F.atan2((F.col("y2") - F.col("y1")).cast("double"), ((F.col("x2") - F.col("x1")) * 10).cast("double")))
    a = page_lines(spark, d).filter("x2 > x1").select("page_id", angle.alias("angle"))
    good = F.abs(F.col("angle")) <= 4
    return a.groupBy("page_id").agg(F.when(F.count_if(good) >= 12, F.percentile(F.when(good, F.col("angle")), 0.5)).otherwise(F.lit(0.0)).alias("angle"))


@R.add(
    f"""WITH {PAGE_LINES} SELECT page_id, coalesce(quantile_cont(y2 - y1, 0.5) FILTER (y2 - y1 >= 5 AND (y2 - y1) * (x2 - x1) >= 60), 0.30 * any_value(coalesce(rule_pitch, 58.4))) AS x_height FROM page_lines GROUP BY 1"""
)
def a26_median_height(spark, d):
    h, w = F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")
    kept = F.when((h >= 5) & (h * w >= 60), h)
    return page_lines(spark, d).groupBy("page_id").agg(F.coalesce(F.percentile(kept, 0.5), F.lit(0.30) * F.first(F.coalesce("rule_pitch", F.lit(58.4)))).alias("x_height"))


QUERIES, SQL = R.queries, R.sql
