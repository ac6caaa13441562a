"""Queries of the orphan-reference operator with their SQL."""

from paperloom.common import table
from paperloom.operators.orphans import find_orphans, orphan_counts


def _all(spark, d):
    return find_orphans(table(spark, d, "ocr_lines"), table(spark, d, "manifest"), table(spark, d, "segmentation"))


def p5_found(spark, d):
    return _all(spark, d).select("ref_field", "line_uid", "reason")


def p5_counts(spark, d):
    return orphan_counts(_all(spark, d))


QUERIES = {"p5_found": p5_found, "p5_counts": p5_counts}

_ORPHANS = r"""
WITH latest AS (
  SELECT DISTINCT ON (lower(trim(line_uid))) lower(trim(line_uid)) AS line_uid, crop, page_id, generated_at, loaded_at
  FROM ocr_lines WHERE line_uid IS NOT NULL ORDER BY lower(trim(line_uid)), generated_at DESC),
refs AS (
  SELECT 'line_uid' AS ref_field, line_uid AS k, line_uid, generated_at, loaded_at FROM latest
  UNION ALL SELECT 'crop', regexp_replace(replace(lower(trim(crop)), '\', '/'), '^(\./+)+', ''), line_uid, generated_at, loaded_at FROM latest
  UNION ALL SELECT 'page_id', lower(trim(page_id)), line_uid, generated_at, loaded_at FROM latest),
parents AS (
  SELECT 'line_uid' AS ref_field, printf('%s_b%02d_l%02d', lower(trim(page_id)), block_id, line_id) AS k, loaded_at, removed_at
  FROM manifest WHERE page_id IS NOT NULL AND block_id IS NOT NULL AND line_id IS NOT NULL
  UNION ALL SELECT 'crop', regexp_replace(replace(lower(trim(crop)), '\', '/'), '^(\./+)+', ''), loaded_at, removed_at FROM manifest
  UNION ALL SELECT 'page_id', lower(trim(page_id)), loaded_at, removed_at FROM segmentation),
p AS (
  SELECT ref_field, k, bool_or(removed_at IS NULL) AS any_live, min(loaded_at) FILTER (removed_at IS NULL) AS live_from
  FROM parents WHERE k IS NOT NULL GROUP BY 1, 2),
o AS (
  SELECT r.ref_field, r.line_uid, r.generated_at,
    CASE WHEN p.any_live IS NULL THEN 'missing' WHEN NOT p.any_live THEN 'deleted' WHEN p.live_from > r.loaded_at THEN 'late' END AS reason
  FROM refs r LEFT JOIN p ON r.ref_field = p.ref_field AND r.k = p.k WHERE r.k IS NOT NULL)
"""

SQL = {
    "p5_found": _ORPHANS + "SELECT ref_field, line_uid, reason FROM o WHERE reason IS NOT NULL",
    "p5_counts": _ORPHANS
    + """SELECT ref_field, CASE ref_field WHEN 'page_id' THEN 'segmentation' ELSE 'manifest' END AS parent_table,
    strftime(generated_at, '%Y-%m') AS month, reason, count(*) AS n_orphans FROM o WHERE reason IS NOT NULL GROUP BY ALL""",
}
