"""References to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.common import latest_lines, norm_key, norm_path


def parent_intervals(manifest: DataFrame, segmentation: DataFrame) -> DataFrame:
    """(ref_field, key, live_from): one row per parent key, with the start of its validity.

    live_from is the earliest loaded_at of rows without removed_at, null with
    any_live false when all were deleted. Rows whose key has a null part name
    no parent. Aggregated before the shuffle, so repeated parents don't skew.
    """
    uid = F.format_string("%s_b%02d_l%02d", norm_key(F.col("page_id")), F.col("block_id"), F.col("line_id"))
    whole = F.col("page_id").isNotNull() & F.col("block_id").isNotNull() & F.col("line_id").isNotNull()
    from_manifest = manifest.select(
        F.explode(
            F.array(
                F.struct(F.lit("line_uid").alias("ref_field"), F.when(whole, uid).alias("key")),
                F.struct(F.lit("crop").alias("ref_field"), norm_path(F.col("crop")).alias("key")),
            )
        ).alias("p"),
        "loaded_at",
        "removed_at",
    ).select("p.*", "loaded_at", "removed_at")
    pages = segmentation.select(F.lit("page_id").alias("ref_field"), norm_key(F.col("page_id")).alias("key"), "loaded_at", "removed_at")
    live = F.col("removed_at").isNull()
    return (
        from_manifest.unionByName(pages)
        .filter(F.col("key").isNotNull())
        .groupBy("ref_field", "key")
        .agg(F.max(live).alias("any_live"), F.min(F.when(live, F.col("loaded_at"))).alias("live_from"))
    )


def find_orphans(lines: DataFrame, manifest: DataFrame, segmentation: DataFrame) -> DataFrame:
    """Broken references of lines: (ref_field, line_uid, key, reason, generated_at).

    References and parent intervals are co-partitioned and sorted by
    (ref_field, key), then merged in one pass over both sorted streams (a
    sort-merge join). reason is missing (no parent row), deleted (all parents
    removed) or late (valid only after the line arrived). Null crop or
    page_id is no reference; a null line_uid names no line; a null arrival or
    load time is never late. A key that holds a third of the references is
    split by adaptive skew handling: the parent side has one row per key.
    Empty tables give no rows; if only parents are empty, all are missing.
    """
    refs = (
        latest_lines(lines, "crop", "page_id")
        .select(
            "line_uid",
            "generated_at",
            "loaded_at",
            F.explode(
                F.array(
                    F.struct(F.lit("line_uid").alias("ref_field"), F.col("line_uid").alias("key")),
                    F.struct(F.lit("crop").alias("ref_field"), norm_path(F.col("crop")).alias("key")),
                    F.struct(F.lit("page_id").alias("ref_field"), norm_key(F.col("page_id")).alias("key")),
                )
            ).alias("r"),
        )
        .select("line_uid", "generated_at", "loaded_at", "r.ref_field", "r.key")
        .filter(F.col("key").isNotNull())
    )
    merged = refs.join(parent_intervals(manifest, segmentation).hint("merge"), ["ref_field", "key"], "left")
    reason = (
        F.when(F.col("any_live").isNull(), "missing")
        .when(~F.col("any_live"), "deleted")
        .when(F.col("live_from") > F.col("loaded_at"), "late")
    )
    return merged.withColumn("reason", reason).filter(F.col("reason").isNotNull()).select("ref_field", "line_uid", "key", "reason", "generated_at")


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """Orphans per referring field, parent table, month of generated_at and reason."""
    parent = F.when(F.col("ref_field") == "page_id", "segmentation").otherwise("manifest")
    return (
        orphans.groupBy("ref_field", parent.alias("parent_table"), F.date_format("generated_at", "yyyy-MM").alias("month"), "reason")
        .agg(F.count(F.lit(1)).alias("n_orphans"))
    )
