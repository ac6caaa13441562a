"""Orphan references against a plain reading of their definition, with nulls, ties, copies and empty tables."""

from datetime import datetime as D

import pytest
from pyspark.sql import functions as F

from paperloom.operators.orphans import find_orphans, orphan_counts

LINES = "line_uid string, page_id string, crop string, generated_at timestamp_ntz, loaded_at timestamp_ntz, key string, reason int"
MAN = "page_id string, block_id int, line_id int, crop string, loaded_at timestamp_ntz, removed_at timestamp_ntz, key string"
SEG = "page_id string, loaded_at timestamp_ntz, removed_at timestamp_ntz"
T = [D(2024, 1, d) for d in range(1, 10)]


@pytest.fixture(scope="module")
def tables(spark):
    lines = [
        ("p_b00_l00", "p", "a.png", T[3], T[4], "x", 1), ("p_b00_l00", "p", "a.png", T[3], T[4], "x", 1), ("P_B00_L00 ", "p", "gone.png", T[2], T[4], "x", 1),
        ("p_b00_l01", "q", "DEL\\A.png", T[3], T[4], None, None), ("p_b00_l02", None, None, T[3], T[4], None, None), ("p_b00_l03", " P ", "./late.png", T[3], None, None, None),
        (None, "zz", "zz", T[1], T[1], None, None), ("p_b00_l04", "w", "late.png", T[3], T[4], None, None), ("p_b00_l05", "", "", T[3], T[4], None, None),
    ]
    man = [
        ("P", 0, 0, "A.png", T[0], None, "k"), ("p", 0, 1, "del/a.png", T[0], T[1], "k"), ("p", 0, 2, None, T[0], T[1], "k"), ("p", 0, 2, None, T[1], None, "k"),
        ("p", 0, 4, "late.png", T[8], None, "k"), ("p", None, 5, "x", T[0], None, "k"), (None, 0, 0, None, None, None, None), ("p", 0, 3, None, None, None, None),
    ]
    seg = [("p", T[0], None), ("w", T[8], None), ("w", T[0], T[1])]
    return spark.createDataFrame(lines, LINES), spark.createDataFrame(man, MAN), spark.createDataFrame(seg, SEG)


def test_reasons(tables):
    got = sorted((r.ref_field, r.line_uid, r.reason) for r in find_orphans(*tables).collect())
    assert got == [
        ("crop", "p_b00_l01", "deleted"), ("crop", "p_b00_l04", "late"), ("crop", "p_b00_l05", "missing"), ("line_uid", "p_b00_l01", "deleted"), ("line_uid", "p_b00_l04", "late"),
        ("line_uid", "p_b00_l05", "missing"), ("page_id", "p_b00_l01", "missing"), ("page_id", "p_b00_l04", "late"), ("page_id", "p_b00_l05", "missing"),
    ]


def test_empty_tables(spark, tables):
    lines, man, seg = tables
    assert find_orphans(lines.limit(0), man, seg).count() == 0
    assert {r.reason for r in find_orphans(lines, man.limit(0), seg.limit(0)).collect()} == {"missing"}
    assert orphan_counts(find_orphans(lines.limit(0), man, seg)).count() == 0


def test_one_key_with_a_third_of_the_rows(spark, tables):
    lines, man, seg = tables
    hot = spark.range(30000).select(F.format_string("s%d_b00_l00", "id").alias("line_uid"), F.when(F.col("id") % 3 == 0, "nowhere").otherwise(F.concat(F.lit("p"), F.col("id"))).alias("page_id"), F.lit("a.png").alias("crop"), F.lit(T[3]).alias("generated_at"), F.lit(T[4]).alias("loaded_at"))
    got = {(r.ref_field, r.reason): r.n for r in find_orphans(hot, man, seg).groupBy("ref_field", "reason").agg(F.count("*").alias("n")).collect()}
    assert got == {("line_uid", "missing"): 30000, ("page_id", "missing"): 30000}
