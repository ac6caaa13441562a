"""Hand cases: maths rule, geometry, contracts, folds, defects of earlier systems that must not come back."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom import schemas as S
from paperloom.functions import geometry as G
from paperloom.functions import identity as I
from paperloom.functions import mathrule as M
from paperloom.operators import annotations as A
from paperloom.operators import assembly, engines, folds, router, sampling, segmentation, spatial
from paperloom.operators.simulate import simulate

CASES = [
    ("= 256-1", "ratio"), ("N = 8", "ratio"), ("Go-Back-N protocol is a protocol", "prose"), ("= 99 mod 32", "word:mod"), ("2^m - 1", "ratio"), ("= 8", "ratio"),
    ("Sequence no. of 100th Packet = (100-1) mod(2^5)", "ratio"), ("= 255 packets", "prose"), ("MOD 5", "word:mod"), ("=", "no operand"), ("->", "no operand"),
    ("2b)", "no operator"), ("5", "no operator"), ("", "empty"), ("  ", "empty"), (None, "empty"), ("ä=1²", "ratio"), ("a = 1", "ratio"), ("sin of log x", "word:log"),
]


def test_math_rule(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, t string")
    got = {r.i: r.why for r in df.select("i", M.math_reason(F.col("t")).alias("why")).collect()}
    assert [got[i] for i in range(len(CASES))] == [w for _, w in CASES]


def test_math_ratio_is_a_parameter(spark):
    df = spark.createDataFrame([("= 255 packets",)], "t string")
    assert df.select(M.math_reason(F.col("t"), 0.36)).first()[0] == "ratio"


def test_diagram_is_never_rerouted(spark):
    df = spark.createDataFrame([("diagram", "x = 1"), ("text_ocr", "x = 1")], "route string, t string")
    got = df.select(M.content_route(F.col("route"), M.math_reason(F.col("t")))).collect()
    assert [r[0] for r in got] == ["diagram", "math_ocr"]


def test_tags_at_thresholds(spark):
    df = spark.createDataFrame([(350, 32), (351, 33)], "w int, h int")
    got = [r[0] for r in df.select(M.tags(F.col("w"), F.col("h"), F.lit(58.4))).collect()]
    assert got == [["short"], ["full-line"]]


def _ioa(spark, a, b):
    df = spark.createDataFrame([(*a, *b)], ", ".join(f"{p}{n} int" for p in "ab" for n in ("x1", "y1", "x2", "y2")))
    return df.select(G.ioa(G.box("a"), G.box("b"))).first()[0]


def test_ioa(spark):
    assert _ioa(spark, (0, 0, 10, 10), (5, 0, 20, 10)) == 0.5
    assert _ioa(spark, (5, 0, 20, 10), (0, 0, 10, 10)) == pytest.approx(1 / 3)
    assert _ioa(spark, (3, 3, 3, 9), (0, 0, 10, 10)) == 0.0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 400), st.integers(0, 400), st.integers(0, 200), st.integers(0, 200)), min_size=1, max_size=12))
def test_overlap_join_finds_what_brute_force_finds(spark, raw):
    boxes = [(x, y, x + w, y + h) for x, y, w, h in raw]
    df = spark.createDataFrame([("p", i, *b) for i, b in enumerate(boxes)], "page_id string, box_id int, x1 int, y1 int, x2 int, y2 int")
    got = sorted((r.a_box_id, r.b_box_id) for r in spatial.overlapping(df, df).collect())
    want = sorted((i, j) for i, a in enumerate(boxes) for j, b in enumerate(boxes) if min(a[2], b[2]) > max(a[0], b[0]) and min(a[3], b[3]) > max(a[1], b[1]))
    assert got == want


def test_block_break_is_from_the_previous_line(spark):
    rows = [("p", 0, 0, 300), ("p", 1, 10, 40), ("p", 2, 133, 150), ("p", 3, 244, 260)]  # gap 93 stays, 94 breaks
    df = spark.createDataFrame(rows, "page_id string, k int, y1 int, y2 int").withColumn("x1", F.lit(0))
    got = segmentation.group_blocks(df, ["page_id"], ["y1", "k"], F.lit(58.4)).orderBy("k")
    assert [r.block for r in got.collect()] == [0, 0, 0, 1]


def test_nearest_rule_ties_go_up(spark):
    items = spark.createDataFrame([("p", 1, 50), ("p", 2, 10), ("q", 3, 5)], "page_id string, id int, bottom int")
    rules = spark.createDataFrame([("p", 40), ("p", 60), (None, 1)], "page_id string, rule_y int")
    got = {r.id: r.rule_y for r in segmentation.nearest_rule(items, rules, ["page_id"], ["id"]).collect()}
    assert got == {1: 40.0, 2: 40.0, 3: None}


def test_interval_union(spark):
    df = spark.createDataFrame([("p", 0, 10), ("p", 5, 7), ("p", 9, 12), ("p", 20, 20), ("p", 30, 31)], "k string, a int, b int")
    assert segmentation.interval_union(df, ["k"]).first().length == 13


def test_identity_of_large_numbers(spark):
    """Three-digit students and two-digit exams are read by pattern."""
    df = spark.createDataFrame([("student_123/cie_10/page_04/b02_l11.png",), ("old/student_1/cie_1/page_1/b1_l1.png",), (None,)], "crop string")
    got = [r.crop_uid for r in assembly.identity_from_crop(df).collect()]
    assert got == ["s123_c10_p04_b02_l11", None, None]
    assert spark.range(1).select(I.page_id(F.lit(7), F.lit(2), F.lit(3))).first()[0] == "s07_c2_p03"


def test_router_carries_pitch_and_page(spark):
    regions = spark.createDataFrame([("p", 0, 0, 1, 1, 5, 9, False, "c.png"), ("p", 0, 1, 1, 1, 5, 9, True, None)], "page_id string, block_id int, line_id int, x1 int, y1 int, x2 int, y2 int, tall boolean, crop string")
    pages = spark.createDataFrame([("q", 60.0)], "page_id string, rule_pitch double")
    row = router.route_regions(regions, pages).collect()
    assert len(row) == 1 and row[0].rule_pitch == S.DEFAULT_PITCH and row[0].page_id == "p" and row[0].reading_order == 0


LINE = "line_uid string, page_id string, status string, confidence double, reading_order int"


@pytest.mark.parametrize(
    ("rows", "rules"),
    [
        ([("a", "p", "ok", 1.0, 0), ("b", "p", "empty", 0.0, 1)], set()),
        ([("a", "p", "unknown", 0.5, 0)], {"status"}),
        ([("a", "p", None, 0.5, 0)], {"status"}),
        ([("a", "p", "ok", 1.01, 0)], {"confidence"}),
        ([("a", "p", "ok", -0.01, 0)], {"confidence"}),
        ([("a", "p", "ok", None, 0)], {"confidence"}),
        ([("a", "p", "ok", 0.5, 0), ("a", "p", "ok", 0.5, 1)], {"unique uid"}),
        ([("a", "p", "ok", 0.5, 0), ("b", "p", "ok", 0.5, 2)], {"dense order"}),
        ([("a", "p", "ok", 0.5, 0), ("b", "p", "ok", 0.5, 0), ("c", "p", "ok", 0.5, 1)], {"dense order"}),
        ([("a", "p", "ok", 0.5, 1), ("b", "p", "ok", 0.5, 2)], {"dense order"}),
        ([], set()),
    ],
)
def test_run_rules(spark, rows, rules):
    df = spark.createDataFrame(rows, LINE)
    assert {r.rule for r in assembly.line_violations(df).collect()} == rules


def test_run_gate(spark):
    good = spark.createDataFrame([("a", "p", "ok", 1.0, 0)], LINE)
    meta = {"schema_version": 1, "simulated": True, "engine": "x", "pages": []}
    assert assembly.validate_run(good, meta) == 1
    with pytest.raises(ValueError, match="version"):
        assembly.validate_run(good, meta | {"schema_version": 2})
    with pytest.raises(ValueError, match="simulated"):
        assembly.validate_run(good, {k: v for k, v in meta.items() if k != "simulated"})


BOX = "page_id string, box_id int, category string, x1 int, y1 int, x2 int, y2 int, page_w int, page_h int"


@pytest.mark.parametrize(
    ("boxes", "rules"),
    [
        ([("paragraph", 5, 5, 5, 50)], {"no area"}),
        ([("paragraph", 5, 5, 102, 50)], {"outside"}),
        ([("paragraph", 5, 5, 101, 50)], set()),
        ([("paragraph", 5, 5, 16, 45)], {"tiny"}),
        ([("paragraph", 0, 0, 60, 60), ("crossed_out", 5, 5, 16, 45)], set()),
        ([("paragraph", 0, 0, 29, 90), ("crossed_out", 0, 10, 100, 30)], {"overlay"}),
        ([("paragraph", 0, 0, 30, 90), ("crossed_out", 0, 10, 100, 30)], set()),
        ([("figure", 0, 0, 80, 90), ("paragraph", 0, 10, 100, 30)], {"nested"}),
        ([("figure", 0, 0, 79, 90), ("paragraph", 0, 10, 100, 30)], set()),
        ([("figure", 0, 0, 100, 90), ("table", 0, 10, 100, 30)], set()),
    ],
)
def test_box_rules(spark, boxes, rules):
    df = spark.createDataFrame([("p", i, *b, 100, 100) for i, b in enumerate(boxes)], BOX)
    v = A.box_violations(df)
    assert {r.rule for r in v.collect()} == rules
    assert A.passes(v) == (not rules or rules == {"tiny"})
    assert A.passes(v, strict=True) == (not rules)


def test_assignments_of_all_forms(spark):
    """Strings, lists and broken text are read, none of them ends the job."""
    df = spark.createDataFrame([("a", '"skip"'), ("b", '{"1":"math","1+2":"table","3":["code","drop"]}'), ("c", "no json"), ("d", None)], "page string, value string")
    skipped, claims = A.explode_assignments(df)
    assert [r.page for r in skipped.collect()] == ["a"]
    assert sorted((r.box_key, r.label, r.ordinal) for r in claims.collect()) == [("1", "math", 1), ("1+2", "table", 1), ("1+2", "table", 2), ("3", "code", 3), ("3", "drop", 3)]
    assert [(r.page, r.ordinal) for r in A.double_claims(claims).collect()] == [("b", 1)]


def test_admitted_predictions_see_each_other(spark):
    boxes = spark.createDataFrame([("p", 0, 0, 100, 100)], "page_id string, x1 int, y1 int, x2 int, y2 int")
    pred = spark.createDataFrame([("p", 200, 0, 300, 100, 0), ("p", 205, 0, 300, 100, 1), ("p", 10, 10, 50, 50, 2), ("q", 0, 0, 9, 9, 3), ("q", None, 0, 9, 9, 4), ("p", 400, 0, 500, 9, None)], "page_id string, x1 int, y1 int, x2 int, y2 int, ord int")
    assert sorted((r.page_id, r.ord) for r in A.admit_predictions(boxes, pred).collect()) == [("p", 0), ("q", 3)]
    assert A.admit_predictions(boxes, pred.filter("ord = 2")).count() == 0


def test_running_mean_clusters(spark):
    rows = [("p", float(v), i) for i, v in enumerate([0, 30, 50, 100, 110, 200])]
    df = spark.createDataFrame(rows, "page string, v double, i int")
    got = sorted((r.i, r.cluster) for r in folds.cluster_running_mean(df, "page", "v", "i", 36.0).collect())
    want, total, n, c = [], 0.0, 0, -1
    for _, v, i in rows:
        if n and abs(v - total / n) <= 36.0:
            total, n = total + v, n + 1
        else:
            total, n, c = v, 1, c + 1
        want.append((i, c))
    assert got == want


def test_template_support_counts_examples(spark):
    """Two lines of one example are one support."""
    rows = [("h", "e1", 10.0, 0.0, 5.0), ("h", "e1", 11.0, 0.0, 5.0), ("h", "e2", 12.0, 0.0, 7.0), ("h", "e3", 90.0, 0.0, 7.0)]
    df = spark.createDataFrame(rows, "axis string, example string, pos double, start double, end double")
    got = folds.line_template(df).collect()
    assert [(r.pos, r.support, r.n_examples) for r in got] == [(11.0, 2, 3)]


def test_global_index_is_total(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), F.md5(F.col("id").cast("string")).alias("h"))
    got = sampling.global_index(df, "h").orderBy("idx").collect()
    assert [r.idx for r in got] == list(range(1000)) and [r.h for r in got] == sorted(r.h for r in got)
    assert sampling.global_index(df.limit(0), "h").count() == 0


def test_round_robin_goes_wide_first(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 1), ("c", 1)], "g string, k int")
    assert [(r.g, r.k) for r in sampling.round_robin(df, "g", ["k"], 4).collect()] == [("a", 1), ("b", 1), ("c", 1), ("a", 2)]


def test_simulation_depends_on_the_key_alone(spark):
    df = spark.createDataFrame([(f"s01_c1_p02_b00_l{i:02d}", False, 400) for i in range(40)] + [("t", True, 10), (None, False, 3), ("u", None, None)], "line_uid string, tall boolean, width int")
    one = {r.line_uid: r for r in simulate(df).collect()}
    two = {r.line_uid: r for r in simulate(df.repartition(7)).collect()}
    assert one == two and one["t"].status == "diagram" and all(0 <= r.confidence <= 1 and r.simulated for r in one.values()) and None not in one


def test_engines(spark):
    with pytest.raises(ValueError, match="unknown"):
        engines.load("nothing")
    df = spark.createDataFrame([("u", 0, 1, 1, 2, bytearray(b"ab")), ("v", 0, 1, 1, 2, None), ("w", 0, 1, 5, 5, bytearray(b"a"))], "line_uid string, index int, of int, height int, width int, data binary")
    got = {r.line_uid: r for r in engines.recognise(df, "none").collect()}
    assert got["u"].latex == "" and got["v"].error == "no image" and got["w"].error and got["w"].simulated


def test_confidence_and_medians(spark):
    df = spark.createDataFrame([([-0.1, -0.2, -9.0], [True, True, False]), ([], [])], "p array<double>, m array<boolean>")
    got = [r[0] for r in df.select(assembly.sequence_confidence(F.col("p"), F.col("m"))).collect()]
    assert got == [0.861, 0.0]
    m = spark.createDataFrame([([4, 1, 3, 2],), ([],)], "v array<int>").select(assembly.upper_median(F.col("v"))).collect()
    assert [r[0] for r in m] == [3, None]


def test_batches_of_images():
    class Reader:
        def read_batch(self, keys, images):
            if any(x is None for x in images):
                raise ValueError("bad image")
            calls.append(len(keys))
            return [{"latex": k, "confidence": 1.0} for k in keys]

    calls = []
    assert [x["latex"] for x in engines.read_batch(Reader(), ["a", "b"], [1, 2])] == ["a", "b"] and calls == [2]
    got = engines.read_batch(Reader(), ["a", "b", "c"], [1, None, KeyError("k")])
    assert got[0]["latex"] == "a" and [type(x) for x in got[1:]] == [ValueError, KeyError]


def test_shared_folder_is_named_on_a_cluster():
    from unittest.mock import MagicMock

    from paperloom.common import shared_folder

    spark = MagicMock()
    spark.sparkContext._jsc.sc().getCheckpointDir().isDefined.return_value = False
    spark.sparkContext.getConf().get.return_value = ""
    spark.sparkContext.master = "yarn"
    with pytest.raises(ValueError, match="checkpoint"):
        shared_folder(spark)


def test_simulated_sentences_fit_the_width(spark):
    width = {f"s01_c1_p02_b00_l{i:03d}": 25 * (i % 40) for i in range(200)}
    df = spark.createDataFrame([(u, False, w) for u, w in width.items()], "line_uid string, tall boolean, width int")
    for r in simulate(df).collect():
        assert r.status != "ok" or 1 <= len(r.text) <= max(1, width[r.line_uid] // 25)
