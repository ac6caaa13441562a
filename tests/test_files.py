"""Readers and writers on real files: images, CSV, JSON, partitions, label files, runs, streams."""

import json
import struct
import zlib
from datetime import datetime as D

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom import schemas as S
from paperloom.operators import pages as P
from paperloom.sources import files, sinks
from paperloom.streaming.lines import first_deliveries, read_lines


def _png(path, a):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    raw = b"".join(b"\0" + r.tobytes() for r in a)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    a = np.full((120, 100), 255, np.uint8)
    a[40:60, 20:70] = 10
    _png(root / "student_01/cie_2/page_01.png", a)
    _png(root / "student_01/cie_2/page_02.png", a)
    (root / "student_101/cie_1").mkdir(parents=True)
    (root / "student_101/cie_1/page_03.png").write_bytes(b"not an image")
    return str(root)


def test_corpus(spark, tree):
    got = sorted((r.page_id, r.page_kind) for r in files.corpus(spark, tree).collect())
    assert got == [("s01_c2_p01", "cover"), ("s01_c2_p02", "content"), ("s101_c1_p03", "content")]
    assert files.corpus(spark, tree, covers=False).count() == 2


def test_images_and_crops(spark, tree):
    img = files.images(spark, tree)
    rows = {r.page_id: r for r in img.collect()}
    assert rows["s01_c2_p02"].height == 120 and rows["s101_c1_p03"].data is None
    seg = {r.page_id: r for r in P.segment_images(img).collect()}
    assert [list(b) for b in seg["s01_c2_p02"].regions] == [[20, 40, 70, 60]] and seg["s101_c1_p03"].error == "unreadable"
    lines = spark.createDataFrame([("s01_c2_p02", 0, 0, 20, 40, 70, 60, 58.4), ("s01_c2_p02", 0, 1, 20, 40, 70, 45, 58.4), ("s101_c1_p03", 0, 0, 1, 1, 50, 50, 58.4), ("none", 0, 0, 1, 1, 50, 50, 58.4), ("s01_c2_p02", 0, 2, 0, 100, 60, 120, 58.4)], "page_id string, block_id int, line_id int, x1 int, y1 int, x2 int, y2 int, rule_pitch double")
    crops = {(r.page_id, r.line_id): r for r in P.crop_lines(img, lines).collect()}
    c = crops[("s01_c2_p02", 0)]
    assert (c.height, c.width) == (32, 62) and np.frombuffer(c.data, np.uint8).reshape(32, 62)[6:26, 6:56].max() == 10
    assert crops[("s01_c2_p02", 1)].skipped == "too low" and crops[("none", 0)].error and crops[("s101_c1_p03", 0)].error
    edge = crops[("s01_c2_p02", 2)]
    assert (edge.height, edge.width) == (32, 72) and np.frombuffer(edge.data, np.uint8).min() == 255
    ready = P.prepare_images(img, 11)
    assert {r.page_id: r.error for r in ready.collect()}["s01_c2_p01"] is None


def test_manifest_csv(spark, tmp_path):
    head = ",".join(f.name for f in S.MANIFEST)
    (tmp_path / "m.csv").write_text(f"{head}\np,1,1,2,0,0,1,2,3,4,2,2,1,,too low\np,1,1,2,0,1,1,2,3,4,2,2,0,a.png,\n")
    got = [(r.tall, r.crop, r.skipped) for r in files.manifest_csv(spark, str(tmp_path / "m.csv")).collect()]
    assert got == [(True, None, "too low"), (False, "a.png", None)]
    (tmp_path / "bad.csv").write_text(f"{head}\np,one,1,2,0,0,1,2,3,4,2,2,1,,x\n")
    with pytest.raises(Exception, match="(?i)malformed|failfast"):
        files.manifest_csv(spark, str(tmp_path / "bad.csv")).collect()


def test_page_records_and_maps(spark, tmp_path):
    record = {"page_id": "p", "student": 1, "size": [10, 20], "rule_pitch": None, "blocks": [{"bbox": [0, 0, 5, 5], "lines": [{"bbox": [0, 0, 5, 5], "parts": 2, "tall": False}]}]}
    (tmp_path / "pages.json").write_text(json.dumps([record, record | {"page_id": "q", "blocks": []}]))
    got = files.page_records(spark, str(tmp_path / "pages.json")).select("page_id", F.size("blocks").alias("n")).collect()
    assert [(r.page_id, r.n) for r in got] == [("p", 1), ("q", 0)]
    doc = spark.createDataFrame([('{"a": 1.5, "b": 2}',), (None,)], "doc string")
    assert [(r.key, r.value) for r in files.keyed_map(doc, "double").collect()] == [("a", 1.5), ("b", 2.0)]


def test_booklets_and_csv(spark, tmp_path):
    df = spark.createDataFrame([("u", 1, 2, True, ["a", "b"], None), ("v", 1, 3, False, [], "x")], "line_uid string, student int, cie int, tall boolean, tags array<string>, note string")
    sinks.by_booklet(df, str(tmp_path / "b"))
    back = files.routed_booklets(spark, str(tmp_path / "b")).filter("cie = 3")
    assert [r.line_uid for r in back.collect()] == ["v"]
    assert "PartitionFilters: [isnotnull(cie" in back._jdf.queryExecution().toString()
    sinks.flat_csv(df, str(tmp_path / "c"))
    text = sorted(x for p in (tmp_path / "c").glob("*.csv") for x in p.read_text().split("\n")[1:] if x)
    assert text == ["u,1,2,1,a|b,", "v,1,3,0,,x"] or text == ["u,1,2,1,a|b,", 'v,1,3,0,"",x']


def test_label_files(spark, tmp_path):
    df = spark.createDataFrame([("train", "a.png", "0 0.5 0.5 1 1"), ("val", "b.png", "")], "split string, file_name string, body string")
    sinks.label_files(df, str(tmp_path / "l"))
    got = {(r.split, r.file): r.body for r in spark.read.parquet(str(tmp_path / "l/labels")).collect()}
    assert got == {("train", "a.txt"): "0 0.5 0.5 1 1", ("val", "b.txt"): ""}
    yaml = [r.value for r in spark.read.text(str(tmp_path / "l/data.yaml")).collect()]
    assert yaml[:5] == ["path: .", "train: images/train", "val: images/val", "nc: 6", "names:"] and yaml[-1] == "  5: crossed_out"


def test_label_documents_round_trip(spark):
    boxes = spark.createDataFrame([("p", 7, "table", 1, 2, 11, 22, 100, 200), ("p", 3, "math", 0, 0, 5, 5, 100, 200)], "page_id string, box_id int, category string, x1 int, y1 int, x2 int, y2 int, page_w int, page_h int")
    img, ann, cat = files.coco_parts(sinks.label_document(boxes))
    assert img.first().file_name == "p.png" and cat.count() == len(S.CATEGORIES)
    assert [(r.id, r.category_id, r.bbox) for r in ann.orderBy("id").collect()] == [(1, 2, [0.0, 0.0, 5.0, 5.0]), (2, 4, [1.0, 2.0, 10.0, 20.0])]


def test_run_payload(spark, tmp_path):
    df = spark.createDataFrame([("a", "p", "ok", 1.0, 0), ("b", "p", "ok", 0.4, 1)], "line_uid string, page_id string, status string, confidence double, reading_order int")
    assert sinks.run_payload(df, "none", str(tmp_path / "run")) == 2
    assert spark.read.parquet(str(tmp_path / "run/lines")).filter("simulated").count() == 2
    assert json.loads(next((tmp_path / "run/envelope").glob("*.json")).read_text())["lines_total"] == 2
    with pytest.raises(ValueError, match="confidence"):
        sinks.run_payload(df.withColumn("confidence", F.lit(2.0)), "none", str(tmp_path / "bad"))
    assert not (tmp_path / "bad").exists()


def test_stream_drops_copies(spark, tmp_path):
    t = D(2024, 1, 1)
    df = spark.createDataFrame([("A ", "x", t), ("a", "x", t), ("b", "y", t)], "line_uid string, text string, generated_at timestamp")
    df.write.parquet(str(tmp_path / "in"))
    q = first_deliveries(read_lines(spark, str(tmp_path / "in"), df.schema)).writeStream.format("memory").queryName("first").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.line_uid for r in spark.table("first").collect()) == ["a", "b"]


def test_page_views(spark, tmp_path):
    line = [([1, 2, 3, 4], 2, False), ([1, 6, 9, 8], 1, True)]
    df = spark.createDataFrame([("s01_c1_p02", 1, 1, 2, 58.0, 3, 90, 0.9, [([1, 2, 9, 8], line), ([0, 9, 9, 12], [])]), ("s01_c1_p03", 1, 1, 3, None, None, None, None, None)], "page_id string, student int, cie int, page int, rule_pitch double, rules_removed int, ink_pixels int, ink_covered double, blocks array<struct<bbox:array<int>,lines:array<struct<bbox:array<int>,parts:int,tall:boolean>>>>")
    sinks.page_views(df, str(tmp_path / "v"))
    read = lambda name: spark.read.option("header", True).csv(str(tmp_path / "v" / name)).collect()
    assert {(r.page_id, r.n_blocks, r.n_lines) for r in read("pages")} == {("s01_c1_p02", "2", "2"), ("s01_c1_p03", None, None)}
    assert len(read("blocks")) == 2 and {(r.line_id, r.y2, r.tall) for r in read("lines")} == {("0", "4", "0"), ("1", "8", "1")}
    assert spark.read.json(str(tmp_path / "v/records")).count() == 2


def test_crops_and_manifest(spark, tmp_path):
    df = spark.createDataFrame([("s01_c2_p03", 0, 1, 2, 3, bytearray(b"abcdef"), None, None), ("s01_c2_p03", 0, 2, None, None, None, "too low", None), ("odd", 0, 0, 1, 1, bytearray(b"x"), None, None)], "page_id string, block_id int, line_id int, height int, width int, data binary, skipped string, error string")
    sinks.crop_images(df, str(tmp_path / "c"))
    rows = spark.read.option("header", True).csv(str(tmp_path / "c/manifest")).collect()
    assert {(r.crop, r.skipped) for r in rows} == {("student_01/cie_2/page_03/b00_l01.png", None), (None, "too low"), (None, None)}
    assert sorted(bytes(r.data) for r in spark.read.parquet(str(tmp_path / "c/crops")).collect()) == [b"abcdef", b"x"]


def test_maths_run(spark, tmp_path):
    df = spark.createDataFrame([("p", "u", 1, 2, [5, 1, 9, 4], "b", 0.5), ("p", "u", 0, 2, [1, 1, 4, 4], "a", None)], "page_id string, line_uid string, index int, of int, bbox array<int>, latex string, confidence double")
    sinks.maths_run(df, "none", str(tmp_path / "m"))
    flat = spark.read.option("header", True).csv(str(tmp_path / "m/expressions")).orderBy("index").collect()
    assert [(r.latex, r.bbox, r.simulated, r.engine) for r in flat] == [("a", "1|1|4|4", "1", "none"), ("b", "5|1|9|4", "1", "none")] and flat[0].generated_at
    nested = spark.read.text(str(tmp_path / "m/records")).withColumnRenamed("value", "doc")
    assert [(r["index"], r.x1, r.latex) for r in files.maths_rows(nested).orderBy("index").collect()] == [(0, 1, "a"), (1, 5, "b")]


def test_statistics_and_lists(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 4.0)], "page_id string, rule_pitch double")
    sinks.side_stats(df, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s/summary")).first().asDict() == {"n": 2, "n_missing": 1, "least": 1.0, "mean": 2.5, "most": 4.0}
    sinks.text_lines(spark.createDataFrame([("a\tb",)], "line string"), str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).first().value == "a\tb"


def test_runs_stop(spark):
    from paperloom.operators import annotations as A

    claims = spark.createDataFrame([("p", "1", "math", 1), ("p", "1+2", "math", 1), ("p", "1+2", "math", 2)], "page string, box_key string, label string, ordinal int")
    with pytest.raises(ValueError, match="two keys: p/1"):
        A.refuse_double_claims(claims)
    assert A.refuse_double_claims(claims.limit(0)).isEmpty()
    boxes = spark.createDataFrame([("p", 10, 10, 20, 20, 30, 30), ("q", 1, 1, 2, 2, 30, 30)], "page_id string, x1 int, y1 int, x2 int, y2 int, page_w int, page_h int")
    with pytest.raises(ValueError, match="without a scale: q"):
        A.scaled(boxes, spark.createDataFrame([("p", 2.0)], "page_id string, scale double"))
    got = A.scaled(boxes, spark.createDataFrame([("p", 2.0), ("q", 1.0)], "page_id string, scale double")).orderBy("page_id").collect()
    assert [(r.x2, r.clipped) for r in got] == [(30.0, True), (2.0, False)]


def test_exact_quantile(spark):
    from paperloom.operators.sampling import exact_quantile

    df = spark.createDataFrame([(v,) for v in (5, 1, 1, 1, 9, None, 2)], "v int")
    assert [exact_quantile(df, "v", q) for q in (0.0, 0.5, 0.9, 1.0)] == [1.0, 1.5, 7.0, 9.0] and exact_quantile(df.limit(0), "v", 0.5) is None
