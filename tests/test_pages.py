"""Pixel operators over tables: what memory holds of them, and what their plans move."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.operators import pages as P
from paperloom.plans import drawn as D


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _lines(spark):
    rows = [("7", 0, 0, 20, 20, 100, 50, 58.4), ("7", 0, 1, 20, 70, 100, 74, 58.4), ("none", 0, 0, 20, 20, 100, 50, 58.4)]
    return spark.createDataFrame(rows, "page_id string, block_id int, line_id int, x1 int, y1 int, x2 int, y2 int, rule_pitch double")


def test_images_are_not_broadcast(spark, sf):
    """Spark takes drawn or decoded images for as small as their keys."""

    def draw(batches):
        for pdf in batches:
            made = [D.ruled(int(h)) for h in pdf["id"]]
            yield pdf.assign(page_id=pdf["id"].astype(str), height=[g.shape[0] for g in made], width=[g.shape[1] for g in made], data=[g.tobytes() for g in made])[["page_id", "height", "width", "data"]]

    images = spark.range(5, 9).mapInPandas(draw, "page_id string, height int, width int, data binary")
    decoded = P.crop_lines(images, _lines(spark))
    assert "Broadcast" not in _plan(decoded)
    pages = spark.range(5, 9).select(F.col("id").cast("string").alias("page_id"), F.col("id").alias("h"))
    loaded = P.crop_lines(pages, _lines(spark), lambda row: D.ruled(int(row.h)))
    got = [sorted((r.page_id, r.line_id, r.height, r.width, r.data, r.skipped, r.error) for r in df.collect()) for df in (decoded, loaded)]
    assert got[0] == got[1] and [x[5:] for x in got[0]] == [(None, None), ("too low", None), (None, "unreadable")]
    assert np.frombuffer(got[0][0][4], np.uint8).min() == 120
    assert _plan(D.k02_crop_manifest(spark, sf)).count("MapInPandas") == 1  # no image leaves the task that draws it


@pytest.mark.parametrize("query", ["x09_ruled_pages", "x12_page_frames", "x21_tilted_pages"])
def test_frames_hold_few_images(spark, monkeypatch, query):
    """A task hands on some megabytes of pixels at once, however many pages its batch names."""
    plain = type(spark.range(1)).mapInPandas

    def watched(df, make, schema):
        def run(batches):
            for pdf in make(batches):
                held = sum(len(v) for c in pdf.columns for v in pdf[c] if isinstance(v, bytes))
                if held > 12 << 20:
                    raise MemoryError(f"{held} bytes of pixels at once")
                yield pdf

        return plain(df, run, schema)

    monkeypatch.setattr(type(spark.range(1)), "mapInPandas", watched)
    monkeypatch.setattr(D, "keyed", lambda spark, d: spark.range(1000).select(F.col("id").cast("string").alias("page_id"), F.col("id").cast("int").alias("h")))
    assert len(D.QUERIES[query](spark, "").collect()) == 1000
