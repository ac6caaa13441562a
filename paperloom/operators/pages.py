"""Pixel operators over decoded pages, in Arrow batches; a page that fails becomes a row with an error."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom import schemas as S
from paperloom.functions import pixels as X

_PAGE = "path string, page_id string, rule_pitch double, rules_removed int, ink_pixels long, ink_covered double, regions array<array<int>>, error string"
_TONED = "path string, page_id string, height int, width int, angle double, data binary, error string"
_CROP = "page_id string, block_id int, line_id int, height int, width int, data binary, skipped string, error string"
_EXPR = "line_uid string, index int, of int, dx int, dy int, ink_pixels int, height int, width int, data binary, error string"


#: Bytes of pixels that a task holds before it hands rows on.
HELD = 8 << 20


def _gray(row) -> np.ndarray:
    if row.data is None:
        raise ValueError("unreadable")
    a = np.frombuffer(row.data, dtype=np.uint8).reshape(int(row.height), int(row.width), -1)
    return a[:, :, 0] if a.shape[2] == 1 else np.rint(a[:, :, :3].mean(axis=2)).astype(np.uint8)


def frames(rows: Iterable[tuple], names: list[str]) -> Iterator[pd.DataFrame]:
    """Rows as frames of some megabytes of pixels each: a batch has up to 10,000 keys, their images would not fit."""
    part, held = [], 0
    for row in rows:
        part.append(row)
        held += sum(len(v) for v in row if isinstance(v, bytes))
        if held >= HELD or len(part) >= 10_000:
            yield pd.DataFrame(part, columns=names)
            part, held = [], 0
    if part:
        yield pd.DataFrame(part, columns=names)


def _each(df: DataFrame, schema: str, make: Callable[[object], list[tuple]], fail: Callable[[object, str], tuple]) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                try:
                    yield from make(row)
                except Exception as e:  # one bad page is no reason to lose the rest
                    bad = fail(row, str(e)[:200])
                    yield from bad if isinstance(bad, list) else [bad]

    return df.mapInPandas(lambda batches: frames(rows(batches), names), schema)


def segment_images(images: DataFrame, load: Callable[[object], np.ndarray] | None = None) -> DataFrame:
    """Page records of images (path, page_id, height, width, data), or of (path, page_id, ...) what `load` makes a page of in its task."""

    def make(row):
        r = X.segment_page((load or _gray)(row))
        return [(row.path, row.page_id, r["rule_pitch"], r["rules_removed"], r["ink_pixels"], r["ink_covered"], [list(b) for b in r["regions"]], None)]

    return _each(images if load else images.select("path", "page_id", "height", "width", "data"), _PAGE, make, lambda row, e: (row.path, row.page_id, None, None, None, None, None, e))


def prepare_images(images: DataFrame, size: int = X.BACKGROUND, load: Callable[[object], np.ndarray] | None = None) -> DataFrame:
    """Deskewed, flattened and stretched pages, one pass per page; `load` as in segment_images."""

    def make(row):
        g = (load or _gray)(row)
        angle = X.skew_angle(g)
        g = X.tone(X.rotate(g, angle) if angle else g, size)
        return [(row.path, row.page_id, g.shape[0], g.shape[1], angle, g.tobytes(), None)]

    return _each(images if load else images.select("path", "page_id", "height", "width", "data"), _TONED, make, lambda row, e: (row.path, row.page_id, None, None, None, None, e))


def crop_lines(images: DataFrame, lines: DataFrame, load: Callable[[object], np.ndarray] | None = None) -> DataFrame:
    """Crops of lines (page_id, block_id, line_id, x1..y2, rule_pitch) from their page, with a margin of a tenth of a pitch; white where the page ends.

    A page is decoded once for all its lines. A line too small to be cropped
    is a row with the reason; a page that is missing or unreadable gives each
    of its lines an error. Images are (page_id, height, width, data), far larger
    than Spark's estimate of them, so they are merged and never broadcast. With
    `load` they are (page_id, ...) what a page is loaded from: only that is
    joined, and the pixels stay in the task that crops them.
    """
    boxes = F.array_sort(F.collect_list(F.struct("block_id", "line_id", "x1", "y1", "x2", "y2", "rule_pitch")))
    per_page = lines.filter(F.col("page_id").isNotNull()).groupBy("page_id").agg(boxes.alias("boxes"))
    if load is None:
        both = per_page.join(images.select("page_id", "height", "width", "data").hint("merge"), "page_id", "left")
    else:
        # a page costs far more than its row weighs, so the rows are spread over all cores
        both = per_page.join(images.withColumn("there", F.lit(True)), "page_id", "left").repartition(images.sparkSession.sparkContext.defaultParallelism)

    def make(row):
        if load is not None and not row.there:
            raise ValueError("unreadable")
        gray = _gray(row) if load is None else load(row)
        out = []
        for b in row.boxes:
            w, h, pitch = b["x2"] - b["x1"], b["y2"] - b["y1"], b["rule_pitch"]
            why = "too low" if h < S.MIN_HEIGHT * pitch else "too narrow" if w < S.MIN_WIDTH * pitch else None
            crop = None if why else X.padded_crop(gray, (b["x1"], b["y1"], b["x2"], b["y2"]), int(round(S.PAD * pitch)))
            out.append((row.page_id, b["block_id"], b["line_id"], *(crop.shape if crop is not None else (None, None)), crop.tobytes() if crop is not None else None, why, None))
        return out

    return _each(both, _CROP, make, lambda row, e: [(row.page_id, b["block_id"], b["line_id"], None, None, None, None, e) for b in row.boxes])


def explode_expressions(crops: DataFrame) -> DataFrame:
    """One row per expression of crops (line_uid, rule_pitch, height, width, data); none for a blank crop."""

    def make(row):
        found = X.prepare(_gray(row), float(row.rule_pitch))
        return [(row.line_uid, i, len(found), *f["offset"], f["ink_pixels"], *f["image"].shape, f["image"].tobytes(), None) for i, f in enumerate(found)]

    return _each(crops.select("line_uid", "rule_pitch", "height", "width", "data"), _EXPR, make, lambda row, e: (row.line_uid, None, None, None, None, None, None, None, None, e))
