"""Queries of pixel operators over drawn pages, whose tilt, rules, boxes and expressions are known from the page's key."""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from paperloom.common import shared_folder
from paperloom.functions import pixels as X
from paperloom.operators import engines
from paperloom.operators import pages as P
from paperloom.plans.base import PAGES, Registry, pages
from paperloom.sources import files, sinks

R = Registry()
_H = f"{PAGES}, h AS (SELECT page_id, CAST(CAST('0x' || substr(sha256(page_id), 1, 4) AS UBIGINT) AS INT) AS h FROM pages)"


def keyed(spark, d):
    """(page_id, h): each page with a number from its key."""
    return pages(spark, d).select("page_id", F.conv(F.substring(F.sha2("page_id", 256), 1, 4), 16, 10).cast("int").alias("h"))


def to_draw(spark, d):
    """(path, page_id, h): pages for operators that draw a page where they read it."""
    # a page costs far more than its key weighs, so the keys are spread over all cores
    return keyed(spark, d).repartition(spark.sparkContext.defaultParallelism).select(F.col("page_id").alias("path"), "page_id", "h")


def drawn(spark, d, draw: Callable[[int], np.ndarray]):
    """(path, page_id, h, height, width, data): an image per page."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                g = draw(int(r.h))
                yield r.path, r.page_id, r.h, *g.shape, g.tobytes()

    names = ["path", "page_id", "h", "height", "width", "data"]
    return to_draw(spark, d).mapInPandas(lambda batches: P.frames(rows(batches), names), "path string, page_id string, h int, height int, width int, data binary")


def measured(df, schema: str, read: Callable[[np.ndarray, int], tuple], draw: Callable[[int], np.ndarray] | None = None):
    """(page_id, ...) what read() finds in each image of (page_id, h, height, width, data), or of (page_id, h) in what draw() makes of it in its task."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(r.page_id, *read(draw(int(r.h)) if draw else np.frombuffer(r.data, np.uint8).reshape(r.height, r.width), r.h)) for r in pdf.itertuples(index=False)]
            yield pd.DataFrame(out, columns=["page_id", *names])

    return df.select("page_id", "h", *([] if draw else ["height", "width", "data"])).mapInPandas(run, f"page_id string, {schema}")


def ruled(h: int) -> np.ndarray:
    """Six to eight ruled lines, 46 to 66 pixels apart, and between them two words."""
    pitch, n = 46 + 5 * (h % 5), 6 + h % 3
    g = np.full((30 + pitch * (n + 1), 500), 235, np.uint8)
    for k in range(n):
        g[30 + pitch * k : 32 + pitch * k, 5:495] = 120
    for x in (60, 260):
        g[36 + pitch : 36 + pitch + 20, x : x + 90 : 3] = 30
        g[36 + pitch : 38 + pitch, x : x + 90] = 30
    return g


@R.add(f"WITH {_H} SELECT page_id, (46 + 5 * (h % 5))::DOUBLE AS rule_pitch, 6 + h % 3 AS rules_removed, 2 AS n_regions, 1.0::DOUBLE AS ink_covered FROM h")
def x09_ruled_pages(spark, d):
    """Rules parted from handwriting, regions of what is left."""
    got = P.segment_images(to_draw(spark, d), lambda row: ruled(int(row.h)))
    return got.select("page_id", "rule_pitch", "rules_removed", F.size("regions").alias("n_regions"), "ink_covered")


def tilted(h: int) -> np.ndarray:
    """Fourteen ruled lines tilted by -2 to 2 degrees, whole lines from border to border."""
    angle = h % 5 - 2
    g = np.full((270, 320), 230, np.uint8)
    x = np.arange(320)
    for k in range(20, 250, 17):
        y = np.rint(k + np.tan(np.radians(angle)) * (x - 160)).astype(int)
        g[y, x] = g[y + 1, x] = 60
    return g


@R.add(f"WITH {_H} SELECT page_id, h % 5 - 2 AS angle, 270 AS height, 320 AS width, true AS level, true AS toned FROM h")
def x21_tilted_pages(spark, d):
    """Pages made level and toned: the tilt where it is found to a tenth of a degree, that none is left, and that paper is white."""
    got = P.prepare_images(to_draw(spark, d), 15, lambda row: tilted(int(row.h)))
    near = F.when(F.abs(F.col("angle") - F.round("angle")) < 0.1, F.round("angle").cast("int")).otherwise(99)

    def read(g: np.ndarray, h: int) -> tuple:
        return h, *g.shape, abs(X.skew_angle(g)) < 0.2, int(np.percentile(g, 90)) == 255

    return measured(got.withColumn("h", near), "angle int, height int, width int, level boolean, toned boolean", read)


@R.add(f"WITH {_H} SELECT page_id, 20 * 30 * (1 + h % 4) AS ink, 3 * (1 + h % 4) AS n_closed, 20 * (1 + h % 4) * 33 AS union_ink, 20 * (1 + h % 4) * 3 AS without_ink FROM h")
def u05_mask_algebra(spark, d):
    """Ink told from paper by its own threshold, and masks put together: or with what closing adds, and not what was there."""

    def draw(h: int) -> np.ndarray:
        g = np.full((40, 200), 200, np.uint8)
        for k in range(1 + h % 4):
            g[10:30, 10 + 45 * k : 25 + 45 * k] = g[10:30, 28 + 45 * k : 43 + 45 * k] = 40
        return g

    def read(g: np.ndarray, h: int) -> tuple:
        ink = X.otsu_mask(g)
        n = 1 + h % 4
        closed = np.zeros_like(ink)
        for k in range(n):
            part = slice(10 + 45 * k, 43 + 45 * k)
            closed[:, part] = X.close_rows(ink[:, part], 4)
        return int(ink.sum()), int((closed & ~ink)[20].sum()), int((ink | closed).sum()), int((closed & ~ink).sum())

    return measured(drawn(spark, d, draw), "ink int, n_closed int, union_ink int, without_ink int", read)


@R.add(f"WITH {_H} SELECT page_id, [34 + h % 10, 24, 241, 281 - h % 20] AS paper, [60 + h % 20, 50, 160 + h % 20, 90] AS ink, 2177 AS crop_height, 1598 AS crop_width, 3 + h % 2 AS n_lines, 4000 AS white FROM h")
def x12_page_frames(spark, d):
    """The sheet on a dark table (within half the smoothing's width), the box of its ink, a crop of fixed size, straight lines of a table, and a rule taken out of a crop."""

    def draw(h: int) -> np.ndarray:
        g = np.full((300, 260), 20, np.uint8)
        g[20 : 285 - h % 20, 30 + h % 10 : 245] = 240
        g[50:90, 60 + h % 20 : 160 + h % 20] = 60
        return g

    def read(g: np.ndarray, h: int) -> tuple:
        sheet = np.where(g == 20, 240, g).astype(np.uint8)
        table = np.zeros((200, 200), bool)
        for k in range(3 + h % 2):
            table[20 + 50 * k, 10:190] = True
        crop = np.full((40, 100), 255, np.uint8)
        crop[20:22] = 0
        clean, _ = X.suppress_rules(crop, 58.4)
        return list(X.paper_box(g, 0)), list(X.ink_extent(X.ink_mask(sheet))), *X.fixed_crop(g, (5, 5)).shape, len(X.table_lines(table)), int((clean == 255).sum())

    return measured(to_draw(spark, d), "paper array<int>, ink array<int>, crop_height int, crop_width int, n_lines int, white int", read, draw)


def formula(h: int) -> np.ndarray:
    """One to three groups of two glyphs on a line."""
    g = np.full((60, 500), 255, np.uint8)
    for k in range(1 + h % 3):
        x = 12 + 160 * k + h % 7
        g[20:40, x : x + 16] = g[20:40, x + 26 : x + 46] = 0
    return g


def _crops(spark, d):
    return drawn(spark, d, formula).select(F.col("page_id").alias("line_uid"), F.lit(58.4).alias("rule_pitch"), "height", "width", "data")


@R.add(f"WITH {_H} SELECT page_id AS line_uid, k::INT AS \"index\", 1 + h % 3 AS \"of\", (12 + 160 * k + h % 7 - 7)::INT AS dx, 13 AS dy, 20 * 36 AS ink_pixels, 34 AS height, 60 AS width FROM h, range(3) r(k) WHERE k <= h % 3")
def x15_drawn_expressions(spark, d):
    """Crops cut into expressions, each with its place in the crop."""
    return P.explode_expressions(_crops(spark, d)).select("line_uid", "index", "of", "dx", "dy", "ink_pixels", "height", "width")


@R.add(f"WITH {_H} SELECT page_id AS line_uid, k::INT AS \"index\", '' AS latex, 0.0::DOUBLE AS confidence, true AS simulated FROM h, range(3) r(k) WHERE k <= h % 3")
def x15_null_readings(spark, d):
    """The same expressions through the engine that reads nothing."""
    return engines.recognise(P.explode_expressions(_crops(spark, d)), "none").select("line_uid", "index", "latex", "confidence", "simulated")


@R.add(
    f"""WITH {_H}, b AS (SELECT page_id, h, k::INT AS line_id, CASE WHEN k = 2 THEN 4 ELSE 30 END AS high, 80 + h % 9 AS wide FROM h, range(3) r(k)),
    c AS (SELECT *, regexp_extract(page_id, '^s(\\d+)_c(\\d+)_p(\\d+)$', 1) AS s FROM b)
    SELECT page_id, 0 AS block_id, line_id, CASE WHEN line_id < 2 THEN wide + 12 END AS width, CASE WHEN line_id < 2 THEN high + 12 END AS height,
      CASE WHEN line_id < 2 AND s <> '' THEN 'student_' || s || '/cie_' || regexp_extract(page_id, '_c(\\d+)_', 1) || '/page_' || regexp_extract(page_id, '_p(\\d+)$', 1) || printf('/b00_l%02d.png', line_id) END AS crop,
      CASE WHEN line_id = 2 THEN 'too low' END AS skipped FROM c"""
)
def k02_crop_manifest(spark, d):
    """Crops of three lines of each page, one of them too low, and their manifest."""
    line = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("line_id")
    lines = keyed(spark, d).select("page_id", "h", F.lit(0).alias("block_id"), line)
    lines = lines.select("page_id", "block_id", "line_id", F.lit(20).alias("x1"), (F.lit(20) + 50 * F.col("line_id")).alias("y1"), (F.lit(100) + F.col("h") % 9).alias("x2"), (F.lit(20) + 50 * F.col("line_id") + F.when(F.col("line_id") == 2, 4).otherwise(30)).alias("y2"), F.lit(58.4).alias("rule_pitch"))
    return sinks.crop_manifest(P.crop_lines(keyed(spark, d), lines, lambda row: ruled(int(row.h))))


def png(g: np.ndarray) -> bytes:
    """A grey image as PNG."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = b"".join(b"\0" + row.tobytes() for row in g)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", g.shape[1], g.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


@R.add(
    """WITH p(student, cie, page) AS (SELECT s, c, p FROM range(1, 4) a(s), range(1, 3) b(c), range(1, 5) x(p))
    SELECT printf('s%02d_c%d_p%02d', student, cie, page) AS page_id, CASE WHEN page = 4 THEN NULL ELSE 20 + page END::INT AS height, CASE WHEN page = 4 THEN NULL ELSE 30 END::INT AS width,
      CASE WHEN page = 4 THEN NULL ELSE 40 * page + student END::INT AS grey, page = 1 AS cover FROM p"""
)
def s05_page_files(spark, d):
    """A small tree of page files, listed and decoded; every fourth file is no image and has null pixels."""
    root = f"{shared_folder(spark).removeprefix('file:')}/tree-{uuid.uuid4().hex}"
    rows = [(s, c, p) for s in range(1, 4) for c in range(1, 3) for p in range(1, 5)]

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                folder = f"{root}/student_{r.student:02d}/cie_{r.cie}"
                os.makedirs(folder, exist_ok=True)
                with open(f"{folder}/page_{r.page:02d}.png", "wb") as f:
                    f.write(b"no image" if r.page == 4 else png(np.full((20 + r.page, 30), 40 * r.page + r.student, np.uint8)))
            yield pdf[["page"]]

    spark.createDataFrame(rows, "student int, cie int, page int").mapInPandas(write, "page int").count()
    listed = files.corpus(spark, root).select("page_id", (F.col("page_kind") == "cover").alias("cover"))
    grey = F.conv(F.hex(F.substring("data", 1, 1)), 16, 10).cast("int")
    decoded = files.images(spark, root).select("page_id", "height", "width", grey.alias("grey"))
    return decoded.join(listed, "page_id")


QUERIES, SQL = R.queries, R.sql
