"""Pixel operators on arrays with known answers."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra import numpy as hn

from paperloom.functions import pixels as X
from paperloom.operators import pages as P


def test_stretch():
    assert X.stretch(np.array([0, 90, 150, 215, 255], np.uint8)).tolist() == [0, 0, 122, 255, 255]


def _page():
    g = np.full((600, 500), 255, np.uint8)
    for y in range(20, 600, 58):
        g[y : y + 2] = 60
    g[:, 40:42] = 60
    g[100:115, 100:160] = 20
    g[300:302, 200:300] = 20
    return g


def test_rules_go_and_strokes_stay():
    clean, rules, pitch, rows = X.split_rules(X.ink_mask(_page()))
    assert pitch == 58.0 and len(rows) == 10
    assert clean[300:302, 200:300].all() and clean[100:115, 100:160].all()
    assert not clean[:, 40:42].any() and not clean[20:22].any()
    r = X.segment_page(_page())
    assert r["regions"] == [(100, 100, 160, 115), (200, 300, 300, 302)] and r["ink_covered"] == 1.0


def test_blank_page_has_no_coverage():
    r = X.segment_page(np.full((50, 50), 255, np.uint8))
    assert r["ink_pixels"] == 0 and r["ink_covered"] is None and r["regions"] == []


def test_skew():
    g = np.full((800, 1000), 250, np.uint8)
    x = np.arange(1000)
    for k in range(30, 780, 40):
        y = np.rint(k + np.tan(np.radians(1.5)) * (x - 500)).astype(int)
        ok = (y >= 0) & (y < 798)
        g[y[ok], x[ok]] = g[y[ok] + 1, x[ok]] = 50
    assert abs(X.skew_angle(g) - 1.5) < 0.1
    assert abs(X.skew_angle(X.rotate(g, X.skew_angle(g)))) < 0.1
    assert X.skew_angle(np.full((100, 100), 255, np.uint8)) == 0.0


def test_expressions():
    def crop(gap):
        c = np.full((60, 220), 255, np.uint8)
        c[20:40, 10:30] = c[20:40, 30 + gap : 60 + gap] = 0
        return c

    assert len(X.prepare(crop(44), 58.4)) == 2 and len(X.prepare(crop(43), 58.4)) == 1
    assert X.prepare(np.full((40, 90), 255, np.uint8), 58.4) == [] and X.x_height(np.zeros((5, 5), bool), 58.4) == 0.0
    assert X.prepare(crop(44), 58.4)[0]["offset"] == (10 - 7, 20 - 7)


@settings(max_examples=60, deadline=None)
@given(hn.arrays(bool, hn.array_shapes(min_dims=2, max_dims=2, max_side=12)), st.integers(1, 4))
def test_runs_against_brute_force(mask, k):
    opened = X.open_rows(mask, k)
    want = np.zeros_like(mask)
    for y, row in enumerate(mask):
        for x in range(len(row) - k + 1):
            if row[x : x + k].all():
                want[y, x : x + k] = True
    assert (opened == want).all()
    seen, n = np.zeros_like(mask), 0
    for y0, x0 in np.argwhere(mask):
        if not seen[y0, x0]:
            n += 1
            todo = [(y0, x0)]
            while todo:
                y, x = todo.pop()
                if 0 <= y < mask.shape[0] and 0 <= x < mask.shape[1] and mask[y, x] and not seen[y, x]:
                    seen[y, x] = True
                    todo += [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    c = X.components(mask)
    assert len(c.area) == n and int(sum(c.area)) == int(mask.sum())


def test_paper_and_crops():
    g = np.full((200, 300), 250, np.uint8)
    g[:, :30] = 10
    x1, y1, x2, y2 = X.paper_box(g)
    assert 30 <= x1 <= 42 and y1 == 4 and x2 == 296
    assert X.paper_box(np.zeros((50, 50), np.uint8)) == (4, 4, 46, 46)
    c = X.fixed_crop(g, (0, 0), (400, 250))
    assert c.shape == (250, 400) and (c[:, 285:] == 255).all()
    assert X.ink_extent(np.zeros((20, 20), bool)) is None
    lines = X.table_lines(X.ink_mask(_page()))
    assert sum(a == "horizontal" for a, *_ in lines) >= 10 and any(a == "vertical" for a, *_ in lines)
    assert X.tone(np.full((60, 60), 200, np.uint8), 11).min() == 255


def test_bad_pages_are_rows(spark):
    g = _page()
    df = spark.createDataFrame([("a", "a", 600, 500, bytearray(g.tobytes())), ("b", "b", None, None, None), ("c", "c", 7, 7, bytearray(b"xx"))], "path string, page_id string, height int, width int, data binary")
    got = {r.path: r for r in P.segment_images(df).collect()}
    assert got["a"].rule_pitch == 58.0 and got["a"].error is None and got["b"].error == "unreadable" and got["c"].error
