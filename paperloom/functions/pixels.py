"""Pixel operators on NumPy arrays, written over runs of ink.

A mask is a boolean array; along a row it is a list of runs [begin, end).
Opening by k keeps runs of at least k, closing by k joins runs whose gap is
under k; nothing is joined to the border. Components are found by union-find
over runs of neighbouring rows. All lengths with `pitch` are in rule pitches.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# fixed values: grey levels and shares
INK_SEGMENT, INK_MATH, INK_COVERAGE = 180, 200, 160
BLACK, PAPER = 90, 215
BACKGROUND = 51


def ink_mask(gray: np.ndarray, below: int = INK_SEGMENT) -> np.ndarray:
    return gray < below


def otsu_mask(gray: np.ndarray) -> np.ndarray:
    """Ink by the threshold that separates two grey classes best; nothing on a page of one grey."""
    hist = np.bincount(gray.ravel(), minlength=256).astype(float)
    n, total = hist.cumsum(), (hist * np.arange(256)).cumsum()
    left, right = n[:-1], n[-1] - n[:-1]
    ok = (left > 0) & (right > 0)
    if not ok.any():
        return np.zeros_like(gray, dtype=bool)
    spread = np.zeros(255)
    spread[ok] = left[ok] * right[ok] * (total[:-1][ok] / left[ok] - (total[-1] - total[:-1][ok]) / right[ok]) ** 2
    return gray <= int(spread.argmax())


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, begin, end) of the runs of a mask, row by row."""
    h, w = mask.shape
    flat = np.zeros(h * (w + 1) + 1, dtype=bool)  # a blank column parts the rows
    flat[1:].reshape(h, w + 1)[:, :w] = mask
    turn = np.flatnonzero(flat[1:] != flat[:-1])
    row, begin = np.divmod(turn[::2], w + 1)
    return row, begin, turn[1::2] - row * (w + 1)


def paint(shape: tuple[int, int], row: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    long = end - begin
    out = np.zeros(shape, dtype=bool)
    out.ravel()[np.repeat(row * shape[1] + begin - (long.cumsum() - long), long) + np.arange(long.sum())] = True
    return out


def open_rows(mask: np.ndarray, k: int) -> np.ndarray:
    row, a, b = runs(mask)
    keep = b - a >= k
    return paint(mask.shape, row[keep], a[keep], b[keep])


def close_rows(mask: np.ndarray, k: int) -> np.ndarray:
    row, a, b = runs(mask)
    near = (row[1:] == row[:-1]) & (a[1:] - b[:-1] < k)
    return mask | paint(mask.shape, row[:-1][near], b[:-1][near], a[1:][near])


def open_columns(mask: np.ndarray, k: int) -> np.ndarray:
    return open_rows(mask.T, k).T


def close_columns(mask: np.ndarray, k: int) -> np.ndarray:
    return close_rows(mask.T, k).T


def dilate(mask: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """Mask spread by dy rows and dx columns to each side."""
    out = mask.copy()
    for axis, reach in ((0, dy), (1, dx)):
        base = out.copy()
        for s in range(1, reach + 1):
            a = [slice(None)] * 2
            b = [slice(None)] * 2
            a[axis], b[axis] = slice(s, None), slice(None, -s)
            out[tuple(a)] |= base[tuple(b)]
            out[tuple(b)] |= base[tuple(a)]
    return out


@dataclass
class Components:
    label: np.ndarray  # label of each run
    row: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    boxes: np.ndarray  # x1, y1, x2, y2 by label
    area: np.ndarray
    centre_y: np.ndarray
    shape: tuple[int, int]

    def mask(self, keep: np.ndarray) -> np.ndarray:
        some = keep[self.label]
        return paint(self.shape, self.row[some], self.begin[some], self.end[some])


def components(mask: np.ndarray) -> Components:
    """8-connected components."""
    row, a, b = runs(mask)
    n = len(row)
    parent = np.arange(n)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first = np.searchsorted(row, np.arange(mask.shape[0] + 1))
    for y in range(1, mask.shape[0]):
        i, i_end, j, j_end = first[y - 1], first[y], first[y], first[y + 1]
        while i < i_end and j < j_end:
            if a[i] <= b[j] and a[j] <= b[i]:
                p, q = root(i), root(j)
                if p != q:
                    parent[max(p, q)] = min(p, q)
            if b[i] < b[j]:
                i += 1
            else:
                j += 1
    roots = np.array([root(i) for i in range(n)], dtype=np.int64)
    _, label = np.unique(roots, return_inverse=True)
    k = int(label.max()) + 1 if n else 0
    boxes = np.zeros((k, 4), dtype=np.int64)
    boxes[:, :2] = 1 << 30
    np.minimum.at(boxes[:, 0], label, a)
    np.minimum.at(boxes[:, 1], label, row)
    np.maximum.at(boxes[:, 2], label, b)
    np.maximum.at(boxes[:, 3], label, row + 1)
    area = np.bincount(label, b - a, k) if n else np.zeros(0)
    centre = np.bincount(label, row * (b - a), k) / np.maximum(area, 1) if n else np.zeros(0)
    return Components(label, row, a, b, boxes, area, centre, mask.shape)


def printed_rules(mask: np.ndarray, probe: float, bridge: float, length: float) -> tuple[np.ndarray, np.ndarray]:
    """(pixels, centres) of long horizontal strokes: opened by a probe, bridged, kept where wide enough."""
    width = mask.shape[1]
    straight = open_rows(mask, max(1, int(width * probe)))
    found = components(close_rows(straight, max(1, int(width * bridge))))
    keep = found.boxes[:, 2] - found.boxes[:, 0] >= length * width if len(found.area) else np.zeros(0, dtype=bool)
    return (found.mask(keep) & straight if len(keep) else np.zeros_like(mask)), np.sort(found.centre_y[keep])


def split_rules(mask: np.ndarray, usual: float = 58.5) -> tuple[np.ndarray, np.ndarray, float, list[float]]:
    """(handwriting, rules, pitch, rule rows): ruled lines over 55 % of the width and margins over 50 % of the height taken out."""
    level, centres = printed_rules(mask, 1 / 20, 0.04, 0.55)
    upright, _ = printed_rules(mask.T, 1 / 25, 0.04, 0.5)
    rules = dilate(level, 1, 0) | dilate(upright.T, 0, 1)
    steps = np.diff(centres)
    steps = steps[(steps > 0.5 * usual) & (steps < 1.5 * usual)]
    pitch = float(np.median(steps)) if len(centres) >= 3 and len(steps) else usual
    return mask & ~rules, rules, pitch, centres.tolist()


def region_boxes(mask: np.ndarray, across: int, down: int = 0, least_area: float = 0.0) -> list[tuple[int, int, int, int]]:
    """Boxes of ink smeared `across` columns and `down` rows, of at least an area in pixels of the smear's box; absolute units."""
    smear = close_rows(mask, across)
    if down:
        smear = close_columns(smear, down)
    b = components(smear).boxes
    size = (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1])
    return [tuple(int(v) for v in x) for x in b[size >= least_area]]


def find_regions(clean: np.ndarray, pitch: float) -> list[tuple[int, int, int, int]]:
    """Regions in pitch units: smeared 0.55 pitch sideways only, at least 0.006 square pitches."""
    return region_boxes(clean, max(1, int(0.55 * pitch)), 0, 0.006 * pitch * pitch)


def coverage(mask: np.ndarray, boxes: list[tuple[int, int, int, int]]) -> float | None:
    """Share of ink in the union of the boxes; None on a page without ink."""
    ink = int(mask.sum())
    if not ink:
        return None
    inside = np.zeros_like(mask)
    for x1, y1, x2, y2 in boxes:
        inside[y1:y2, x1:x2] = True
    return float((mask & inside).sum() / ink)


def skew_angle(gray: np.ndarray, most: float = 4.0, least_segments: int = 12, probe: int = 60) -> float:
    """Tilt of the ruled lines in degrees: a line is fitted to every long stroke; the median, 0 without enough of them.

    A deterministic fit in place of a sampled line transform.
    """
    mask = otsu_mask(gray)
    width = mask.shape[1]
    found = components(close_rows(open_rows(mask, max(4, probe // 4)), probe))
    angles = []
    for k in np.flatnonzero(found.boxes[:, 2] - found.boxes[:, 0] >= width / 5) if len(found.area) else []:
        at = found.label == k
        x = (found.begin[at] + found.end[at] - 1) / 2
        w = (found.end[at] - found.begin[at]).astype(float)
        if len(x) < 2 or np.ptp(x) == 0:
            angles.append(0.0)
            continue
        mx, my = np.average(x, weights=w), np.average(found.row[at], weights=w)
        # strokes have an extent of their own along x
        var = np.average((x - mx) ** 2 + w**2 / 12, weights=w)
        angles.append(float(np.degrees(np.arctan2(np.average((x - mx) * (found.row[at] - my), weights=w), var))))
    good = [a for a in angles if abs(a) <= most]
    return float(np.median(good)) if len(good) >= least_segments else 0.0


def rotate(gray: np.ndarray, angle: float) -> np.ndarray:
    """Rotated about the centre so that a line of this tilt becomes level; bilinear, borders repeated."""
    h, w = gray.shape
    t = np.radians(angle)
    dx, dy = np.arange(w, dtype=float)[None, :] - w / 2, np.arange(h, dtype=float)[:, None] - h / 2
    sx = np.clip(np.cos(t) * dx - np.sin(t) * dy + w / 2, 0, w - 1)
    sy = np.clip(np.sin(t) * dx + np.cos(t) * dy + h / 2, 0, h - 1)
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fx, fy = sx - x0, sy - y0
    g = gray.astype(float)
    out = g[y0, x0] * (1 - fx) * (1 - fy) + g[y0, x1] * fx * (1 - fy) + g[y1, x0] * (1 - fx) * fy + g[y1, x1] * fx * fy
    return np.rint(out).astype(np.uint8)


def _slide(a: np.ndarray, reach: int, largest: bool) -> np.ndarray:
    """Sliding maximum or minimum over 2 * reach + 1 columns, borders repeated."""
    of, out = np.maximum if largest else np.minimum, np.pad(a, ((0, 0), (reach, reach)), mode="edge")
    size, whole = 1, 2 * reach + 1
    while size < whole:  # windows of up to twice the size are two that meet or overlap
        step = min(size, whole - size)
        out = of(out[:, :-step], out[:, step:])
        size += step
    return out


def background(gray: np.ndarray, size: int = BACKGROUND) -> np.ndarray:
    """Grey closing by a disc: the paper with narrow ink filled in. Built of row spans of the disc."""
    r = size // 2
    spans = [int(np.sqrt(max(r * r - dy * dy, 0))) for dy in range(-r, r + 1)]

    def spread(a: np.ndarray, largest: bool) -> np.ndarray:
        rows = {s: _slide(a, s, largest) for s in set(spans)}
        h = a.shape[0]
        out = None
        for dy, s in zip(range(-r, r + 1), spans, strict=True):
            part = rows[s][np.clip(np.arange(h) + dy, 0, h - 1)]
            out = part if out is None else np.maximum(out, part) if largest else np.minimum(out, part)
        return out

    return spread(spread(gray, True), False)


def stretch(gray: np.ndarray) -> np.ndarray:
    """Grey 90 to black and 215 to white, linear between."""
    return np.clip((gray.astype(np.float32) - BLACK) * 255.0 / (PAPER - BLACK), 0, 255).astype(np.uint8)


def flatten(gray: np.ndarray, size: int = BACKGROUND) -> np.ndarray:
    return np.clip(gray.astype(np.float32) / np.maximum(background(gray, size), 1) * 255.0, 0, 255).astype(np.uint8)


def tone(gray: np.ndarray, size: int = BACKGROUND) -> np.ndarray:
    return stretch(flatten(gray, size))


def bright_span(means: np.ndarray, share: float = 0.90, smooth: int = 9) -> tuple[int, int]:
    """First and last place where the sliding minimum reaches a share of the median; an all-dark line gives (n, -1)."""
    r = smooth // 2
    low = _slide(means[None, :].astype(float), r, False)[0]
    bright = np.flatnonzero(low >= share * np.median(means))
    return (int(bright[0]), int(bright[-1])) if len(bright) else (len(means), -1)


def paper_box(gray: np.ndarray, margin: int = 4) -> tuple[int, int, int, int]:
    """Box of the paper within dark edges; the whole page where under half of it would be left."""
    h, w = gray.shape
    (x1, x2), (y1, y2) = bright_span(gray.mean(axis=0)), bright_span(gray.mean(axis=1))
    x1, y1, x2, y2 = min(x1 + margin, w), min(y1 + margin, h), max(x2 + 1 - margin, 0), max(y2 + 1 - margin, 0)
    return (0, 0, w, h) if (x2 - x1) * (y2 - y1) < 0.5 * w * h or x2 <= x1 else (x1, y1, x2, y2)


def fixed_crop(gray: np.ndarray, anchor: tuple[int, int], size: tuple[int, int] = (1598, 2177), seam: int = 15) -> np.ndarray:
    """Crop of one size from an anchor after the seam; where the page ends it is white."""
    w, h = size
    x, y = max(0, anchor[0] + seam), max(0, anchor[1])
    out = np.full((h, w), 255, dtype=np.uint8)
    part = gray[y : y + h, x : x + w]
    out[: part.shape[0], : part.shape[1]] = part
    return out


def padded_crop(gray: np.ndarray, box: tuple[int, int, int, int], pad: int) -> np.ndarray:
    """The box with a margin on every side, white where the margin leaves the page."""
    h, w = gray.shape
    x1, y1, x2, y2 = box[0] - pad, box[1] - pad, box[2] + pad, box[3] + pad
    out = np.full((max(0, y2 - y1), max(0, x2 - x1)), 255, dtype=np.uint8)
    part = gray[max(0, y1) : min(h, y2), max(0, x1) : min(w, x2)]
    top, left = max(0, -y1), max(0, -x1)
    out[top : top + part.shape[0], left : left + part.shape[1]] = part
    return out


def table_lines(mask: np.ndarray, probe: int = 40, least: float = 0.15) -> list[tuple[str, float, float, float]]:
    """(axis, pos, start, end) of straight lines of at least a share of the page in either direction."""
    out = []
    for axis, m in (("horizontal", mask), ("vertical", mask.T)):
        found = components(open_rows(m, probe))
        for b, c in zip(found.boxes, found.centre_y, strict=True):
            if b[2] - b[0] >= least * m.shape[1]:
                out.append((axis, float(c), float(b[0]), float(b[2])))
    return out


def ink_extent(mask: np.ndarray, margin: float = 0.03) -> tuple[int, int, int, int] | None:
    """Box of all ink with the edges of the page blanked; None without ink."""
    m = mask.copy()
    dy, dx = int(m.shape[0] * margin), int(m.shape[1] * margin)
    m[:dy], m[m.shape[0] - dy :], m[:, :dx], m[:, m.shape[1] - dx :] = False, False, False, False
    ys, xs = np.flatnonzero(m.any(axis=1)), np.flatnonzero(m.any(axis=0))
    return (int(xs[0]), int(ys[0]), int(xs[-1]) + 1, int(ys[-1]) + 1) if len(ys) else None


def suppress_rules(gray: np.ndarray, pitch: float, span: float = 0.85, edge: float = 0.02) -> tuple[np.ndarray, int]:
    """Rules of a crop made white: straight through to both borders and nowhere thick. (crop, pixels erased)."""
    mask = ink_mask(gray, INK_MATH)
    thick = max(3, int(round(0.10 * pitch)))
    gone = np.zeros_like(mask)
    for turned in (False, True):
        m = mask.T if turned else mask
        n = m.shape[1]
        if round(span * n) < 8:
            continue
        c = components(open_rows(m, int(round(span * n))))
        tol = max(1, int(round(edge * n)))
        keep = (c.boxes[:, 0] <= tol) & (c.boxes[:, 2] - 1 >= n - 1 - tol)
        hit = c.mask(keep) & ~open_columns(m, thick) if len(keep) else np.zeros_like(m)
        gone |= hit.T if turned else hit
    out = gray.copy()
    out[gone] = 255
    return out, int(gone.sum())


def x_height(mask: np.ndarray, pitch: float) -> float:
    """Median height of components over the floor; 0.30 pitch where there are none, 0 for an empty mask."""
    if not mask.any():
        return 0.0
    c = components(mask)
    h = c.boxes[:, 3] - c.boxes[:, 1]
    h = h[(h >= max(4, 0.12 * pitch)) & (c.area >= 12)]
    return float(np.median(h)) if len(h) else 0.30 * pitch


def glyph_mask(mask: np.ndarray, pitch: float) -> np.ndarray:
    """Mask without debris: components as large as a glyph in one direction at least."""
    c = components(mask)
    if not len(c.area):
        return mask
    least = max(4, 0.12 * pitch)
    return c.mask(np.maximum(c.boxes[:, 2] - c.boxes[:, 0], c.boxes[:, 3] - c.boxes[:, 1]) >= least)


def split_spans(mask: np.ndarray, gap: int) -> list[tuple[int, int]]:
    """Spans of inked columns, cut where `gap` or more columns are blank."""
    xs = np.flatnonzero(mask.any(axis=0))
    if not len(xs):
        return []
    cut = np.flatnonzero(np.diff(xs) - 1 >= gap)
    return [(int(a), int(b) + 1) for a, b in zip(xs[np.concatenate([[0], cut + 1])], xs[np.concatenate([cut, [len(xs) - 1]])], strict=True)]


def prepare(gray: np.ndarray, pitch: float, least_ink: int = 25) -> list[dict]:
    """Padded images of the expressions of a crop, each with its offset in the crop and its ink; none for a blank crop."""
    clean, _ = suppress_rules(gray, pitch)
    mask = glyph_mask(ink_mask(clean, INK_MATH), pitch)
    if not mask.any():
        return []
    high = x_height(mask, pitch)
    pad = max(2, int(round(0.35 * high)))
    out = []
    for x1, x2 in split_spans(mask, max(2, int(round(2.2 * high)))):
        part = mask[:, x1:x2]
        if part.sum() < least_ink:
            continue
        ys = np.flatnonzero(part.any(axis=1))
        y1, y2 = int(ys[0]), int(ys[-1]) + 1
        out.append({"image": np.pad(clean[y1:y2, x1:x2], pad, constant_values=255), "offset": (x1 - pad, y1 - pad), "ink_pixels": int(part.sum())})
    return out


def segment_page(gray: np.ndarray) -> dict:
    """Page record of the pixel side: rules removed, pitch, ink, regions and the share of ink they cover."""
    mask = ink_mask(gray)
    clean, _, pitch, rows = split_rules(mask)
    boxes = find_regions(clean, pitch)
    return {"rule_pitch": pitch, "rules_removed": len(rows), "ink_pixels": int(clean.sum()), "ink_covered": coverage(clean, boxes), "regions": boxes, "rule_rows": rows}
