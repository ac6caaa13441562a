"""Box arithmetic as native column expressions. A box is four columns x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "") -> Box:
    return tuple(F.col(f"{prefix}{n}") for n in ("x1", "y1", "x2", "y2"))


def from_array(c: Column) -> Box:
    return tuple(F.get(c, F.lit(i)) for i in range(4))


def xywh(b: Box) -> tuple[Column, Column, Column, Column]:
    x1, y1, x2, y2 = b
    return x1, y1, x2 - x1, y2 - y1


def xyxy(x: Column, y: Column, w: Column, h: Column) -> Box:
    return x, y, x + w, y + h


def area(b: Box) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def overlap(a: Box, b: Box) -> Column:
    """Area of the intersection, 0 where the boxes do not meet."""
    zero = F.lit(0)
    return F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), zero) * F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), zero)


def ioa(a: Box, b: Box) -> Column:
    """Share of box a inside box b; 0.0 for a box a without area, null if a coordinate is null."""
    own = area(a)
    share = F.when(own > 0, overlap(a, b) / own).when(own <= 0, F.lit(0.0))
    return F.when(b[0].isNotNull() & b[1].isNotNull() & b[2].isNotNull() & b[3].isNotNull(), share)


def iou(a: Box, b: Box) -> Column:
    both = overlap(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def clip(v: Column, low: Column | float, high: Column | float) -> Column:
    return F.greatest(F.least(v, high if isinstance(high, Column) else F.lit(high)), low if isinstance(low, Column) else F.lit(low))


def union_box() -> list[Column]:
    """Aggregates of the least box around a group."""
    return [F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2")]


def yolo_line(class_id: Column, b: Box, width: Column, height: Column) -> Column:
    """Class and centre form, clipped to the page, six decimals."""
    x1, y1, x2, y2 = clip(b[0], 0, width), clip(b[1], 0, height), clip(b[2], 0, width), clip(b[3], 0, height)
    parts = [(x1 + x2) / 2 / width, (y1 + y2) / 2 / height, (x2 - x1) / width, (y2 - y1) / height]
    return F.format_string("%d %.6f %.6f %.6f %.6f", class_id, *[p.cast("double") for p in parts])


def pad_window(b: Box, pad: Column, width: Column, height: Column) -> dict[str, Column]:
    """Crop window with a margin, clamped to the page, and the white border that clamping leaves on each side."""
    x1, y1 = F.greatest(b[0] - pad, F.lit(0)), F.greatest(b[1] - pad, F.lit(0))
    x2, y2 = F.least(b[2] + pad, width), F.least(b[3] + pad, height)
    return {
        "cx1": x1, "cy1": y1, "cx2": x2, "cy2": y2,
        "left": x1 - (b[0] - pad), "top": y1 - (b[1] - pad), "right": (b[2] + pad) - x2, "bottom": (b[3] + pad) - y2,
    }


def page_scale(trimmed_w: Column, trimmed_h: Column, final_w: Column, final_h: Column, undersized: float = 0.90) -> Column:
    """A page under 90 % of the target on either side is scaled to fit, any other stays."""
    small = (trimmed_w < final_w * undersized) | (trimmed_h < final_h * undersized)
    return F.when(small, F.least(final_w / trimmed_w, final_h / trimmed_h)).otherwise(F.lit(1.0))


def remap_box(b: Box, angle: Column, source: tuple[Column, Column], crop: tuple[Column, Column], scale: Column, pad: tuple[Column, Column], final: tuple[Column, Column]) -> Box:
    """Rotate about the source centre, subtract the crop origin, scale, add padding, clip; null where nothing is left."""
    cx, cy = source[0] / 2.0, source[1] / 2.0
    cos, sin = F.cos(F.radians(angle)), F.sin(F.radians(angle))
    xs, ys = [], []
    for x, y in ((b[0], b[1]), (b[2], b[1]), (b[2], b[3]), (b[0], b[3])):
        dx, dy = x - cx, y - cy
        xs.append((cos * dx + sin * dy + cx - crop[0]) * scale + pad[0])
        ys.append((cos * dy - sin * dx + cy - crop[1]) * scale + pad[1])
    x1, x2 = clip(F.least(*xs), 0.0, final[0]), clip(F.greatest(*xs), 0.0, final[0])
    y1, y2 = clip(F.least(*ys), 0.0, final[1]), clip(F.greatest(*ys), 0.0, final[1])
    some = (x2 > x1) & (y2 > y1)
    return tuple(F.when(some, v) for v in (x1, y1, x2, y2))


def crop_extent(anchor: Column, size: int, available: Column, seam: int = 15) -> tuple[Column, Column]:
    """(start, extent) of a fixed-size crop anchored after the seam, as far as the page reaches."""
    start = clip(anchor + seam, 0, F.greatest(available - 1, F.lit(0)))
    return start, F.least(F.lit(size), available - start)
