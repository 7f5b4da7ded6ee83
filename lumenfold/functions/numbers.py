"""Scalar functions over numbers: token estimates, boxes, sampling steps and tiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def estimated_tokens(size: Column) -> Column:
    """A quarter of the bytes, rounded up, one at least."""
    return F.greatest(F.lit(1), F.ceil(F.greatest(size, F.lit(0)) / 4)).cast("bigint")


def image_tokens(width: Column, height: Column, patch: int = 28) -> Column:
    return (F.ceil(width / patch) * F.ceil(height / patch)).cast("bigint")


def text_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded down, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("bigint")


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two (x1, y1, x2, y2) arrays; 0 for degenerate boxes."""
    at = lambda box, i: F.get(box, F.lit(i))
    zero = F.lit(0.0)
    inter = F.greatest(zero, F.least(at(a, 2), at(b, 2)) - F.greatest(at(a, 0), at(b, 0))) * F.greatest(zero, F.least(at(a, 3), at(b, 3)) - F.greatest(at(a, 1), at(b, 1)))
    area = lambda box: F.greatest(zero, at(box, 2) - at(box, 0)) * F.greatest(zero, at(box, 3) - at(box, 1))
    union = area(a) + area(b) - inter
    return F.coalesce(F.when(union > 0, inter / union), zero)


def expand_box(box: Column, width: Column, height: Column, scale: float) -> Column:
    """A pixel box scaled about its centre and clipped to the image, halves to even."""
    at = lambda i: F.get(box, F.lit(i))
    cx, cy = (at(0) + at(2)) / 2, (at(1) + at(3)) / 2
    hw, hh = F.greatest(F.lit(1.0), (at(2) - at(0)) * scale / 2), F.greatest(F.lit(1.0), (at(3) - at(1)) * scale / 2)
    whole = lambda x: F.bround(x).cast("int")
    return F.array(F.greatest(F.lit(0), whole(cx - hw)), F.greatest(F.lit(0), whole(cy - hh)), F.least(width, whole(cx + hw)), F.least(height, whole(cy + hh)))


def frame_step(source_fps: Column, target_fps: Column) -> Column:
    """Every how many frames to sample."""
    return F.when((source_fps <= 0) | (target_fps <= 0), 1).otherwise(F.greatest(F.lit(1), F.bround(source_fps / target_fps).cast("int")))


def ratio(part: Column, whole: Column, digits: int = 4) -> Column:
    """part / whole, rounded; null for a whole of zero."""
    return F.round(part / F.nullif(whole, F.lit(0)), digits)


def confidence_95(p: Column, n: Column) -> Column:
    """Half-width of the normal approximation's 95 % interval."""
    return 1.96 * F.sqrt(p * (1 - p) / F.nullif(n, F.lit(0)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def budget(types: Column, total: int = 1000) -> Column:
    """Struct (anchor, evidence) of the token budget by the question's types, halves to even."""
    has = lambda *names: F.arrays_overlap(types, F.array(*map(F.lit, names)))
    share = F.when(has("spatial_relation"), 0.3).when(has("ocr", "temporal_order", "audio_visual"), 0.25).when(has("semantic_video"), 0.15).otherwise(0.2)
    anchor = F.bround(share * total).cast("int")
    return F.struct(anchor.alias("anchor"), (F.lit(total) - anchor).alias("evidence"))


def tile_grid(width: Column, height: Column, size: int = 448, most: int = 6) -> Column:
    """(columns, rows) of up to `most` tiles whose aspect is nearest the image's; of equals the last that the area fills half."""
    aspect = width / height
    grids = sorted({(i, j) for i in range(1, most + 1) for j in range(1, most + 1) if i * j <= most}, key=lambda g: (g[0] * g[1], g))
    start = F.struct(F.lit(float("inf")).alias("d"), F.lit(1).alias("columns"), F.lit(1).alias("rows"))

    def step(best: Column, g: Column) -> Column:
        d = F.abs(aspect - g["columns"] / g["rows"])
        better = (d < best["d"]) | ((d == best["d"]) & (width * height > 0.5 * size * size * g["columns"] * g["rows"]))
        return F.when(better, F.struct(d.alias("d"), g["columns"].alias("columns"), g["rows"].alias("rows"))).otherwise(best)

    every = F.array(*(F.struct(F.lit(i).alias("columns"), F.lit(j).alias("rows")) for i, j in grids))
    return F.aggregate(every, start, step, lambda b: F.struct(b["columns"].alias("columns"), b["rows"].alias("rows")))
