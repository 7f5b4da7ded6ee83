"""Crop boxes that a question suggests, in pixels of an image or as shares of a frame."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenfold.functions import terms
from lumenfold.functions.text import any_of


def pixel_box(width: Column, height: Column, x1: float, y1: float, x2: float, y2: float) -> Column:
    """(left, upper, right, lower) within the image, a pixel at least, halves to even."""
    whole = lambda side, share: F.bround(side * share).cast("int")
    inside = lambda v, most: F.greatest(F.lit(0), F.least(most, v))
    left, upper = inside(whole(width, x1), width - 1), inside(whole(height, y1), height - 1)
    return F.array(left, upper, F.greatest(left + 1, F.least(width, whole(width, x2))), F.greatest(upper + 1, F.least(height, whole(height, y2))))


def _unique(boxes: Column) -> Column:
    """The first of each box."""
    return F.filter(boxes, lambda b, i: ~F.exists(F.slice(boxes, F.lit(1), i), lambda a: a["box"] == b["box"]))


def image_crops(low: Column, width: Column, height: Column, spatial: Column) -> Column:
    """Array of (label, box): sides that the lower-cased question names, the centre, then corners for spatial questions or bands."""
    crop = lambda c: F.struct(F.lit(c[0]).alias("label"), pixel_box(width, height, *c[1:]).alias("box"))
    sides = [F.when(any_of(low, words), crop(c)) for words, c in terms.IMAGE_CROPS.values()]
    rest = F.when(spatial, F.array(*map(crop, terms.CORNER_CROPS))).otherwise(F.array(*map(crop, terms.BAND_CROPS)))
    return _unique(F.concat(F.array_compact(F.array(*sides)), F.array(crop(terms.CENTER_CROP)), rest))


def _shares(crops) -> Column:
    return F.array(*(F.struct(F.lit(c[0]).alias("label"), F.array(*map(F.lit, c[1:])).alias("box")) for c in crops))


def frame_crops(low: Column) -> Column:
    """Array of (label, box as shares) for key frames: for text, for sides, or in general."""
    return F.when(any_of(low, terms.FRAME_TEXT_TERMS), _shares(terms.FRAME_CROPS["text"])).when(any_of(low, terms.SIDE_TERMS), _shares(terms.FRAME_CROPS["side"])).otherwise(_shares(terms.FRAME_CROPS["other"]))


def tubelet_crops(low: Column) -> Column:
    """Array of (label, box as shares) for short clips."""
    return F.when(any_of(low, terms.TUBELET_TEXT_TERMS), _shares(terms.TUBELET_CROPS["text"])).when(any_of(low, terms.SIDE_TERMS), _shares(terms.TUBELET_CROPS["side"])).otherwise(_shares(terms.TUBELET_CROPS["other"]))
