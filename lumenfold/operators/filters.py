"""Row filters: which images, videos and keys take part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.operators.sampling import first_of_each


def megapixels(width: Column, height: Column) -> Column:
    return F.round(width * height / 1_000_000, 4)


def high_resolution(images: DataFrame, width: int = 0, height: int = 0, pixels: float = 0.0, size: int = 0) -> DataFrame:
    """Images (width, height, bytes) at or over every threshold; unknown values count as 0."""
    at = lambda c: F.coalesce(F.col(c), F.lit(0))
    return images.where((at("width") >= width) & (at("height") >= height) & (megapixels(at("width"), at("height")) >= pixels) & (at("bytes") >= size))


def duration_matches(classes: tuple[str, ...] = (), least: float = 0.0, kind: str = "duration", seconds: tuple[str, ...] = ("duration_sec", "duration_seconds", "video_duration", "length")) -> Column:
    """True if a row's class is one of those asked for (or it has none) and the first of its lengths that can be read is long
    enough (or none can)."""
    own = F.lower(F.coalesce(F.col(kind), F.lit("")))
    allowed = (own == "") | own.isin(*classes) if classes else F.lit(True)
    length = F.coalesce(*(F.col(c).cast("string").try_cast("double") for c in seconds))
    return allowed & (F.coalesce(length >= least, F.lit(True)) if least > 0 else F.lit(True))


def resolution_matches(rows: DataFrame, media: DataFrame, key: str, width: int = 0, height: int = 0, smallest: int = 0, largest: int = 0) -> DataFrame:
    """Rows whose medium (key, size, width, height) is known, of a size in range and large enough; all rows if no side is asked for."""
    if width <= 0 and height <= 0:
        return rows
    good = media.where((F.coalesce("width", F.lit(0)) >= width) & (F.coalesce("height", F.lit(0)) >= height))
    good = good.where(F.col("size") >= smallest) if smallest else good
    good = good.where(F.col("size") <= largest) if largest else good
    return rows.join(good.select(key), key, "left_semi")


def selected(rows: DataFrame, requested: DataFrame | None, otherwise: Column, key: str = "record_key", unique: str | None = None, ord_: str = "ord") -> DataFrame:
    """Rows of the keys requested, or, without a request, those that a predicate takes; the first of each video if asked."""
    taken = rows.join(requested.select(key), key, "left_semi") if requested is not None else rows.where(otherwise)
    return first_of_each(taken, unique, ord_) if unique else taken


def by_task(rows: DataFrame, task: str, subtask: str) -> DataFrame:
    return rows.where((F.col("Subtask") == subtask) & (F.col("Task") == task))
