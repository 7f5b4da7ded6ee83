"""What is kept of a detector's, reader's or coder's output, as rows: the calls themselves are stages, their outputs are tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.numbers import expand_box
from lumenfold.functions.text import normalize_label
from lumenfold.operators.timeline import uniform_segments


def _first(rows: DataFrame, key: str, most: int, *order) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("place") <= most)


def kept_readings(regions: DataFrame, key: str, text: str, confidence: str, ord_: str, least: float = 0.35, most: int = 8) -> DataFrame:
    """The first reading of each normalised text, of those that are sure enough: the first `most` of a key."""
    usable = regions.withColumn("_norm", normalize_label(F.coalesce(text, F.lit("")))).where((F.col(confidence) >= least) & (F.col("_norm") != ""))
    once = usable.groupBy(key, F.col("_norm").alias("norm")).agg(F.min_by(F.struct(text, confidence, ord_), ord_).alias("r"))
    return _first(once.select(key, "norm", "r.*"), key, most, ord_)


def kept_detections(detections: DataFrame, key: str, label: str, confidence: str, ord_: str, relevant: Column, least: float = 0.20, sure: float = 0.45, most: int = 12) -> DataFrame:
    """Detections that are relevant and not too unsure, or sure by themselves: the surest `most` of a key."""
    taken = detections.where((F.col(confidence) >= least) & (relevant | (F.col(confidence) >= sure)))
    return _first(taken.select(key, label, confidence, ord_), key, most, F.desc(confidence), ord_)


def kept_speech(attempts: DataFrame, key: str, attempt: str, start: str, text: str, most: int) -> DataFrame:
    """Segments of the first attempt that heard anything: the first `most` of a key."""
    heard = attempts.where(F.trim(F.coalesce(text, F.lit(""))) != "")
    first = heard.groupBy(key).agg(F.min(attempt).alias(attempt))
    return _first(heard.join(first, [key, attempt], "left_semi"), key, most, start)


def scenes_or_even(scenes: DataFrame, videos: DataFrame, key: str, duration: str) -> DataFrame:
    """A detector's scenes (key, part, start_sec, end_sec), and even ones for videos in which it found none."""
    bare = videos.join(scenes.select(key).distinct(), key, "left_anti")
    found = scenes.select(key, "part", "start_sec", "end_sec", F.lit("detector").alias("origin"))
    return found.unionByName(uniform_segments(bare, key, duration).withColumn("origin", F.lit("even")))


def within_budget(encodings: DataFrame, key: str, rung: str, size: str, budget: Column) -> DataFrame:
    """The first rung of each key's ladder of encodings whose size is within the budget, else the last rung."""
    fits = F.coalesce(F.col(size) <= budget, F.lit(False))
    order = [fits.desc(), F.when(fits, F.col(rung)).otherwise(-F.col(rung))]
    best = encodings.withColumns({"fits": fits, "_rank": F.row_number().over(Window.partitionBy(key).orderBy(*order))})
    return best.where("_rank = 1").drop("_rank")


def zoom_requests(answers: DataFrame, box: str = "box", scale: float = 1.5) -> DataFrame:
    """answers with the pixels to look at again: the answer's box (shares of the sides), enlarged; null without a box."""
    share = lambda i, side: F.get(F.col(box), F.lit(i)) * F.col(side)
    pixels = F.array(share(0, "width"), share(1, "height"), share(2, "width"), share(3, "height"))
    return answers.withColumn("crop", F.when(F.col(box).isNotNull(), expand_box(pixels, F.col("width"), F.col("height"), scale)))


def rechecked(answers: DataFrame, second: DataFrame, key: str, answer: str = "answer") -> DataFrame:
    """answers with the second look's answer where there is one."""
    again = second.groupBy(key).agg(F.max(answer).alias("_second"))
    return answers.join(again, key, "left").withColumn("final", F.coalesce("_second", answer)).drop("_second")
