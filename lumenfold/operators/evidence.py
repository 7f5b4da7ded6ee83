"""Evidence: votes over readings, visible options, bounded unions of typed units, audits of inputs and option checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.text import collapse


def ocr_vote(regions: DataFrame, key: str, text: str, confidence: str, ord_: str, in_scope: Column | None = None) -> DataFrame:
    """The reading with the most votes, then the highest sum of confidence, then the first seen; confident from two votes of a
    mean of 0.6."""
    norm = F.regexp_replace(F.lower(collapse(F.coalesce(text, F.lit("")))), "[^a-z0-9]+", "")
    usable = regions.withColumn("norm", norm).where((F.col("norm") != "") & (F.lit(True) if in_scope is None else in_scope))
    votes = usable.groupBy(key, "norm").agg(F.count("*").alias("votes"), F.round(F.sum(F.coalesce(confidence, F.lit(0.0))), 6).alias("score"), F.min_by(collapse(F.col(text)), ord_).alias("reading"), F.min(ord_).alias("first_ord"))
    best = votes.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("votes"), F.desc("score"), "first_ord"))).where("_rank = 1")
    sure = (F.col("votes") >= 2) & (F.col("score") / F.col("votes") >= 0.6)
    return best.select(key, "votes", "score", F.when(sure, F.col("reading")).alias("voted_text"), F.when(sure, "confident").otherwise("uncertain").alias("ocr_status"))


def visible_set(options: DataFrame, sightings: DataFrame, key: str, letter: str, terms: str, text: str, time: str, confidence: str) -> DataFrame:
    """Each option with whether any of its terms occurs in a sighting of its key, how often, when first, and how surely."""
    low = sightings.select(F.col(key).alias("_key"), F.lower(F.coalesce(text, F.lit(""))).alias("_low"), F.col(time).alias("_t"), F.col(confidence).alias("_c"))
    met = options.join(low, (F.col(key) == F.col("_key")) & F.exists(F.col(terms), lambda t: F.col("_low").contains(t)), "left")
    return met.groupBy(key, letter).agg((F.count("_low") > 0).alias("seen"), F.count("_low").alias("times"), F.min("_t").alias("first_time"), F.coalesce(F.max("_c"), F.lit(0.0)).alias("confidence"))


def missing_options(visible: DataFrame, key: str, letter: str) -> DataFrame:
    """Letters seen and not seen, in order, as text."""
    letters = lambda seen: F.array_join(F.array_sort(F.collect_list(F.when(F.col("seen") == F.lit(seen), F.col(letter)))), ",")
    return visible.groupBy(key).agg(letters(True).alias("visible"), letters(False).alias("missing"))


def evidence_units(parts: dict[str, tuple[DataFrame, int]], key: str, ord_: str, most: int = 36) -> DataFrame:
    """Bounded union of typed sources (frame, limit), in the order given, numbered, `most` of a key in all."""
    every = None
    for n, (kind, (rows, limit)) in enumerate(parts.items()):
        capped = rows.withColumn("_i", F.row_number().over(Window.partitionBy(key).orderBy(ord_))).where(F.col("_i") <= limit)
        capped = capped.withColumns({"evidence_type": F.lit(kind), "_kind": F.lit(n)})
        every = capped if every is None else every.unionByName(capped, allowMissingColumns=True)
    numbered = every.withColumn("unit", F.row_number().over(Window.partitionBy(key).orderBy("_kind", "_i")))
    return numbered.where(F.col("unit") <= most).drop("_i", "_kind")


def input_audit(anchors: DataFrame, key: str, kind: str, size: str, kinds: list[str], critical: list[str] | None = None) -> DataFrame:
    """Anchors of each kind, missing (null) and empty files, warnings, and whether a critical one stops the record."""
    counts = [F.count_if(F.col(kind) == k).alias(f"n_{k}") for k in kinds]
    table = anchors.groupBy(key).agg(F.count("*").alias("anchors"), *counts, F.count_if(F.col(size).isNull()).alias("missing_files"), F.count_if(F.col(size) == 0).alias("empty_files"))
    warnings = F.array_compact(F.array(*(F.when(F.col(f"n_{k}") == 0, F.lit(f"no_{k}")) for k in kinds), F.when(F.col("missing_files") > 0, "missing_files"), F.when(F.col("empty_files") > 0, "empty_files")))
    stop = F.arrays_overlap("_w", F.array(*map(F.lit, critical or ["missing_files", "empty_files"])))
    return table.withColumn("_w", warnings).withColumns({"warnings": F.array_join("_w", ","), "stopped": stop}).drop("_w")


def first_relevant(items: DataFrame, key: str, item: str, ord_: str, most: int = 16) -> DataFrame:
    """The first `most` distinct items of each key, in order of first sight."""
    once = items.groupBy(key, item).agg(F.min(ord_).alias(ord_))
    return once.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(ord_, item))).where(F.col("place") <= most)


def sample_ends(values: Column, n: int) -> Column:
    """The first half and the last half of n of an array; the first n for three or fewer."""
    head = n // 2
    return F.when(F.size(values) <= n, values).otherwise(F.slice(values, 1, n) if n <= 3 else F.concat(F.slice(values, 1, head), F.slice(values, -(n - head), n - head)))


def even_times(videos: DataFrame, key: str, duration: str, beginning: str, count: int = 48) -> DataFrame:
    """key, i and time_sec of an even grid over a video, or over its first eight seconds where a question asks for its beginning."""
    n = max(8, count)
    end = F.when(F.col(beginning), F.least(F.col(duration), F.lit(8.0))).otherwise(F.col(duration))
    return videos.where(F.col(duration) > 0).select(key, end.alias("_end"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")).select(key, "i", F.round(F.col("_end") * F.col("i") / (n - 1), 3).alias("time_sec"))


def instance_count(frames: DataFrame, key: str, count: str) -> DataFrame:
    """The largest and the median (rounded down) number of instances seen in a frame."""
    return frames.groupBy(key).agg(F.count("*").alias("frames"), F.max(count).alias("most"), F.floor(F.median(count)).cast("bigint").alias("median"))


def latest_quota_hits(lines: DataFrame, pattern: str = r"(?i)quota|insufficient balance|rate limit|429", ord_: str = "ord", key: str = "file") -> DataFrame:
    """The last line of each log that speaks of a quota, and how many do."""
    hit = lines.where(F.col("value").rlike(pattern))
    return hit.groupBy(key).agg(F.count("*").alias("hits"), F.max_by("value", ord_).alias("latest"))
