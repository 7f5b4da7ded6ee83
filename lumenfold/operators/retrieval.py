"""Lexical retrieval of transcript segments for a question, and what goes into its prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.operators.timeline import coverage_sample


def hit_terms(terms: Column, text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(terms, lambda t: low.contains(t))


def lexical_score(hits: Column) -> Column:
    """Hits, plus the long ones once more, plus up to two for variety."""
    return F.size(hits) + F.size(F.filter(hits, lambda t: F.length(t) >= 6)) + F.least(F.lit(2.0), F.size(hits) / 3.0)


def lexical_topk(segments: DataFrame, key: str, ord_: str, text: str, terms: Column, most: int) -> DataFrame:
    """The best segments of each key with their neighbours: by score, then order, each brings the one before it, itself and
    the one after, first come first kept, `most` in all.

    Every segment's rank comes from the three that could bring it, which a window of its neighbours shows: nothing is joined.
    """
    by, order = Window.partitionBy(key), Window.partitionBy(key).orderBy(ord_)
    hits = hit_terms(terms, F.col(text))
    scored = segments.withColumn("hits", hits).withColumn("score", F.when(F.size("hits") > 0, lexical_score(F.col("hits"))))
    ranked = scored.withColumn("rank", F.when(F.col("score").isNotNull(), F.row_number().over(by.orderBy(F.desc_nulls_last("score"), ord_))))
    # a segment is the first (of the one after it), the second (of itself) or the third (of the one before it) that a rank brings
    brought = F.least(F.lead("rank").over(order) * 3, F.col("rank") * 3 + 1, F.lag("rank").over(order) * 3 + 2)
    placed = ranked.withColumn("place", brought).where("place IS NOT NULL").withColumn("relevance_rank", F.row_number().over(by.orderBy("place")))
    kept = placed.where(F.col("relevance_rank") <= most)
    return kept.withColumns({"relevance_score": F.round(F.coalesce("score", F.lit(0.0)), 3), "relevance_terms": F.array_join(F.slice("hits", 1, 12), " ")}).drop("hits", "score", "rank", "place")


def prompt_segments(segments: DataFrame, relevant: DataFrame, key: str, ord_: str, most: int, coverage: int) -> DataFrame:
    """Relevant segments by rank, then evenly spaced others, `most` in all: key, ord, role and place."""
    first = relevant.select(key, ord_, F.lit(0).alias("bucket"), F.col("relevance_rank").cast("bigint").alias("o"))
    rest = coverage_sample(segments.join(relevant.select(key, ord_), [key, ord_], "left_anti").select(key, ord_), key, ord_, coverage)
    union = first.unionByName(rest.select(key, ord_, F.lit(1).alias("bucket"), F.col(ord_).cast("bigint").alias("o")))
    placed = union.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("bucket", "o")))
    return placed.where(F.col("place") <= most).select(key, ord_, F.when(F.col("bucket") == 0, "question_relevant_transcript").otherwise("temporal_coverage_transcript").alias("role"), "place")


def priority_union(parts: list[DataFrame], key: str, item: str, ord_: str, most: int) -> DataFrame:
    """Union in the order of the parts: an item of a key counts where it comes first, `most` items of a key."""
    every = None
    for n, part in enumerate(parts):
        part = part.select(key, item, ord_, F.lit(n).alias("bucket"))
        every = part if every is None else every.unionByName(part)
    once = every.withColumn("_first", F.row_number().over(Window.partitionBy(key, item).orderBy("bucket", ord_))).where("_first = 1").drop("_first")
    return once.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("bucket", ord_))).where(F.col("place") <= most)
