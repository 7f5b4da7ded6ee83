"""Sampling, sharding and ordered key sets. Random order is the order of a seeded hash, the same in every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def round_robin(rows: DataFrame, group: str, key: str, most: int, seed: int = 0) -> DataFrame:
    """Stratified sample: the first of each group in seeded order, then the second of each, until there are `most`.

    The groups' rows beyond `most` go before any rows meet, the rest is a top-k.
    """
    turn = F.row_number().over(Window.partitionBy(group).orderBy(seeded(key, seed), key))
    early = rows.withColumn("turn", turn).where(F.col("turn") <= most)
    return early.orderBy("turn", group, key).limit(most)


def sample(rows: DataFrame, key: str, most: int, seed: int = 0) -> DataFrame:
    return rows.orderBy(seeded(key, seed), key).limit(most)


def shards(rows: DataFrame, group: str, key: str, count: int) -> DataFrame:
    """A shard for each row, dealt round within its group in seeded order of the key.

    A group is numbered in 256 parts of the order, each by itself after the counts of those before it, so no task sorts a whole group.
    """
    marked = rows.withColumn("_seeded", seeded(key, 0)).withColumn("_part", F.substring("_seeded", 1, 2))
    counts = marked.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(group).orderBy("_part"))
    before = counts.select(F.col(group).alias("_group"), F.col("_part").alias("_p"), (upto - F.col("_n")).alias("_before"))
    turn = F.row_number().over(Window.partitionBy(group, "_part").orderBy("_seeded", key)) - 1
    placed = marked.withColumn("_turn", turn).join(before, F.col(group).eqNullSafe(F.col("_group")) & F.col("_part").eqNullSafe(F.col("_p")))
    return placed.select(*rows.columns, ((F.col("_turn") + F.col("_before")) % count).cast("int").alias("shard"))


def first_of_each(rows: DataFrame, group: str, ord_: str) -> DataFrame:
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(ord_))).where("_rank = 1").drop("_rank")


def covered_keys(keys: DataFrame, covered: DataFrame, key: str, position: str, most: int) -> DataFrame:
    """The first `most` keys, in order, that are covered."""
    return keys.join(covered.select(key).distinct(), key, "left_semi").orderBy(position).limit(most)


def uncovered_keys(keys: DataFrame, covered: DataFrame, key: str, position: str, among: int) -> DataFrame:
    """Those of the first `among` keys that aren't covered."""
    return keys.orderBy(position).limit(among).join(covered.select(key).distinct(), key, "left_anti")


def split_at(rows: DataFrame, position: str, at: int) -> tuple[DataFrame, DataFrame]:
    """The rows up to a position (from 1) and the rest; all in the rest for 0 or less."""
    return rows.where(F.col(position) <= max(0, at)), rows.where(~(F.col(position) <= max(0, at)) | F.col(position).isNull())


def requested_order(rows: DataFrame, requested: DataFrame, key: str, position: str) -> DataFrame:
    """rows in the order of a list of keys, others last."""
    return rows.join(requested.select(key, position), key, "left").orderBy(F.asc_nulls_last(position), key)


def together(rows: DataFrame, key: str, count: int) -> DataFrame:
    """All rows of a key in one partition of `count`."""
    return rows.repartition(count, key)


def pending(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items whose key isn't done; a null key is never done."""
    return items.join(done.select(key).distinct(), key, "left_anti")
