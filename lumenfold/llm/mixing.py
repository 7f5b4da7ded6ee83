"""Mixing sources to target weights: temperature mixing realised as budgeted block permutations.

Shares q of tokens by source become weights w proportional to q ** exponent. The exponent is bisected on [0, 1]: to the
largest whose entropy reaches target_entropy * ln(number of sources), or to the smallest whose repetition
max(w * budget / tokens) stays within max_repeats. Five levels of bisection, 31 dyadic exponents, are evaluated by each
pass over the small table of sources.

Each source is cut into blocks of about block_tokens tokens, and block_rows rows at most in the mean, by a hash of doc_id and
text, so a source of any size, with or without tokens, and a doc_id of many rows are many independent blocks. Every block gets the budget rate * tokens, rate being w * budget / tokens of the source: that many
whole permutations of the block, then the head of one more, cut where the budget ends.

Defined results: a null source is a source of its own; null and empty texts have no tokens and take part in whole
permutations, and in the last one if they fall before its cut; sources without tokens have rate 1; repeated rows are
permuted like any other, those with one doc_id and text together; ties of the order go by doc_id, tokens and text; an empty
table gives an empty result; further columns are ignored, but for those that keep names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.common import space_words, text_of, written

LEVELS, PASSES = 5, 6


def exponent(sources: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None, budget_ratio: float = 1.0) -> float:
    """The bisected exponent; sources has a column tokens, one row per source."""
    if (target_entropy is None) == (max_repeats is None):
        raise ValueError("give either target_entropy or max_repeats")
    total, n = sources.agg(F.sum("tokens"), F.count_if(F.col("tokens") > 0)).first()
    if not n:
        return 1.0
    shares = sources.where("tokens > 0").withColumn("lq", F.log(F.col("tokens") / F.lit(float(total))))
    low, high = 0.0, 1.0
    for _ in range(PASSES):
        step = (high - low) / (1 << LEVELS)
        grid = [low + k * step for k in range((1 << LEVELS) + 1)]
        z, zl = (F.sum(F.exp(F.col("e") * F.col("lq"))), F.sum(F.exp(F.col("e") * F.col("lq")) * F.col("e") * F.col("lq")))
        rows = shares.withColumn("e", F.explode(F.array(*map(F.lit, grid)))).groupBy("e").agg((F.log(z) - zl / z).alias("entropy"), (F.max(F.exp((F.col("e") - 1) * F.col("lq"))) / z * budget_ratio).alias("repeats")).collect()
        at = {r.e: r for r in rows}
        enough = (lambda r: r.entropy >= target_entropy * math.log(n) - 1e-12) if target_entropy is not None else (lambda r: r.repeats > max_repeats + 1e-12)
        # both hold for small exponents and fail for large ones
        k = max([i for i, e in enumerate(grid) if enough(at[e])], default=None)
        if k is None:
            return grid[0]
        if k == len(grid) - 1:
            return grid[-1]
        low, high = grid[k], grid[k + 1]
    return low if target_entropy is not None else high


def mixture(docs: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None, budget_ratio: float = 1.0, block_tokens: int = 1 << 16, seed: int = 7, keep: tuple[str, ...] = (), block_rows: int = 1 << 10) -> DataFrame:
    """doc_id, source, n_tokens, epoch (from 0), block and place (from 0, within the block's epoch) of every drawn copy, and the columns keep.

    The budget is budget_ratio times all tokens.
    """
    counted = written(docs.select("doc_id", F.col("source").cast("string").alias("source"), F.size(space_words(text_of())).cast("bigint").alias("n_tokens"), F.xxhash64("text").alias("text_hash"), F.struct(*(F.col(c).alias(c) for c in keep)).alias("kept") if keep else F.lit(0).alias("kept")), "mix-tokens")
    sources = written(counted.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")), "mix-sources")
    e = exponent(sources, target_entropy, max_repeats, budget_ratio)
    total = float(sources.agg(F.sum("tokens")).first()[0] or 1)
    shares = sources.withColumn("q", F.when(F.col("tokens") > 0, F.col("tokens") / F.lit(total)))
    norm = shares.agg(F.sum(F.pow("q", F.lit(e)))).first()[0] or 1.0
    rates = shares.select("source", F.greatest(F.lit(1), F.ceil(F.col("tokens") / block_tokens), F.ceil(F.col("rows") / block_rows)).cast("bigint").alias("blocks"), F.coalesce(F.pow("q", F.lit(e)) / norm * budget_ratio / F.col("q"), F.lit(1.0)).alias("rate"))
    rates = written(rates, "mix-rates").withColumnRenamed("source", "s")
    placed = counted.join(rates, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("doc_id", "text_hash", F.lit(seed)), F.col("blocks")))
    block = Window.partitionBy("source", "block")
    order = block.orderBy(F.xxhash64("doc_id", "text_hash", "block", F.lit(seed + 1)), "doc_id", "n_tokens", "text_hash")
    whole = F.floor("rate").cast("int")
    before = F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_tokens") / 2
    ranked = placed.withColumns({"place": (F.row_number().over(order) - 1).cast("bigint"), "before": before, "in_block": F.sum("n_tokens").over(block)})
    copies = whole + F.when(F.col("before") < (F.col("rate") - whole) * F.col("in_block"), 1).otherwise(0)
    drawn = ranked.withColumn("copies", copies).where("copies > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    return drawn.select("doc_id", "source", "n_tokens", "epoch", "block", "place", *(F.col(f"kept.{c}").alias(c) for c in keep))


def op3_source_mixing(docs: DataFrame) -> DataFrame:
    """Temperature mixing of documents to the smallest exponent that repeats no source more than 1.25 times."""
    return mixture(docs, max_repeats=1.25)
