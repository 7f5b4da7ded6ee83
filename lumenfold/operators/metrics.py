"""Run records: token accounting, the authoritative record among retries, summaries and comparisons of configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.numbers import confidence_95, estimated_tokens, ratio


def token_metrics(records: DataFrame, source: str = "source_bytes", evidence: str = "evidence_bytes") -> DataFrame:
    """Token estimates, compression ratio (null without source bytes), raw and clamped saving, and the expanded flag."""
    out = records.withColumns({"original_tokens": estimated_tokens(F.col(source)), "compressed_tokens": estimated_tokens(F.col(evidence))})
    raw = 1 - F.col("compressed_tokens") / F.col("original_tokens")
    return out.withColumns({
        "compression_ratio": F.when(F.col(source) > 0, F.round(F.col(evidence) / F.col(source), 4)),
        "token_saving_ratio": F.round(F.greatest(F.lit(0.0), raw), 4), "token_saving_ratio_raw": F.round(raw, 4), "compression_expanded": raw < 0})


#: Which record of a key counts, by rule: order among completed records, order among others (None: others never count).
RULES = {"a": ("last", "first"), "b": ("first", "last"), "c": ("last", "first"), "d": ("first", None), "e": ("last", None)}


def authoritative(records: DataFrame, rule: str, key: str = "record_key", ord_: str = "ord") -> DataFrame:
    """One record of each key by rule a to e. Rule c also drops records without a key; rule d wants keys of videos."""
    done, others = RULES[rule]
    completed = F.coalesce(F.col("status") == "completed", F.lit(False))
    if others is None:
        records = records.where(completed)
    if rule == "c":
        records = records.where(F.col(key).isNotNull())
    if rule == "d":
        records = records.where(F.col(key).startswith("video:"))
    sign = lambda which: F.col(ord_) if which == "first" else -F.col(ord_)
    rank = F.when(completed, sign(done)).otherwise(sign(others or "first"))
    first = Window.partitionBy(key).orderBy(completed.desc(), rank)
    return records.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_rank")


def summarize(records: DataFrame, *groups: str) -> DataFrame:
    """Counts, accuracy over completed, mean compression and saving, the mean saving of records that didn't expand, and time."""
    completed, correct = F.col("status") == "completed", F.col("correct") == F.lit(True)
    expanded = F.coalesce(F.col("compression_expanded"), F.lit(False))
    saving = F.col("token_saving_ratio")
    return records.groupBy(*groups).agg(
        F.count("*").alias("total"), F.count_if(completed).alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(correct).alias("correct"),
        F.count_if(saving.isNotNull() & expanded).alias("expanded_count"), F.round(F.coalesce(F.sum("elapsed_seconds"), F.lit(0.0)), 3).alias("elapsed_seconds"),
        ratio(F.count_if(correct), F.count_if(completed)).alias("accuracy"), F.round(F.avg("compression_ratio"), 4).alias("avg_compression_ratio"),
        F.round(F.avg(saving), 4).alias("avg_token_saving_ratio"), F.round(F.avg(F.when(~expanded, saving)), 4).alias("avg_token_saving_ratio_positive_only"))


def accuracy_interval(records: DataFrame, *groups: str) -> DataFrame:
    """Accuracy over completed with its 95 % half-width, and mean, median and extremes of the raw saving, in percent."""
    done = records.where("status = 'completed'")
    p, n, raw = F.avg(F.coalesce("correct", F.lit(False)).cast("double")), F.count("*"), F.col("token_saving_ratio_raw")
    pct = lambda c, d=4: F.round(100 * c, d)
    return done.groupBy(*groups).agg(n.alias("n"), pct(p).alias("accuracy_pct"), pct(confidence_95(p, n)).alias("half_width_pct"), pct(F.avg(raw)).alias("mean_saving_pct"),
                                     pct(F.median(raw)).alias("median_saving_pct"), pct(F.min(raw)).alias("min_saving_pct"), pct(F.max(raw)).alias("max_saving_pct"), F.count_if(raw > 0).alias("positive"))


def failure_topk(records: DataFrame, k: int = 5, width: int = 50, ord_: str = "ord") -> DataFrame:
    """The most common error texts, cut to a width; ties go to the one seen first."""
    text = F.substring(F.coalesce("error", F.lit("")), 1, width)
    counts = records.where(F.coalesce(F.col("status") != "completed", F.lit(True))).groupBy(text.alias("error")).agg(F.count("*").alias("n"), F.min(ord_).alias("first_ord"))
    return counts.orderBy(F.desc("n"), "first_ord").limit(k)


def weighted_averages(groups: DataFrame, accuracy: str = "accuracy", n: str = "n") -> DataFrame:
    """Weighted and simple mean; negative counts are 0, accuracies are clamped to [0, 100]."""
    a, w = F.least(F.greatest(F.col(accuracy), F.lit(0.0)), F.lit(100.0)), F.greatest(F.col(n), F.lit(0))
    return groups.agg(F.round(F.sum(a * w) / F.nullif(F.sum(w), F.lit(0)), 4).alias("weighted_mean"), F.round(F.avg(a), 4).alias("simple_mean"))


def breakdown(records: DataFrame, *dims: str) -> DataFrame:
    """Totals and errors by each dimension on its own: grouping sets in one pass, as dimension, bucket, total and wrong."""
    sets = [[F.col(d)] for d in dims]
    wrong = F.count_if(~F.coalesce(F.col("correct"), F.lit(False)))
    out = records.groupingSets(sets, *dims).agg(F.count("*").alias("total"), wrong.alias("wrong"), *(F.grouping(d).alias(f"_{d}") for d in dims))
    name, bucket = F.lit(None).cast("string"), F.lit(None).cast("string")
    for d in dims:
        name, bucket = F.when(F.col(f"_{d}") == 0, F.lit(d)).otherwise(name), F.when(F.col(f"_{d}") == 0, F.col(d).cast("string")).otherwise(bucket)
    return out.select(name.alias("dimension"), bucket.alias("bucket"), "total", "wrong")


def paired(a: DataFrame, b: DataFrame, group: Column, key: str = "record_key") -> DataFrame:
    """Two configurations on the completed keys they share, by group and in total (group null)."""
    side = lambda df, s: df.where("status = 'completed'").select(key, F.coalesce("correct", F.lit(False)).cast("int").alias(f"{s}_ok"), F.col("token_saving_ratio_raw").alias(f"{s}_raw"))
    both = side(a, "a").join(side(b, "b"), key).withColumn("grp", group)
    pct = lambda c: F.round(100 * c, 4)
    return both.rollup("grp").agg(F.count("*").alias("shared"), F.sum("a_ok").alias("a_correct"), F.sum("b_ok").alias("b_correct"), pct(F.avg(F.col("a_ok") - F.col("b_ok"))).alias("delta_points"),
                                  pct(F.median("a_raw")).alias("a_median_saving"), pct(F.median("b_raw")).alias("b_median_saving"), F.count_if((F.col("a_ok") == 1) & (F.col("b_ok") == 0)).alias("only_a"), F.count_if((F.col("a_ok") == 0) & (F.col("b_ok") == 1)).alias("only_b"))


def majority_vote(first: DataFrame, second: DataFrame, third: DataFrame, key: str = "record_key") -> DataFrame:
    """Votes of up to three runs for the keys of the first: a strict majority decides, else the first run."""
    vote = lambda df, n: df.select(key, F.coalesce("correct", F.lit(False)).alias(f"vote{n}"))
    joined = vote(first, 1).join(vote(second, 2), key, "left").join(vote(third, 3), key, "left")
    votes = [F.col(f"vote{n}") for n in (1, 2, 3)]
    yes = sum((F.coalesce(v.cast("int"), F.lit(0)) for v in votes[1:]), F.coalesce(votes[0].cast("int"), F.lit(0)))
    cast = sum((v.isNotNull().cast("int") for v in votes[1:]), votes[0].isNotNull().cast("int"))
    majority = F.when(2 * yes > cast, True).when(2 * yes < cast, False).otherwise(votes[0])
    return joined.select(key, "vote1", majority.alias("majority"), ((yes > 0) & (yes < cast)).alias("unstable"))


def vote_totals(votes: DataFrame) -> DataFrame:
    """Keys, correct before and after, unstable ones, and flips both ways."""
    before, after = F.col("vote1"), F.col("majority")
    return votes.agg(F.count("*").alias("keys"), F.count_if(before).alias("run1_correct"), F.count_if(after).alias("majority_correct"), F.count_if("unstable").alias("unstable"),
                     F.count_if(~before & after).alias("flips_up"), F.count_if(before & ~after).alias("flips_down"), F.count_if(~before & ~after).alias("still_wrong"))


def merged_runs(*runs: DataFrame, key: str = "record_key") -> DataFrame:
    """A keyed union in which a later run's record replaces an earlier one's."""
    every = None
    for n, run in enumerate(runs):
        run = run.withColumn("_run", F.lit(n))
        every = run if every is None else every.unionByName(run, allowMissingColumns=True)
    last = Window.partitionBy(key).orderBy(F.desc("_run"))
    return every.withColumn("_rank", F.row_number().over(last)).where("_rank = 1").drop("_rank", "_run")


def rechecked_accuracy(rows: DataFrame) -> DataFrame:
    """Rows with truth, answer and rechecked letters: accuracy of rechecked answers where there are any, and of the final ones."""
    final = F.coalesce("rechecked", "answer")
    return rows.agg(F.count("rechecked").alias("rechecked_rows"), ratio(F.count_if(F.col("rechecked") == F.col("truth")), F.count("rechecked"), 6).alias("rechecked_accuracy"),
                    F.count(final).alias("answered"), ratio(F.count_if(final == F.col("truth")), F.count(final), 6).alias("combined_accuracy"))


def slice_accuracy(rows: DataFrame, position: str, first: int, last: int) -> DataFrame:
    """Accuracy over the rows whose position (from 1) is first to last; rows without a truth or an answer are skipped and counted."""
    part = rows.where(F.col(position).between(first, last))
    read = F.col("truth").isNotNull() & F.col("answer").isNotNull()
    right = F.count_if(F.col("truth") == F.col("answer"))
    return part.agg(F.count_if(read).alias("processed"), F.count_if(~read).alias("skipped"), right.alias("correct"), ratio(right, F.count_if(read), 6).alias("accuracy"))


def keyword_scores(answers: DataFrame, *groups: str) -> DataFrame:
    """Share of answers with a keyword, share that don't refuse, and nullable sums of tokens."""
    return answers.groupBy(*groups).agg(F.count("*").alias("n"), F.round(F.avg(F.col("hit").cast("double")), 6).alias("keyword_accuracy"), F.round(F.avg((~F.col("refused")).cast("double")), 6).alias("answerability"), F.sum("tokens").alias("tokens"))


def checkpoint_counts(records: DataFrame, *groups: str, key: str = "record_key") -> DataFrame:
    """Distinct keys seen and completed."""
    return records.groupBy(*groups).agg(F.count_distinct(key).alias("seen"), F.count_distinct(F.when(F.col("status") == "completed", F.col(key))).alias("completed"))


def mean_resolution(images: DataFrame) -> DataFrame:
    """Mean width and height over images that have both, halves to even."""
    both = images.where("width IS NOT NULL AND height IS NOT NULL")
    return both.agg(F.count("*").alias("n"), F.bround(F.avg("width")).cast("bigint").alias("mean_width"), F.bround(F.avg("height")).cast("bigint").alias("mean_height"))


def box_statistics(boxes: DataFrame, column: str = "box") -> DataFrame:
    """Valid boxes by area under and from a tenth, mean area, and how many are invalid or missing."""
    at = lambda i: F.get(column, F.lit(i))
    valid = F.coalesce((F.size(column) == 4) & (at(0) >= 0) & (at(0) < at(2)) & (at(2) <= 1) & (at(1) >= 0) & (at(1) < at(3)) & (at(3) <= 1), F.lit(False))
    area = F.when(valid, (at(2) - at(0)) * (at(3) - at(1)))
    return boxes.agg(F.count_if(area < 0.1).alias("under_tenth"), F.count_if(area >= 0.1).alias("from_tenth"), F.count_if(~valid).alias("invalid"), F.round(F.avg(area), 6).alias("mean_area"))
