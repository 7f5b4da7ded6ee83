"""Micro-batch evaluation: new items pass a stage once each, and a restart takes up where the sink ends."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumenfold.runtime import scratch, ship

RESULT = "record_key string, status string, response string, error string, attempts int"
COLUMNS = ["record_key", "status", "response", "error", "attempts"]


def _answered(item: dict, answer: Callable[[dict, int], str], tokens: int, retries: int) -> tuple:
    """The result row of one item."""
    budget, error, response, tried = tokens, None, None, 0
    while tried < retries and response is None:
        tried += 1
        try:
            response, error = answer(item, budget), None
        except Exception as e:  # noqa: BLE001  what a model call raises belongs to its record
            error = f"{type(e).__name__}: {e}"
            budget = min(max(2 * budget, budget + 256), 2048)
    return item["record_key"], "failed" if response is None else "completed", response, error, tried


def stage(items: DataFrame, answer: Callable[[dict, int], str], tokens: int = 512, retries: int = 3) -> DataFrame:
    """Results of calling answer(item, token budget) on each item: at most `retries` calls, each with a larger budget (twice, at
    least 256 more, at most 2048); an item that fails is a failed record, not a failed task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([_answered(item, answer, tokens, retries) for item in pdf.to_dict("records")], columns=COLUMNS)

    ship(items.sparkSession)
    return items.mapInPandas(run, RESULT)


def queued(jobs: DataFrame, run: Callable[[dict], object], workers: int) -> DataFrame:
    """record_key, status and error of jobs, of which at most `workers` run at once; a job that raises has failed, the others go on."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for job in pdf.to_dict("records"):
                try:
                    run(job)
                    rows.append((job["record_key"], "completed", None))
                except Exception as e:  # noqa: BLE001  what a job raises belongs to its record
                    rows.append((job["record_key"], "failed", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["record_key", "status", "error"])

    ship(jobs.sparkSession)
    return jobs.repartition(workers).mapInPandas(work, "record_key string, status string, error string")


def with_failover(models: list[Callable[[dict, int], str]], dead: Callable[[Exception], bool] = lambda e: False, wait: float = 0.0) -> Callable[[dict, int], str]:
    """An answer function that tries models in order; one whose error is deadly isn't tried again by the worker."""
    gone: set[int] = set()

    def answer(item: dict, budget: int) -> str:
        last: Exception = RuntimeError("no model left")
        for n, model in enumerate(models):
            if n in gone:
                continue
            try:
                return model(item, budget)
            except Exception as e:  # noqa: BLE001  the next model may do
                last = e
                if dead(e):
                    gone.add(n)
                time.sleep(wait)
        raise last

    return answer


def evaluate(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, answer: Callable[[dict, int], str], files_per_batch: int = 1, tokens: int = 512, retries: int = 3, buckets: int = 1 << 12) -> StreamingQuery:
    """Evaluate the JSON items under source whose key has no completed record under sink, a few files at a time, till none is new.

    The sink is read once, at the start, for its finished keys; those that finish later are the query's state, by buckets of keys,
    as a call for each key would cost far more than the key. A batch costs its own items and the keys of the buckets that they
    fall into. A checkpoint keeps its number of buckets. A key that failed is tried again when it comes again.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    folder = spark._jvm.org.apache.hadoop.fs.Path(sink)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
    finished = scratch(spark, "finished")
    spark.read.schema(RESULT).json(sink).where("status = 'completed' AND record_key IS NOT NULL").select("record_key").distinct().write.parquet(finished)
    known = spark.read.schema("record_key string").parquet(finished).withColumn("_finished", F.lit(True))

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        finished = list(state.get[0]) if state.exists else []
        seen, before = set(finished), len(finished)
        for pdf in batches:
            rows = []
            for item in pdf.drop(columns="_bucket").to_dict("records"):
                if item["record_key"] in seen:
                    continue
                seen.add(item["record_key"])
                rows.append(_answered(item, answer, tokens, retries))
                if rows[-1][1] == "completed":
                    finished.append(item["record_key"])
            yield pd.DataFrame(rows, columns=COLUMNS)
        if len(finished) > before:
            state.update((finished,))

    ship(spark)
    items = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(source)
    fresh = items.join(known, "record_key", "left").where("_finished IS NULL").drop("_finished").withColumn("_bucket", F.pmod(F.xxhash64("record_key"), F.lit(buckets)))
    results = fresh.groupBy("_bucket").applyInPandasWithState(step, RESULT, "finished array<string>", "append", GroupStateTimeout.NoTimeout)
    write = lambda rows, _: rows.write.mode("append").json(sink)
    return results.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def change_stream(frames: DataFrame, key: str = "video_id") -> DataFrame:
    """Change scores over a stream of frames (key, ord, feature) that come in order: each key's last feature is its state."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import numpy as np

        last = np.asarray(state.get[0]) if state.exists else None
        for pdf in batches:
            rows = []
            for o, feature in sorted(zip(pdf["ord"], pdf["feature"], strict=True), key=lambda r: r[0]):
                v = np.asarray(feature, dtype=np.float64)
                n = np.linalg.norm(v)
                v = v / n if n else v
                rows.append((group[0], int(o), 0.0 if last is None else round(1 - float(np.clip(last @ v, -1, 1)), 6)))
                last = v
            yield pd.DataFrame(rows, columns=[key, "ord", "change_score"])
        if last is not None:
            state.update((last.tolist(),))

    ship(frames.sparkSession)
    return frames.groupBy(key).applyInPandasWithState(step, f"{key} string, ord bigint, change_score double", "last array<double>", "append", GroupStateTimeout.NoTimeout)


def run_status(records: DataFrame) -> DataFrame:
    """Totals of a run: items, completed, failed and still to do by their latest record."""
    from lumenfold.operators.metrics import authoritative

    latest = authoritative(records, "a")
    return latest.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(~F.col("status").isin("completed", "failed")).alias("running"))
