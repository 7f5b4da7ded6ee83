"""Run records as JSON lines, key lists and result files: readers that skip what is malformed, and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.functions import terms

#: Fields of a run record.
RECORD = """config string, dataset string, shard int, record_key string, modality string, status string, Answer string, ground_truth string, correct boolean,
raw_response string, question string, task_type string, sub_category string, source_bytes bigint, evidence_bytes bigint, compression_ratio double,
original_tokens bigint, compressed_tokens bigint, token_saving_ratio double, token_saving_ratio_raw double, compression_expanded boolean,
fail_class string, Error string, elapsed_seconds double"""
#: Fields of a question.
QA = "video_id string, duration string, domain string, sub_category string, url string, videoID string, question_id string, task_type string, question string, options array<string>, answer string"
#: Columns that a slim copy leaves out.
HEAVY = ("raw_response", "evidence_package", "prompt", "messages", "computed_evidence")


def read_records(spark: SparkSession, paths: list[str] | str, schema: str = RECORD) -> DataFrame:
    """Records of JSON-lines files with their file; malformed lines are dropped."""
    parsed = F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    rows = spark.read.text(paths).where("trim(value) <> ''").select(parsed.alias("r"), F.col("_metadata.file_path").alias("file"))
    return rows.where("r._bad IS NULL").select("r.*", "file").drop("_bad")


def done_keys(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Distinct keys with a completed record."""
    return read_records(spark, paths, "record_key string, status string").where("status = 'completed' AND record_key IS NOT NULL").select("record_key").distinct()


def read_keys(spark: SparkSession, path: str) -> DataFrame:
    """Keys of whitespace-separated lists with their position, from 0; files follow one another by name.

    Words are numbered as they are read, so none is shuffled or sorted: a word's position is its place in its task, less the
    place of the first word of its split, plus the words of all splits before. There is one row for each split, as in the scan's own plan.
    """
    words = F.filter(F.split("value", r"\s+"), lambda w: w != "")
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), words.alias("words"))
    placed = lines.select("file", "start", F.explode("words").alias("record_key")).withColumn("place", F.monotonically_increasing_id())
    splits = placed.groupBy("file", "start").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("file", "start"))
    shifts = splits.select("file", "start", (upto - F.col("n") - F.col("first")).alias("shift"))
    return placed.join(F.broadcast(shifts), ["file", "start"]).select("record_key", (F.col("place") + F.col("shift")).cast("int").alias("position"))


def read_parts(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Union of JSON arrays in files named ...part<N>.json, with part (null if there is no number) to order by, nulls last."""
    rows = spark.read.option("multiLine", True).json(paths)
    return rows.withColumn("part", F.regexp_extract(F.col("_metadata.file_path"), r"(?i)part([0-9]+)\.json$", 1).try_cast("int"))


def read_questions(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Questions of Parquet files, with their key."""
    rows = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    return rows.withColumn("record_key", F.concat_ws(":", F.lit("video"), "videoID", "question_id"))


def append_records(records: DataFrame, path: str) -> None:
    """Append to a folder of JSON lines."""
    records.write.mode("append").json(path)


def write_summary(records: DataFrame, summary: DataFrame, path: str) -> None:
    """Overwrite results and summary beside each other."""
    records.write.mode("overwrite").json(f"{path}/results")
    summary.write.mode("overwrite").json(f"{path}/summary")


def slim(records: DataFrame, heavy: tuple[str, ...] = HEAVY) -> DataFrame:
    """records without the heavy columns."""
    return records.drop(*heavy)


def file_class(path: str = "path"):
    """slim, skip or copy by a file's extension."""
    extension = F.lower(F.regexp_extract(F.col(path), r"(\.[A-Za-z0-9]+)$", 1))
    return F.when(extension.isin(*terms.SLIM_EXTENSIONS), "slim").when(extension.isin(*terms.SKIPPED_EXTENSIONS), "skip").otherwise("copy")


def write_report(summary: DataFrame, path: str, title: str = "Report") -> None:
    """One HTML table of a small summary, at most 1,000 rows, and the same as JSON."""
    import html

    rows = summary.limit(1000).collect()
    cells = lambda values, tag: "<tr>" + "".join(f"<{tag}>{html.escape('' if v is None else str(v))}</{tag}>" for v in values) + "</tr>"
    page = f"<!doctype html><title>{html.escape(title)}</title><table>{cells(summary.columns, 'th')}{''.join(cells(r, 'td') for r in rows)}</table>"
    summary.sparkSession.createDataFrame([(page,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/html")
    summary.write.mode("overwrite").json(f"{path}/json")
