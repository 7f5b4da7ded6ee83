"""Members of archives and subtitle files as tables."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.functions.text import subtitle_segments
from lumenfold.runtime import ship


def _stem(column: str):
    return F.regexp_extract(column, r"([^/]+)\.[^./]+$", 1)


def _cells(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """path and content of files, through Spark's reader, which reaches every store; a file has 2 GB at most."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")


def members_of(cells: DataFrame, suffixes: tuple[str, ...] = (".mp4",)) -> DataFrame:
    """stem, archive, member and size of the non-empty members, with one of the suffixes, of zip cells (path, content); the last
    archive of a stem, by name, counts. Cells that can't be read are skipped."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for archive, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        rows += [(archive, m.filename, m.file_size) for m in z.infolist() if m.file_size > 0 and m.filename.lower().endswith(suffixes)]
                except zipfile.BadZipFile:
                    continue
            yield pd.DataFrame(rows, columns=["archive", "member", "size"])

    ship(cells.sparkSession)
    members = cells.select("path", "content").mapInPandas(run, "archive string, member string, size bigint").withColumn("stem", _stem("member"))
    last = Window.partitionBy("stem").orderBy(F.desc("archive"), F.desc("member"))
    return members.withColumn("_rank", F.row_number().over(last)).where("_rank = 1").select("stem", "archive", "member", "size")


def contents_of(cells: DataFrame, members: DataFrame) -> DataFrame:
    """stem and content of the members listed, read where their cell is; members that are broken or of another size are left out."""
    wanted = members.groupBy("archive").agg(F.collect_list(F.struct("stem", "member", "size")).alias("members"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content, listed in zip(pdf["content"], pdf["members"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for m in listed:
                            data = z.read(m["member"])
                            if len(data) == m["size"]:
                                yield pd.DataFrame({"stem": [m["stem"]], "content": [data]})
                except (zipfile.BadZipFile, KeyError, zlib.error):
                    continue

    ship(cells.sparkSession)
    both = cells.select(F.col("path").alias("archive"), "content").join(wanted, "archive")
    return both.select("content", "members").mapInPandas(run, "stem string, content binary")


def archive_members(spark: SparkSession, path: str, pattern: str = "*.zip", suffixes: tuple[str, ...] = (".mp4",)) -> DataFrame:
    return members_of(_cells(spark, path, pattern), suffixes)


def member_bytes(spark: SparkSession, path: str, members: DataFrame, pattern: str = "*.zip") -> DataFrame:
    return contents_of(_cells(spark, path, pattern), members)


def subtitle_files(spark: SparkSession, path: str, pattern: str = "*.srt") -> DataFrame:
    """stem, path and content of non-empty subtitle files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).where("length > 0")
    return files.select(_stem("path").alias("stem"), "path", F.decode("content", "UTF-8").alias("content"))


def transcript(files: DataFrame, source: str = "external_subtitle") -> DataFrame:
    """Segments of subtitle files: stem, sequence_index, start_sec, end_sec, text and anchor_link."""
    rows = files.select("stem", F.explode_outer(subtitle_segments(F.col("content"))).alias("s")).where("s IS NOT NULL")
    link = F.concat(F.col("stem"), F.lit("_seg_"), F.lpad(F.col("s.sequence_index").cast("string"), 4, "0"))
    return rows.select("stem", "s.*", link.alias("anchor_link"), F.lit(source).alias("source"))


def first_source(parts: list[DataFrame], key: str = "stem") -> DataFrame:
    """Segments of each key from the first part that has any."""
    every = None
    for n, part in enumerate(parts):
        part = part.withColumn("_part", F.lit(n))
        every = part if every is None else every.unionByName(part, allowMissingColumns=True)
    best = every.groupBy(key).agg(F.min("_part").alias("_part"))
    return every.join(best, [key, "_part"], "left_semi").drop("_part")
