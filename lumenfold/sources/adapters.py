"""Datasets to common shapes: chat rows, question rows, encoded images and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LETTERS = "ABCDEFGH"


def letter(position: Column) -> Column:
    """The letter of a position from 1."""
    return F.substring(F.lit(LETTERS), position.cast("int"), F.lit(1))


def labelled(candidates: Column) -> Column:
    """Options `A. text` of an array of texts."""
    return F.transform(candidates, lambda c, i: F.concat(letter(i + 1), F.lit(". "), c))


def from_candidates(rows: DataFrame, dataset: str, task: str) -> DataFrame:
    """Question rows from video_id, ord, question, candidates and the answer's text; rows whose answer is no candidate go."""
    place = F.array_position("candidates", F.col("answer"))
    return rows.where(place > 0).select(F.col("video_id").cast("string"), F.lit("short").alias("duration"), F.lit(dataset).alias("domain"), F.lit(task).alias("sub_category"), F.col("video_id").cast("string").alias("videoID"),
                                        F.concat_ws("_", "video_id", "ord").alias("question_id"), F.lit(task).alias("task_type"), "question", labelled(F.col("candidates")).alias("options"), letter(place).alias("answer"))


def from_option_lines(rows: DataFrame) -> DataFrame:
    """Stem, options and answer letter from a question whose lines begin with A. to G.; the answer is a letter or a text.
    Rows with fewer than two options or without a letter go."""
    lines = F.transform(F.split("question", "\n"), lambda x: F.trim(x))
    choices = F.filter(lines, lambda x: x.rlike(r"^[A-G]\. "))
    stem = F.array_join(F.filter(lines, lambda x: ~x.rlike(r"^[A-G]\. ") & (x != "")), " ")
    by_text = F.get(F.filter(F.col("options"), lambda o: F.lower(F.trim(F.regexp_replace(o, r"^[A-G]\. ", ""))) == F.lower(F.trim("answer"))), F.lit(0))
    split = rows.withColumns({"stem": stem, "options": choices})
    own = F.nullif(F.regexp_extract(F.trim("answer"), r"^\s*([A-G])\.", 1), F.lit(""))
    return split.withColumn("letter", F.coalesce(own, F.substring(by_text, 1, 1))).where((F.size("options") >= 2) & F.col("letter").isNotNull())


def chat_row(text: Column, choices: Column, truth: Column, image: Column, before: str = "\nChoices:\n", after: str = "\nReply with one letter.") -> Column:
    """Struct (messages, images) of a question with an image; before and after are the wording around the choices."""
    content = F.concat(text, F.lit(before), F.concat_ws("\n", choices), F.lit(after))
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.struct(F.array(message("user", content), message("assistant", truth)).alias("messages"), F.array(image).alias("images"))


def assistant_text(messages: Column, *aliases: Column) -> Column:
    """The first assistant message, else the first alias that isn't null."""
    return F.coalesce(F.get(F.filter(messages, lambda m: m["role"] == "assistant"), F.lit(0))["content"], *aliases)


def decoded_image(encoded: Column) -> Column:
    """Struct (content, extension, ok) of a base64 cell, its format told by its first bytes; jpg if they tell nothing."""
    content = F.try_to_binary(F.regexp_replace(encoded, r"\s+", ""), F.lit("base64"))
    head = F.hex(F.substring(content, 1, 12))
    extension = F.when(head.startswith("89504E47"), "png").when(head.startswith("FFD8FF"), "jpg").when(head.startswith("47494638"), "gif").when(head.startswith("424D"), "bmp").when(head.startswith("52494646") & head.endswith("57454250"), "webp").otherwise("jpg")
    return F.struct(content.alias("content"), extension.alias("extension"), (F.coalesce(F.octet_length(content), F.lit(0)) > 0).alias("ok"))


def existing_extension(rows: DataFrame, files: DataFrame, stem: str, order: tuple[str, ...] = (".jpg", ".png", ".jpeg")) -> DataFrame:
    """rows with the path of the first extension, in the order given, of which a file (stem, extension, path) exists; others go."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("extension"))
    best = files.where(rank > 0).groupBy(stem).agg(F.min_by("path", rank).alias("path"))
    return rows.join(best, stem)


def manifest(samples: DataFrame, dataset: str = "dataset", key: str = "record_key", video: str = "videoID") -> DataFrame:
    """Samples and distinct videos of each dataset."""
    return samples.groupBy(dataset).agg(F.count_distinct(key).alias("samples"), F.count_distinct(video).alias("videos"))


def duration_range(rows: DataFrame, column: str, least: float, most: float, video: str = "videoID") -> DataFrame:
    """One row (the smallest question id) of each video of a duration in a range."""
    from lumenfold.operators.sampling import first_of_each

    return first_of_each(rows.where(F.col(column).between(least, most)), video, "question_id")
