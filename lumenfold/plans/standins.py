"""Views of the driver's tables that play run records, segments and frames, in Spark and in SQL.

documents with labels are run records (an unlabelled document is a run that didn't complete), conversations are transcripts,
events are frames, readings and samples, and questions are dealt from a list by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUESTIONS = (
    "What is the current score of the ongoing game?", "Which color is absent in the rack?", "What happens in the second clip?", "Why does the player leave?", "How many jumps does the skater do?",
    "How many items are stored in the box displayed at the beginning?", "How many men and women are presenting on the stage?", "How many challengers took part?", "Describe the man on the train.", "Describe the mood.",
    "What does the narrator say after the music?", "Which word is written on the sign at the end?", "Then which event happens next?", "Where is the lamp, left or right of the door?", "Germany and its country houses",
)
ANSWERS = (
    "FINAL_ANSWER: C", "(b)", "The answer is D.", '{"answer": "A"}', "I think (A) or maybe (E)", "no letter in this rather long sentence", "  e.  ", "Option: B because A is wrong", "E\nor\nD)", "choose option f", "",
    "It could be A but C fits", "{'final_answer': 'B'}",
)
OPTIONS = ("Pick one.\nA. Cat\nB. Dog house\nC.  Green   car", "A. only one", "no options here", "Which?\nA. red hat\nB.Dog\nA. blue hat\nD. none of them", "A. Cat B. Dog")
LABELS = ("['Speech', 'Dog bark']", "Rain, Wind; Thunder/Storm", "\"Car horn\"", "", "a,,b")
BOXES = ("bbox: [0.1, 0.2, 0.5, 0.6]", "BBox = [0,0,1,1] then bbox: [0.25, 0.3, 1.4, 0.9]", "bbox: [0.5,0.5,0.2,0.9]", "none", "bbox [ .1 , .1 , .2 , .2 ]")
CAPTIONS = ("<font color=\"red\">Hi  there</font>", "{\\an8}Tom &amp; Jerry", "a &lt;b&gt; c", "plain", "   ", "x<br/>y &quot;z&quot;")
SRT = "1\n00:00:01,500 --> 00:00:03,250\n<i>Hello</i> there\n\n2\n00:00:03,000 --> 00:00:04,000\n42\n\nno arrow\nhere\n\n4\n01:05 --> 01:07,5\nAll {\\an8}right\n\n5\nbad --> 00:00:09,000\nend"
JSONS = ('```json\n{"a": 1, "b": {"c": "x"}}\n```', 'Sure: {"a": 2} done', "[1, 2]", "", "{broken", '{"a": null}')


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(values: tuple, by: Column) -> Column:
    """values[by % len(values)]."""
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(by, F.lit(len(values))) + 1).cast("int"))


def sql_text(value: str) -> str:
    parts = ["'" + p.replace("'", "''") + "'" for p in value.split("\n")]
    return "(" + " || chr(10) || ".join(parts) + ")" if len(parts) > 1 else parts[0]


def sql_dealt(values: tuple, by: str) -> str:
    return f"([{', '.join(map(sql_text, values))}])[(({by}) % {len(values)}) + 1]"


def sql_list(words) -> str:
    return ", ".join(sql_text(w) for w in words)


ERRORS = ("timeout after 60 s", "HTTP 429 too many requests", "HTTP 500 server error", "bad json in the answer of the model, cut at fifty")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run records of documents and labels."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    size = F.octet_length("text").cast("bigint")
    return d.select(
        F.col("doc_id").alias("ord"), F.concat(F.lit("video:"), "source", F.lit(":q"), (F.col("doc_id") % 37).cast("string")).alias("record_key"), F.col("lang").alias("modality"), "source",
        F.when(F.expr("doc_id div 20 % 2") == 0, "A").otherwise("B").alias("config"), F.when(F.col("quality").isNotNull(), "completed").when(F.col("doc_id") % 3 == 0, "failed").otherwise("started").alias("status"),
        (F.col("quality") == 1).alias("correct"), size.alias("source_bytes"), F.expr("cast(octet_length(text) as bigint) * (doc_id % 7) div 5").alias("evidence_bytes"),
        (F.col("doc_id") % 1000 / 8).alias("elapsed_seconds"), F.when(F.col("quality").isNull(), dealt(ERRORS, F.col("doc_id"))).alias("error"), dealt(QUESTIONS, F.col("doc_id")).alias("question"), dealt(ANSWERS, F.col("doc_id")).alias("answer_text"))


RUNS = f"""runs AS (
  SELECT d.doc_id AS ord, 'video:' || source || ':q' || (d.doc_id % 37)::VARCHAR AS record_key, lang AS modality, source,
    CASE WHEN d.doc_id // 20 % 2 = 0 THEN 'A' ELSE 'B' END AS config, CASE WHEN quality IS NOT NULL THEN 'completed' WHEN d.doc_id % 3 = 0 THEN 'failed' ELSE 'started' END AS status,
    quality = 1 AS correct, strlen(text)::BIGINT AS source_bytes, (strlen(text)::BIGINT * (d.doc_id % 7)) // 5 AS evidence_bytes,
    (d.doc_id % 1000)::DOUBLE / 8 AS elapsed_seconds, CASE WHEN quality IS NULL THEN {sql_dealt(ERRORS, 'd.doc_id')} END AS error,
    {sql_dealt(QUESTIONS, 'd.doc_id')} AS question, {sql_dealt(ANSWERS, 'd.doc_id')} AS answer_text
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
counted AS (
  SELECT *, greatest(1, ceil(greatest(source_bytes, 0) / 4.0::DOUBLE))::BIGINT AS original_tokens, greatest(1, ceil(greatest(evidence_bytes, 0) / 4.0::DOUBLE))::BIGINT AS compressed_tokens FROM runs),
metered AS (
  SELECT *, CASE WHEN source_bytes > 0 THEN round(evidence_bytes::DOUBLE / source_bytes, 4) END AS compression_ratio,
    round(greatest(0::DOUBLE, 1 - compressed_tokens::DOUBLE / original_tokens), 4) AS token_saving_ratio, round(1 - compressed_tokens::DOUBLE / original_tokens, 4) AS token_saving_ratio_raw,
    1 - compressed_tokens::DOUBLE / original_tokens < 0 AS compression_expanded FROM counted)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames: video_id, ord, time_sec (of the day), score, label."""
    e = table(spark, sf_dir, "events")
    seconds = (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).cast("double")
    return e.select(F.concat(F.lit("v"), (F.col("user_id") % 40).cast("string")).alias("video_id"), F.col("event_id").alias("ord"), seconds.alias("time_sec"), F.col("value").alias("score"), F.col("event_type").alias("label"))


FRAMES = """frames AS (
  SELECT 'v' || (user_id % 40)::VARCHAR AS video_id, event_id AS ord, (hour(ts) * 3600 + minute(ts) * 60 + second(ts))::DOUBLE AS time_sec, value AS score, event_type AS label FROM events)"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as transcripts: video_id, ord, start_sec, end_sec, text. Every fifth turn is short, every seventh comes late."""
    c = table(spark, sf_dir, "conversations")
    start = F.col("turn") * 4.0 + F.when(F.col("turn") % 7 == 6, 9.0).otherwise(0.0)
    return c.select(F.col("conv_id").alias("video_id"), F.col("turn").alias("ord"), start.alias("start_sec"), (start + F.when(F.col("turn") % 5 == 2, 0.5).otherwise(3.0)).alias("end_sec"), "text")


SEGMENTS = """segments AS (
  SELECT conv_id AS video_id, turn AS ord, s AS start_sec, s + CASE WHEN turn % 5 = 2 THEN 0.5::DOUBLE ELSE 3 END AS end_sec, text
  FROM (SELECT *, turn * 4.0::DOUBLE + CASE WHEN turn % 7 = 6 THEN 9.0::DOUBLE ELSE 0 END AS s FROM conversations))"""
