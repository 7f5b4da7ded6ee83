"""Queries over sources, sinks, media cells, archives, stages and streams, on data derived from the driver's tables.

Files that a query reads are first written from a table to the shared folder; they go when the process ends.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F

from lumenfold.functions import json as jsons
from lumenfold.functions.numbers import budget
from lumenfold.functions.routing import lowered, question_types, task_family
from lumenfold.functions.text import ALONE, LETTER_CUES, OPTION, answer_letter, clean_caption, label_list, options, subtitle_block
from lumenfold.operators import anchors, evidence, filters, metrics, packages, sampling, timeline
from lumenfold.plans.standins import FRAMES, JSONS, QUESTIONS, RUNS, SEGMENTS, dealt, frames, runs, segments, sql_dealt, table
from lumenfold.plans.text_queries import _sql, typed_sql
from lumenfold.runtime import scratch, ship
from lumenfold.sources import adapters, archives, media, records
from lumenfold.streaming import runner

# ---- records, key lists, parts and sinks


def _stored(spark, sf_dir) -> list[str]:
    """Run records as JSON lines, a folder for each configuration, with a malformed line."""
    kept = runs(spark, sf_dir).select("config", F.col("ord").cast("int").alias("shard"), "record_key", "modality", "status", "correct", "source_bytes", "elapsed_seconds")
    paths = [scratch(spark, f"runs-{config}") for config in "AB"]
    for config, path in zip("AB", paths, strict=True):
        records.append_records(kept.where(F.col("config") == config), path)
    spark.range(1).select(F.lit('{"record_key": "cut').alias("value")).write.mode("append").text(paths[0])
    return paths


def stored_records(spark, sf_dir):
    return records.read_records(spark, _stored(spark, sf_dir)).select("config", "shard", "record_key", "modality", "status", "correct", "source_bytes", "elapsed_seconds")


def completed_keys(spark, sf_dir):
    return records.done_keys(spark, _stored(spark, sf_dir))


def key_positions(spark, sf_dir):
    path = scratch(spark, "keys")
    words = table(spark, sf_dir, "orders").select(F.concat_ws(" ", F.lit(""), F.col("o_orderkey").cast("string"), F.concat(F.lit("c"), F.col("o_custkey").cast("string"))).alias("value"), "o_orderkey")
    words.orderBy("o_orderkey").select("value").write.text(path)  # files by ranges of keys, in order of their names
    return records.read_keys(spark, path)


def merged_parts(spark, sf_dir):
    """Parts as three files, each a JSON array, of which the second follows the first by number and not by name."""
    path = scratch(spark, "parts")
    p = table(spark, sf_dir, "part")
    fs, at = None, spark._jvm.org.apache.hadoop.fs.Path
    for n in (1, 2, 10):
        own = p.where(F.pmod("p_partkey", F.lit(3)) == n % 3).select(F.struct("p_partkey", "p_size").alias("r"))
        own.agg(F.to_json(F.sort_array(F.collect_list("r"))).alias("value")).write.text(f"{path}/written{n}")
        fs = fs or at(path).getFileSystem(spark._jsc.hadoopConfiguration())
        file = next(f.getPath() for f in fs.listStatus(at(f"{path}/written{n}")) if f.getPath().getName().startswith("part-"))
        fs.rename(file, at(f"{path}/run_part{n}.json"))
    return records.read_parts(spark, [f"{path}/run_part{n}.json" for n in (10, 1, 2)]).select("p_partkey", "p_size", "part")


def slim_files(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), dealt((".JSON", ".jsonl", ".mp4", ".txt", ""), F.col("doc_id"))).alias("path"), F.lit("x").alias("raw_response"), F.lit("y").alias("prompt"))
    return records.slim(d).withColumn("class", records.file_class())


def summary_files(spark, sf_dir):
    path = scratch(spark, "summary")
    r = runs(spark, sf_dir)
    records.write_summary(r.select("ord", "config"), r.groupBy("config").agg(F.count("*").alias("n"), F.count_if("correct").alias("right")), path)
    results, summary = spark.read.json(f"{path}/results"), spark.read.json(f"{path}/summary")
    return results.groupBy("config").agg(F.count("*").alias("results"), F.max("ord").alias("last")).join(summary, "config")


def report_page(spark, sf_dir):
    path = scratch(spark, "report")
    summary = runs(spark, sf_dir).groupBy("config").agg(F.count("*").alias("n")).orderBy("config")
    records.write_report(summary, path, "Runs & more")
    return spark.read.text(f"{path}/html").select("value", F.lit(summary.count()).cast("bigint").alias("rows"))


def quota_hits(spark, sf_dir):
    lines = runs(spark, sf_dir).select("ord", F.col("source").alias("file"), F.coalesce("error", F.lit("ok")).alias("value"))
    return evidence.latest_quota_hits(lines)


def run_progress(spark, sf_dir):
    r = runs(spark, sf_dir).select("ord", "record_key", "status", "correct", F.lit("f").alias("file"))
    return runner.run_status(r)


# ---- dataset adapters


def task_subset(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("Task"), F.split("p_type", " ")[0].alias("Subtask"))
    first = rows.orderBy("p_partkey").first()
    return filters.by_task(rows, first["Task"], first["Subtask"])


def question_keys(spark, sf_dir):
    path = scratch(spark, "questions")
    table(spark, sf_dir, "documents").select(F.col("source").alias("videoID"), F.col("doc_id").cast("string").alias("question_id"), dealt(QUESTIONS, F.col("doc_id")).alias("question")).write.parquet(path)
    return records.read_questions(spark, path)


_HEADS = {"png": "89504E470D0A1A0A", "jpg": "FFD8FFE000104A46", "gif": "474946383961", "bmp": "424D36000000", "webp": "52494646000000005745425056503820", "none": "00010203"}


def decoded_images(spark, sf_dir):
    cell = F.concat(F.to_binary(dealt(tuple(_HEADS.values()), F.col("doc_id")), F.lit("hex")), F.to_binary("text", F.lit("utf-8")))
    encoded = F.when(F.col("doc_id") % 11 == 0, "*not base64*").otherwise(F.base64(cell))
    out = table(spark, sf_dir, "documents").select("doc_id", adapters.decoded_image(encoded).alias("i"))
    return out.select("doc_id", "i.extension", "i.ok", F.coalesce(F.octet_length("i.content"), F.lit(0)).cast("bigint").alias("size"))


def chat_rows(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", adapters.chat_row(dealt(QUESTIONS, F.col("doc_id")), F.array(F.lit("A. x"), F.col("lang")), F.col("lang"), F.concat(F.lit("image_"), F.col("doc_id").cast("string"))).alias("c"))
    said = adapters.assistant_text(F.col("c.messages"), F.lit("none"))
    asked = F.get(F.col("c.messages"), F.lit(0))["content"]
    return d.select("doc_id", said.alias("said"), F.get(F.col("c.images"), F.lit(0)).alias("image"), asked.startswith(dealt(QUESTIONS, F.col("doc_id"))).alias("asks"), asked.contains(F.concat(F.lit("A. x\n"), F.col("lang"))).alias("lists"))


def existing_files(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("stem"), "lang")
    files = d.where("stem % 4 > 0").select("stem", F.explode(F.slice(F.array(F.lit(".png"), F.lit(".jpeg"), F.lit(".jpg"), F.lit(".gif")), 1, (F.col("stem") % 4).cast("int"))).alias("extension"))
    files = files.withColumn("path", F.concat(F.lit("d/"), F.col("stem").cast("string"), F.col("extension")))
    return adapters.existing_extension(d, files, "stem")


def candidate_questions(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("video_id"), F.col("doc_id").alias("ord"), dealt(QUESTIONS, F.col("doc_id")).alias("question"), F.array(F.lit("en"), F.lit("de"), F.lit("xx")).alias("candidates"), F.col("lang").alias("answer"))
    return adapters.from_candidates(d, "docs", "lang").withColumn("options", F.array_join("options", "|"))


_LINED = ("What?\nA. one\n B. two ", "Why so\nreally\nA. x\nB. Y y\nC. z", "no options", "A. alone\n?", "Which?\nC. red\nD. blue")
_TOLD = ("A. one", "y Y", "B", "A. alone", "Blue")


def option_questions(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", dealt(_LINED, F.col("doc_id")).alias("question"), dealt(_TOLD, F.col("doc_id")).alias("answer"))
    return adapters.from_option_lines(d).select("doc_id", "stem", F.array_join("options", "|").alias("options"), "letter")


def dataset_manifest(spark, sf_dir):
    return adapters.manifest(table(spark, sf_dir, "documents").select(F.col("lang").alias("dataset"), F.col("doc_id").alias("record_key"), F.col("source").alias("videoID")))


def duration_pick(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("videoID"), F.col("doc_id").alias("question_id"), F.col("n_chars").alias("seconds"))
    return adapters.duration_range(d, "seconds", 300, 3000)


# ---- media cells and archives


def image_headers(spark, sf_dir):
    """PNG, GIF and BMP headers with sizes from a part's numbers."""
    w, h = F.col("p_size") + 1, F.pmod("p_partkey", F.lit(500)).cast("int") + 1
    big = lambda x: F.lpad(F.hex(x), 8, "0")
    pairs = lambda x, n: F.concat(*(F.substring(big(x), 9 - 2 * k, 2) for k in range(1, n + 1)))
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), big(w), big(h))
    gif = F.concat(F.lit("474946383961"), pairs(w, 2), pairs(h, 2))
    bmp = F.concat(F.lit("424D" + "00" * 16), pairs(w, 4), pairs(h, 4))
    kind = F.pmod("p_partkey", F.lit(4))
    cell = F.unhex(F.when(kind == 0, png).when(kind == 1, gif).when(kind == 2, bmp).otherwise("00FF"))
    return media.image_stats(table(spark, sf_dir, "part").select("p_partkey", cell.alias("content"))).drop("content")


def _wav_cells(spark, sf_dir):
    """WAV cells of 8 bits at 8 Hz: the bytes of each benchmark item's text as samples."""
    size = lambda n: F.concat(*(F.substring(F.lpad(F.hex(n), 8, "0"), 9 - 2 * k, 2) for k in range(1, 5)))
    data = F.to_binary(F.regexp_replace("text", "[^ -~]", ""), F.lit("utf-8"))
    n = F.octet_length(data).cast("int")
    head = F.concat(F.lit("52494646"), size(n + 36), F.lit("57415645666D7420100000000100010008000000080000000100080064617461"), size(n))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("clip_id"), F.concat(F.unhex(head), data).alias("content"))


def audio_energy(spark, sf_dir):
    samples = media.sample_rows(media.audio_samples(_wav_cells(spark, sf_dir), "clip_id", rate=8), "clip_id")
    return timeline.energy_profile(samples, "clip_id", "i", "x", 64)


def resampled_audio(spark, sf_dir):
    samples = media.sample_rows(media.audio_samples(_wav_cells(spark, sf_dir), "clip_id", rate=4), "clip_id")
    return samples.select("clip_id", "i", F.round(F.col("x").cast("double"), 5).alias("x"))


def audio_spectrum(spark, sf_dir):
    """A tone of eight samples a period, as loud as its part's number says. Parts are dealt anew, as a few bytes of each become
    16 KB of samples: the splits of their file are too few."""
    tone = F.lit([math.sin(k * 2 * math.pi / 8) for k in range(2048)])
    parts = table(spark, sf_dir, "part").where("p_size IS NOT NULL").select("p_partkey", "p_size").repartition("p_partkey")
    x = F.transform(tone, lambda s: F.col("p_size") / 50.0 * s)
    out = timeline.spectrum_summary(parts.select(F.col("p_partkey").cast("string").alias("clip_id"), x.alias("samples")))
    return out.select("clip_id", F.round("rms", 5).alias("rms"), F.get("top_hz", F.lit(0)).alias("loudest"))


def media_payload(spark, sf_dir):
    urls = F.array(media.data_url(F.to_binary(F.col("lang"), F.lit("utf-8")), F.lit("text/plain")), F.col("source"))
    d = table(spark, sf_dir, "documents").select("doc_id", media.degraded(media.payload(dealt(QUESTIONS, F.col("doc_id")), urls), F.col("doc_id") % 3).alias("p"))
    return d.select("doc_id", F.size("p").alias("n"), F.array_join(F.transform("p", lambda x: F.coalesce(x["text"], x["url"])), "|").alias("parts"))


def _archives(spark, sf_dir):
    """A zip cell for each block of fifty ids, its members documents; every third is broken."""
    import io
    import zipfile

    def zipped(pdf: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for r in pdf.sort_values("doc_id").itertuples(index=False):
                z.writestr(f"sub/{r.doc_id % 400}.{'mp4' if r.doc_id % 5 else 'txt'}", r.lang * (r.doc_id % 7))
        n = int(pdf["block"].iloc[0])
        return pd.DataFrame({"path": [f"a{n:09d}.zip"], "content": [out.getvalue()[: 10 if n % 3 == 2 else None]]})

    ship(spark)
    d = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL AND lang IS NOT NULL").select("doc_id", "lang", F.expr("doc_id div 50").alias("block"))
    return d.groupBy("block").applyInPandas(zipped, "path string, content binary")


def archive_listing(spark, sf_dir):
    return archives.members_of(_archives(spark, sf_dir))


def archive_contents(spark, sf_dir):
    cells = _archives(spark, sf_dir)
    return archives.contents_of(cells, archives.members_of(cells)).select("stem", F.decode("content", "UTF-8").alias("content"))


def _subtitles(spark, sf_dir):
    s = segments(spark, sf_dir).where("video_id IS NOT NULL")
    block = subtitle_block(F.col("ord") + 1, F.col("start_sec"), F.col("end_sec"), F.concat(F.lit("turn "), F.col("ord").cast("string"), F.when(F.col("ord") % 2 == 0, " <i>said</i>").otherwise(" &amp; heard")))
    lines = s.groupBy("video_id").agg(F.sort_array(F.collect_list(F.struct("ord", block.alias("b")))).alias("bs"))  # a transcript is one file
    return lines.select(F.col("video_id").cast("string").alias("stem"), F.array_join(F.transform("bs", lambda x: x["b"]), "\n").alias("content"))


def subtitle_rows(spark, sf_dir):
    return archives.transcript(_subtitles(spark, sf_dir))


def first_transcripts(spark, sf_dir):
    every = subtitle_rows(spark, sf_dir)
    best = every.where("cast(stem AS bigint) % 3 = 0")
    return archives.first_source([best.withColumn("source", F.lit("file")), every.withColumn("source", F.lit("speech"))]).groupBy("stem", "source").agg(F.count("*").alias("segments"))


# ---- anchors, budgets, JSON


def flattened_anchors(spark, sf_dir):
    s = segments(spark, sf_dir).where("video_id IS NOT NULL")
    at = F.when(F.col("ord") % 4 == 3, "late").otherwise(F.col("start_sec").cast("string"))
    anchors = s.groupBy("video_id").agg(F.sort_array(F.collect_list(F.struct("ord", at.alias("time_sec")))).alias("windows"))
    return packages.flattened(anchors, "video_id", "windows", "time_sec")


def linked_anchors(spark, sf_dir):
    f = frames(spark, sf_dir)
    index = f.groupBy("label").agg(F.min("ord").alias("first_ord"), F.max("time_sec").alias("time_sec"))
    rows = f.select("ord", "label", F.when(F.col("ord") % 2 == 0, F.col("time_sec")).alias("time_sec"), F.lit(None).cast("bigint").alias("first_ord"))
    return packages.linked(rows, index, "label", "first_ord", "time_sec")


def token_budgets(spark, sf_dir):
    low = lowered(dealt(QUESTIONS, F.col("doc_id")))
    d = table(spark, sf_dir, "documents").select("doc_id", low.alias("low"))
    return d.select("doc_id", budget(question_types(F.col("low"), task_family(F.col("low"))), 999).alias("b")).select("doc_id", "b.anchor", "b.evidence")


def ends_sample(spark, sf_dir):
    words = F.split("text", " ")
    return table(spark, sf_dir, "benchmark").select("item_id", *(F.array_join(evidence.sample_ends(words, n), " ").alias(f"of_{n}") for n in (3, 4, 7)))


def mean_resolution(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_size").alias("width"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_partkey")).alias("height"))
    return metrics.mean_resolution(p)


def grouped_shards(spark, sf_dir):
    d = sampling.together(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", 16).withColumn("p", F.spark_partition_id())
    return d.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("p").alias("partitions"))


def keys_removed(spark, sf_dir):
    e = table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct("lang", F.struct("source", F.array(F.struct(F.col("lang").alias("raw"), F.col("doc_id").alias("n"))).alias("items")).alias("deep"), F.lit(1).alias("raw"))).alias("j"))
    return jsons.without_keys(e, "j", ["raw", "source"])


def json_objects(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", dealt(JSONS, F.col("doc_id")).alias("t"))
    v = jsons.model_json(F.col("t"))
    return d.select("doc_id", v.isNotNull().alias("is_object"), jsons.path(v, "$.a", "int", -1).alias("a"), jsons.path(v, "$.b.c", "string", "none").alias("c"), jsons.model_object(F.col("t")).alias("object"))


def json_lists(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.try_parse_json(dealt(("[1, 2, 3]", "7", "null", '{"x": 1}', "[]", "bad"), F.col("doc_id"))).alias("v"))
    return d.select("doc_id", F.size(jsons.as_list(F.col("v"))).alias("n"), jsons.fallback(F.lit("no json"), (F.col("doc_id") % 4).cast("int")).alias("fallback"))


# ---- what is kept of detectors, readers and coders


def _readings(spark, sf_dir):
    return frames(spark, sf_dir).select("video_id", "ord", F.concat("label", F.lit(" #"), (F.col("ord") % 6).cast("string")).alias("text"), (F.col("ord") % 10 / 10).alias("confidence"))


def kept_readings(spark, sf_dir):
    return anchors.kept_readings(_readings(spark, sf_dir), "video_id", "text", "confidence", "ord")


def kept_detections(spark, sf_dir):
    return anchors.kept_detections(_readings(spark, sf_dir), "video_id", "text", "confidence", "ord", F.col("text").startswith("error"))


def kept_speech(spark, sf_dir):
    s = segments(spark, sf_dir)
    tries = s.select("video_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("attempt"), "start_sec", "ord")
    heard = F.when((F.col("attempt") == 2) | (F.col("video_id") % 3 > 0), F.concat(F.lit("turn "), F.col("ord").cast("string"))).otherwise(" ")
    return anchors.kept_speech(tries.withColumn("text", heard), "video_id", "attempt", "start_sec", "text", 3)


def scenes_or_even(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 7.5).alias("d"))
    scenes = p.where("p_partkey % 2 = 0").select("p_partkey", F.lit(0).alias("part"), F.lit(0.0).alias("start_sec"), F.col("d").alias("end_sec"))
    return anchors.scenes_or_even(scenes, p, "p_partkey", "d")


def within_budget(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("rung"))
    sized = p.withColumn("bytes", F.floor(F.col("p_size") * 1000 / F.col("rung")))
    return anchors.within_budget(sized, "p_partkey", "rung", "bytes", F.lit(12000))


def zoomed_answers(spark, sf_dir):
    box = F.when(F.col("doc_id") % 3 > 0, F.array(*(F.lit(x) for x in (0.25, 0.25, 0.5, 0.75))))
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("answer"), F.lit(640).alias("width"), F.lit(360).alias("height"), box.alias("box"))
    asked = anchors.zoom_requests(d)
    second = asked.where("crop IS NOT NULL AND doc_id % 2 = 0").select("doc_id", F.concat(F.lit("sure "), "answer").alias("answer"))
    return anchors.rechecked(asked, second, "doc_id").select("doc_id", "final", F.array_join(F.col("crop").cast("array<string>"), ",").alias("crop"))


def video_headers(spark, sf_dir):
    """MP4 headers with sizes and durations from a part's numbers."""
    big = lambda x: F.lpad(F.hex(x), 8, "0")
    box = lambda kind, body: F.concat(big((F.length(body) / 2 + 8).cast("int")), F.lit(kind.encode().hex()), body)
    mvhd = box("mvhd", F.concat(F.lit("00" * 12), big(F.lit(600)), big(F.col("p_size") * 300), F.lit("00" * 80)))
    tkhd = box("tkhd", F.concat(F.lit("00" * 76), big(F.col("p_size") * 65536), big((F.pmod("p_partkey", F.lit(500)) + 1).cast("int") * 65536)))
    cell = F.concat(box("ftyp", F.lit("69736F6D")), box("moov", F.concat(mvhd, box("trak", tkhd))))
    rows = table(spark, sf_dir, "part").where("p_size IS NOT NULL").select("p_partkey", F.unhex(F.when(F.col("p_partkey") % 5 > 0, cell).otherwise("0102")).alias("content"))
    return media.video_stats(rows).drop("content")


def queued_jobs(spark, sf_dir):
    def run(job):
        if int(job["record_key"]) % 9 == 4:
            raise RuntimeError("exit 1")

    return runner.queued(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("record_key")), run, 4)


# ---- real texts


def page_captions(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(clean_caption(F.col("html"))).alias("digest"))


def turn_answers(spark, sf_dir):
    """The letters, labels and options that the conversations' own texts hold."""
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", answer_letter(F.col("text")).alias("letter"), F.size(label_list(F.col("text"))).alias("labels"), F.size(options(F.col("text"))).alias("options"))


def turn_profiles(spark, sf_dir):
    """Family and types of the conversations' own texts as questions."""
    low = lowered(F.col("text"))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", low.alias("low")).withColumn("family", task_family(F.col("low")))
    return c.select("conv_id", "turn", "family", F.array_join(question_types(F.col("low"), F.col("family")), ",").alias("types"))


# ---- stages and streams


def failover_records(spark, sf_dir):
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("record_key"), "lang")

    def small(item, tokens):
        if int(item["record_key"]) % 3:
            raise ValueError("too hard")
        return f"small {item['lang']}"

    def large(item, tokens):
        if int(item["record_key"]) % 7 == 1:
            raise ValueError("no answer")
        return f"large {item['lang']}"

    return runner.stage(items, runner.with_failover([small, large]), retries=2)


def streamed_evaluation(spark, sf_dir):
    """Two runs over one folder of items, the second with new ones: each key is answered once."""
    source, sink, state = (scratch(spark, f"stream-{x}") for x in ("items", "sink", "state"))
    items = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select(F.col("doc_id").cast("string").alias("record_key"), "lang")

    def answer(item, tokens):
        if int(item["record_key"]) % 10 == 0:
            raise ValueError("no answer")
        return item["lang"]

    for part in (F.col("lang") != "en", F.lit(True)):
        items.where(part).coalesce(2).write.mode("append").json(source)
        runner.evaluate(spark, source, "record_key string, lang string", sink, state, answer, 2).awaitTermination()
    out = spark.read.schema(runner.RESULT).json(sink)
    return out.where("status = 'completed'").groupBy("record_key").agg(F.count("*").alias("records"), F.min("response").alias("response"))


def streamed_changes(spark, sf_dir):
    """The vectors as a stream of two files in order; change scores carry over the files."""
    source, sink, state = (scratch(spark, f"frames-{x}") for x in ("in", "out", "state"))
    v = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("v"), F.col("label").cast("string")).alias("video_id"), F.col("vec_id").alias("ord"), F.col("embedding").alias("feature"))
    half = v.agg(F.percentile_approx("ord", 0.5)).first()[0]
    for part in (F.col("ord") <= half, F.col("ord") > half):
        v.where(part).coalesce(1).write.mode("append").parquet(source)
        changes = runner.change_stream(spark.readStream.schema(v.schema).option("maxFilesPerTrigger", 1).parquet(source))
        changes.writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(sink).select("video_id", "ord", F.round("change_score", 4).alias("change_score"))


def _sizes(word: str) -> str:
    return f"CASE WHEN list_contains(types, 'spatial_relation') THEN {word.format(0.3)} WHEN list_has_any(types, ['ocr', 'temporal_order', 'audio_visual']) THEN {word.format(0.25)} WHEN list_contains(types, 'semantic_video') THEN {word.format(0.15)} ELSE {word.format(0.2)} END"


_STORED = "SELECT config, ord::INT AS shard, record_key, modality, status, correct, source_bytes, elapsed_seconds FROM runs"
_WAV = "SELECT item_id::VARCHAR AS clip_id, regexp_replace(text, '[^ -~]', '', 'g') AS t FROM benchmark"
_ZIPPED = """z AS (SELECT doc_id, (doc_id % 400)::VARCHAR AS stem, 'a' || lpad((doc_id // 50)::VARCHAR, 9, '0') || '.zip' AS archive, repeat(lang, (doc_id % 7)::INT) AS content FROM documents WHERE doc_id % 5 > 0 AND doc_id % 7 > 0 AND doc_id // 50 % 3 <> 2),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY archive DESC) AS k FROM z) WHERE k = 1)"""
_SRT = """cues AS (SELECT video_id::VARCHAR AS stem, (ord + 1)::INT AS sequence_index, round(start_sec, 3) AS start_sec, round(end_sec, 3) AS end_sec, 'turn ' || ord::VARCHAR || CASE WHEN ord % 2 = 0 THEN ' said' ELSE ' & heard' END AS text FROM segments)"""
_READ = "r AS (SELECT video_id, ord, label || ' #' || (ord % 6)::VARCHAR AS text, (ord % 10) / 10.0::DOUBLE AS confidence FROM frames)"


def _letters_sql() -> str:
    last = lambda p: f"regexp_extract_all(x, '{p}', 1)[-1]"
    cues = ", ".join(last(c.replace("'", "QQ")) for c in (*LETTER_CUES, ALONE))
    bare = "upper(regexp_replace(x, '^[(\\s]+|[).,\\s]+$', '', 'g'))"
    normal = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'), ' ')"
    quoted = "regexp_extract_all(text, 'QQ[^QQ]+QQ|\"[^\"]+\"')"
    items = f"CASE WHEN len({quoted}) > 0 THEN list_transform({quoted}, lambda q: q[2:-2]) ELSE regexp_split_to_array(text, '[,;/]') END"
    # word boundaries between letters of any script, which the pattern language's own don't know
    word = "regexp_extract_all('  ' || regexp_replace(x, '[^\\p{L}\\p{M}\\p{N}_]+', '  ', 'g') || '  ', ' ([A-Fa-f]) ', 1)[-1]"
    sql = f"""SELECT conv_id, turn, CASE WHEN {bare} IN ('A', 'B', 'C', 'D', 'E', 'F') THEN {bare} ELSE upper(coalesce({cues}, CASE WHEN length(x) <= 120 THEN {word} END)) END AS letter,
  len(list_filter(list_transform({items}, lambda i: {normal.format('i')}), lambda i: i <> ''))::INT AS labels, len(list_distinct(regexp_extract_all(text, '{OPTION}', 1)))::INT AS options FROM (SELECT *, trim(text, ' ') AS x FROM conversations)"""
    return sql.replace("QQ", "''")


def _profiles_sql() -> str:
    own = typed_sql().replace(_sql(QUESTIONS, "q"), "(SELECT conv_id * 1000 + turn AS doc_id, text AS q FROM conversations)")
    return f"WITH {own} SELECT doc_id // 1000 AS conv_id, doc_id % 1000 AS turn, family, array_to_string(types, ',') AS types FROM typed"


_PLAIN = "replace(replace(replace(replace(html, '&copy;', chr(169)), '&middot;', chr(183)), '&quot;', '\"'), '&amp;', '&')"
QUERIES = {
    "kept_readings": (kept_readings, f"""WITH {FRAMES}, {_READ}, o AS (SELECT video_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' ') AS norm, arg_min(text, ord) AS text, arg_min(confidence, ord) AS confidence, min(ord) AS ord FROM r WHERE confidence >= 0.35::DOUBLE GROUP BY 1, 2),
p AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY ord)::INT AS place FROM o) SELECT * FROM p WHERE place <= 8"""),
    "kept_detections": (kept_detections, f"""WITH {FRAMES}, {_READ}, p AS (SELECT video_id, text, confidence, ord, row_number() OVER (PARTITION BY video_id ORDER BY confidence DESC, ord)::INT AS place FROM r
WHERE confidence >= 0.2::DOUBLE AND (starts_with(text, 'error') OR confidence >= 0.45::DOUBLE)) SELECT * FROM p WHERE place <= 12"""),
    "kept_speech": (kept_speech, f"""WITH {SEGMENTS}, t AS (SELECT video_id, CASE WHEN video_id % 3 > 0 THEN 1 ELSE 2 END AS attempt, start_sec, ord, 'turn ' || ord::VARCHAR AS text, row_number() OVER (PARTITION BY video_id ORDER BY start_sec)::INT AS place FROM segments) SELECT * FROM t WHERE place <= 3"""),
    "scenes_or_even": (scenes_or_even, """WITH n AS (SELECT p_partkey, p_size * 7.5::DOUBLE AS d, least(12, greatest(1, ceil(p_size * 7.5::DOUBLE / 20)))::INT AS n FROM part WHERE p_size > 0 AND p_partkey % 2 = 1), p AS (SELECT *, unnest(range(0, n))::INT AS part FROM n)
SELECT p_partkey, part, round(d * part / n, 3) AS start_sec, round(d * (part + 1) / n, 3) AS end_sec, 'even' AS origin FROM p UNION ALL SELECT p_partkey, 0, 0, p_size * 7.5::DOUBLE, 'detector' FROM part WHERE p_partkey % 2 = 0"""),
    "within_budget": (within_budget, """WITH s AS (SELECT p_partkey, p_size, rung, floor(p_size * 1000 / rung::DOUBLE)::BIGINT AS bytes FROM part, (VALUES (1), (2), (3)) AS r(rung)),
k AS (SELECT *, bytes <= 12000 AS fits, row_number() OVER (PARTITION BY p_partkey ORDER BY (bytes <= 12000)::INT DESC, CASE WHEN bytes <= 12000 THEN rung ELSE -rung END) AS k FROM s) SELECT p_partkey, p_size, rung, bytes, fits FROM k WHERE k = 1"""),
    "zoomed_answers": (zoomed_answers, "SELECT doc_id, CASE WHEN doc_id % 3 > 0 AND doc_id % 2 = 0 THEN 'sure ' || lang ELSE lang END AS final, CASE WHEN doc_id % 3 > 0 THEN '120,45,360,315' END AS crop FROM documents"),
    "video_headers": (video_headers, """SELECT p_partkey, CASE WHEN p_partkey % 5 > 0 THEN p_size ELSE 0 END::INT AS width, CASE WHEN p_partkey % 5 > 0 THEN p_partkey % 500 + 1 ELSE 0 END::INT AS height, CASE WHEN p_partkey % 5 > 0 THEN p_size / 2.0::DOUBLE ELSE 0 END AS duration_sec FROM part"""),
    "queued_jobs": (queued_jobs, "SELECT doc_id::VARCHAR AS record_key, CASE WHEN doc_id % 9 = 4 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN doc_id % 9 = 4 THEN 'RuntimeError: exit 1' END AS error FROM documents"),
    "page_captions": (page_captions, f"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace({_PLAIN}, '<[^>]+>', ' ', 'g'), '\\{{\\\\[^}}]+\\}}', ' ', 'g'), '[\\s\\x{{00A0}}]+', ' ', 'g'), ' ')) AS digest FROM pages"""),
    "turn_answers": (turn_answers, _letters_sql()),
    "turn_profiles": (turn_profiles, _profiles_sql()),
    "stored_records": (stored_records, f"WITH {RUNS} {_STORED}"),
    "completed_keys": (completed_keys, f"WITH {RUNS} SELECT DISTINCT record_key FROM runs WHERE status = 'completed'"),
    "key_positions": (key_positions, """WITH k AS (SELECT o_orderkey::VARCHAR AS record_key, 2 * (row_number() OVER (ORDER BY o_orderkey)) - 2 AS position, 'c' || o_custkey::VARCHAR AS c FROM orders)
SELECT record_key, position::BIGINT AS position FROM k UNION ALL SELECT c, (position + 1)::BIGINT FROM k"""),
    "merged_parts": (merged_parts, "SELECT p_partkey, p_size::BIGINT AS p_size, CASE p_partkey % 3 WHEN 2 THEN 2 ELSE n END::INT AS part FROM part, (VALUES (1), (10)) AS v(n) WHERE p_partkey % 3 = 1 OR (p_partkey % 3 = 2 AND n = 1)"),
    "slim_files": (slim_files, """WITH d AS (SELECT doc_id, source || '/' || doc_id::VARCHAR || (['.JSON', '.jsonl', '.mp4', '.txt', ''])[doc_id % 5 + 1] AS path FROM documents) SELECT doc_id, path, (['slim', 'slim', 'skip', 'copy', 'copy'])[doc_id % 5 + 1] AS class FROM d"""),
    "summary_files": (summary_files, f"WITH {RUNS} SELECT config, count(*) AS results, max(ord) AS last, count(*) AS n, count(*) FILTER (correct) AS \"right\" FROM runs GROUP BY config"),
    "report_page": (report_page, f"""WITH {RUNS}, s AS (SELECT config, count(*) AS n FROM runs GROUP BY config) SELECT '<!doctype html><title>Runs &amp; more</title><table><tr><th>config</th><th>n</th></tr>' ||
  string_agg('<tr><td>' || config || '</td><td>' || n::VARCHAR || '</td></tr>', '' ORDER BY config) || '</table>' AS value, count(*) AS rows FROM s"""),
    "quota_hits": (quota_hits, f"WITH {RUNS} SELECT source AS file, count(*) AS hits, arg_max(error, ord) AS latest FROM runs WHERE regexp_matches(error, '(?i)quota|insufficient balance|rate limit|429') GROUP BY source"),
    "run_progress": (run_progress, f"""WITH {RUNS}, k AS (SELECT *, row_number() OVER (PARTITION BY record_key ORDER BY (status = 'completed')::INT DESC, CASE WHEN status = 'completed' THEN -ord ELSE ord END) AS k FROM runs WHERE record_key IS NOT NULL)
SELECT count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status NOT IN ('completed', 'failed')) AS running FROM k WHERE k = 1"""),
    "task_subset": (task_subset, """WITH p AS (SELECT p_partkey, p_brand AS "Task", string_split(p_type, ' ')[1] AS "Subtask" FROM part), f AS (SELECT * FROM p ORDER BY p_partkey LIMIT 1) SELECT p.* FROM p JOIN f ON p."Task" = f."Task" AND p."Subtask" = f."Subtask" """),
    "question_keys": (question_keys, f"SELECT source AS \"videoID\", doc_id::VARCHAR AS question_id, {sql_dealt(QUESTIONS, 'doc_id')} AS question, 'video:' || source || ':' || doc_id::VARCHAR AS record_key FROM documents"),
    "decoded_images": (decoded_images, f"""SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'jpg' ELSE (['png', 'jpg', 'gif', 'bmp', 'webp', 'jpg'])[doc_id % 6 + 1] END AS extension, doc_id % 11 > 0 AS ok,
  CASE WHEN doc_id % 11 = 0 THEN 0 ELSE strlen(text) + ([{', '.join(str(len(h) // 2) for h in _HEADS.values())}])[doc_id % 6 + 1] END::BIGINT AS size FROM documents"""),
    "chat_rows": (chat_rows, "SELECT doc_id, lang AS said, 'image_' || doc_id::VARCHAR AS image, TRUE AS asks, TRUE AS lists FROM documents"),
    "existing_files": (existing_files, "SELECT doc_id AS stem, lang, 'd/' || doc_id::VARCHAR || CASE WHEN doc_id % 4 = 3 THEN '.jpg' ELSE '.png' END AS path FROM documents WHERE doc_id % 4 > 0"),
    "candidate_questions": (candidate_questions, f"""SELECT source AS video_id, 'short' AS duration, 'docs' AS domain, 'lang' AS sub_category, source AS "videoID", source || '_' || doc_id::VARCHAR AS question_id, 'lang' AS task_type, {sql_dealt(QUESTIONS, 'doc_id')} AS question,
  'A. en|B. de|C. xx' AS options, CASE lang WHEN 'en' THEN 'A' ELSE 'B' END AS answer FROM documents WHERE lang IN ('en', 'de')"""),
    "option_questions": (option_questions, """WITH v(k, stem, options, letter) AS (VALUES (0, 'What?', 'A. one|B. two', 'A'), (1, 'Why so really', 'A. x|B. Y y|C. z', 'B'), (4, 'Which?', 'C. red|D. blue', 'D')) SELECT doc_id, stem, options, letter FROM documents JOIN v ON doc_id % 5 = k"""),
    "dataset_manifest": (dataset_manifest, "SELECT lang AS dataset, count(DISTINCT doc_id) AS samples, count(DISTINCT source) AS videos FROM documents GROUP BY lang"),
    "duration_pick": (duration_pick, "SELECT source AS \"videoID\", min(doc_id) AS question_id, arg_min(n_chars, doc_id) AS seconds FROM documents WHERE n_chars BETWEEN 300 AND 3000 GROUP BY source"),
    "image_headers": (image_headers, """WITH p AS (SELECT p_partkey, p_partkey % 4 AS k, p_size + 1 AS w, p_partkey % 500 + 1 AS h FROM part) SELECT p_partkey, CASE WHEN k < 3 THEN w ELSE 0 END::INT AS width, CASE WHEN k < 3 THEN h ELSE 0 END::INT AS height,
  ([24, 10, 26, 2])[k + 1]::INT AS bytes, CASE WHEN k < 3 THEN round(w * h / 1000000.0::DOUBLE, 4) ELSE 0 END AS megapixels FROM p"""),
    "audio_energy": (audio_energy, f"""WITH b AS ({_WAV}), s AS (SELECT clip_id, i - 1 AS i, ((ascii(t[i]) - 128) / 128.0::DOUBLE)::FLOAT::DOUBLE AS x FROM (SELECT clip_id, t, unnest(range(1, length(t) + 1)) AS i FROM b))
SELECT clip_id, (i // 64)::BIGINT AS win, round(sqrt(avg(x * x)), 6) AS rms, count(*) AS n FROM s GROUP BY 1, 2"""),
    "resampled_audio": (resampled_audio, f"""WITH b AS (SELECT *, length(t) AS n, greatest(1, round_even(length(t) / 2.0::DOUBLE, 0))::BIGINT AS m FROM ({_WAV})), g AS (SELECT *, unnest(range(0, m)) AS i FROM b), p AS (SELECT *, i * n / m::DOUBLE AS place FROM g),
v AS (SELECT *, least(floor(place), n - 1)::BIGINT AS a FROM p) SELECT clip_id, i::INT AS i, round(((ascii(t[a + 1]) - 128) / 128.0::DOUBLE * (1 - (place - a)) + (ascii(t[least(a + 2, n)]) - 128) / 128.0::DOUBLE * (place - a))::FLOAT::DOUBLE, 5) AS x FROM v"""),
    "audio_spectrum": (audio_spectrum, "SELECT p_partkey::VARCHAR AS clip_id, round(p_size / 50.0::DOUBLE / sqrt(2), 5) AS rms, 2000.0::DOUBLE AS loudest FROM part"),
    "media_payload": (media_payload, f"""SELECT doc_id, (3 - doc_id % 3)::INT AS n, {sql_dealt(QUESTIONS, 'doc_id')} || CASE WHEN doc_id % 3 < 2 THEN '|data:text/plain;base64,' || base64(lang::BLOB) ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN '|' || source ELSE '' END AS parts FROM documents"""),
    "archive_listing": (archive_listing, f"WITH {_ZIPPED} SELECT stem, archive, 'sub/' || stem || '.mp4' AS member, strlen(content)::BIGINT AS size FROM last"),
    "archive_contents": (archive_contents, f"WITH {_ZIPPED} SELECT stem, content FROM last"),
    "subtitle_rows": (subtitle_rows, f"WITH {SEGMENTS}, {_SRT} SELECT stem, sequence_index, start_sec, end_sec, text, stem || '_seg_' || lpad(sequence_index::VARCHAR, 4, '0') AS anchor_link, 'external_subtitle' AS source FROM cues"),
    "first_transcripts": (first_transcripts, f"WITH {SEGMENTS}, {_SRT} SELECT stem, CASE WHEN stem::BIGINT % 3 = 0 THEN 'file' ELSE 'speech' END AS source, count(*) AS segments FROM cues GROUP BY 1, 2"),
    "flattened_anchors": (flattened_anchors, f"""WITH {SEGMENTS}, a AS (SELECT video_id, ord, CASE WHEN ord % 4 = 3 THEN 'late' ELSE start_sec::VARCHAR END AS time_sec FROM segments)
SELECT video_id, ord, time_sec, row_number() OVER (PARTITION BY video_id ORDER BY coalesce(try_cast(time_sec AS DOUBLE), 0), ord)::INT AS place FROM a"""),
    "linked_anchors": (linked_anchors, f"WITH {FRAMES}, i AS (SELECT label, min(ord) AS first_ord, max(time_sec) AS latest FROM frames GROUP BY label) SELECT label, ord, CASE WHEN ord % 2 = 0 THEN time_sec ELSE latest END AS time_sec, first_ord FROM frames JOIN i USING (label)"),
    "token_budgets": (token_budgets, f"WITH {typed_sql()}, a AS (SELECT doc_id, ({_sizes('round_even({}::DOUBLE * 999, 0)')})::INT AS anchor FROM typed) SELECT doc_id, anchor, (999 - anchor)::INT AS evidence FROM a"),
    "ends_sample": (ends_sample, """WITH w AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark) SELECT item_id, array_to_string(w[1:3], ' ') AS of_3, array_to_string(CASE WHEN len(w) <= 4 THEN w ELSE w[1:2] || w[len(w) - 1:] END, ' ') AS of_4,
  array_to_string(CASE WHEN len(w) <= 7 THEN w ELSE w[1:3] || w[len(w) - 3:] END, ' ') AS of_7 FROM w"""),
    "mean_resolution": (mean_resolution, "SELECT count(*) AS n, round_even(avg(p_size), 0)::BIGINT AS mean_width, round_even(avg(p_partkey), 0)::BIGINT AS mean_height FROM part WHERE p_partkey % 3 > 0 AND p_size IS NOT NULL"),
    "grouped_shards": (grouped_shards, "SELECT source, count(*) AS n, 1::BIGINT AS partitions FROM documents GROUP BY source"),
    "keys_removed": (keys_removed, """SELECT doc_id, '{"lang":"' || lang || '","deep":{"items":[{"n":' || doc_id::VARCHAR || '}]}}' AS j FROM documents"""),
    "json_objects": (json_objects, """WITH v(k, is_object, a, c, object) AS (VALUES (0, TRUE, 1, 'x', '{"a":1,"b":{"c":"x"}}'), (1, TRUE, 2, 'none', '{"a":2}'), (2, FALSE, -1, 'none', '{"raw_evidence":"[1, 2]"}'), (3, FALSE, -1, 'none', '{"raw_evidence":""}'),
(4, FALSE, -1, 'none', '{"raw_evidence":"{broken"}'), (5, TRUE, -1, 'none', '{"a":null}')) SELECT doc_id, is_object, a::INT AS a, c, object FROM documents JOIN v ON doc_id % 6 = k"""),
    "json_lists": (json_lists, """SELECT doc_id, ([3, 1, 0, 1, 0, 0])[doc_id % 6 + 1]::INT AS n, '{"status":"fallback","reason":"no json","attempts":' || (doc_id % 4)::VARCHAR || '}' AS fallback FROM documents"""),
    "failover_records": (failover_records, """SELECT doc_id::VARCHAR AS record_key, CASE WHEN doc_id % 3 > 0 AND doc_id % 7 = 1 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN doc_id % 3 = 0 THEN 'small ' || lang WHEN doc_id % 7 <> 1 THEN 'large ' || lang END AS response,
  CASE WHEN doc_id % 3 > 0 AND doc_id % 7 = 1 THEN 'ValueError: no answer' END AS error, CASE WHEN doc_id % 3 > 0 AND doc_id % 7 = 1 THEN 2 ELSE 1 END::INT AS attempts FROM documents"""),
    "streamed_evaluation": (streamed_evaluation, "SELECT doc_id::VARCHAR AS record_key, 1::BIGINT AS records, lang AS response FROM documents WHERE doc_id % 10 > 0"),
    "streamed_changes": (streamed_changes, """WITH v AS (SELECT 'v' || label::VARCHAR AS video_id, vec_id AS ord, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), p AS (SELECT *, lag(e) OVER (PARTITION BY video_id ORDER BY ord) AS b FROM v)
SELECT video_id, ord, round(round(CASE WHEN b IS NULL THEN 0 ELSE 1 - least(greatest(list_inner_product(e, b) / sqrt(list_inner_product(e, e) * list_inner_product(b, b)), -1), 1) END, 6), 4) AS change_score FROM p"""),
}
