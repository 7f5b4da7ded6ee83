"""Readers, adapters, sinks and the micro-batch runner on files made here."""

import base64
import json
import zipfile

from pyspark.sql import functions as F

from lumenfold.sources import adapters, archives, records
from lumenfold.streaming import runner


def lines(path, rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))


def test_records_skip_malformed_lines(spark, tmp_path):
    lines(tmp_path / "a.jsonl", [{"record_key": "k1", "status": "failed"}, "{broken", {"record_key": "k1", "status": "completed", "correct": True}, ""])
    lines(tmp_path / "b.jsonl", [{"record_key": "k2", "status": "started"}, {"status": "completed"}])
    rows = records.read_records(spark, [f"{tmp_path}/a.jsonl", f"{tmp_path}/b.jsonl"])
    assert rows.count() == 4 and rows.where("file LIKE '%b.jsonl'").count() == 2
    assert [r.record_key for r in records.done_keys(spark, str(tmp_path)).collect()] == ["k1"]
    assert "raw_response" not in records.slim(rows).columns


def test_keys_and_parts(spark, tmp_path):
    (tmp_path / "keys.txt").write_text("  k3 k1\n\nk2\n")
    assert [(r.record_key, r.position) for r in records.read_keys(spark, f"{tmp_path}/keys.txt").orderBy("position").collect()] == [("k3", 0), ("k1", 1), ("k2", 2)]
    for name, rows in (("r_part10.json", [{"x": 3}]), ("r_part2.json", [{"x": 1}, {"x": 2}]), ("r_other.json", [{"x": 4}])):
        (tmp_path / name).write_text(json.dumps(rows))
    merged = records.read_parts(spark, f"{tmp_path}/*.json").orderBy(F.asc_nulls_last("part"), "x").collect()
    assert [(r.x, r.part) for r in merged] == [(1, 2), (2, 2), (3, 10), (4, None)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("k", 1)], "record_key string, n int")
    records.append_records(df, f"{tmp_path}/log")
    records.append_records(df, f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log").count() == 2
    records.write_summary(df, df, f"{tmp_path}/s")
    records.write_summary(df, df, f"{tmp_path}/s")
    assert spark.read.json(f"{tmp_path}/s/summary").count() == 1
    records.write_report(df.withColumn("t", F.lit("<b>")), f"{tmp_path}/r")
    assert "&lt;b&gt;" in spark.read.text(f"{tmp_path}/r/html").first()[0]
    files = spark.createDataFrame([("a.JSONL",), ("b.mp4",), ("c.txt",)], "path string")
    assert [r[0] for r in files.select(records.file_class()).collect()] == ["slim", "skip", "copy"]


def test_archives(spark, tmp_path):
    for n, members in ((0, {"d/a.mp4": b"old", "b.mp4": b"", "x.txt": b"t"}), (1, {"a.mp4": b"newer", "c.MP4": b"c"})):
        with zipfile.ZipFile(tmp_path / f"videos_{n}.zip", "w") as z:
            for name, data in members.items():
                z.writestr(name, data)
    (tmp_path / "bad.zip").write_bytes(b"no zip")
    members = archives.archive_members(spark, str(tmp_path))
    assert sorted((r.stem, r.size) for r in members.collect()) == [("a", 5), ("c", 1)]
    assert {r.stem: bytes(r.content) for r in archives.member_bytes(spark, str(tmp_path), members).collect()} == {"a": b"newer", "c": b"c"}


def test_subtitles(spark, tmp_path):
    (tmp_path / "v1.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\nHi\n\n2\n00:00:02,000 --> 00:00:03,000\nthere")
    (tmp_path / "v2.srt").write_text("")
    rows = archives.transcript(archives.subtitle_files(spark, str(tmp_path)))
    assert [(r.stem, r.anchor_link, r.text) for r in rows.orderBy("sequence_index").collect()] == [("v1", "v1_seg_0001", "Hi"), ("v1", "v1_seg_0002", "there")]
    other = rows.limit(1).withColumn("text", F.lit("asr")).unionByName(rows.limit(1).withColumns({"stem": F.lit("v3"), "text": F.lit("asr")}))
    assert sorted((r.stem, r.text) for r in archives.first_source([rows, other]).collect()) == [("v1", "Hi"), ("v1", "there"), ("v3", "asr")]


def test_adapters(spark):
    rows = spark.createDataFrame([("v", 0, "q?", ["x", "y"], "y"), ("v", 1, "q?", ["x"], "z")], "video_id string, ord int, question string, candidates array<string>, answer string")
    (got,) = adapters.from_candidates(rows, "set", "causal").collect()
    assert (got.question_id, got.options, got.answer) == ("v_0", ["A. x", "B. y"], "B")
    asked = spark.createDataFrame([("What?\nA. up\nB. down", "down"), ("What?\nA. up\nB. down", "A. up"), ("What?\nA. up", "A."), ("What?\nA. up\nB. down", "left")], "question string, answer string")
    assert [(r.stem, r.letter, len(r.options)) for r in adapters.from_option_lines(asked).collect()] == [("What?", "B", 2), ("What?", "A", 2)]
    chat = rows.select(adapters.chat_row(F.col("question"), F.col("candidates"), F.col("answer"), F.lit("i.png")).alias("c")).select("c.*")
    assert chat.select(adapters.assistant_text(F.col("messages"))).first()[0] == "y" and "x\ny" in chat.first().messages[0].content
    png = base64.b64encode(b"\x89PNG\r\n\x1a\nrest").decode()
    images = spark.createDataFrame([(png,), (base64.b64encode(b"\xff\xd8\xffx").decode(),), ("***",), (None,)], "b string").select(adapters.decoded_image(F.col("b")).alias("i")).select("i.*").collect()
    assert [(r.extension, r.ok) for r in images] == [("png", True), ("jpg", True), ("jpg", False), ("jpg", False)]
    files = spark.createDataFrame([("a", ".png", "a.png"), ("a", ".jpg", "a.jpg"), ("b", ".gif", "b.gif")], "stem string, extension string, path string")
    assert [(r.stem, r.path) for r in adapters.existing_extension(files.select("stem").distinct(), files, "stem").collect()] == [("a", "a.jpg")]


def answer(item, budget):
    n = int(item["record_key"][1:])
    if n == 3 or (n == 2 and budget < 1000):
        raise ValueError("no")
    return f"r{n}"


def test_stage_keeps_failures_as_records(spark):
    items = spark.createDataFrame([(f"k{i}",) for i in range(4)], "record_key string")
    got = {r.record_key: (r.status, r.response, r.error, r.attempts) for r in runner.stage(items, answer).collect()}
    assert got == {"k0": ("completed", "r0", None, 1), "k1": ("completed", "r1", None, 1), "k2": ("completed", "r2", None, 2), "k3": ("failed", None, "ValueError: no", 3)}


def test_failover_drops_dead_models():
    calls = []

    def first(item, budget):
        calls.append("first")
        raise RuntimeError("quota")

    tried = runner.with_failover([first, lambda i, b: "second"], dead=lambda e: "quota" in str(e))
    assert [tried({}, 1), tried({}, 1)] == ["second", "second"] and calls == ["first"]


def test_micro_batches_resume(spark, tmp_path):
    source, sink = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    for n in range(3):
        lines(source / f"{n}.json", [{"record_key": f"k{i}"} for i in range(n * 10, n * 10 + 12)])
    sink.mkdir()
    lines(sink / "before.json", [{"record_key": "k5", "status": "completed"}, {"record_key": "k7", "status": "failed"}])
    run = lambda c: runner.evaluate(spark, str(source), "record_key string", str(sink), str(tmp_path / c), answer).awaitTermination()
    run("check")
    done = spark.read.schema(runner.RESULT).json(str(sink)).where("status = 'completed'")
    assert done.count() == done.select("record_key").distinct().count() == 31  # all of k0 to k31 but k3
    run("check")
    run("lost")
    again = spark.read.schema(runner.RESULT).json(str(sink)).where("status = 'completed'")
    assert again.count() == 31


def test_change_stream_equals_batch(spark, tmp_path):
    from lumenfold.operators.timeline import change_score

    rows = [("v", i, [float(i % 3), 1.0]) for i in range(6)]
    lines(tmp_path / "f.json", [{"video_id": v, "ord": o, "feature": f} for v, o, f in rows])
    stream = spark.readStream.schema("video_id string, ord bigint, feature array<double>").json(str(tmp_path))
    runner.change_stream(stream).writeStream.format("memory").queryName("changes").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = {r.ord: r.change_score for r in spark.table("changes").collect()}
    batch = change_score(spark.createDataFrame(rows, "video_id string, ord bigint, feature array<double>"), "video_id", "ord", "feature")
    assert got == {r.ord: r.change_score for r in batch.collect()}


def test_run_status(spark):
    rows = spark.createDataFrame([("a", 0, "failed"), ("a", 1, "completed"), ("b", 2, "failed"), ("c", 3, "started")], "record_key string, ord int, status string")
    assert tuple(runner.run_status(rows).first()) == (3, 1, 1, 1)
