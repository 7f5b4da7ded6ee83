"""What plans of ordered operators must not have, and edge cases of readers of headers and references."""

import html

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.functions.text import unescaped
from lumenfold.operators import sampling, timeline
from lumenfold.plans import catalog
from lumenfold.sources import media, records
from lumenfold.streaming import runner


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def items(spark):
    return spark.range(400).select(F.concat(F.lit("v"), (F.col("id") % 3).cast("string")).alias("video_id"), F.col("id").alias("ord"), (F.col("id") * 7 % 400).cast("double").alias("t"), (F.col("id") * 13 % 101).cast("double").alias("s"))


def test_suppression_streams_sorted_rows(spark, items):
    for df in (timeline.suppress_near(items, "video_id", "t", "s", "ord", 20.0, 5), timeline.distinct_times(items, "video_id", "t", "ord", 30.0, 6)):
        text = plan(df)
        assert "MapInArrow" in text and "Sort" in text and "collect_list" not in text
    rows = sorted(items.collect(), key=lambda r: (r.video_id, -r.s, r.ord))
    want, kept = set(), {}
    for r in rows:
        own = kept.setdefault(r.video_id, [])
        if len(own) < 5 and all(abs(k.t - r.t) >= 20 for k in own):
            own.append(r)
            want.add((r.video_id, r.ord))
    assert {(r.video_id, r.ord) for r in timeline.suppress_near(items, "video_id", "t", "s", "ord", 20.0, 5).collect()} == want
    assert timeline.suppress_near(items.limit(0), "video_id", "t", "s", "ord", 20.0, 5).count() == 0


def test_folds_take_nulls_and_empty_tables(spark):
    rows = spark.createDataFrame([(None, 1, 5.0, 1.0), (None, 2, None, 2.0), ("a", 3, 1.0, None), ("a", 4, 50.0, 3.0)], "video_id string, ord bigint, t double, s double")
    got = {(r.video_id, r.ord) for r in timeline.distinct_times(rows, "video_id", "t", "ord", 10.0, 9).collect()}
    assert got == {(None, 1), ("a", 3), ("a", 4)}
    boxes = rows.withColumns({c: F.lit(v) for c, v in (("x1", 0.0), ("y1", 0.0), ("x2", 1.0), ("y2", 1.0), ("confidence", 0.5))} | {"label": F.lit(None).cast("string"), "time_sec": F.col("t")})
    assert sorted((r.video_id or "", r.frames_seen) for r in timeline.object_tracks(boxes).collect()) == [("", 2), ("a", 2)]
    assert timeline.object_tracks(boxes.limit(0)).count() == 0


def test_nearest_join_reads_no_frame_anew_for_each_row(spark):
    left = [(k, 10 * n + i, None if i == 7 else float(i * 5 % 13)) for n, k in enumerate(("a", "b", "c")) for i in range(9)]
    right = [("a", i, float(i * 3 % 11)) for i in range(40)] + [("a", 50, None), ("b", 60, 6.0)]
    df = timeline.nearest_join(spark.createDataFrame(left, "k string, probe int, t double"), spark.createDataFrame(right, "k string, ord int, time_sec double"), "k", "t", "time_sec", "ord")
    assert "unboundedfollowing" not in plan(df).lower()
    got = {r.probe: r.ord for r in df.where("t IS NOT NULL").collect()}
    best = lambda k, t: min(((abs(x - t), o) for kk, o, x in right if kk == k and x is not None), default=(0, None))[1]
    assert got == {p: best(k, t) for k, p, t in left if t is not None}


def test_spectra_stay_arrays_and_parts_are_dealt(spark):
    draw = np.random.default_rng(5)
    cells = [draw.normal(size=n).tolist() for n in (0, 300, 1024, 1500, 1500, 1600, 2048)] + [None, [1.0, None, 2.0], [0.0] * 1100] + [draw.normal(size=1100).tolist() for _ in range(600)]
    clips = spark.createDataFrame([(f"c{i}", c) for i, c in enumerate(cells)], "clip_id string, samples array<double>").coalesce(1)
    df = timeline.spectrum_summary(clips)
    assert "MapInArrow" in plan(df) and "MapInPandas" not in plan(df)
    got = {r.clip_id: r for r in df.collect()}
    assert len(got) == len(cells)
    for i, c in enumerate(cells):
        x = np.asarray([] if c is None else c, dtype=np.float64)
        frames = np.lib.stride_tricks.sliding_window_view(np.pad(x, (0, max(0, 1024 - len(x)))), 1024)[::512] * np.hanning(1024)
        magnitude = np.abs(np.fft.rfft(frames, axis=1))
        r = got[f"c{i}"]
        assert r.top_hz == (np.argsort(-magnitude.mean(axis=0), kind="stable")[:5] * 16000.0 / 1024).tolist()
        assert np.allclose([r.log_magnitude, r.rms], [np.log1p(magnitude).mean(), np.sqrt((x**2).mean()) if len(x) else 0.0], equal_nan=True)
    assert "hashpartitioning(p_partkey" in plan(catalog.queries()["audio_spectrum"](spark, "/root/testdata/sf0.001"))


def test_key_lists_of_many_files_and_splits_are_numbered_without_a_sort(spark, tmp_path):
    texts = {"a": "k0\n", "b": "".join(f" b{i}\tc{i}\n" + "\n" * (i % 3) for i in range(900)), "c": "", "d": "d0 d1\n\n  d2\n"}
    for name, text in texts.items():
        (tmp_path / f"{name}.txt").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        df = records.read_keys(spark, str(tmp_path))
        assert "row_number" not in plan(df)
        got = sorted((r.position, r.record_key) for r in df.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == list(enumerate(" ".join(texts.values()).split()))


def test_shards_are_even_and_number_no_whole_group(spark, items):
    dealt = sampling.shards(items, "video_id", "ord", 4)
    counts = dealt.groupBy("video_id", "shard").count().collect()
    for video in ("v0", "v1", "v2"):
        own = [r["count"] for r in counts if r.video_id == video]
        assert len(own) == 4 and max(own) - min(own) <= 1
    assert dealt.columns == [*items.columns, "shard"] and dealt.count() == 400
    assert all("_part" in line for line in plan(dealt).split("\n") if "row_number" in line)


def test_character_references_equal_the_standard_library(spark):
    texts = ["&eacute;&#8217;&#x41; &amp;lt; &", "&bogus; &#0; &#xD800; &#1114112; &#146;", "a&b;c &nbsp;&copy; &#39;&apos;&quot;", "none", "&;&#;&#x;", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", unescaped(F.col("t")).alias("u")).collect()
    assert {r.i: r.u for r in rows} == {i: t if t is None else html.unescape(t) for i, t in enumerate(texts)}


def test_video_headers_that_are_cut_or_broken():
    box = lambda kind, body: (len(body) + 8).to_bytes(4, "big") + kind + body
    tkhd = box(b"tkhd", bytes(76) + (640 << 16).to_bytes(4, "big") + (360 << 16).to_bytes(4, "big"))
    mvhd = box(b"mvhd", b"\x01" + bytes(19) + (1000).to_bytes(4, "big") + (2500).to_bytes(8, "big") + bytes(80))
    whole = box(b"ftyp", b"isom") + box(b"moov", mvhd + box(b"trak", tkhd))
    assert media.video_header(whole) == (640, 360, 2.5)
    assert media.video_header(None) == media.video_header(b"\x00" * 40) == media.video_header(whole[:30]) == (0, 0, 0.0)


def test_a_batch_of_the_stream_does_not_read_the_sink(spark, tmp_path):
    answer = lambda item, tokens: item["x"]
    source, sink = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.createDataFrame([("a", "1"), ("b", "2")], "record_key string, x string").write.json(source)
    spark.createDataFrame([("a", "completed", "0", None, 1)], runner.RESULT).write.json(sink)
    query = runner.evaluate(spark, source, "record_key string, x string", sink, f"{tmp_path}/state", answer)
    query.awaitTermination()
    assert sorted((r.record_key, r.response) for r in spark.read.schema(runner.RESULT).json(sink).collect()) == [("a", "0"), ("b", "2")]
    spark.createDataFrame([("b", "3"), ("c", "4")], "record_key string, x string").write.mode("append").json(source)
    runner.evaluate(spark, source, "record_key string, x string", sink, f"{tmp_path}/state", answer).awaitTermination()
    assert sorted((r.record_key, r.response) for r in spark.read.schema(runner.RESULT).json(sink).collect()) == [("a", "0"), ("b", "2"), ("c", "4")]


def test_the_stream_keeps_finished_keys_by_bucket(spark, tmp_path):
    source, sink = f"{tmp_path}/in", f"{tmp_path}/out"

    def answer(item, tokens):
        if item["x"] == "bad":
            raise ValueError("no answer")
        return ",".join(sorted(item)) + item["x"]

    keys = [f"k{i}" for i in range(30)] + [None]
    for rows in ([(k, "bad" if k == "k3" else "1") for k in keys + keys], [(k, "2") for k in [*keys, "new"]]):
        spark.createDataFrame(rows, "record_key string, x string").coalesce(1).write.mode("append").json(source)
        query = runner.evaluate(spark, source, "record_key string, x string", sink, f"{tmp_path}/state", answer, buckets=2)
        query.awaitTermination()
    got = [(r.record_key, r.status, r.response) for r in spark.read.schema(runner.RESULT).json(sink).collect()]
    fields = "record_key,x"
    want = [(k, "completed", fields + "1") for k in keys if k != "k3"] + [("k3", "failed", None), ("k3", "completed", fields + "2"), ("new", "completed", fields + "2")]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2
