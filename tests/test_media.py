"""Media cells made here, and crops."""

import io
import struct
import wave

import numpy as np
from pyspark.sql import functions as F

from lumenfold.functions import crops
from lumenfold.operators import evidence
from lumenfold.sources import media

PNG = b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + struct.pack(">II", 640, 480)
JPEG = b"\xff\xd8\xff\xe0\x00\x10" + b"x" * 14 + b"\xff\xc0\x00\x11\x08" + struct.pack(">HH", 300, 200) + b"\x00" * 8


def wav(samples, rate=8000, channels=1):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.asarray(samples) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def test_image_headers(spark):
    cells = [PNG, JPEG, b"GIF89a" + struct.pack("<HH", 7, 9), b"BM" + b"\0" * 16 + struct.pack("<ii", 5, -6), b"RIFF1234WEBPVP8X" + b"\0" * 8 + b"\x0f\0\0\x1f\0\0", b"junk", b"", None]
    df = spark.createDataFrame([(i, None if c is None else bytearray(c)) for i, c in enumerate(cells)], "i int, content binary")
    got = [(r.width, r.height) for r in media.image_stats(df).orderBy("i").collect()]
    assert got == [(640, 480), (200, 300), (7, 9), (5, 6), (16, 32), (0, 0), (0, 0), (0, 0)]
    assert media.image_stats(df).orderBy("i").first().megapixels == 0.3072


def test_wav_cells(spark):
    tone = np.sin(np.arange(8000) / 20)
    df = spark.createDataFrame([("a", bytearray(wav(tone))), ("b", bytearray(wav(np.repeat(tone, 2), channels=2))), ("c", bytearray(b"no"))], "clip string, content binary")
    got = {r.clip: np.array(r.samples) for r in media.audio_samples(df, "clip").collect()}
    assert len(got["a"]) == 16000 and np.abs(got["a"][::2] - tone).max() < 1e-3 and np.abs(got["a"] - got["b"]).max() < 1e-3 and len(got["c"]) == 0
    assert media.sample_rows(media.audio_samples(df, "clip", rate=8000), "clip").count() == 16000


def test_payloads(spark):
    df = spark.range(1).select(media.payload(F.lit("p"), F.array(media.data_url(F.encode(F.lit("x" * 90), "UTF-8"), F.lit("image/png")), F.lit("u2"))).alias("p"))
    rows = df.select("p", media.degraded(F.col("p"), F.lit(1)).alias("one"), media.degraded(F.col("p"), F.lit(2)).alias("none")).first()
    assert [x.type for x in rows.p] == ["text", "image_url", "image_url"] and rows.p[1].url.startswith("data:image/png;base64,eHh4") and " " not in rows.p[1].url and "\n" not in rows.p[1].url
    assert (len(rows.one), len(rows.none)) == (2, 1)


def test_crops_and_counts(spark):
    row = spark.range(1).select(crops.image_crops(F.lit("the left or the right side"), F.lit(100), F.lit(50), F.lit(True)).alias("c"), crops.image_crops(F.lit("x"), F.lit(1), F.lit(1), F.lit(False)).alias("tiny")).first()
    assert [(c.label, list(c.box)) for c in row.c][:3] == [("right_side_detail", [45, 2, 100, 48]), ("left_side_detail", [0, 2, 55, 48]), ("center_detail", [18, 9, 82, 41])]
    assert len(row.c) == 7 and [list(c.box) for c in row.tiny] == [[0, 0, 1, 1]]
    logs = spark.createDataFrame([("a", 0, "HTTP 429"), ("a", 1, "ok"), ("a", 2, "Quota used"), ("b", 0, "fine")], "file string, ord int, value string")
    assert [tuple(r) for r in evidence.latest_quota_hits(logs).collect()] == [("a", 2, "Quota used")]
