"""Media cells without codec libraries: image sizes from headers, WAV samples, resampling and data URLs."""

from __future__ import annotations

import io
import struct
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.runtime import ship


def image_size(data: bytes | None) -> tuple[int, int]:
    """Width and height in a PNG, GIF, BMP, WebP or JPEG header; zeros if there is none."""
    d = data or b""
    if d[:8] == b"\x89PNG\r\n\x1a\n" and len(d) >= 24:
        return struct.unpack(">II", d[16:24])
    if d[:4] == b"GIF8" and len(d) >= 10:
        return struct.unpack("<HH", d[6:10])
    if d[:2] == b"BM" and len(d) >= 26:
        w, h = struct.unpack("<ii", d[18:26])
        return w, abs(h)
    if d[:4] == b"RIFF" and d[8:12] == b"WEBP" and len(d) >= 30:
        if d[12:16] == b"VP8X":
            return 1 + int.from_bytes(d[24:27], "little"), 1 + int.from_bytes(d[27:30], "little")
        if d[12:16] == b"VP8 ":
            w, h = struct.unpack("<HH", d[26:30])
            return w & 0x3FFF, h & 0x3FFF
        if d[12:16] == b"VP8L":
            bits = int.from_bytes(d[21:25], "little")
            return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
    if d[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(d) and d[at] == 0xFF:
            marker, length = d[at + 1], int.from_bytes(d[at + 2 : at + 4], "big")
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", d[at + 5 : at + 9])
                return w, h
            at += 2 + length
    return 0, 0


def image_stats(rows: DataFrame, content: str = "content") -> DataFrame:
    """rows with width, height, bytes and megapixels of an image cell."""
    ship(rows.sparkSession)

    @F.pandas_udf("width int, height int")
    def sized(cells: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in cells:
            yield pd.DataFrame([image_size(c) for c in batch], columns=["width", "height"])

    out = rows.withColumn("_size", sized(F.col(content)))
    out = out.withColumns({"width": F.col("_size.width"), "height": F.col("_size.height"), "bytes": F.coalesce(F.octet_length(content), F.lit(0))}).drop("_size")
    return out.withColumn("megapixels", F.round(F.col("width") * F.col("height") / 1_000_000, 4))


def _boxes(d: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Kind, begin and end of the content of each box of an ISO media file."""
    while at + 8 <= end:
        size, kind, head = int.from_bytes(d[at : at + 4], "big"), d[at + 4 : at + 8], 8
        if size == 1:
            size, head = int.from_bytes(d[at + 8 : at + 16], "big"), 16
        size = size or end - at
        if size < head:
            return
        yield kind, at + head, min(end, at + size)
        at += size


def video_header(data: bytes | None) -> tuple[int, int, float]:
    """Width, height and seconds in the headers of an MP4 file; zeros for what isn't there."""
    d, width, height, seconds = data or b"", 0, 0, 0.0
    number = lambda at, n: int.from_bytes(d[at : at + n], "big")
    for kind, a, b in _boxes(d, 0, len(d)):
        if kind != b"moov":
            continue
        for inner, c, e in _boxes(d, a, b):
            long = 8 if d[c : c + 1] == b"\x01" else 4  # version 1 has times of 8 bytes
            if inner == b"mvhd" and e - c >= 8 + 3 * long:
                scale = number(c + 4 + 2 * long, 4)
                seconds = number(c + 8 + 2 * long, long) / scale if scale else 0.0
            for track, f, g in _boxes(d, c, e) if inner == b"trak" else ():
                if track == b"tkhd" and g - f >= 84 and number(g - 8, 4):  # sizes are the last two fields, in 16.16
                    width, height = max(width, number(g - 8, 4) >> 16), max(height, number(g - 4, 4) >> 16)
    return width, height, seconds


def video_stats(rows: DataFrame, content: str = "content") -> DataFrame:
    """rows with width, height and duration_sec of a video cell."""
    ship(rows.sparkSession)

    @F.pandas_udf("width int, height int, duration_sec double")
    def probed(cells: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in cells:
            yield pd.DataFrame([video_header(c) for c in batch], columns=["width", "height", "duration_sec"])

    out = rows.withColumn("_header", probed(F.col(content)))
    return out.withColumns({c: F.col(f"_header.{c}") for c in ("width", "height", "duration_sec")}).drop("_header")


def wav_samples(data: bytes | None, rate: int) -> np.ndarray:
    """Mono samples in [-1, 1] at a rate, of a PCM WAV cell of 8, 16, 24 or 32 bits; nothing if it can't be read."""
    try:
        with wave.open(io.BytesIO(data or b"")) as w:
            width, channels, own, raw = w.getsampwidth(), w.getnchannels(), w.getframerate(), w.readframes(w.getnframes())
    except (wave.Error, EOFError):
        return np.zeros(0, np.float32)
    if width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = (b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) / 2.0**31
    else:
        x = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128 if width == 1 else np.frombuffer(raw, f"<i{width}") / 2.0 ** (8 * width - 1)
    return resample(x.reshape(-1, channels).mean(axis=1), own, rate)


def resample(x: np.ndarray, own: int, rate: int) -> np.ndarray:
    """Linear interpolation on even grids that begin together."""
    if not len(x) or own <= 0 or own == rate:
        return x.astype(np.float32)
    duration = len(x) / own
    at = np.linspace(0.0, duration, num=max(1, round(duration * rate)), endpoint=False)
    return np.interp(at, np.linspace(0.0, duration, num=len(x), endpoint=False), x).astype(np.float32)


def audio_samples(rows: DataFrame, key: str, content: str = "content", rate: int = 16000) -> DataFrame:
    """key and samples of WAV cells."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "samples": [wav_samples(c, rate) for c in pdf[content]]})

    return rows.select(F.col(key).cast("string").alias(key), content).mapInPandas(run, f"{key} string, samples array<float>")


def sample_rows(clips: DataFrame, key: str) -> DataFrame:
    """A row (key, i, x) of each sample, as the energy profile takes them."""
    return clips.select(key, F.posexplode("samples").alias("i", "x"))


def data_url(content: Column, mime: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.regexp_replace(F.base64(content), r"\s+", ""))


def payload(text: Column, images: Column) -> Column:
    """Array of (type, text, url): the prompt, then the media in order."""
    item = lambda kind, t, u: F.struct(F.lit(kind).alias("type"), t.cast("string").alias("text"), u.cast("string").alias("url"))
    return F.concat(F.array(item("text", text, F.lit(None))), F.transform(images, lambda u: item("image_url", F.lit(None), u)))


def degraded(payload_: Column, level: Column) -> Column:
    """The payload at a level: 0 in full, 1 the text and the first medium, 2 the text."""
    return F.when(level <= 0, payload_).when(level == 1, F.slice(payload_, 1, 2)).otherwise(F.slice(payload_, 1, 1))
