"""Ordered operators over time: energy, events, boundaries, windows, coverage, nearest matches, suppression, peaks and tracks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lumenfold.functions.numbers import dot
from lumenfold.runtime import ship


def energy_profile(samples: DataFrame, key: str, index: str, value: str, window: int) -> DataFrame:
    """Root mean square of tumbling windows of samples; the last may be short."""
    return samples.groupBy(key, F.floor(F.col(index) / window).cast("bigint").alias("win")).agg(F.round(F.sqrt(F.avg(F.col(value).cast("double") * F.col(value))), 6).alias("rms"), F.count("*").alias("n"))


def energy_totals(profile: DataFrame, key: str) -> DataFrame:
    return profile.groupBy(key).agg(F.round(F.avg("rms"), 6).alias("rms_mean"), F.round(F.stddev_pop("rms"), 6).alias("rms_std"), F.round(F.max("rms"), 6).alias("rms_max"), F.count("*").alias("windows"))


def audio_events(profile: DataFrame, key: str, most: int = 8) -> DataFrame:
    """Windows of high energy (mean + std or more) or silence (a fifth of the mean or less), else the loudest; the most
    marked ones, numbered in time order."""
    by = Window.partitionBy(key)
    stats = profile.join(energy_totals(profile, key).select(key, "rms_mean", "rms_std"), key)
    high, low = F.col("rms_mean") + F.col("rms_std"), F.col("rms_mean") * 0.2
    kind = F.when((F.col("rms") >= high) & (F.col("rms") > 0), "high_energy").when(F.col("rms") <= low, "silence_or_pause")
    score = F.when(kind == "high_energy", F.col("rms") - high).when(kind == "silence_or_pause", low - F.col("rms"))
    marked = stats.select(key, "win", "rms", kind.alias("kind"), score.alias("score")).withColumn("any", F.count("kind").over(by))
    chosen = marked.where("kind IS NOT NULL OR any = 0").withColumns({"event_type": F.coalesce("kind", F.lit("representative_audio")), "score": F.round(F.coalesce("score", "rms"), 6)})
    top = chosen.withColumn("rank", F.row_number().over(by.orderBy(F.desc("score"), "win"))).where(F.col("rank") <= most)
    return top.select(key, F.row_number().over(by.orderBy("win")).alias("event"), "win", "event_type", "score", "rms")


def change_score(frames: DataFrame, key: str, ord_: str, vector: str) -> DataFrame:
    """One minus the dot product with the frame before, both normalised; 0 for the first and for zero vectors stays as it falls."""
    unit = F.sqrt(dot(F.col(vector), F.col(vector)))
    normal = frames.withColumns({"_v": F.col(vector), "_n": unit})
    order = Window.partitionBy(key).orderBy(ord_)
    before = normal.withColumns({"_pv": F.lag("_v").over(order), "_pn": F.lag("_n").over(order)})
    length = F.col("_n") * F.col("_pn")
    cosine = F.when(length > 0, dot(F.col("_v"), F.col("_pv")) / length).otherwise(0.0)
    return before.withColumn("change_score", F.round(F.when(F.col("_pv").isNull(), 0.0).otherwise(1 - F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0))), 6)).drop("_v", "_n", "_pv", "_pn")


def event_boundaries(frames: DataFrame, key: str, time: str, score: str, ord_: str, most: int) -> DataFrame:
    """The frames of the largest positive change, the earlier first among equals."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), ord_))
    return frames.where(F.col(score) > 0).withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def merge_windows(segments: DataFrame, key: str, start: str, end: str, pad: float, gap: float = 1.0, most: int = 12) -> DataFrame:
    """Padded windows, merged where the next begins within a gap of the last end: islands; the first of each key."""
    a = F.greatest(F.lit(0.0), F.col(start) - pad)
    padded = segments.select(key, a.alias("a"), F.greatest(a, F.col(end) + pad).alias("b"))
    order = Window.partitionBy(key).orderBy("a", "b")
    reach = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = padded.withColumn("new", F.when(reach.isNull() | (F.col("a") > reach + gap), 1).otherwise(0))
    islands = opened.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return islands.groupBy(key, "island").agg(F.round(F.min("a"), 3).alias("start_sec"), F.round(F.max("b"), 3).alias("end_sec"), F.count("*").alias("segments")).where(F.col("island") <= most)


def merge_short_segments(segments: DataFrame, key: str, ord_: str, start: str, end: str, shortest: float) -> DataFrame:
    """Segments shorter than a minimum fold into the one kept before; the first is always kept."""
    order = Window.partitionBy(key).orderBy(ord_)
    kept = segments.withColumn("_kept", F.when((F.row_number().over(order) == 1) | (F.col(end) - F.col(start) >= shortest), 1).otherwise(0))
    grouped = kept.withColumn("segment", F.sum("_kept").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return grouped.groupBy(key, "segment").agg(F.min_by(start, ord_).alias("start_sec"), F.max(end).alias("end_sec"), (F.count("*") - 1).alias("merged"))


def uniform_segments(videos: DataFrame, key: str, duration: str, every: float = 20.0, most: int = 12) -> DataFrame:
    """Equal parts of about `every` seconds, at most `most`."""
    n = F.least(F.lit(most), F.greatest(F.lit(1), F.ceil(F.col(duration) / every))).cast("int")
    parts = videos.where(F.col(duration) > 0).select(key, F.col(duration).alias("_d"), n.alias("_n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("part"))
    return parts.select(key, "part", F.round(F.col("_d") * F.col("part") / F.col("_n"), 3).alias("start_sec"), F.round(F.col("_d") * (F.col("part") + 1) / F.col("_n"), 3).alias("end_sec"))


def coverage_sample(rows: DataFrame, key: str, ord_: str, count: int) -> DataFrame:
    """Evenly spaced rows of each key: the positions round(i * (n - 1) / (count - 1)), halves to even; all if there are no more."""
    by = Window.partitionBy(key)
    placed = rows.withColumns({"_at": (F.row_number().over(by.orderBy(ord_)) - 1).cast("bigint"), "_n": F.count("*").over(by)})
    if count == 1:
        return placed.where("_at = 0").drop("_at", "_n")
    # position p is drawn if some i rounds to it: i is then one of the two around p * (count - 1) / (n - 1)
    i = F.col("_at") * (count - 1) / F.nullif(F.col("_n") - 1, F.lit(0))
    hits = lambda k: F.bround(k * (F.col("_n") - 1) / (count - 1)) == F.col("_at")
    drawn = (F.col("_n") <= count) | hits(F.floor(i)) | hits(F.ceil(i))
    return placed.where(drawn).drop("_at", "_n")


def nearest_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, right_ord: str) -> DataFrame:
    """Each left row with the right row of its key nearest in time, whatever the distance; the smallest ordinal among equals.

    A sort of both sides by key and time finds the neighbour before, and one in reverse the neighbour after: no pairs of a key
    are formed, and both frames run on from row to row (one that ends at a key's last row would be read anew for each).
    """
    names = [c for c in right.columns if c != key]
    once = right.groupBy(key, right_time).agg(F.min_by(F.struct(*names), right_ord).alias("_r"))
    a = left.select(key, F.struct(*left.columns).alias("_l"), F.lit(None).cast(once.schema["_r"].dataType).alias("_r"), F.col(left_time).cast("double").alias("_t"), F.lit(1).alias("_side"))
    b = once.select(key, F.lit(None).cast(a.schema["_l"].dataType).alias("_l"), "_r", F.col(right_time).cast("double").alias("_t"), F.lit(0).alias("_side"))
    latest = lambda *order: F.last("_r", True).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    both = a.unionByName(b).withColumns({"_before": latest("_t", "_side"), "_after": latest(F.desc("_t"), F.desc("_side"))}).where("_side = 1")
    away = lambda c: F.abs(F.col(f"{c}.{right_time}").cast("double") - F.col("_t"))
    second = F.col("_before").isNull() | (away("_after") < away("_before")) | ((away("_after") == away("_before")) & (F.col(f"_after.{right_ord}") < F.col(f"_before.{right_ord}")))
    best = F.when(second & F.col("_after").isNotNull(), F.col("_after")).otherwise(F.col("_before"))
    out = both.select("_l", best.alias("_r"))
    return out.select("_l.*", *(F.col(f"_r.{c}").alias(c if c not in left.columns else f"right_{c}") for c in names))


def overlap_join(items: DataFrame, scopes: DataFrame, key: str, start: str = "start_sec", end: str = "end_sec", scope_start: str = "scope_start", scope_end: str = "scope_end") -> DataFrame:
    """Items and scopes of one key whose closed intervals meet."""
    scopes = scopes.withColumnRenamed(key, "_key")
    return items.join(scopes, (F.col(key) == F.col("_key")) & (F.col(end) >= F.col(scope_start)) & (F.col(start) <= F.col(scope_end))).drop("_key")


def _folded(rows: DataFrame, keys: list[str], order: list[Column], schema: StructType, start: Callable) -> DataFrame:
    """A fold over the rows of each key in order. start() gives (take, end): take(row) and end() give output tuples after the keys.

    Rows are sorted by Spark, which spills, and come as a stream: a task holds one key's state and a batch, never a key's rows.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind, names, key, fold, out = None, schema.fieldNames(), None, None, []
        for batch in batches:
            kind = kind or [batch.schema.field(k).type for k in keys]
            for row in batch.to_pylist():
                own = tuple(row[k] for k in keys)
                if fold is None or own != key:
                    out += [(*key, *r) for r in fold[1]()] if fold else []
                    key, fold = own, start()
                out += [(*own, *r) for r in fold[0](row)]
            if out:
                yield pa.RecordBatch.from_pydict({n: [r[i] for r in out] for i, n in enumerate(names)}, schema=arrow)
                out = []
        if fold and (out := [(*key, *r) for r in fold[1]()]):
            yield pa.RecordBatch.from_pydict({n: [r[i] for r in out] for i, n in enumerate(names)}, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    ship(rows.sparkSession)
    arrow = to_arrow_schema(schema)
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _spaced(gap: float, most: int, row_of: Callable, alike: bool = False) -> Callable:
    """A fold that keeps a row if no kept one is within the gap (and alike), at most `most`."""

    def start() -> tuple[Callable, Callable]:
        kept: list[dict] = []

        def take(row: dict) -> list[tuple]:
            near = row["_t"] is not None and any(abs(k["_t"] - row["_t"]) < gap and (not alike or k["_l"] == row["_l"]) for k in kept)
            if len(kept) >= most or near or row["_t"] is None:
                return []
            kept.append(row)
            return [row_of(row)]

        return take, lambda: []

    return start


def _fields(rows: DataFrame, *names: str) -> StructType:
    return StructType([rows.schema[n] for n in names])


def suppress_near(items: DataFrame, key: str, time: str, score: str, ord_: str, gap: float, most: int, label: str | None = None) -> DataFrame:
    """Temporal suppression: best score first, dropping what lies within a gap of a kept item (of the same label), at most
    `most` by key; items without a time go."""
    rows = items.select(key, F.col(ord_), F.col(score).alias("_s"), F.col(time).cast("double").alias("_t"), (F.col(label) if label else F.lit(0)).alias("_l"))
    chosen = _folded(rows, [key], [F.desc("_s"), F.asc(ord_)], _fields(items, key, ord_), _spaced(gap, most, lambda r: (r[ord_],), label is not None))
    return items.join(chosen, [key, ord_], "left_semi")


def distinct_times(times: DataFrame, key: str, time: str, ord_: str, gap: float, most: int) -> DataFrame:
    """Times in input order, each kept if no kept one is within the gap."""
    rows = times.select(key, ord_, F.col(time).cast("double").alias("_t"))
    schema = StructType([*_fields(times, key, ord_).fields, StructField(time, DoubleType())])
    return _folded(rows, [key], [F.asc(ord_)], schema, _spaced(gap, most, lambda r: (r[ord_], r["_t"])))


def smoothed(signal: DataFrame, key: str, ord_: str, value: str) -> DataFrame:
    """The centred mean of three, with zeros beyond the ends, its neighbours, and the threshold mean + 0.4 std by key."""
    order, by = Window.partitionBy(key).orderBy(ord_), Window.partitionBy(key)
    beside = lambda n: F.coalesce(F.lag(value, n).over(order), F.lit(0.0))
    sm = signal.withColumn("sm", (beside(1) + F.col(value) + beside(-1)) / 3)
    return sm.withColumns({"i": F.row_number().over(order) - 1, "prev": F.lag("sm").over(order), "next": F.lead("sm").over(order), "threshold": F.avg("sm").over(by) + 0.4 * F.stddev_pop("sm").over(by)})


def motion_peaks(signal: DataFrame, key: str, ord_: str, value: str, spacing: int = 2) -> DataFrame:
    """Peaks of the smoothed signal over its threshold, greedily at least `spacing` apart: their number by key."""
    peak = (F.col("sm") > F.col("threshold")) & (F.col("sm") >= F.col("prev")) & (F.col("sm") > F.col("next"))
    marked = smoothed(signal, key, ord_, value)
    at = F.array_sort(F.collect_list(F.when(peak, F.col("i"))))
    start = F.struct(F.lit(-10).alias("last"), F.lit(0).alias("n"))
    fold = lambda acc, i: F.when(i - acc["last"] >= spacing, F.struct(i.alias("last"), (acc["n"] + 1).alias("n"))).otherwise(acc)
    return marked.groupBy(key).agg(F.count("*").alias("frames"), F.aggregate(at, start, fold, lambda a: a["n"]).cast("bigint").alias("peaks"))


def _overlap(a: tuple, b: tuple) -> float:
    """Intersection over union of two boxes."""
    both = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    either = max(0.0, a[2] - a[0]) * max(0.0, a[3] - a[1]) + max(0.0, b[2] - b[0]) * max(0.0, b[3] - b[1]) - both
    return both / either if either > 0 else 0.0


def object_tracks(detections: DataFrame, key: str = "video_id", least: float = 0.30) -> DataFrame:
    """Greedy tracks over detections (key, label, time_sec, ord, x1..y2, confidence): in time order each joins the track of its
    label whose last box overlaps it most, if by `least` or more, else begins one. Tracks never cross labels, so that each
    key and label is a fold of its own, whose state is its tracks; ids number a key's tracks by their first detection."""
    fields = "first_time double, last_time double, first_ord bigint, frames_seen bigint, confidence double"

    def start() -> tuple[Callable, Callable]:
        boxes: list[tuple] = []
        tracks: list[list] = []

        def take(d: dict) -> list[tuple]:
            box = (d["x1"], d["y1"], d["x2"], d["y2"])
            overlaps = [_overlap(b, box) for b in boxes]
            best = max(range(len(boxes)), key=overlaps.__getitem__, default=None)
            if best is None or overlaps[best] <= 0 or overlaps[best] < least:
                boxes.append(box)
                tracks.append([d["time_sec"], d["time_sec"], d["ord"], 1, d["confidence"]])
            else:
                boxes[best] = box
                first, _, ord_, seen, sure = tracks[best]
                tracks[best] = [first, d["time_sec"], ord_, seen + 1, round(max(sure, d["confidence"]), 4)]
            return []

        return take, lambda: [tuple(t) for t in tracks]

    numbers = {c: F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2", "time_sec")} | {"ord": F.col("ord").cast("bigint")}
    prepared = detections.withColumns({**numbers, "label": F.lower(F.coalesce("label", F.lit(""))), key: F.col(key).cast("string"), "confidence": F.coalesce(F.col("confidence").cast("double"), F.lit(0.0))})
    schema = StructType.fromDDL(f"{key} string, label string, {fields}")
    tracks = _folded(prepared.select(key, "label", *numbers, "confidence"), [key, "label"], [F.asc("time_sec"), F.asc("ord")], schema, start)
    number = F.row_number().over(Window.partitionBy(key).orderBy("first_time", "first_ord"))
    return tracks.withColumns({"track_id": F.concat(F.lit("T"), F.lpad(number.cast("string"), 2, "0")), "confirmed": F.col("frames_seen") >= 2})


def track_count(tracks: DataFrame, key: str = "video_id") -> DataFrame:
    """Confirmed tracks and the confidence of their number."""
    n = F.count_if("confirmed")
    return tracks.groupBy(key).agg(n.alias("count_value"), F.when(n > 0, F.round(F.least(F.lit(0.95), 0.35 + 0.12 * n), 3)).otherwise(0.0).alias("count_confidence"), F.count_if(~F.col("confirmed")).alias("uncertain"))


def select_frames(frames: DataFrame, most: int, key: str = "video_id") -> DataFrame:
    """At most `most` frames (key, ord) of each video: both ends, the `most // 3` largest changes between them, and an even grid of
    what is left of `most`; with fewer than three, the first or both ends. Windows place the rows, none is gathered."""
    order, by = Window.partitionBy(key).orderBy("ord"), Window.partitionBy(key)
    placed = frames.select(F.col(key).cast("string").alias(key), F.col("ord").cast("bigint").alias("ord"), F.col("change_score").cast("double").alias("_c"))
    placed = placed.withColumns({"_at": F.row_number().over(order) - 1, "_n": F.count("*").over(by)})
    end = (F.col("_at") == 0) | (F.lit(most > 1) & (F.col("_at") == F.col("_n") - 1))
    inner = ~((F.col("_at") == 0) | (F.col("_at") == F.col("_n") - 1))
    largest, grid = most // 3, most - 2 - most // 3
    turn = F.row_number().over(Window.partitionBy(key, inner).orderBy(F.desc("_c"), "_at"))
    spot = F.floor(F.col("_at") * (grid + 1) / (F.col("_n") - 1))
    hits = lambda j: (j >= 1) & (j <= grid) & (F.bround(j * ((F.col("_n") - 1) / (grid + 1))) == F.col("_at"))
    even = hits(spot) | hits(spot + 1) if grid > 0 else F.lit(False)
    chosen = placed.withColumn("_turn", turn).where((F.col("_n") <= most) | end | (inner & (F.lit(most > 2) & ((F.col("_turn") <= largest) | even))))
    return chosen.select(key, "ord")


def time_points(windows: DataFrame, start: str = "start_sec", end: str = "end_sec") -> DataFrame:
    """Before, during and after points of each window."""
    a, b = F.col(start), F.col(end)
    points = F.array(F.struct(F.lit("before").alias("role"), a.alias("time_sec")), F.struct(F.lit("during").alias("role"), ((a + b) / 2).alias("time_sec")), F.struct(F.lit("after").alias("role"), b.alias("time_sec")))
    return windows.select(*windows.columns, F.explode(points).alias("_p")).select(*windows.columns, "_p.role", F.round("_p.time_sec", 3).alias("time_sec"))


def _spectra(x: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean log magnitude, RMS and the five strongest frequencies of clips of one length, a row each."""
    padded = np.pad(x, ((0, 0), (0, max(0, 1024 - x.shape[1]))))
    frames = np.lib.stride_tricks.sliding_window_view(padded, 1024, axis=1)[:, ::512] * np.hanning(1024)
    magnitude = np.abs(np.fft.rfft(frames, axis=2))
    mean = magnitude.mean(axis=1)
    mean[np.isnan(mean)] = -1.0  # after all others
    top, row = np.empty((len(x), 5)), np.arange(len(x))
    for k in range(5):  # argmax takes the lowest frequency among equals
        at = mean.argmax(axis=1)
        top[:, k] = at * rate / 1024
        mean[row, at] = -np.inf
    rms = np.sqrt((x**2).mean(axis=1)) if x.shape[1] else np.zeros(len(x))
    return np.log1p(magnitude).reshape(len(x), -1).mean(axis=1), rms, top


#: Samples that are transformed at once: 4 MB, which with their frames and spectra stays near the processor.
CHUNK = 1 << 19


def spectrum_summary(clips: DataFrame, samples: str = "samples", rate: float = 16000.0) -> DataFrame:
    """clip_id with mean log magnitude, RMS and the five strongest frequencies of a Hann short-time spectrum (1024 by 512).

    Samples come as Arrow arrays, never as Python objects; neighbours of one length are transformed together, CHUNK samples at
    a time at most, or one clip if it is longer.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = StructType.fromDDL("clip_id string, log_magnitude double, rms double, top_hz array<double>")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            clips, cells = batch.columns
            lengths = cells.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = cells.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null samples as NaN, null clips without samples
            ends, a = np.cumsum(lengths), 0
            changes = np.append(np.flatnonzero(np.diff(lengths)) + 1, len(lengths))
            while a < len(lengths):
                own = int(lengths[a])
                b = min(int(changes[np.searchsorted(changes, a, side="right")]), a + max(1, CHUNK // max(own, 1024)))
                x = flat[ends[a] - own : ends[b - 1]].reshape(b - a, own)
                logs, rms, top = _spectra(x, rate)
                hz = pa.ListArray.from_arrays(pa.array(np.arange(0, 5 * (b - a) + 1, 5, dtype=np.int32)), pa.array(top.ravel()))
                yield pa.RecordBatch.from_arrays([clips.slice(a, b - a).cast(pa.string()), pa.array(logs), pa.array(rms), hz.cast(arrow.field("top_hz").type)], schema=arrow)
                a = b

    ship(clips.sparkSession)
    return clips.select(F.col("clip_id").cast("string").alias("clip_id"), samples).mapInArrow(run, schema)
