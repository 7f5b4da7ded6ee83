"""Queries over time: energy, events, changes, windows, coverage, nearest matches, retrieval, votes, units, audits and tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.functions.text import query_terms
from lumenfold.operators import evidence, retrieval, timeline
from lumenfold.plans.standins import FRAMES, SEGMENTS, frames, segments, sql_list, table
from lumenfold.streaming.runner import stage

WORDS = ("the", "and", "with", "that", "tion", "ververst", "which")
STOP = ("query", "the", "and", "with", "that", "which")


def energy_profile(spark, sf_dir):
    return timeline.energy_profile(frames(spark, sf_dir), "video_id", "time_sec", "score", 3600)


def energy_totals(spark, sf_dir):
    return timeline.energy_totals(energy_profile(spark, sf_dir), "video_id").withColumns({c: F.round(c, 4) for c in ("rms_mean", "rms_std", "rms_max")})


_PROFILE = f"""{FRAMES}, profile AS (SELECT video_id, floor(time_sec / 3600)::BIGINT AS win, round(sqrt(avg(score * score)), 6) AS rms, count(*) AS n FROM frames GROUP BY 1, 2),
stats AS (SELECT video_id, round(avg(rms), 6) AS rms_mean, round(stddev_pop(rms), 6) AS rms_std, round(max(rms), 6) AS rms_max, count(*) AS windows FROM profile GROUP BY 1)"""


def audio_events(spark, sf_dir):
    return timeline.audio_events(energy_profile(spark, sf_dir), "video_id", 4).withColumn("score", F.round("score", 4))


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.concat(F.lit("v"), F.col("label").cast("string")).alias("video_id"), F.col("vec_id").alias("ord"), "embedding")


def change_score(spark, sf_dir):
    return timeline.change_score(_vectors(spark, sf_dir), "video_id", "ord", "embedding").select("video_id", "ord", F.round("change_score", 4).alias("change_score"))


def event_boundaries(spark, sf_dir):
    return timeline.event_boundaries(frames(spark, sf_dir), "video_id", "time_sec", "score", "ord", 12)


def merge_windows(spark, sf_dir):
    return timeline.merge_windows(segments(spark, sf_dir), "video_id", "start_sec", "end_sec", 0.25)


def merge_short(spark, sf_dir):
    return timeline.merge_short_segments(segments(spark, sf_dir), "video_id", "ord", "start_sec", "end_sec", 1.2)


def uniform_segments(spark, sf_dir):
    return timeline.uniform_segments(table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 7.5).alias("d")), "p_partkey", "d")


def coverage_sample(spark, sf_dir):
    return timeline.coverage_sample(frames(spark, sf_dir).select("video_id", "ord"), "video_id", "ord", 7)


def nearest_join(spark, sf_dir):
    """Each click with the nearest frame of any other kind."""
    f = frames(spark, sf_dir)
    probes = f.where("label = 'click'").select("video_id", F.col("ord").alias("probe"), (F.col("time_sec") + 0.5).alias("t"))
    return timeline.nearest_join(probes, f.where("label <> 'click'").select("video_id", "ord", "time_sec"), "video_id", "t", "time_sec", "ord").select("video_id", "probe", "ord", F.abs(F.col("time_sec") - F.col("t")).alias("delta"))


def scope_overlap(spark, sf_dir):
    s = segments(spark, sf_dir)
    scopes = s.groupBy("video_id").agg((F.max("end_sec") * 0.25).alias("scope_start"), (F.max("end_sec") * 0.5).alias("scope_end"))
    return timeline.overlap_join(s.select("video_id", "ord", "start_sec", "end_sec"), scopes, "video_id").select("video_id", "ord", "start_sec", "end_sec")


def suppress_near(spark, sf_dir):
    return timeline.suppress_near(frames(spark, sf_dir), "video_id", "time_sec", "score", "ord", 600.0, 12).select("video_id", "ord", "time_sec")


def suppress_alike(spark, sf_dir):
    return timeline.suppress_near(frames(spark, sf_dir), "video_id", "time_sec", "score", "ord", 900.0, 12, "label").select("video_id", "ord", "label")


def distinct_times(spark, sf_dir):
    return timeline.distinct_times(frames(spark, sf_dir), "video_id", "time_sec", "ord", 1200.0, 16)


def motion_peaks(spark, sf_dir):
    return timeline.motion_peaks(frames(spark, sf_dir).withColumn("k", F.round("score", 2)), "video_id", "ord", "k")


def time_points(spark, sf_dir):
    return timeline.time_points(segments(spark, sf_dir).select("video_id", "ord", "start_sec", "end_sec"))


def _detections(spark, sf_dir):
    f = frames(spark, sf_dir)
    x, y = F.pmod(F.col("ord"), F.lit(7)) / 20, F.pmod(F.col("ord"), F.lit(5)) / 20
    return f.withColumns({"x1": x, "y1": y, "x2": x + 0.4, "y2": y + 0.5, "confidence": F.round(F.pmod(F.col("ord"), F.lit(10)) / 10, 4)})


def object_tracks(spark, sf_dir):
    return timeline.object_tracks(_detections(spark, sf_dir))


def track_count(spark, sf_dir):
    return timeline.track_count(object_tracks(spark, sf_dir))


def select_frames(spark, sf_dir):
    scored = timeline.change_score(_vectors(spark, sf_dir), "video_id", "ord", "embedding").withColumnRenamed("embedding", "feature")
    return timeline.select_frames(scored, 9)


def _segments_terms(spark, sf_dir):
    return segments(spark, sf_dir).withColumn("terms", query_terms(F.lit("query the and with that tion ververst which")))


def lexical_topk(spark, sf_dir):
    return retrieval.lexical_topk(_segments_terms(spark, sf_dir), "video_id", "ord", "text", F.array(*map(F.lit, WORDS)), 4).select("video_id", "ord", "relevance_rank", "relevance_score", "relevance_terms")


_LEXICAL = f"""{SEGMENTS}, h AS (SELECT *, list_filter([{sql_list(WORDS)}], lambda w: contains(lower(text), w)) AS hits FROM segments),
sc AS (SELECT *, CASE WHEN len(hits) > 0 THEN len(hits) + len(list_filter(hits, lambda w: length(w) >= 6)) + least(2::DOUBLE, len(hits) / 3.0::DOUBLE) END AS score, row_number() OVER (PARTITION BY video_id ORDER BY ord) AS i FROM h),
rk AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, ord) AS r FROM sc WHERE score IS NOT NULL),
br AS (SELECT video_id, i - 1 AS i, r * 3 AS place FROM rk UNION ALL SELECT video_id, i, r * 3 + 1 FROM rk UNION ALL SELECT video_id, i + 1, r * 3 + 2 FROM rk),
fi AS (SELECT video_id, i, min(place) AS place FROM br GROUP BY 1, 2),
nu AS (SELECT sc.*, row_number() OVER (PARTITION BY sc.video_id ORDER BY place) AS relevance_rank FROM fi JOIN sc USING (video_id, i)),
top AS (SELECT video_id, ord, relevance_rank, round(coalesce(score, 0), 3) AS relevance_score, array_to_string(hits[1:12], ' ') AS relevance_terms FROM nu WHERE relevance_rank <= 4)"""


def prompt_segments(spark, sf_dir):
    s = segments(spark, sf_dir)
    return retrieval.prompt_segments(s, lexical_topk(spark, sf_dir), "video_id", "ord", 6, 3)


def ocr_vote(spark, sf_dir):
    f = frames(spark, sf_dir).withColumns({"reading": F.concat(F.col("label"), F.lit(" #"), F.pmod(F.col("ord"), F.lit(3)).cast("string")), "confidence": F.pmod(F.col("ord"), F.lit(16)) / 16})
    return evidence.ocr_vote(f, "video_id", "reading", "confidence", "ord")


def visible_set(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("confidence", F.pmod(F.col("ord"), F.lit(16)) / 16)
    options = f.select("video_id").distinct().select("video_id", F.explode(F.array(*(F.struct(F.lit(k).alias("letter"), F.array(*map(F.lit, v)).alias("terms")) for k, v in (("A", ("click", "view")), ("B", ("purch",)), ("C", ("zebra",)), ("D", ("err", "sign")))))).alias("o")).select("video_id", "o.*")
    return evidence.visible_set(options, f, "video_id", "letter", "terms", "label", "time_sec", "confidence")


_VISIBLE = f"""{FRAMES}, o AS (SELECT DISTINCT video_id, letter, terms FROM frames, (VALUES ('A', ['click', 'view']), ('B', ['purch']), ('C', ['zebra']), ('D', ['err', 'sign'])) AS v(letter, terms)),
vis AS (SELECT o.video_id, letter, count(f.ord) > 0 AS seen, count(f.ord) AS times, min(time_sec) AS first_time, coalesce(max((ord % 16)::DOUBLE / 16), 0) AS confidence
  FROM o LEFT JOIN frames f ON o.video_id = f.video_id AND len(list_filter(terms, lambda t: contains(lower(label), t))) > 0 GROUP BY 1, 2)"""


def evidence_units(spark, sf_dir):
    f = frames(spark, sf_dir).select("video_id", "ord", "time_sec", "label", "score")
    kinds = ("click", "view", "purchase", "error", "signup")
    return evidence.evidence_units({k: (f.where(F.col("label") == k), limit) for k, limit in zip(kinds, (6, 8, 8, 12, 8), strict=True)}, "video_id", "ord", 30)


def input_audit(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("size", F.when(F.col("ord") % 501 != 0, F.pmod(F.col("ord"), F.lit(997))))
    return evidence.input_audit(f, "video_id", "label", "size", ["click", "view", "zoom"])


def first_relevant(spark, sf_dir):
    return evidence.first_relevant(frames(spark, sf_dir).withColumn("item", F.pmod(F.col("ord"), F.lit(31))), "video_id", "item", "ord", 16).select("video_id", "item", "ord", "place")


def priority_union(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("item", F.pmod(F.col("ord"), F.lit(53)))
    return retrieval.priority_union([f.where("label = 'error'"), f.where("label = 'purchase'"), f], "video_id", "item", "ord", 20).select("video_id", "item", "bucket", "place")


def stage_records(spark, sf_dir):
    """A deterministic answer stands in for a model; one item in ten fails, one in five needs a second call."""
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("record_key"), "lang")

    def answer(item, budget):
        n = int(item["record_key"])
        if n % 10 == 0 or (n % 5 == 1 and budget < 1000):
            raise ValueError("no answer")
        return item["lang"]

    return stage(items, answer)


def _spaced_sql(order: str, gap: float, most: int, label: str = "") -> str:
    """CTEs up to kept (video_id, x with o, t, l): a fold over each video's rows in order."""
    near = f"abs(k.t - x[1].t) < {gap}::DOUBLE{' AND k.l = x[1].l' if label else ''}"
    return f"""{FRAMES}, a AS (SELECT video_id, list([{{'o': ord, 't': time_sec, 'l': label}}] ORDER BY {order}) AS rows FROM frames GROUP BY 1),
kept AS (SELECT video_id, unnest(list_reduce(rows, lambda acc, x: CASE WHEN len(acc) < {most} AND len(list_filter(acc, lambda k: {near})) = 0 THEN acc || x ELSE acc END)) AS x FROM a)"""


def _tracks_sql() -> str:
    """CTEs up to tracks (video_id, label, and t with a, b, o, n, c): a fold over each video's and label's detections in order."""
    side = lambda u, lo, hi: f"greatest(0, least({u}.{hi}, x[1].{hi}) - greatest({u}.{lo}, x[1].{lo}))"
    area = lambda u: f"greatest(0, {u}.x2 - {u}.x1) * greatest(0, {u}.y2 - {u}.y1)"
    both = lambda u: f"{side(u, 'x1', 'x2')} * {side(u, 'y1', 'y2')}"
    overlaps = f"list_transform(acc, lambda u: {both('u')} / ({area('u')} + {area('x[1]')} - {both('u')}))"
    grown = "{'a': t.a, 'b': x[1].b, 'o': t.o, 'n': t.n + 1, 'c': round(greatest(t.c, x[1].c), 4), 'x1': x[1].x1, 'y1': x[1].y1, 'x2': x[1].x2, 'y2': x[1].y2}"
    return f"""{FRAMES}, d AS (SELECT video_id, lower(label) AS label, list([{{'a': time_sec, 'b': time_sec, 'o': ord, 'n': 1, 'c': round((ord % 10)::DOUBLE / 10, 4), 'x1': (ord % 7)::DOUBLE / 20, 'y1': (ord % 5)::DOUBLE / 20,
  'x2': (ord % 7)::DOUBLE / 20 + 0.4::DOUBLE, 'y2': (ord % 5)::DOUBLE / 20 + 0.5::DOUBLE}}] ORDER BY time_sec, ord) AS rows FROM frames GROUP BY 1, 2),
tracks AS (SELECT video_id, label, unnest(list_reduce(rows, lambda acc, x: CASE WHEN list_max({overlaps}) >= 0.3::DOUBLE
  THEN list_transform(acc, lambda t, i: CASE WHEN i = list_position({overlaps}, list_max({overlaps})) THEN {grown} ELSE t END) ELSE acc || x END)) AS t FROM d),
numbered AS (SELECT video_id, label, t.a AS first_time, t.b AS last_time, t.o AS first_ord, t.n::BIGINT AS frames_seen, t.c AS confidence, 'T' || lpad((row_number() OVER (PARTITION BY video_id ORDER BY t.a, t.o))::VARCHAR, 2, '0') AS track_id, t.n >= 2 AS confirmed FROM tracks)"""


QUERIES = {
    "energy_profile": (energy_profile, f"WITH {_PROFILE} SELECT * FROM profile"),
    "energy_totals": (energy_totals, f"WITH {_PROFILE} SELECT video_id, round(rms_mean, 4) AS rms_mean, round(rms_std, 4) AS rms_std, round(rms_max, 4) AS rms_max, windows FROM stats"),
    "audio_events": (audio_events, f"""WITH {_PROFILE}, m AS (SELECT p.video_id, win, rms, CASE WHEN rms >= rms_mean + rms_std AND rms > 0 THEN 'high_energy' WHEN rms <= rms_mean * 0.2::DOUBLE THEN 'silence_or_pause' END AS kind,
  CASE WHEN rms >= rms_mean + rms_std AND rms > 0 THEN rms - (rms_mean + rms_std) WHEN rms <= rms_mean * 0.2::DOUBLE THEN rms_mean * 0.2::DOUBLE - rms END AS score FROM profile p JOIN stats USING (video_id)),
a AS (SELECT *, count(kind) OVER (PARTITION BY video_id) AS n FROM m), c AS (SELECT video_id, win, rms, coalesce(kind, 'representative_audio') AS event_type, round(coalesce(score, rms), 6) AS score FROM a WHERE kind IS NOT NULL OR n = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, win) AS rk FROM c) SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY win)::INT AS event, win, event_type, round(score, 4) AS score, rms FROM t WHERE rk <= 4"""),
    "change_score": (change_score, """WITH v AS (SELECT 'v' || label::VARCHAR AS video_id, vec_id AS ord, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), p AS (SELECT *, lag(e) OVER (PARTITION BY video_id ORDER BY ord) AS b FROM v)
SELECT video_id, ord, round(round(CASE WHEN b IS NULL THEN 0 ELSE 1 - least(greatest(list_inner_product(e, b) / sqrt(list_inner_product(e, e) * list_inner_product(b, b)), -1), 1) END, 6), 4) AS change_score FROM p"""),
    "event_boundaries": (event_boundaries, f"WITH {FRAMES} SELECT video_id, ord, time_sec, score, label FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, ord) AS k FROM frames WHERE score > 0) WHERE k <= 12"),
    "merge_windows": (merge_windows, f"""WITH {SEGMENTS}, p AS (SELECT video_id, greatest(0, start_sec - 0.25::DOUBLE) AS a, end_sec + 0.25::DOUBLE AS b FROM segments), r AS (SELECT *, max(b) OVER (PARTITION BY video_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM p),
i AS (SELECT *, sum((reach IS NULL OR a > reach + 1)::INT) OVER (PARTITION BY video_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM r) SELECT video_id, island::BIGINT AS island, round(min(a), 3) AS start_sec, round(max(b), 3) AS end_sec, count(*) AS segments FROM i WHERE island <= 12 GROUP BY 1, 2"""),
    "merge_short_segments": (merge_short, f"""WITH {SEGMENTS}, k AS (SELECT *, (row_number() OVER (PARTITION BY video_id ORDER BY ord) = 1 OR end_sec - start_sec >= 1.2::DOUBLE)::INT AS kept FROM segments), g AS (SELECT *, sum(kept) OVER (PARTITION BY video_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS segment FROM k)
SELECT video_id, segment::BIGINT AS segment, arg_min(start_sec, ord) AS start_sec, max(end_sec) AS end_sec, count(*) - 1 AS merged FROM g GROUP BY 1, 2"""),
    "uniform_segments": (uniform_segments, """WITH n AS (SELECT p_partkey, p_size * 7.5::DOUBLE AS d, least(12, greatest(1, ceil(p_size * 7.5::DOUBLE / 20)))::INT AS n FROM part WHERE p_size > 0), p AS (SELECT *, unnest(range(0, n))::INT AS part FROM n)
SELECT p_partkey, part, round(d * part / n, 3) AS start_sec, round(d * (part + 1) / n, 3) AS end_sec FROM p"""),
    "coverage_sample": (coverage_sample, f"""WITH {FRAMES}, p AS (SELECT video_id, ord, row_number() OVER (PARTITION BY video_id ORDER BY ord) - 1 AS k, count(*) OVER (PARTITION BY video_id) AS n FROM frames)
SELECT DISTINCT video_id, ord FROM p, range(0, 7) AS g(i) WHERE n <= 7 OR round_even(i * (n - 1) / 6.0::DOUBLE, 0)::BIGINT = k"""),
    "nearest_join": (nearest_join, f"""WITH {FRAMES}, a AS (SELECT video_id, ord AS probe, time_sec + 0.5::DOUBLE AS t FROM frames WHERE label = 'click'), b AS (SELECT video_id, ord, time_sec FROM frames WHERE label <> 'click')
SELECT video_id, probe, arg_min(ord, (abs(time_sec - t), ord)) AS ord, min(abs(time_sec - t)) AS delta FROM a LEFT JOIN b USING (video_id) GROUP BY video_id, probe"""),
    "scope_overlap_join": (scope_overlap, f"WITH {SEGMENTS}, s AS (SELECT video_id, max(end_sec) * 0.25::DOUBLE AS a, max(end_sec) * 0.5::DOUBLE AS b FROM segments GROUP BY 1) SELECT video_id, ord, start_sec, end_sec FROM segments JOIN s USING (video_id) WHERE end_sec >= a AND start_sec <= b"),
    "suppress_near": (suppress_near, f"WITH {_spaced_sql('score DESC, ord', 600, 12)} SELECT video_id, x.o AS ord, x.t AS time_sec FROM kept"),
    "suppress_alike": (suppress_alike, f"WITH {_spaced_sql('score DESC, ord', 900, 12, 'label')} SELECT video_id, x.o AS ord, x.l AS label FROM kept"),
    "distinct_times": (distinct_times, f"WITH {_spaced_sql('ord', 1200, 16)} SELECT video_id, x.o AS ord, x.t AS time_sec FROM kept"),
    "motion_peaks": (motion_peaks, f"""WITH {FRAMES}, s AS (SELECT *, (coalesce(lag(k) OVER w, 0) + k + coalesce(lead(k) OVER w, 0)) / 3 AS sm FROM (SELECT *, round(score, 2) AS k FROM frames) WINDOW w AS (PARTITION BY video_id ORDER BY ord)),
t AS (SELECT *, lag(sm) OVER w AS p, lead(sm) OVER w AS n, avg(sm) OVER (PARTITION BY video_id) + 0.4::DOUBLE * stddev_pop(sm) OVER (PARTITION BY video_id) AS thr FROM s WINDOW w AS (PARTITION BY video_id ORDER BY ord))
SELECT video_id, count(*) AS frames, count(*) FILTER (sm > thr AND sm >= p AND sm > n) AS peaks FROM t GROUP BY 1"""),
    "time_points": (time_points, f"""WITH {SEGMENTS} SELECT video_id, ord, start_sec, end_sec, role, round(CASE role WHEN 'before' THEN start_sec WHEN 'during' THEN (start_sec + end_sec) / 2 ELSE end_sec END, 3) AS time_sec FROM segments, (VALUES ('before'), ('during'), ('after')) AS r(role)"""),
    "object_tracks": (object_tracks, f"WITH {_tracks_sql()} SELECT * FROM numbered"),
    "track_count": (track_count, f"""WITH {_tracks_sql()}, c AS (SELECT video_id, count(*) FILTER (confirmed) AS count_value, count(*) FILTER (NOT confirmed) AS uncertain FROM numbered GROUP BY 1)
SELECT video_id, count_value, CASE WHEN count_value > 0 THEN round(least(0.95::DOUBLE, 0.35::DOUBLE + 0.12::DOUBLE * count_value), 3) ELSE 0 END AS count_confidence, uncertain FROM c"""),
    "select_frames": (select_frames, """WITH v AS (SELECT 'v' || label::VARCHAR AS video_id, vec_id AS ord, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), p AS (SELECT *, lag(e) OVER w AS b, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY video_id) AS n FROM v WINDOW w AS (PARTITION BY video_id ORDER BY ord)),
c AS (SELECT *, round(CASE WHEN b IS NULL THEN 0 ELSE 1 - least(greatest(list_inner_product(e, b) / sqrt(list_inner_product(e, e) * list_inner_product(b, b)), -1), 1) END, 6) AS score FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY video_id, i = 0 OR i = n - 1 ORDER BY score DESC, i) AS k FROM c)
SELECT DISTINCT video_id, ord FROM r, range(1, 5) AS g(j) WHERE n <= 9 OR i = 0 OR i = n - 1 OR k <= 3 OR round_even(j * ((n - 1) / 5.0::DOUBLE), 0)::BIGINT = i"""),
    "lexical_topk": (lexical_topk, f"WITH {_LEXICAL} SELECT * FROM top"),
    "prompt_segments": (prompt_segments, f"""WITH {_LEXICAL}, rest AS (SELECT video_id, ord, row_number() OVER (PARTITION BY video_id ORDER BY ord) - 1 AS k, count(*) OVER (PARTITION BY video_id) AS n FROM segments ANTI JOIN top USING (video_id, ord)),
cov AS (SELECT DISTINCT video_id, ord FROM rest, range(0, 3) AS g(i) WHERE n <= 3 OR round_even(i * (n - 1) / 2.0::DOUBLE, 0)::BIGINT = k),
u AS (SELECT video_id, ord, 0 AS b, relevance_rank AS o FROM top UNION ALL SELECT video_id, ord, 1, ord FROM cov), p AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY b, o)::INT AS place FROM u)
SELECT video_id, ord, CASE b WHEN 0 THEN 'question_relevant_transcript' ELSE 'temporal_coverage_transcript' END AS role, place FROM p WHERE place <= 6"""),
    "ocr_vote": (ocr_vote, f"""WITH {FRAMES}, r AS (SELECT video_id, label || ' #' || (ord % 3)::VARCHAR AS reading, (ord % 16)::DOUBLE / 16 AS c, ord FROM frames), v AS (SELECT video_id, regexp_replace(lower(reading), '[^a-z0-9]+', '', 'g') AS norm, count(*) AS votes, round(sum(c), 6) AS score, arg_min(reading, ord) AS reading, min(ord) AS f FROM r GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY votes DESC, score DESC, f) AS k FROM v) SELECT video_id, votes, score, CASE WHEN votes >= 2 AND score / votes >= 0.6::DOUBLE THEN reading END AS voted_text, CASE WHEN votes >= 2 AND score / votes >= 0.6::DOUBLE THEN 'confident' ELSE 'uncertain' END AS ocr_status FROM b WHERE k = 1"""),
    "visible_set": (visible_set, f"WITH {_VISIBLE} SELECT * FROM vis"),
    "missing_options": (lambda s, d: evidence.missing_options(visible_set(s, d), "video_id", "letter"), f"WITH {_VISIBLE} SELECT video_id, coalesce(string_agg(letter, ',' ORDER BY letter) FILTER (seen), '') AS visible, coalesce(string_agg(letter, ',' ORDER BY letter) FILTER (NOT seen), '') AS missing FROM vis GROUP BY 1"),
    "evidence_units": (evidence_units, f"""WITH {FRAMES}, k(label, n, lim) AS (VALUES ('click', 0, 6), ('view', 1, 8), ('purchase', 2, 8), ('error', 3, 12), ('signup', 4, 8)), c AS (SELECT f.*, n, lim, row_number() OVER (PARTITION BY video_id, f.label ORDER BY ord) AS i FROM frames f JOIN k ON f.label = k.label),
u AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY n, i)::INT AS unit FROM c WHERE i <= lim) SELECT video_id, ord, time_sec, label, score, label AS evidence_type, unit FROM u WHERE unit <= 30"""),
    "input_audit": (input_audit, f"""WITH {FRAMES}, f AS (SELECT *, CASE WHEN ord % 501 <> 0 THEN ord % 997 END AS size FROM frames), a AS (SELECT video_id, count(*) AS anchors, count(*) FILTER (label = 'click') AS n_click, count(*) FILTER (label = 'view') AS n_view, count(*) FILTER (label = 'zoom') AS n_zoom,
  count(*) FILTER (size IS NULL) AS missing_files, count(*) FILTER (size = 0) AS empty_files FROM f GROUP BY 1)
SELECT *, array_to_string(list_filter([CASE WHEN n_click = 0 THEN 'no_click' END, CASE WHEN n_view = 0 THEN 'no_view' END, CASE WHEN n_zoom = 0 THEN 'no_zoom' END, CASE WHEN missing_files > 0 THEN 'missing_files' END, CASE WHEN empty_files > 0 THEN 'empty_files' END], lambda x: x IS NOT NULL), ',') AS warnings, missing_files > 0 OR empty_files > 0 AS stopped FROM a"""),
    "first_relevant": (first_relevant, f"WITH {FRAMES}, o AS (SELECT video_id, ord % 31 AS item, min(ord) AS ord FROM frames GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY ord, item)::INT AS place FROM o) SELECT video_id, item, ord, place FROM p WHERE place <= 16"),
    "priority_union": (priority_union, f"""WITH {FRAMES}, u AS (SELECT video_id, ord % 53 AS item, ord, 0 AS bucket FROM frames WHERE label = 'error' UNION ALL SELECT video_id, ord % 53, ord, 1 FROM frames WHERE label = 'purchase' UNION ALL SELECT video_id, ord % 53, ord, 2 FROM frames),
o AS (SELECT *, row_number() OVER (PARTITION BY video_id, item ORDER BY bucket, ord) AS k FROM u), p AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY bucket, ord)::INT AS place FROM o WHERE k = 1) SELECT video_id, item, bucket, place FROM p WHERE place <= 20"""),
    "stage_records": (stage_records, """SELECT doc_id::VARCHAR AS record_key, CASE WHEN doc_id % 10 = 0 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN doc_id % 10 <> 0 THEN lang END AS response, CASE WHEN doc_id % 10 = 0 THEN 'ValueError: no answer' END AS error,
  CASE WHEN doc_id % 10 = 0 THEN 3 WHEN doc_id % 5 = 1 THEN 2 ELSE 1 END AS attempts FROM documents"""),
}
