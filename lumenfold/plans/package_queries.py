"""Queries over filters and evidence packages."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.functions import crops, routing, terms
from lumenfold.operators import evidence, filters, packages
from lumenfold.plans.standins import ANSWERS, FRAMES, QUESTIONS, SEGMENTS, dealt, frames, segments, sql_dealt, sql_text, table
from lumenfold.plans.text_queries import _CTE, _any, _docs, _sql, typed_sql

CITED = ("audio_anchor_low_bitrate_event at 3s aligns", "video_anchor_low_fps_frame 1.5-2s is sufficient", "unsure", "", "nothing to cite here", "I cannot answer; not enough information")


def image_filter(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 80).alias("width"), F.when(F.col("p_partkey") % 9 > 0, F.col("p_partkey") % 2000).alias("height"), (F.col("p_partkey") * 100).alias("bytes"))
    return filters.high_resolution(p, 800, 600, 1.0, 20000).select("p_partkey", filters.megapixels(F.col("width"), F.col("height")).alias("mp"))


def duration_filter(spark, sf_dir):
    d = _docs(spark, sf_dir, duration=dealt(("short", "MEDIUM", "long", ""), F.col("doc_id")), duration_sec=dealt(("12", "x", "90.5"), F.col("doc_id")), length=F.col("n_chars").cast("double"))
    return d.where(filters.duration_matches(("short", "long"), 30.0, seconds=("duration_sec", "length"))).select("doc_id", "duration")


def resolution_filter(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("video"))
    c = table(spark, sf_dir, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("video"), (F.col("c_custkey") * 10).alias("size"), (F.col("c_nationkey") * 100).alias("width"), (F.col("c_custkey") % 1000).alias("height"))
    return filters.resolution_matches(o, c, "video", 800, 300, 100, 10000)


def key_selection(spark, sf_dir):
    d = _docs(spark, sf_dir, record_key=F.concat(F.lit("k"), (F.col("doc_id") % 200).cast("string")), video=F.col("doc_id") % 60)
    asked = spark.range(150).select(F.concat(F.lit("k"), (F.col("id") * 2).cast("string")).alias("record_key"))
    return filters.selected(d, asked, F.lit(True), unique="video", ord_="doc_id")


def citation_scores(spark, sf_dir):
    return _docs(spark, sf_dir, c=packages.citation_score(dealt(CITED, F.col("doc_id"))), answerable=packages.answerable(dealt(CITED, F.col("doc_id"))), keyword=packages.keyword_match(dealt(CITED, F.col("doc_id")), ["cite", "align"])).select("doc_id", "c.*", "answerable", "keyword")


def constraint_lists(spark, sf_dir):
    low = routing.lowered(dealt(QUESTIONS, F.col("doc_id")))
    d = _docs(spark, sf_dir, low=low).withColumn("family", routing.task_family(F.col("low"))).withColumn("types", routing.question_types(F.col("low"), F.col("family")))
    scope = routing.temporal_scope(F.col("low"), F.lit(60.0))["type"]
    return d.withColumn("c", packages.constraints(F.col("low"), F.col("family"), F.col("types"), scope)).select("doc_id", F.size("c").alias("n"), F.md5(F.array_join("c", "\n")).alias("digest"))


def transcript_evidence(spark, sf_dir):
    s = segments(spark, sf_dir).select("video_id", "ord", "start_sec", "end_sec")
    scopes = s.select("video_id").distinct().select("video_id", dealt(("beginning", "full_video", "end"), F.col("video_id")).alias("type"), F.lit(0.0).alias("scope_start"), F.lit(9.5).alias("scope_end"), (F.col("video_id") % 2 == 0).alias("counts"))
    return packages.transcript_evidence(s, scopes, "video_id", "ord", 5)


def token_usage(spark, sf_dir):
    f = frames(spark, sf_dir).select("video_id", (F.col("ord") % 640 + 1).alias("width"), (F.col("ord") % 360 + 1).alias("height"))
    v = frames(spark, sf_dir).groupBy("video_id").agg(F.count("*").alias("frame_count")).select("video_id", "frame_count", F.lit(1280).alias("width"), F.lit(720).alias("height"), F.lit("What happens here?").alias("question"), F.lit("look at frames").alias("prompt"), F.lit("[]").alias("audio_text"))
    return packages.token_usage(v, f, "video_id")


def evidence_text(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("second", F.col("time_sec").cast("int"))
    return packages.evidence_lines(f, "video_id", "ord", ["label", "second"], 10)


def prompts(spark, sf_dir):
    f = frames(spark, sf_dir)
    q = f.select("video_id").distinct().withColumn("question", dealt(QUESTIONS, F.substring("video_id", 2, 9).cast("int")))
    part = lambda label, n: packages.evidence_lines(f.where(F.col("label") == label), "video_id", "ord", ["label", "ord"], n)
    p = packages.package(q, {"motion": part("click", 3), "speech": part("none", 2)}, "video_id")
    return p.select("video_id", "package.task_family", packages.prompt(F.col("package"), F.col("question"), ["motion", "speech"]).alias("prompt"))


def record_bytes(spark, sf_dir):
    return _docs(spark, sf_dir, b=packages.package_bytes(dealt(ANSWERS, F.col("doc_id")), F.array(F.col("n_chars"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id"))))).select("doc_id", F.col("b").alias("evidence_bytes"))


def image_crops(spark, sf_dir):
    d = _docs(spark, sf_dir, low=routing.lowered(dealt(QUESTIONS, F.col("doc_id"))), w=(F.col("doc_id") % 640 + 1).cast("int"), h=(F.col("doc_id") % 480 + 1).cast("int"))
    c = crops.image_crops(F.col("low"), F.col("w"), F.col("h"), F.col("doc_id") % 2 == 0)
    return d.select("doc_id", F.posexplode_outer(c).alias("place", "c")).select("doc_id", "place", "c.label", F.array_join(F.col("c.box").cast("array<string>"), ",").alias("box"))


def frame_crops(spark, sf_dir):
    d = _docs(spark, sf_dir, low=routing.lowered(dealt(QUESTIONS, F.col("doc_id"))))
    text = lambda c: F.array_join(F.transform(c, lambda x: x["label"]), ",")
    return d.select("doc_id", text(crops.frame_crops(F.col("low"))).alias("frame"), text(crops.tubelet_crops(F.col("low"))).alias("tubelet"))


def even_times(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 1.5).alias("d"), (F.col("p_partkey") % 2 == 0).alias("b"))
    return evidence.even_times(p, "p_partkey", "d", "b", 9)


def instance_count(spark, sf_dir):
    return evidence.instance_count(frames(spark, sf_dir).withColumn("people", F.col("ord") % 7), "video_id", "people")


def _frame_sql(names, text_terms) -> str:
    joined = {k: ",".join(c[0] for c in v) for k, v in names.items()}
    return f"CASE WHEN {_any('low', text_terms)} THEN '{joined['text']}' WHEN {_any('low', terms.SIDE_TERMS)} THEN '{joined['side']}' ELSE '{joined['other']}' END"


def _crops_sql() -> str:
    inside = lambda side, share: f"greatest(0, least({side} - 1, round_even({side} * {share}::DOUBLE, 0)::INT))"
    far = lambda side, low, high: f"greatest({inside(side, low)} + 1, least({side}, round_even({side} * {high}::DOUBLE, 0)::INT))"
    crop = lambda c: f"{{'label': '{c[0]}', 'box': concat_ws(',', {inside('w', c[1])}, {inside('h', c[2])}, {far('w', c[1], c[3])}, {far('h', c[2], c[4])})}}"
    sides = ", ".join(f"CASE WHEN {_any('low', words)} THEN {crop(c)} END" for words, c in terms.IMAGE_CROPS.values())
    rest = lambda crops_: f"[{', '.join(map(crop, crops_))}]"
    return f"""WITH q AS (SELECT doc_id, lower(t) AS low, (doc_id % 640 + 1)::INT AS w, (doc_id % 480 + 1)::INT AS h FROM {_sql(QUESTIONS)}),
c AS (SELECT doc_id, list_filter([{sides}], lambda x: x IS NOT NULL) || [{crop(terms.CENTER_CROP)}] || CASE WHEN doc_id % 2 = 0 THEN {rest(terms.CORNER_CROPS)} ELSE {rest(terms.BAND_CROPS)} END AS c FROM q),
u AS (SELECT doc_id, list_filter(c, lambda x, i: list_position(list_transform(c, lambda y: y.box), x.box) = i) AS c FROM c)
SELECT doc_id, (i - 1)::INT AS place, c[i].label AS label, c[i].box AS box FROM (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS i FROM u)"""


def _constraints_sql() -> str:
    scenes = [w for words in terms.SCENES.values() for w in words]
    narrow = f"({_any('low', (*terms.BEGINNING_TERMS, *terms.END_TERMS, *scenes, *terms.CURRENT_TERMS))} OR regexp_matches(low, '{routing.CLIP}'))"
    has = lambda name: f"list_contains(types, '{name}')"
    cast = f"{_any('low', terms.CAST_TERMS)} AND {_any('low', terms.STAGE_TERMS)}"
    group = "family = 'scene_group_attribute_count'"
    holds = {"in_scope": narrow, "count": has("count"), "absence": has("absence_verification"), "ocr": f"{has('ocr')} OR {_any('low', terms.READING_TERMS)}", "cast": f"{group} AND {cast}", "group": f"{group} AND NOT ({cast})",
             "container": "family = 'container_object_count'", "ordinal": "family = 'ordinal_clip_action'", "intent": "family = 'domain_intention'", "beginning": _any("low", terms.OPENING_TERMS)}
    items = ["'no_answer'", "'grounded'", "'each_option'", "'family:' || family", *(f"CASE WHEN {h} THEN '{n}' END" for n, h in holds.items())]
    return f"WITH {typed_sql()}, c AS (SELECT doc_id, list_filter([{', '.join(items)}], lambda x: x IS NOT NULL) AS c FROM typed) SELECT doc_id, len(c)::INT AS n, md5(array_to_string(c, chr(10))) AS digest FROM c"


_MARKS = {n: _any("low", w) for n, w in terms.CITATION_WORDS.items()} | {"has_timestamp": "regexp_matches(low, '\\b[0-9]+(?:\\.[0-9]+)?(?:-[0-9]+(?:\\.[0-9]+)?)?s\\b')"}
QUERIES = {
    "image_crops": (image_crops, _crops_sql()),
    "frame_crops": (frame_crops, f"SELECT doc_id, {_frame_sql(terms.FRAME_CROPS, terms.FRAME_TEXT_TERMS)} AS frame, {_frame_sql(terms.TUBELET_CROPS, terms.TUBELET_TEXT_TERMS)} AS tubelet FROM (SELECT doc_id, lower(t) AS low FROM {_sql(QUESTIONS)})"),
    "even_times": (even_times, "SELECT p_partkey, i::INT AS i, round(CASE WHEN p_partkey % 2 = 0 THEN least(p_size * 1.5::DOUBLE, 8) ELSE p_size * 1.5::DOUBLE END * i / 8, 3) AS time_sec FROM part, range(0, 9) AS g(i) WHERE p_size > 0"),
    "instance_count": (instance_count, f"WITH {FRAMES} SELECT video_id, count(*) AS frames, max(ord % 7) AS most, floor(median(ord % 7))::BIGINT AS median FROM frames GROUP BY 1"),
    "image_filter": (image_filter, "WITH p AS (SELECT p_partkey, p_size * 80 AS w, CASE WHEN p_partkey % 9 > 0 THEN p_partkey % 2000 END AS h, p_partkey * 100 AS b FROM part) SELECT p_partkey, round(w * h / 1000000.0::DOUBLE, 4) AS mp FROM p WHERE w >= 800 AND h >= 600 AND round(w * h / 1000000.0::DOUBLE, 4) >= 1 AND b >= 20000"),
    "duration_filter": (duration_filter, f"""WITH d AS (SELECT doc_id, n_chars, {sql_dealt(('short', 'MEDIUM', 'long', ''), 'doc_id')} AS duration, {sql_dealt(('12', 'x', '90.5'), 'doc_id')} AS s FROM documents)
SELECT doc_id, duration FROM d WHERE lower(duration) IN ('short', 'long', '') AND coalesce(try_cast(s AS DOUBLE), n_chars) >= 30"""),
    "resolution_filter": (resolution_filter, "SELECT o_orderkey, o_custkey AS video FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 > 0 AND c_nationkey * 100 >= 800 AND c_custkey % 1000 >= 300 AND c_custkey * 10 BETWEEN 100 AND 10000)"),
    "key_selection": (key_selection, "WITH d AS (SELECT doc_id, 'k' || (doc_id % 200)::VARCHAR AS record_key, doc_id % 60 AS video FROM documents WHERE (doc_id % 200) % 2 = 0) SELECT doc_id, record_key, video FROM (SELECT *, row_number() OVER (PARTITION BY video ORDER BY doc_id) AS k FROM d) WHERE k = 1"),
    "citation_scores": (citation_scores, f"""WITH d AS (SELECT doc_id, lower(t) AS low FROM {_sql(CITED)}) SELECT doc_id, {', '.join(f'{s} AS {n}' for n, s in _MARKS.items())}, {' + '.join(f'({s})::INT' for s in _MARKS.values())} AS score,
  trim(low, ' ') <> '' AND NOT {_any('low', terms.REFUSALS)} AS answerable, regexp_matches(low, '\\b(?:cite|align)\\b') AS keyword FROM d"""),
    "constraint_lists": (constraint_lists, _constraints_sql()),
    "transcript_evidence": (transcript_evidence, f"""WITH {SEGMENTS}, f AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY ord) AS i, {sql_dealt(('beginning', 'full_video', 'end'), 'video_id')} AS type, video_id % 2 = 0 AS counts FROM segments),
m AS (SELECT *, type = 'full_video' OR (end_sec >= 0 AND start_sec <= 9.5::DOUBLE) AS scope_match, counts AND type = 'beginning' AS visual FROM f WHERE i <= 5)
SELECT video_id, ord, start_sec, end_sec, scope_match, scope_match AND NOT visual AS use_for_answer, CASE WHEN visual THEN 'weak' ELSE 'normal' END AS task_match, CASE WHEN NOT scope_match THEN 'outside' WHEN visual THEN 'auxiliary' ELSE 'inside' END AS reason FROM m"""),
    "token_usage": (token_usage, f"""WITH {FRAMES}, k AS (SELECT video_id, sum(ceil((ord % 640 + 1) / 28.0::DOUBLE) * ceil((ord % 360 + 1) / 28.0::DOUBLE))::BIGINT AS visual, count(*) AS frames FROM frames GROUP BY 1), v AS (SELECT video_id, count(*) AS n FROM frames GROUP BY 1),
t AS (SELECT video_id, coalesce(frames, 0) AS frames, n * 46 * 26 + 4 AS original_tokens, coalesce(visual, 0) + 8 + 1 AS package_tokens FROM v LEFT JOIN k USING (video_id))
SELECT *, round(package_tokens::DOUBLE / original_tokens, 6) AS compression_rate, round(1 - package_tokens::DOUBLE / original_tokens, 6) AS token_saving_rate FROM t"""),
    "evidence_text": (evidence_text, f"WITH {FRAMES}, f AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY ord) AS i FROM frames) SELECT video_id, string_agg(label || ' | ' || time_sec::INT::VARCHAR, chr(10) ORDER BY i) AS lines FROM f WHERE i <= 10 GROUP BY 1"),
    "prompts": (prompts, f"""WITH {FRAMES}, {_CTE}, fam AS (SELECT DISTINCT doc_id % {len(QUESTIONS)} AS k, family FROM routed), v AS (SELECT DISTINCT video_id, substr(video_id, 2)::INT AS n FROM frames),
m AS (SELECT video_id, string_agg(label || ' | ' || ord::VARCHAR, chr(10) ORDER BY ord) AS lines FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY ord) AS i FROM frames WHERE label = 'click') WHERE i <= 3 GROUP BY 1)
SELECT v.video_id, family AS task_family, 'Task family: ' || family || chr(10) || 'Question: ' || {sql_dealt(QUESTIONS, 'n')} || coalesce(chr(10) || '[motion]' || chr(10) || lines, '') || chr(10) || 'Answer with the option''s letter only.' AS prompt
FROM v JOIN fam ON n % {len(QUESTIONS)} = k LEFT JOIN m USING (video_id)"""),
    "record_bytes": (record_bytes, f"SELECT doc_id, strlen({sql_dealt(ANSWERS, 'doc_id')}) + n_chars + CASE WHEN doc_id % 2 = 0 THEN doc_id ELSE 0 END AS evidence_bytes FROM documents"),
}
