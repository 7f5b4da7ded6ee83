"""Queries over text: answers, options, labels, boxes, tokens, captions, subtitles, JSON and the routing of questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.functions import numbers, routing, terms, text
from lumenfold.functions.json import model_json, model_object, path
from lumenfold.plans.standins import ANSWERS, BOXES, CAPTIONS, JSONS, LABELS, OPTIONS, QUESTIONS, SRT, dealt, sql_dealt, sql_list, sql_text, table


def _docs(spark, sf_dir, **columns):
    """doc_id and dealt values, then columns of them."""
    return table(spark, sf_dir, "documents").select("doc_id", *(v.alias(k) for k, v in columns.items()))


def _by(values: tuple):
    return dealt(values, F.col("doc_id"))


def _sql(values: tuple, name: str = "t") -> str:
    return f"(SELECT doc_id, {sql_dealt(values, 'doc_id')} AS {name} FROM documents)"


def _any(low: str, words) -> str:
    return "(" + " OR ".join(f"contains({low}, {sql_text(w)})" for w in words) + ")"


def answer_letter(spark, sf_dir):
    return _docs(spark, sf_dir, t=_by(ANSWERS)).select("doc_id", text.answer_letter(F.col("t")).alias("letter"), text.first_letter(F.col("t")).alias("first_letter"))


def letter_sql() -> str:
    last = lambda p: f"regexp_extract_all(x, '{p}', 1)[-1]".replace("(?:final_", "(?:final_")
    cues = ", ".join(last(c.replace("'", "''")) for c in text.LETTER_CUES)
    return f"""SELECT doc_id, upper(coalesce(nullif(regexp_extract(x, '^\\(?\\s*([A-Fa-f])\\s*\\)?\\.?,?$', 1), ''), {cues}, {last(text.ALONE)}, CASE WHEN length(x) <= 120 THEN {last(chr(92) + 'b([A-Fa-f])' + chr(92) + 'b')} END)) AS letter,
  nullif(regexp_extract(upper(t), '([A-E])', 1), '') AS first_letter FROM (SELECT doc_id, t, trim(t, ' ') AS x FROM {_sql(ANSWERS)})"""


def option_parse(spark, sf_dir):
    rows = _docs(spark, sf_dir, o=text.options(_by(OPTIONS)))
    return rows.select("doc_id", F.size("o").cast("bigint").alias("n"), F.array_join(F.transform("o", lambda x: F.concat_ws("=", x["letter"], x["text"])), "|").alias("options"))


def labels(spark, sf_dir):
    rows = _docs(spark, sf_dir, l=text.label_list(_by(LABELS)), r=dealt(("A dog bark and some rain", "car horn, wind", "silence"), F.col("doc_id")))
    return rows.select("doc_id", F.array_join("l", "|").alias("labels"), F.array_join(text.label_hits(F.col("l"), F.col("r")), "|").alias("hits"))


def short_answers(spark, sf_dir):
    rows = _docs(spark, sf_dir, e=dealt(("Yes", "no", "Blue car", "42", ""), F.col("doc_id")), r=dealt(("Answer: yes, it is", "No.", "a blue car!", "final answer: 42", "nothing", "yesterday", "The answer: No"), F.col("doc_id")))
    return rows.select("doc_id", text.normalize_label(F.col("r")).alias("normal"), text.short_answer_correct(F.col("e"), F.col("r")).alias("correct"))


def bbox_parse(spark, sf_dir):
    b = F.col("b")
    return _docs(spark, sf_dir, b=text.bbox(_by(BOXES))).select("doc_id", *(F.get(b, F.lit(i)).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))))


def query_tokens(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", F.concat_ws(" ", "text", dealt(QUESTIONS, F.col("item_id"))).alias("t"))
    joined = lambda f: F.array_join(f(F.col("t")), " ")
    return b.select("item_id", joined(text.query_terms).alias("query"), joined(text.evidence_terms).alias("evidence"), joined(text.option_terms).alias("options"))


def _tokens_sql(stop, digits=True, cap=None) -> str:
    keep = "(length(x) >= 3 OR regexp_full_match(x, '[0-9]+'))" if digits else "length(x) >= 3"
    words = f"list_filter(string_split(trim(regexp_replace(lower(t), '[^a-z0-9]+', ' ', 'g'), ' '), ' '), lambda x: {keep} AND x NOT IN ({sql_list(stop)}))"
    first = f"list_filter({words}, lambda x, i: list_position({words}, x) = i)"
    return f"array_to_string({first}[1:{cap}], ' ')" if cap else f"array_to_string({first}, ' ')"


def captions(spark, sf_dir):
    return _docs(spark, sf_dir, t=_by(CAPTIONS)).select("doc_id", text.clean_caption(F.col("t")).alias("caption"), text.ellipsis(F.concat_ws(" ", "t", F.lit("and so on")), 16).alias("short"))


def page_text(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.length(F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]+>", " "), r"\s+", " "))).cast("bigint").alias("chars"))


def srt_parse(spark, sf_dir):
    rows = _docs(spark, sf_dir, t=F.concat(F.lit(SRT + " "), F.col("doc_id").cast("string")))
    s = rows.select("doc_id", F.explode_outer(text.subtitle_segments(F.col("t"))).alias("s")).select("doc_id", "s.*")
    return s.select("doc_id", "sequence_index", "start_sec", "end_sec", "text", text.subtitle_block(F.col("sequence_index"), F.col("start_sec"), F.col("end_sec"), F.col("text")).alias("block"))


def people(spark, sf_dir):
    c = text.people_counts(dealt(("men=3 women=2", "women: 4", "Men = 1", "none"), F.col("doc_id")))
    return _docs(spark, sf_dir, c=c).select("doc_id", "c.men", "c.women")


def json_parse(spark, sf_dir):
    v = _docs(spark, sf_dir, t=_by(JSONS))
    return v.select("doc_id", model_json(F.col("t")).isNotNull().alias("is_object"), path(model_json(F.col("t")), "$.a", "int", -1).alias("a"), path(model_json(F.col("t")), "$.b.c").alias("c"), model_object(F.col("t")).alias("kept"))


def route_family(spark, sf_dir):
    q = _docs(spark, sf_dir, q=_by(QUESTIONS)).withColumn("low", routing.lowered(F.col("q"))).withColumn("family", routing.task_family(F.col("low")))
    r = q.withColumn("r", routing.resolver(F.col("family")))
    return r.select("doc_id", "family", "r.resolver_class", "r.priority", "r.confidence", F.array_join("r.required_evidence", ",").alias("evidence"), routing.asks_performing_cast(F.col("low")).alias("cast_question"))


_CTE = f"""routed AS (SELECT doc_id, low, CASE WHEN {_any('low', terms.STATE_TERMS)} THEN 'stateful_ocr' WHEN {_any('low', terms.MISSING_TERMS)} THEN 'missing_set' WHEN {_any('low', terms.ORDINAL_TERMS)} THEN 'ordinal_clip_action'
  WHEN {_any('low', terms.INTENT_TERMS)} THEN 'domain_intention' WHEN {_any('low', terms.COUNT_TERMS)} THEN
    CASE WHEN {_any('low', terms.REPETITION_GATE)} AND ({_any('low', terms.REPETITION_PHRASES)} OR list_has_any(regexp_extract_all(low, '[a-z][a-z\\-]*'), [{sql_list(terms.REPETITION_WORDS)}])) THEN 'temporal_event_count'
      WHEN {_any('low', terms.CONTAINER_TERMS)} THEN 'container_object_count' WHEN {_any('low', terms.GROUP_TERMS)} THEN 'scene_group_attribute_count' ELSE 'cross_shot_entity_count' END
  WHEN {_any('low', terms.SCENE_TERMS)} THEN 'scene_conditioned_attribute' ELSE 'generic_video_evidence' END AS family FROM (SELECT doc_id, lower(q) AS low FROM {_sql(QUESTIONS, 'q')}))"""


def _family_case(values: dict) -> str:
    return "CASE family " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"


def anchor_policy(spark, sf_dir):
    q = _docs(spark, sf_dir, q=_by(QUESTIONS)).withColumn("low", routing.lowered(F.col("q")))
    q = q.withColumn("policy", routing.anchor_policy(F.col("low"), routing.task_family(F.col("low"))))
    rows = ", ".join(f"('{name}', {', '.join(str(v).lower() for v in values)})" for name, values in sorted(routing.policies().items()))
    table_ = spark.sql(f"SELECT * FROM VALUES {rows} AS p(policy, fps, max_frames, max_side, detail_max_crops, detail_max_side, audio_anchor, transcript, evidence_max_tokens)")
    return q.join(table_.select("policy", F.col("fps").cast("double").alias("fps"), "max_frames", "detail_max_crops", "audio_anchor", "evidence_max_tokens"), "policy").select("doc_id", "policy", "fps", "max_frames", "detail_max_crops", "audio_anchor", "evidence_max_tokens")


def _policy_sql() -> str:
    rows = ", ".join(f"('{name}', {v[0]}::DOUBLE, {v[1]}, {v[3]}, {str(v[5]).upper()}, {v[7]})" for name, v in sorted(routing.policies().items()))
    return f"""WITH {_CTE}, named AS (SELECT doc_id, CASE WHEN family = 'scene_group_attribute_count' THEN 'full_scene_group_count' WHEN family IN ('container_object_count', 'missing_set') THEN 'medium_' || family
  WHEN {_any('low', terms.ASR_TERMS)} THEN 'tiny_asr' WHEN {_any('low', terms.OCR_TERMS)} THEN 'medium_ocr' WHEN {_any('low', terms.TEMPORAL_TERMS)} THEN 'medium_temporal' ELSE 'light' END AS policy FROM routed),
p(policy, fps, max_frames, detail_max_crops, audio_anchor, evidence_max_tokens) AS (VALUES {rows}) SELECT doc_id, policy, fps, max_frames, detail_max_crops, audio_anchor, evidence_max_tokens FROM named JOIN p USING (policy)"""


def question_profile(spark, sf_dir):
    q = _docs(spark, sf_dir, q=_by(QUESTIONS)).withColumn("low", routing.lowered(F.col("q"))).withColumn("family", routing.task_family(F.col("low")))
    q = q.withColumn("types", routing.question_types(F.col("low"), F.col("family")))
    return q.select("doc_id", F.array_join("types", ",").alias("types"), F.array_join(routing.required_evidence(F.col("types"), F.col("family")), ",").alias("evidence"), numbers.budget(F.col("types"))["anchor"].alias("anchor_budget"))


def typed_sql() -> str:
    """CTEs up to typed (doc_id, low, family, types)."""
    own = ", ".join(f"CASE WHEN {_any('low', words)} THEN '{name}' END" for name, words in terms.QUESTION_TYPES.items())
    added = _family_case({k: f"[{sql_list(v)}]" for k, v in terms.FAMILY_TYPES.items()})
    return f"""{_CTE}, own AS (SELECT doc_id, low, family, list_filter([{own}], lambda x: x IS NOT NULL) || coalesce({added}, []) AS ty FROM routed),
typed AS (SELECT doc_id, low, family, CASE WHEN len(ty) = 0 THEN ['semantic_video'] ELSE {_first('ty')} END AS types FROM own)"""


def _first(x: str) -> str:
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def _profile_sql() -> str:
    by_type = "CASE t " + " ".join(f"WHEN '{k}' THEN [{sql_list(v)}]" for k, v in terms.TYPE_EVIDENCE.items()) + " ELSE [] END"
    by_family = _family_case({k: f"[{sql_list(v)}]" for k, v in terms.FAMILY_EVIDENCE.items()})
    return f"""WITH {typed_sql()}, ev AS (SELECT doc_id, types, ['global_timeline', 'low_fps_context'] || flatten(list_transform(types, lambda t: {by_type})) || {by_family} AS e FROM typed)
SELECT doc_id, array_to_string(types, ',') AS types, array_to_string({_first('e')}, ',') AS evidence,
  CASE WHEN list_contains(types, 'spatial_relation') THEN 300 WHEN list_has_any(types, ['ocr', 'temporal_order', 'audio_visual']) THEN 250 WHEN list_contains(types, 'semantic_video') THEN 150 ELSE 200 END AS anchor_budget FROM ev"""


def temporal_scope(spark, sf_dir):
    q = _docs(spark, sf_dir, q=_by(QUESTIONS)).withColumns({"low": routing.lowered(F.col("q")), "d": (F.col("doc_id") % 97).cast("double")})
    return q.select("doc_id", routing.temporal_scope(F.col("low"), F.col("d")).alias("s")).select("doc_id", "s.type", F.col("s.start").alias("scope_start"), F.col("s.end").alias("scope_end"), "s.confidence", F.col("s.source").alias("scope_source"))


def _scope_sql() -> str:
    scene = _any("low", [w for words in terms.SCENES.values() for w in words])
    n = "CASE regexp_extract(low, '" + routing.CLIP + "', 1) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in terms.ORDINALS.items()) + " END"
    return f"""WITH q AS (SELECT doc_id, lower(q) AS low, (doc_id % 97)::DOUBLE AS d FROM {_sql(QUESTIONS, 'q')}),
k AS (SELECT *, least(d, greatest(6::DOUBLE, least(15::DOUBLE, d * 0.15::DOUBLE))) AS edge, {n} AS n,
  CASE WHEN d <= 0 THEN 'none' WHEN {_any('low', terms.BEGINNING_TERMS)} THEN 'beginning' WHEN {_any('low', terms.END_TERMS)} THEN 'end' WHEN ({n}) IS NOT NULL THEN 'clip_index' WHEN {scene} THEN 'scene_specific' WHEN {_any('low', terms.CURRENT_TERMS)} THEN 'current_state' ELSE 'full_video' END AS kind FROM q),
c AS (SELECT *, round(d * (n - 1) / greatest(n, 3), 3) AS cs, round(d * n / greatest(n, 3), 3) AS ce FROM k),
p AS (SELECT *, least(1.5::DOUBLE, greatest(0::DOUBLE, (ce - cs) * 0.25::DOUBLE)) AS pad FROM c),
r AS (SELECT *, greatest(0::DOUBLE, least(CASE kind WHEN 'end' THEN greatest(0::DOUBLE, d - edge) WHEN 'clip_index' THEN cs - pad ELSE 0 END, d)) AS a, CASE kind WHEN 'beginning' THEN edge WHEN 'clip_index' THEN ce + pad ELSE d END AS b FROM p)
SELECT doc_id, CASE kind WHEN 'none' THEN 'full_video' ELSE kind END AS type, CASE WHEN kind <> 'none' THEN round(a, 3) END AS scope_start, CASE WHEN kind = 'full_video' THEN round(d, 3) WHEN kind <> 'none' THEN round(greatest(0::DOUBLE, least(greatest(b, a + 0.5::DOUBLE), d)), 3) END AS scope_end,
  CASE kind WHEN 'none' THEN 0.5::DOUBLE WHEN 'beginning' THEN 0.9 WHEN 'end' THEN 0.86 WHEN 'clip_index' THEN 0.62 WHEN 'scene_specific' THEN 0.55 WHEN 'current_state' THEN 0.58 ELSE 0.7 END AS confidence,
  CASE kind WHEN 'none' THEN 'missing_duration' WHEN 'beginning' THEN 'keyword_beginning' WHEN 'end' THEN 'keyword_end' WHEN 'clip_index' THEN 'scene_segment_clip_index' WHEN 'scene_specific' THEN 'scene_keyword_no_semantic_locator' WHEN 'current_state' THEN 'keyword_current_requires_visual_state' ELSE 'default_full_video' END AS scope_source FROM r"""


def priority_windows(spark, sf_dir):
    q = _docs(spark, sf_dir, w=routing.priority_windows(routing.lowered(_by(QUESTIONS)), (F.col("doc_id") % 97).cast("double")))
    return q.select("doc_id", F.posexplode_outer("w").alias("place", "w")).where("w IS NOT NULL").select("doc_id", "place", F.col("w.start").alias("start_sec"), F.col("w.end").alias("end_sec"), "w.source")


def estimates(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", numbers.image_tokens(F.col("p_size") * 40, F.col("p_partkey") % 1000 + 1).alias("image_tokens"), numbers.text_tokens(F.col("p_name")).alias("text_tokens"), numbers.estimated_tokens(F.octet_length("p_name")).alias("byte_tokens"), numbers.frame_step(F.col("p_size") * 1.0, F.lit(4.0)).alias("frame_step"))


def boxes_overlap(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem")
    box = lambda *c: F.array(*(F.col(x) if isinstance(x, str) else x for x in c))
    return e.select("l_orderkey", "l_linenumber", F.round(numbers.iou(box("l_discount", "l_tax", F.col("l_discount") + 0.3, F.col("l_tax") + 0.25), box("l_tax", "l_discount", F.col("l_tax") + 0.5, F.col("l_discount") + F.col("l_quantity") / 100)), 6).alias("iou"))


def expand_boxes(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    b = numbers.expand_box(F.array(F.col("p_size"), F.col("p_size"), F.col("p_size") * 3, F.col("p_size") + 20), F.lit(100), F.lit(60), 1.5)
    return p.select("p_partkey", *(F.get(b, F.lit(i)).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))))


def tile_grids(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", numbers.tile_grid(F.col("p_size") * 37, F.col("p_partkey") % 900 + 100).alias("g")).select("p_partkey", "g.columns", "g.rows")


#: The character references that the dealt captions use.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&"))


def _unescaped(x: str) -> str:
    for name, value in ENTITIES:
        x = f"replace({x}, {sql_text(name)}, {sql_text(value)})"
    return x


def _tiles_sql() -> str:
    grids = sorted({(i, j) for i in range(1, 7) for j in range(1, 7) if i * j <= 6}, key=lambda g: (g[0] * g[1], g))
    rows = ", ".join(f"({n}, {i}, {j})" for n, (i, j) in enumerate(grids))
    # of the nearest grids the first counts, then each later one that the area fills half
    return f"""WITH g(n, c, r) AS (VALUES {rows}), p AS (SELECT p_partkey, p_size * 37 AS w, p_partkey % 900 + 100 AS h FROM part), d AS (SELECT *, abs(w::DOUBLE / h - c::DOUBLE / r) AS d FROM p, g),
b AS (SELECT *, min(d) OVER (PARTITION BY p_partkey) AS least FROM d), e AS (SELECT *, min(n) OVER (PARTITION BY p_partkey) AS first FROM b WHERE d = least)
SELECT p_partkey, arg_max(c, n) AS columns, arg_max(r, n) AS rows FROM e WHERE n = first OR w * h > 0.5::DOUBLE * 448 * 448 * c * r GROUP BY p_partkey"""


def _windows_sql() -> str:
    count, score = _any("low", terms.PRIORITY_COUNT_TERMS), _any("low", ("current score", "ongoing game", "scoreboard", "score of", "final score"))
    rows = [(_any("low", terms.BEGINNING_TERMS), "0::DOUBLE", "least(10::DOUBLE, d)", "question_start_focus"), (score, "0::DOUBLE", "d", "question_score_full_timeline_focus"), (count, "0::DOUBLE", "greatest(4::DOUBLE, d / 3)", "question_counting_early_coverage"),
            (count, "d / 3 - 2", "2 * d / 3 + 2", "question_counting_middle_coverage"), (count, "2 * d / 3 - 2", "d", "question_counting_late_coverage")]
    union = " UNION ALL ".join(f"SELECT doc_id, d, {k} AS k, {a} AS s, {b} AS e, '{source}' AS source FROM q WHERE {holds}" for k, (holds, a, b, source) in enumerate(rows))
    return f"""WITH q AS (SELECT doc_id, lower(q) AS low, (doc_id % 97)::DOUBLE AS d FROM {_sql(QUESTIONS, 'q')} WHERE doc_id % 97 > 0), u AS ({union}), c AS (SELECT *, greatest(0::DOUBLE, least(s, d)) AS a FROM u),
r AS (SELECT doc_id, k, round(a, 3) AS start_sec, round(least(greatest(e, a + 0.5::DOUBLE), d), 3) AS end_sec, source FROM c), f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, start_sec, end_sec ORDER BY k) AS i FROM r WHERE end_sec > start_sec)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS place, start_sec, end_sec, source FROM f WHERE i = 1"""


_LABEL_LIST = """CASE WHEN len(regexp_extract_all(t, '''([^'']+)''|"([^"]+)"')) > 0 THEN list_transform(regexp_extract_all(t, '''([^'']+)''|"([^"]+)"'), lambda x: x[2:-2]) ELSE regexp_split_to_array(t, '[,;/]') END"""
_NORMAL = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'), ' ')"
_NUMBER = r"\s*(-?[0-9]*\.?[0-9]+)\s*"
QUERIES = {
    "answer_letter": (answer_letter, letter_sql()),
    "option_parse": (option_parse, f"""WITH p AS (SELECT doc_id, regexp_extract_all(t, '{text.OPTION}', 1) AS l, list_transform(regexp_extract_all(t, '{text.OPTION}', 2), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'), ' ')) AS x FROM {_sql(OPTIONS)}),
e AS (SELECT doc_id, unnest(l) AS letter, unnest(x) AS text, generate_subscripts(l, 1) AS i FROM p), f AS (SELECT doc_id, letter, arg_max(text, i) AS text FROM e GROUP BY doc_id, letter)
SELECT d.doc_id, count(letter) AS n, coalesce(string_agg(letter || '=' || f.text, '|' ORDER BY letter), '') AS options FROM documents d LEFT JOIN f ON d.doc_id = f.doc_id GROUP BY d.doc_id"""),
    "label_list": (labels, f"""WITH p AS (SELECT doc_id, list_filter(list_transform({_LABEL_LIST}, lambda x: {_NORMAL.format('x')}), lambda x: x <> '') AS l, {_NORMAL.format("(['A dog bark and some rain', 'car horn, wind', 'silence'])[doc_id % 3 + 1]")} AS r FROM {_sql(LABELS)})
SELECT doc_id, array_to_string(l, '|') AS labels, array_to_string(list_filter(l, lambda x: contains(r, x))[1:8], '|') AS hits FROM p"""),
    "short_answers": (short_answers, f"""WITH p AS (SELECT doc_id, (['Yes', 'no', 'Blue car', '42', ''])[doc_id % 5 + 1] AS e, (['Answer: yes, it is', 'No.', 'a blue car!', 'final answer: 42', 'nothing', 'yesterday', 'The answer: No'])[doc_id % 7 + 1] AS r FROM documents),
n AS (SELECT doc_id, {_NORMAL.format('r')} AS normal, {_NORMAL.format('e')} AS e, {_NORMAL.format("coalesce(nullif(regexp_extract(r, '(?is)(?:final\\s*answer|answer|答案)\\s*[:：]\\s*(.+)$', 1), ''), r)")} AS p FROM p)
SELECT doc_id, normal, CASE WHEN e = '' OR p = '' THEN FALSE WHEN e = p THEN TRUE WHEN e IN ('yes', 'no') THEN string_split(p, ' ')[1] = e ELSE contains(p, e) OR contains(e, p) END AS correct FROM n"""),
    "bbox_parse": (bbox_parse, f"""WITH p AS (SELECT doc_id, list_transform(string_split(regexp_extract_all(t, '(?i)bbox[^\\[]*\\[({_NUMBER},{_NUMBER},{_NUMBER},{_NUMBER})\\]', 1)[-1], ','), lambda x: least(greatest(trim(x, ' ')::DOUBLE, 0), 1)) AS b FROM {_sql(BOXES)}),
v AS (SELECT doc_id, CASE WHEN b[1] < b[3] AND b[2] < b[4] THEN b END AS b FROM p) SELECT doc_id, b[1] AS x1, b[2] AS y1, b[3] AS x2, b[4] AS y2 FROM v"""),
    "query_terms": (query_tokens, f"SELECT item_id, {_tokens_sql(terms.TRANSCRIPT_STOPWORDS, cap=80)} AS query, {_tokens_sql(terms.EVIDENCE_STOPWORDS)} AS evidence, {_tokens_sql(terms.OPTION_STOPWORDS, False)} AS options FROM (SELECT item_id, text || ' ' || {sql_dealt(QUESTIONS, 'item_id')} AS t FROM benchmark)"),
    "caption_clean": (captions, f"""WITH c AS (SELECT doc_id, t, trim(regexp_replace(regexp_replace(regexp_replace({_unescaped('t')}, '<[^>]+>', ' ', 'g'), '\\{{\\\\[^}}]+\\}}', ' ', 'g'), '[\\s\\x{{00A0}}]+', ' ', 'g'), ' ') AS caption FROM {_sql(CAPTIONS)}),
s AS (SELECT *, trim(regexp_replace(t || ' and so on', '\\s+', ' ', 'g'), ' ') AS x FROM c) SELECT doc_id, caption, CASE WHEN length(x) > 16 THEN rtrim(substr(x, 1, 13), ' ') || '...' ELSE x END AS short FROM s"""),
    "page_text": (page_text, "SELECT page_id, length(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'), ' ')) AS chars FROM pages"),
    "srt_parse": (srt_parse, """SELECT doc_id, i AS sequence_index, s AS start_sec, e AS end_sec, CASE WHEN i = 5 THEN 'end ' || doc_id::VARCHAR ELSE t END AS text, b || CASE WHEN i = 5 THEN 'end ' || doc_id::VARCHAR ELSE t END || chr(10) AS block FROM documents,
(VALUES (1, 1.5::DOUBLE, 3.25::DOUBLE, 'Hello there', '1' || chr(10) || '00:00:01,500 --> 00:00:03,250' || chr(10)), (4, 65, 67.5, 'All right', '4' || chr(10) || '00:01:05,000 --> 00:01:07,500' || chr(10)), (5, 0, 9, '', '5' || chr(10) || '00:00:00,000 --> 00:00:09,000' || chr(10))) AS v(i, s, e, t, b)"""),
    "people_counts": (people, """WITH p AS (SELECT doc_id, (['men=3 women=2', 'women: 4', 'men = 1', 'none'])[doc_id % 4 + 1] AS t FROM documents)
SELECT doc_id, try_cast(nullif(regexp_extract(t, 'men\\s*[=:]\\s*([0-9]+)', 1), '') AS INT) AS men, try_cast(nullif(regexp_extract(t, 'women\\s*[=:]\\s*([0-9]+)', 1), '') AS INT) AS women FROM p"""),
    "json_validate": (json_parse, """WITH v(k, is_object, a, c, kept) AS (VALUES (0, TRUE, 1, 'x', '{"a":1,"b":{"c":"x"}}'), (1, TRUE, 2, NULL, '{"a":2}'), (2, FALSE, -1, NULL, '{"raw_evidence":"[1, 2]"}'), (3, FALSE, -1, NULL, '{"raw_evidence":""}'),
(4, FALSE, -1, NULL, '{"raw_evidence":"{broken"}'), (5, TRUE, -1, NULL, '{"a":null}')) SELECT doc_id, is_object, a::INT AS a, c, kept FROM documents JOIN v ON doc_id % 6 = k"""),
    "route_family": (route_family, f"""WITH {_CTE} SELECT doc_id, family, {_family_case({k: f"'{v[0]}'" for k, v in terms.FAMILIES.items()})} AS resolver_class, {_family_case({k: f"'{v[1]}'" for k, v in terms.FAMILIES.items()})} AS priority,
  ({_family_case({k: str(v[2]) for k, v in terms.FAMILIES.items()})})::DOUBLE AS confidence, {_family_case({k: f"'{','.join(v)}'" for k, v in terms.FAMILY_EVIDENCE.items()})} AS evidence, {_any('low', terms.CAST_TERMS)} AND {_any('low', terms.STAGE_TERMS)} AS cast_question FROM routed"""),
    "anchor_policy": (anchor_policy, _policy_sql()),
    "question_profile": (question_profile, _profile_sql()),
    "temporal_scope": (temporal_scope, _scope_sql()),
    "priority_windows": (priority_windows, _windows_sql()),
    "token_estimates": (estimates, """SELECT p_partkey, (ceil(p_size * 40 / 28.0::DOUBLE) * ceil((p_partkey % 1000 + 1) / 28.0::DOUBLE))::BIGINT AS image_tokens, greatest(1, length(p_name) // 4)::BIGINT AS text_tokens, greatest(1, ceil(strlen(p_name) / 4.0::DOUBLE))::BIGINT AS byte_tokens,
  greatest(1, round_even(p_size / 4.0::DOUBLE, 0))::INT AS frame_step FROM part"""),
    "boxes_overlap": (boxes_overlap, """WITH b AS (SELECT l_orderkey, l_linenumber, l_discount AS ax1, l_tax AS ay1, l_discount + 0.3::DOUBLE AS ax2, l_tax + 0.25::DOUBLE AS ay2, l_tax AS bx1, l_discount AS by1, l_tax + 0.5::DOUBLE AS bx2, l_discount + l_quantity / 100 AS by2 FROM lineitem),
i AS (SELECT *, greatest(0::DOUBLE, least(ax2, bx2) - greatest(ax1, bx1)) * greatest(0::DOUBLE, least(ay2, by2) - greatest(ay1, by1)) AS inter, greatest(0::DOUBLE, ax2 - ax1) * greatest(0::DOUBLE, ay2 - ay1) + greatest(0::DOUBLE, bx2 - bx1) * greatest(0::DOUBLE, by2 - by1) AS both_ FROM b)
SELECT l_orderkey, l_linenumber, round(CASE WHEN both_ - inter > 0 THEN inter / (both_ - inter) ELSE 0 END, 6) AS iou FROM i"""),
    "expand_boxes": (expand_boxes, """WITH b AS (SELECT p_partkey, (p_size + p_size * 3) / 2.0::DOUBLE AS cx, (p_size + p_size + 20) / 2.0::DOUBLE AS cy, greatest(1::DOUBLE, (p_size * 3 - p_size) * 1.5::DOUBLE / 2) AS hw, greatest(1::DOUBLE, 20 * 1.5::DOUBLE / 2) AS hh FROM part)
SELECT p_partkey, greatest(0, round_even(cx - hw, 0)::INT) AS x1, greatest(0, round_even(cy - hh, 0)::INT) AS y1, least(100, round_even(cx + hw, 0)::INT) AS x2, least(60, round_even(cy + hh, 0)::INT) AS y2 FROM b"""),
    "tile_grids": (tile_grids, _tiles_sql()),
}
