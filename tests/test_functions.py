"""Scalar functions on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from lumenfold.functions import buckets, numbers, routing, text
from lumenfold.functions.json import as_list, fallback, model_json, model_object, path, without_keys


def values(spark, f, items, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x")).alias("y")).collect()]


def test_answer_letters(spark):
    cases = {"C": "C", "(b)": "B", " d. ": "D", "FINAL_ANSWER: C": "C", "final answer is (e)": "E", "答案：B": "B", "answer A. Then answer: D": "D", '{"answer": "A"}': "A", "I pick (A) not (B)": "B", "x\nC)\n": "C", "it is c": "C",
             "nothing": None, "": None, None: None, "G": None, "a" * 130 + " B": None, "select option f": "F", "'final_answer': 'D'": "D"}
    assert values(spark, text.answer_letter, list(cases)) == list(cases.values())
    assert values(spark, text.first_letter, ["xyz", "bad", None]) == [None, "B", None]


def test_options(spark):
    cases = {"A. Cat\nB. Dog": [("A", "Cat"), ("B", "Dog")], "A. one\nA. two": [("A", "two")], "B.Dog": [], "A.  x   y": [("A", "x y")], None: [], "none": []}
    assert [[tuple(o) for o in row] for row in values(spark, text.options, list(cases))] == list(cases.values())


def test_labels_and_short_answers(spark):
    assert values(spark, text.label_list, ["['Speech', \"Dog bark\"]", "Rain, Wind; A/B", "", None]) == [["speech", "dog bark"], ["rain", "wind", "a", "b"], [], []]
    pairs = [("yes", "Yes, it is", True), ("no", "yes no", False), ("Blue car", "answer: the blue car", True), ("42", "4", True), ("x", "", False), ("", "x", False)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, e string, r string, ok boolean")
    assert all(r.ok == r.got for r in df.withColumn("got", text.short_answer_correct(F.col("e"), F.col("r"))).collect())


def test_boxes(spark):
    assert values(spark, text.bbox, ["bbox: [0.1,0.2,0.5,0.6]", "bbox [0,0,1,1] bbox: [0.2, 0.3, 1.4, 0.9]", "bbox: [0.5,0,0.2,1]", "", None]) == [[0.1, 0.2, 0.5, 0.6], [0.2, 0.3, 1.0, 0.9], None, None, None]
    same = [0.0, 0.0, 1.0, 1.0]
    rows = [(same, same, 1.0), (same, [0.5, 0.0, 1.5, 1.0], 1 / 3), (same, [2.0, 2.0, 3.0, 3.0], 0.0), ([0.0] * 4, [0.0] * 4, 0.0)]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>, y double")
    assert all(r.got == pytest.approx(r.y) for r in df.withColumn("got", numbers.iou(F.col("a"), F.col("b"))).collect())


def test_tokens(spark):
    assert values(spark, text.query_terms, ["Which Red car, the red CAR no 7?", None]) == [["red", "car", "7"], []]
    assert values(spark, text.option_terms, ["The relaxed fit shirt 42 x9 blue"]) == [["blue"]]


def test_captions_and_subtitles(spark):
    assert values(spark, text.clean_caption, ["<i>Tom</i> &amp;  Jerry {\\an8}x", None]) == ["Tom & Jerry x", ""]
    assert values(spark, text.clock_seconds, ["01:02:03,500", "02:03.25", "7", "x:y", "", "00:00:09.1 pos"]) == [3723.5, 123.25, 7.0, 0.0, 0.0, 9.1]
    assert values(spark, text.clock_text, [3723.5, 0.0, -1.0], "double") == ["01:02:03,500", "00:00:00,000", "00:00:00,000"]
    srt = "1\r\n00:00:01,000 --> 00:00:02,000\r\n<b>Hi</b>\r\n\r\n\r\n2\r\nno arrow\r\n\r\n3\r\n00:00:03,000 --> 00:00:04,000\r\n12\r\n\r\n4\r\n5 --> 6\r\na\r\nb"
    (found,) = values(spark, text.subtitle_segments, [srt])
    assert [tuple(s) for s in found] == [(1, 1.0, 2.0, "Hi"), (4, 5.0, 6.0, "a b")]
    assert values(spark, text.subtitle_segments, [None, ""]) == [[], []]


def test_small_text_functions(spark):
    assert [tuple(v) for v in values(spark, text.record_key_parts, ["video:a:b:c", "image:x"])] == [("a:b", "c"), ("", "")]
    assert [tuple(v) for v in values(spark, text.people_counts, ["women=4 men=3", "men: 2"])] == [(4, 4), (2, None)]
    assert values(spark, lambda x: text.ellipsis(x, 8), ["short", "a  rather long one", None]) == ["short", "a rat...", ""]
    assert values(spark, buckets.answer_kind, ["b", "YES", "-3.5", "Grey", "a cat", None]) == ["mcq_letter", "yes_no", "number", "color", "short_text", "short_text"]
    assert values(spark, buckets.question_kind, ["How many?", "Is it left", "Why so", None]) == ["counting", "spatial_depth", "causal", "other"]


FAMILIES = {
    "What is the current score of the ongoing game?": "stateful_ocr", "Which color is absent in the rack?": "missing_set", "What happens in the second clip?": "ordinal_clip_action", "Why does the player leave?": "domain_intention",
    "How many jumps does the skater do?": "temporal_event_count", "How many items are stored in the box displayed at the beginning?": "container_object_count", "How many men and women are presenting on the stage?": "scene_group_attribute_count",
    "How many challengers took part?": "cross_shot_entity_count", "Describe the man on the train.": "scene_conditioned_attribute", "Describe the mood.": "generic_video_evidence", "Why are there so many?": "domain_intention",
    "How many laptops are spinach green?": "cross_shot_entity_count", "Germany": "cross_shot_entity_count", None: "generic_video_evidence",
}


def test_families(spark):
    assert values(spark, lambda x: routing.task_family(routing.lowered(x)), list(FAMILIES)) == list(FAMILIES.values())
    assert values(spark, lambda x: routing.resolver(routing.task_family(routing.lowered(x)))["confidence"], list(FAMILIES)[:2]) == [0.88, 0.86]


def test_scopes(spark):
    scope = lambda x: routing.temporal_scope(routing.lowered(x), F.lit(100.0))
    got = values(spark, scope, ["at the beginning", "at the end", "the second clip", "on the train", "now", "mood"])
    assert [(s.type, s.start, s.end) for s in got] == [("beginning", 0.0, 15.0), ("end", 85.0, 100.0), ("clip_index", 31.833, 68.167), ("scene_specific", 0.0, 100.0), ("current_state", 0.0, 100.0), ("full_video", 0.0, 100.0)]
    segments = F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((0.0, 4.0), (4.0, 8.0))))
    (own,) = values(spark, lambda x: routing.temporal_scope(routing.lowered(x), F.lit(100.0), segments), ["second clip"])
    assert (own.start, own.end, own.confidence) == (3.0, 9.0, 0.76)
    windows = values(spark, lambda x: routing.priority_windows(routing.lowered(x), F.lit(30.0)), ["how many at the start", "mood"])
    assert [[(w.start, w.end) for w in row] for row in windows] == [[(0.0, 10.0), (8.0, 22.0), (18.0, 30.0)], []]


def test_numbers(spark):
    assert values(spark, numbers.estimated_tokens, [0, 1, 4, 5, -3], "bigint") == [1, 1, 1, 2, 1]
    assert values(spark, lambda x: numbers.frame_step(x, F.lit(4.0)), [30.0, 10.0, 0.0], "double") == [8, 2, 1]
    assert [tuple(v) for v in values(spark, lambda x: numbers.tile_grid(x, F.lit(448)), [448, 896, 2688], "int")] == [(1, 1), (2, 1), (6, 1)]
    assert [tuple(v) for v in values(spark, numbers.budget, [["ocr"], ["semantic_video"], ["count"]], "array<string>")] == [(250, 750), (150, 850), (200, 800)]


def test_json(spark):
    texts = ['```json\n{"a": [1, 2], "b": {"c": "x"}}\n```', 'so {"a": 5} then', "[1]", "{bad", None]
    assert values(spark, lambda x: model_json(x).isNotNull(), texts) == [True, True, False, False, False]
    assert values(spark, lambda x: path(model_json(x), "$.b.c", default="none"), texts[:2]) == ["x", "none"]
    assert values(spark, lambda x: F.size(as_list(F.try_variant_get(model_json(x), "$.a", "variant"))), texts[:3]) == [2, 1, 0]
    assert values(spark, model_object, ["{bad"]) == ['{"raw_evidence":"{bad"}']
    assert values(spark, lambda x: fallback(x, F.lit(2)), ["r"]) == ['{"status":"fallback","reason":"r","attempts":2}']
    df = spark.createDataFrame([('{"a": {"answer": 1, "b": [{"answer": 2, "é": 3}]}}',), ("no json",), (None,)], "j string")
    assert [r.j for r in without_keys(df, "j", ["answer"]).collect()] == ['{"a":{"b":[{"é":3}]}}', "no json", None]
