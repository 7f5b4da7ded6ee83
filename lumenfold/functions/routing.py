"""Routing of questions: task family, anchor policy, extraction profile and time scope, all as columns of the question."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenfold.functions import terms
from lumenfold.functions.text import any_of


def lowered(question: Column) -> Column:
    return F.lower(F.coalesce(question, F.lit("")))


def counts_repetition(low: Column) -> Column:
    """A count of a repeated action: a phrase, or one of the action words as a whole word."""
    words = F.regexp_extract_all(low, F.lit(r"[a-z][a-z\-]*"), F.lit(0))
    return any_of(low, terms.REPETITION_GATE) & (any_of(low, terms.REPETITION_PHRASES) | F.arrays_overlap(words, F.array(*map(F.lit, terms.REPETITION_WORDS))))


def asks_performing_cast(low: Column) -> Column:
    return any_of(low, terms.CAST_TERMS) & any_of(low, terms.STAGE_TERMS)


def task_family(low: Column) -> Column:
    """The family of a lower-cased question; the order of the branches decides."""
    counted = (F.when(counts_repetition(low), "temporal_event_count").when(any_of(low, terms.CONTAINER_TERMS), "container_object_count")
               .when(any_of(low, terms.GROUP_TERMS), "scene_group_attribute_count").otherwise("cross_shot_entity_count"))
    return (F.when(any_of(low, terms.STATE_TERMS), "stateful_ocr").when(any_of(low, terms.MISSING_TERMS), "missing_set").when(any_of(low, terms.ORDINAL_TERMS), "ordinal_clip_action")
            .when(any_of(low, terms.INTENT_TERMS), "domain_intention").when(any_of(low, terms.COUNT_TERMS), counted).when(any_of(low, terms.SCENE_TERMS), "scene_conditioned_attribute").otherwise("generic_video_evidence"))


def of_family(family: Column, values: dict) -> Column:
    """values[family] as a CASE."""
    case = None
    for name, value in values.items():
        case = F.when(family == name, value) if case is None else case.when(family == name, value)
    return case


def resolver(family: Column) -> Column:
    """Struct (resolver_class, priority, confidence, required_evidence)."""
    return F.struct(of_family(family, {k: v[0] for k, v in terms.FAMILIES.items()}).alias("resolver_class"), of_family(family, {k: v[1] for k, v in terms.FAMILIES.items()}).alias("priority"),
                    of_family(family, {k: v[2] for k, v in terms.FAMILIES.items()}).alias("confidence"), of_family(family, {k: F.array(*map(F.lit, v)) for k, v in terms.FAMILY_EVIDENCE.items()}).alias("required_evidence"))


def anchor_policy(low: Column, family: Column) -> Column:
    """The derived policy's name."""
    return (F.when(family == "scene_group_attribute_count", "full_scene_group_count").when(family.isin("container_object_count", "missing_set"), F.concat(F.lit("medium_"), family))
            .when(any_of(low, terms.ASR_TERMS), "tiny_asr").when(any_of(low, terms.OCR_TERMS), "medium_ocr").when(any_of(low, terms.TEMPORAL_TERMS), "medium_temporal").otherwise("light"))


def policies() -> dict[str, tuple]:
    """Settings by derived or base policy name: a base policy, with crops, crop side, audio and tokens overlaid."""
    out = dict(terms.POLICIES) | {"tiny_asr": terms.POLICIES["tiny"], "medium_temporal": terms.POLICIES["medium"]}
    for name, (base, crops, side, audio, most) in terms.POLICY_OVERLAYS.items():
        fps, frames, max_side, *_, transcript, _ = terms.POLICIES[base]
        out[name] = (fps, frames, max_side, crops, side, audio, transcript, most)
    return out


def question_types(low: Column, family: Column) -> Column:
    """Distinct types in order: those of the text, then those of the family; semantic_video if there are none."""
    own = F.array_compact(F.array(*(F.when(any_of(low, words), F.lit(name)) for name, words in terms.QUESTION_TYPES.items())))
    added = F.coalesce(of_family(family, {k: F.array(*map(F.lit, v)) for k, v in terms.FAMILY_TYPES.items()}), F.array().cast("array<string>"))
    found = F.array_distinct(F.concat(own, added))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("semantic_video")))


def required_evidence(types: Column, family: Column) -> Column:
    """Distinct evidence in order: always two, then by type, then by family."""
    by_type = F.flatten(F.transform(types, lambda t: F.coalesce(of_family(t, {k: F.array(*map(F.lit, v)) for k, v in terms.TYPE_EVIDENCE.items()}), F.array().cast("array<string>"))))
    by_family = of_family(family, {k: F.array(*map(F.lit, v)) for k, v in terms.FAMILY_EVIDENCE.items()})
    return F.array_distinct(F.concat(F.array(F.lit("global_timeline"), F.lit("low_fps_context")), by_type, by_family))


CLIP = terms.CLIP


def clip_index(low: Column) -> Column:
    """The clip that a question names, from 1; null if it names none."""
    return of_family(F.regexp_extract(low, CLIP, 1), terms.ORDINALS)


def temporal_scope(low: Column, duration: Column, segments: Column | None = None) -> Column:
    """Struct (type, start, end, confidence, source) for a question over a video of some seconds.

    segments: array of (start, end), the merged scenes; a clip beyond them, or none given, is one of equal parts of the video.
    """
    edge = F.least(duration, F.greatest(F.lit(6.0), F.least(F.lit(15.0), duration * 0.15)))
    n = clip_index(low)
    parts = F.greatest(n, F.lit(3))
    equal_start, equal_end = F.round(duration * (n - 1) / parts, 3), F.round(duration * n / parts, 3)
    own = F.get(segments, n - 1) if segments is not None else None
    start = F.coalesce(own["start"], equal_start) if segments is not None else equal_start
    end = F.coalesce(own["end"], equal_end) if segments is not None else equal_end
    sure = F.when(own.isNotNull(), 0.76).otherwise(0.62) if segments is not None else F.lit(0.62)
    pad = F.least(F.lit(1.5), F.greatest(F.lit(0.0), (end - start) * 0.25))

    def scoped(kind: str, a: Column, b: Column, confidence: Column, source: str) -> Column:
        a = F.greatest(F.lit(0.0), F.least(a, duration))
        b = F.greatest(F.lit(0.0), F.least(F.greatest(b, a + 0.5), duration))
        return F.struct(F.lit(kind).alias("type"), F.round(a, 3).alias("start"), F.round(b, 3).alias("end"), confidence.alias("confidence"), F.lit(source).alias("source"))

    zero = F.lit(0.0)
    unknown = F.struct(F.lit("full_video").alias("type"), F.lit(None).cast("double").alias("start"), F.lit(None).cast("double").alias("end"), F.lit(0.5).alias("confidence"), F.lit("missing_duration").alias("source"))
    return (F.when(F.coalesce(duration, zero) <= 0, unknown)
            .when(any_of(low, terms.BEGINNING_TERMS), scoped("beginning", zero, edge, F.lit(0.9), "keyword_beginning"))
            .when(any_of(low, terms.END_TERMS), scoped("end", F.greatest(zero, duration - edge), duration, F.lit(0.86), "keyword_end"))
            .when(n.isNotNull(), scoped("clip_index", start - pad, end + pad, sure, "scene_segment_clip_index"))
            .when(any_of(low, [w for words in terms.SCENES.values() for w in words]), scoped("scene_specific", zero, duration, F.lit(0.55), "scene_keyword_no_semantic_locator"))
            .when(any_of(low, terms.CURRENT_TERMS), scoped("current_state", zero, duration, F.lit(0.58), "keyword_current_requires_visual_state"))
            .otherwise(F.struct(F.lit("full_video").alias("type"), zero.alias("start"), F.round(duration, 3).alias("end"), F.lit(0.7).alias("confidence"), F.lit("default_full_video").alias("source"))))


def priority_windows(low: Column, duration: Column) -> Column:
    """Up to six distinct (start, end, source) windows to look at first."""
    def window(start: Column, end: Column, source: str) -> Column:
        a = F.greatest(F.lit(0.0), F.least(start, duration))
        return F.struct(F.round(a, 3).alias("start"), F.round(F.least(F.greatest(end, a + 0.5), duration), 3).alias("end"), F.lit(source).alias("source"))

    count = any_of(low, terms.PRIORITY_COUNT_TERMS)
    all_windows = F.array(
        F.when(any_of(low, terms.BEGINNING_TERMS), window(F.lit(0.0), F.least(F.lit(10.0), duration), "question_start_focus")),
        F.when(any_of(low, ("current score", "ongoing game", "scoreboard", "score of", "final score")), window(F.lit(0.0), duration, "question_score_full_timeline_focus")),
        F.when(count, window(F.lit(0.0), F.greatest(F.lit(4.0), duration / 3), "question_counting_early_coverage")),
        F.when(count, window(duration / 3 - 2, 2 * duration / 3 + 2, "question_counting_middle_coverage")),
        F.when(count, window(2 * duration / 3 - 2, duration, "question_counting_late_coverage")))
    usable = F.filter(F.array_compact(all_windows), lambda w: w["end"] > w["start"])
    first = F.filter(usable, lambda w, i: ~F.exists(F.slice(usable, F.lit(1), i), lambda v: (v["start"] == w["start"]) & (v["end"] == w["end"])))
    return F.when(F.coalesce(duration, F.lit(0.0)) > 0, F.slice(first, 1, 6)).otherwise(F.slice(first, 1, 0))


def scope_match(kind: Column, scope_start: Column, scope_end: Column, start: Column, end: Column) -> Column:
    """True if [start, end] meets the scope; scopes that don't narrow time match everything."""
    free = kind.isNull() | kind.isin("full_video", "current_state", "scene_specific") | scope_start.isNull()
    return free | ((end >= scope_start) & (start <= scope_end))
