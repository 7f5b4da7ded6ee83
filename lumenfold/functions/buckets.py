"""Buckets of run records: by source, by kind of answer, by kind of question."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenfold.functions import terms
from lumenfold.functions.text import any_of


def _first(text: Column, table, otherwise: Column) -> Column:
    found = otherwise
    for name, words in reversed(table):
        found = F.when(any_of(text, words), F.lit(name)).otherwise(found)
    return found


def record_source(key: Column, dataset: Column) -> Column:
    return _first(F.coalesce(key, F.lit("")), terms.SOURCE_MARKS, F.coalesce(F.nullif(dataset, F.lit("")), F.lit("unknown")))


def answer_kind(truth: Column) -> Column:
    t = F.trim(F.coalesce(truth, F.lit("")))
    low = F.lower(t)
    return (F.when(t.rlike("^[A-Fa-f]$"), "mcq_letter").when(low.isin("yes", "no"), "yes_no").when(t.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), "number").when(low.isin(*terms.COLORS), "color").otherwise("short_text"))


def question_kind(question: Column) -> Column:
    return _first(F.lower(F.coalesce(question, F.lit(""))), terms.QUESTION_BUCKETS, F.lit("other"))
