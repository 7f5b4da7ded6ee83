"""JSON that models write: validation, coercion and paths, over VARIANT values."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.runtime import ship


def model_json(text: Column) -> Column:
    """The object in a model's output as VARIANT: the text without a code fence, else its first brace to its last; else null."""
    t = F.trim(F.coalesce(text, F.lit("")))
    bare = F.trim(F.regexp_replace(F.regexp_replace(t, "^```[A-Za-z]*", ""), "```$", ""))
    value = F.coalesce(F.try_parse_json(bare), F.try_parse_json(F.regexp_extract(bare, r"(?s)\{.*\}", 0)))
    return F.when(F.schema_of_variant(value).startswith("OBJECT"), value)


def model_object(text: Column) -> Column:
    """JSON text of the object, or of an object that holds the raw text."""
    return F.coalesce(F.to_json(model_json(text)), F.to_json(F.struct(F.coalesce(text, F.lit("")).alias("raw_evidence"))))


def as_list(value: Column) -> Column:
    """An array of VARIANT: nothing for null, the elements of an array, else the value alone."""
    kind = F.schema_of_variant(value)
    empty = F.array().cast("array<variant>")
    return F.when(value.isNull() | (kind == "VOID"), empty).when(kind.startswith("ARRAY"), F.try_variant_get(value, "$", "array<variant>")).otherwise(F.array(value))


def path(value: Column, at: str, kind: str = "string", default=None) -> Column:
    return F.coalesce(F.try_variant_get(value, at, kind), F.lit(default).cast(kind))


def fallback(reason: Column, attempts: Column) -> Column:
    """The object that stands in for an answer that couldn't be read."""
    return F.to_json(F.struct(F.lit("fallback").alias("status"), reason.alias("reason"), attempts.alias("attempts")))


def without_keys(rows: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """rows with the keys gone from the JSON text of a column, at any depth; text that isn't JSON stays as it is."""
    ship(rows.sparkSession)
    gone = set(keys)

    def drop(value):
        if isinstance(value, dict):
            return {k: drop(v) for k, v in value.items() if k not in gone}
        return [drop(v) for v in value] if isinstance(value, list) else value

    def cleaned(text: str | None) -> str | None:
        try:
            return text if text is None else json.dumps(drop(json.loads(text)), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return text

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(cleaned, na_action="ignore")

    return rows.withColumn(column, clean(F.col(column)))
