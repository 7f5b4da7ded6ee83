"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.runtime import shared_dir

#: Separators of words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
#: Separators of alphanumeric words: every ASCII character but 0-9 and a-z (after lower-casing).
NON_WORD_CLASS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_written: list[tuple[SparkSession, str]] = []


def let(value: Column, body) -> Column:
    """body(v) with v bound to value, which is evaluated once however often body uses it.

    Spark may inline a named column into a lambda, where it would run once per element;
    a one-element transform cannot be inlined away.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_of(name: str = "text") -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; lower() is the same, and faster, on pure ASCII."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, UPPER.lower())).otherwise(F.lower(text))


def space_words(text: Column) -> Column:
    """Maximal runs without the six ASCII separators, in order."""
    return F.array_remove(F.split(text, SPACE_CLASS), "")


def alnum_words(text: Column) -> Column:
    """Words of lower-cased ASCII letters, digits and any non-ASCII characters, in order."""
    return F.array_remove(F.split(ascii_lower(text), NON_WORD_CLASS), "")


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts lineage, survives lost executors and has a known size.

    The tables go with discard(), at the end of a tidy() block, or when the session's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(_forget)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing will read any more."""
    for path in [t._written_at for t in tables]:
        for entry in [e for e in _written if e[1] == path]:
            _written.remove(entry)
            _delete(*entry)


@contextmanager
def tidy() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes, at its end, the tables that written() has made within, but for those given to the function that it yields."""
    before, kept = list(_written), set()

    def keep(table: DataFrame) -> DataFrame:
        kept.add(table._written_at)
        return table

    try:
        yield keep
    finally:
        for entry in [e for e in _written if e not in before and e[1] not in kept]:
            _written.remove(entry)
            _delete(*entry)


#: Cells, of 64 bits each, of the filter that sifts rows by keys: a broadcast table of two megabytes at most.
SIFT_CELLS = 1 << 17
_SIFT_MASK = "shiftleft(1L, int(shiftright(_sift_h, 17) & 63)) | shiftleft(1L, int(shiftright(_sift_h, 23) & 63))"


def sifted(rows: DataFrame, own: Column, keys: DataFrame, key: Column) -> tuple[DataFrame, DataFrame]:
    """The rows whose hash own may be among the hashes key of keys, and those for which it surely isn't.

    The keys make a Bloom filter: each sets two bits of one cell. It has a fixed size; the more keys, the more rows may be
    among them, up to all.
    """
    cell = F.expr(f"int(_sift_h & {SIFT_CELLS - 1})").alias("_sift_cell")
    bits = keys.select(key.alias("_sift_h")).groupBy(cell).agg(F.bit_or(F.expr(_SIFT_MASK)).alias("_sift_bits"))
    bits = written(bits, "sift")
    marked = rows.withColumn("_sift_h", own).withColumn("_sift_cell", cell)
    marked = marked.join(F.broadcast(bits), "_sift_cell", "left")
    may = F.coalesce(F.expr(f"_sift_bits & ({_SIFT_MASK}) = ({_SIFT_MASK})"), F.lit(False))
    return tuple(marked.where(part).select(rows.columns) for part in (may, ~may))


def _of_documents(docs: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """sifted() by doc_id and text_hash."""
    hashed = lambda doc_id, text_hash: F.xxhash64(doc_id.cast("string"), text_hash)
    return sifted(docs, hashed(docs["doc_id"], F.xxhash64(docs["text"])), keys, hashed(keys["doc_id"], keys["text_hash"]))


def _same(docs: DataFrame, keys: DataFrame) -> Column:
    return docs["doc_id"].eqNullSafe(keys["doc_id"]) & F.xxhash64(docs["text"]).eqNullSafe(keys["text_hash"])


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id and text aren't among gone (doc_id, text_hash).

    Rows that a filter of the keys lets through are shuffled to the keys by doc_id and text, so copies of a text part; the
    others, nearly all if few keys are gone, never move. Exact for any number of keys, and one plan for all of them.
    """
    may, rest = _of_documents(docs, gone)
    return rest.unionAll(may.join(gone.hint("shuffle_hash"), _same(may, gone), "left_anti"))


def perhaps_within(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id and text are among wanted (doc_id, text_hash), and some others; nothing is shuffled."""
    return _of_documents(docs, wanted)[0]


def _delete(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session may be gone already
        return


def _forget() -> None:
    while _written:
        _delete(*_written.pop())
