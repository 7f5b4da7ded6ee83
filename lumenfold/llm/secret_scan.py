"""Secret scans: fixed patterns, and dictionary-primed zstandard novelty for what no pattern names.

A candidate is an unbroken string of 16 or more key characters, with letters and digits, that begins within
CONTEXT_REACH characters after a sensitive word on its line and touches no base span. Its novelty is the number of bytes that
it adds to a zstandard frame primed with the identifier dictionary and the surrounding text, over its length. Identifiers,
paths and repeated values compress against that; random keys don't and are reported as kind novel.

Work is text by text in Arrow batches: no shuffle, memory bounded by a batch of BATCH_ROWS texts.

Defined results: null is the empty text, which has no spans; spans of one start come by kind as listed, then by end; spans count code points, the end is exclusive; repeated
documents are judged row by row; an empty table gives an empty result; other columns pass through redacted() untouched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.runtime import ship

KINDS = ("assign", "access", "hex", "novel")
BATCH_ROWS = 1000
CONTEXT_REACH = 48
SURROUND = 256
#: Added bytes per character from which a candidate is a secret.
NOVELTY = 0.8


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = re.compile("(?:" + "|".join(map(_either, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]{16,}")  # a maximal run: nothing shorter fits within a longer one
HEX = re.compile("[0-9a-f]{24,}")
SENSITIVE = re.compile("|".join(map(_either, ("api", "auth", "bearer", "cred", "key", "pass", "private", "pwd", "secret", "signature", "token"))))
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")

#: Names and values that stand in code around secrets without being any.
IDENTIFIERS = """access_token refresh_token id_token api_key apikey api-key client_id client_secret secret_key secret_access_key
private_key public_key ssh-rsa ssh-ed25519 authorization bearer basic password passwd username user_name credentials credential
session_id session_token csrf_token x-api-key application/json application/x-www-form-urlencoded content-type accept-encoding
get_access_token set_access_token validate_token refresh_credentials load_private_key read_public_key default_password
example_secret your_api_key_here changeme placeholder undefined null true false none test_token dummy_token environment
configuration settings options parameters arguments function return import export class const static final string integer
boolean timestamp expires_in expiration created_at updated_at https://api.example.com/v1/ localhost 127.0.0.1 development
production staging abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0000000000000000 1234567890 xxxxxxxxxxxxxxxx"""


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def _compressor(around: bytes):
    import zstandard

    primed = zstandard.ZstdCompressionDict(IDENTIFIERS.encode() + b"\n" + around, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=9, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False)


def novelty(candidate: str, around: str) -> float:
    """Bytes that candidate adds to a frame primed with the dictionary and its surroundings, per character."""
    compress = _compressor(around.encode()).compress
    return (len(compress(candidate.encode())) - len(compress(b""))) / len(candidate)


def contexts(text: str) -> Iterator[tuple[int, int]]:
    """Where candidates may begin: from the end of a sensitive word to CONTEXT_REACH characters on or the line's end.

    Reaches that meet are one context. The last one grows while words are found, so contexts come as they are closed.
    """
    first = reach = None
    for word in SENSITIVE.finditer(text):
        end = word.end()
        stop = text.find("\n", end, end + CONTEXT_REACH)
        stop = stop if stop >= 0 else end + CONTEXT_REACH
        if reach is not None and end < reach:
            reach = max(reach, stop)
            continue
        if reach is not None:
            yield first, reach
        first, reach = end, stop
    if reach is not None:
        yield first, reach


def candidates(text: str) -> Iterator[re.Match]:
    """Candidates of all contexts, left to right; a context that begins within a candidate goes on from its end.

    A match that lies beyond a context is kept for the next, so the text is searched once.
    """
    ahead, end = None, 0
    for at, reach in contexts(text):
        at = max(at, end)
        while True:
            if ahead is None or ahead.start() < at:
                ahead = CANDIDATE.search(text, at)
                if ahead is None:
                    return
            if ahead.start() >= reach:
                break
            yield ahead
            at = end = ahead.end()


def novel_spans(text: str, taken: list[tuple[int, int, str]], least: float = NOVELTY) -> list[tuple[int, int, str]]:
    found, at, reach = [], 0, 0  # reach is the largest end of the taken spans that begin before the candidate's end
    taken = sorted(taken)
    for m in candidates(text):
        while at < len(taken) and taken[at][0] < m.end():
            reach = max(reach, taken[at][1])
            at += 1
        value = m[0]
        if reach > m.start() or not (any(map(str.isdigit, value)) and any(map(str.isalpha, value))):
            continue
        around = text[max(0, m.start() - SURROUND) : m.start()] + text[m.end() : m.end() + SURROUND]
        if novelty(value, around) >= least:
            found.append((m.start(), m.end(), "novel"))
    return found


def spans_of(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans and all spans (start, end, kind), each by start, then kind as listed."""
    order = lambda s: (s[0], KINDS.index(s[2]), s[1])
    base = sorted(base_spans(text), key=order)
    return base, sorted(base + novel_spans(text, base), key=order)


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans: arrays of (start, end, kind)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                found = [spans_of(t.as_py() or "") for t in part.column(1)]
                as_rows = lambda k: pa.array([[{"start": a, "end": b, "kind": c} for a, b, c in f[k]] for f in found], span)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([part.column(0), as_rows(0), as_rows(1)], ["doc_id", "base", "spans"])

    ship(docs.sparkSession)
    row = "array<struct<start:bigint,end:bigint,kind:string>>"
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, f"doc_id bigint, base {row}, spans {row}")


def redact(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with every span, overlapping ones together, replaced by the mark."""
    spans = spans_of(text or "")[1]
    out, at = [], 0
    for a, b, _ in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]]) if spans else text


def redacted(docs: DataFrame) -> DataFrame:
    """docs, all rows and columns, with secrets in text replaced; n_chars, if there is one, follows the text."""
    names = docs.columns
    k = names.index("text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                texts = pa.array([redact(t.as_py()) for t in part.column(k)], part.schema.field(k).type)
                columns = [texts if i == k else c for i, c in enumerate(part.columns)]
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    ship(docs.sparkSession)
    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def op8_secret_scan(docs: DataFrame) -> DataFrame:
    """The contract's digest of secrets()."""
    of_kind = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return secrets(docs).select("doc_id", of_kind("assign").alias("n_assign"), of_kind("access").alias("n_access"), of_kind("hex").alias("n_hex"), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
