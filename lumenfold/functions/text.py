"""Scalar functions over text: labels, option letters, options, boxes, tokens, captions and subtitle blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenfold.functions import terms

ALONE, OPTION = terms.ALONE, terms.OPTION


def _one_of(words) -> str:
    return f"(?:{'|'.join(words)})"


def _cues() -> tuple[str, ...]:
    """Patterns of a letter from A to F, the surest first: after a cue word and a link, after a verdict, as the value of a quoted
    field, and in parentheses."""
    letter = "([A-F])"
    bracketed = rf"\s*\(?\s*{letter}"
    fields = [f"{q}{_one_of(terms.ANSWER_FIELDS)}{q}{chr(92)}s*:{chr(92)}s*{q}{letter}{q}" for q in "\"'"]
    return tuple("(?i)" + p for p in (_one_of(terms.ANSWER_CUES) + r"\s*" + _one_of(terms.ANSWER_LINKS) + "?" + bracketed, _one_of(terms.VERDICT_CUES) + bracketed, *fields, rf"\({letter}\)"))


LETTER_CUES = _cues()


def any_of(text: Column, words) -> Column:
    """True if the text contains any of the words as a substring."""
    found = F.lit(False)
    for word in words:
        found = found | text.contains(word)
    return found


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalize_label(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def last_match(text: Column, pattern: str) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(-1))


def answer_letter(text: Column) -> Column:
    """The option letter that a model's answer names, upper-cased; null if it names none.

    An answer that is a letter but for brackets and stops counts first, then the cues, a line of its own, and in answers of 120
    characters or fewer any letter that is a word; of several the last.
    """
    t = F.trim(text)
    bare = F.upper(F.regexp_replace(t, r"^[(\s]+|[).,\s]+$", ""))
    found = [last_match(t, cue) for cue in (*LETTER_CUES, ALONE)]
    word = F.when(F.length(t) <= 120, last_match(t, r"(?i)\b([A-F])\b"))
    return F.when(bare.isin(*"ABCDEF"), bare).otherwise(F.upper(F.coalesce(*found, word)))


def first_letter(text: Column, letters: str = "A-E") -> Column:
    """The legacy rule: the first letter of the range anywhere in the upper-cased text."""
    return F.nullif(F.regexp_extract(F.upper(text), f"([{letters}])", 1), F.lit(""))


def short_answer_correct(expected: Column, response: Column) -> Column:
    """Yes and no by the first word, other answers by containment either way, after normalisation."""
    stripped = F.coalesce(F.nullif(F.trim(F.regexp_extract(response, r"(?is)(?:final\s*answer|answer|答案)\s*[:：]\s*(.+)$", 1)), F.lit("")), F.trim(response))
    e, p = normalize_label(F.coalesce(expected, F.lit(""))), normalize_label(F.coalesce(stripped, F.lit("")))
    return F.when((e == "") | (p == ""), False).when(e == p, True).when(e.isin("yes", "no"), F.get(F.split(p, " "), F.lit(0)) == e).otherwise(p.contains(e) | e.contains(p))


def label_list(text: Column) -> Column:
    """Normalised labels: quoted items if there are any, else parts between commas, semicolons and slashes."""
    t = F.coalesce(text, F.lit(""))
    quoted = F.transform(F.regexp_extract_all(t, F.lit("'([^']+)'|\"([^\"]+)\""), F.lit(0)), lambda x: F.substring(x, F.lit(2), F.length(x) - 2))
    items = F.when(F.size(quoted) > 0, quoted).otherwise(F.split(t, "[,;/]"))
    return F.filter(F.transform(items, normalize_label), lambda x: x != "")


def label_hits(labels: Column, response: Column) -> Column:
    """The first eight labels that the normalised response contains."""
    r = normalize_label(F.coalesce(response, F.lit("")))
    return F.slice(F.filter(labels, lambda x: (x != "") & r.contains(x)), 1, 8)


def options(question: Column) -> Column:
    """Array of (letter, text) of the options in a question, by letter; the last of a letter counts."""
    q = F.coalesce(question, F.lit(""))
    pairs = F.arrays_zip(F.regexp_extract_all(q, F.lit(OPTION), F.lit(1)).alias("letter"), F.transform(F.regexp_extract_all(q, F.lit(OPTION), F.lit(2)), collapse).alias("text"))
    final = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda later: later["letter"] == p["letter"]))
    return F.array_sort(final)


def bbox(text: Column) -> Column:
    """The last `bbox: [a, b, c, d]` as an array of doubles clamped to [0, 1]; null unless ordered."""
    number = r"\s*(-?[0-9]*\.?[0-9]+)\s*"
    found = F.try_element_at(F.regexp_extract_all(text, F.lit(rf"(?i)bbox[^\[]*\[({number},{number},{number},{number})\]"), F.lit(1)), F.lit(-1))
    raw = F.transform(F.split(found, ","), lambda x: F.trim(x).try_cast("double"))
    box = F.transform(raw, lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))
    at = lambda i: F.get(box, F.lit(i))
    return F.when((at(0) < at(2)) & (at(1) < at(3)), box)


def tokens(text: Column, stopwords, cap: int | None = None, digits: bool = True) -> Column:
    """Distinct lower-case alphanumeric tokens of three characters or more (or, with digits, all digits), by first occurrence."""
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " ")), " ")
    long = lambda w: F.length(w) >= 3
    kept = F.filter(words, lambda w: ((long(w) | w.rlike("^[0-9]+$")) if digits else long(w)) & ~w.isin(*stopwords))
    found = F.array_distinct(kept)
    return F.slice(found, 1, cap) if cap else found


def query_terms(question: Column) -> Column:
    return tokens(question, terms.TRANSCRIPT_STOPWORDS, 80)


def evidence_terms(question: Column) -> Column:
    return tokens(question, terms.EVIDENCE_STOPWORDS)


def option_terms(text: Column) -> Column:
    return tokens(text, terms.OPTION_STOPWORDS, digits=False)


#: The control characters 128 to 159 mean those of Windows-1252 in references.
_CONTROLS = {n: bytes([n]).decode("cp1252") for n in range(128, 160) if n not in (129, 141, 143, 144, 157)}


def unescaped(text: Column) -> Column:
    """The text with its character references resolved once: named ones of HTML 4, decimal and hexadecimal ones."""
    from html.entities import name2codepoint

    names = F.create_map(*(F.lit(x) for name, code in {**name2codepoint, "apos": 39}.items() for x in (name, chr(code))))
    controls = F.create_map(*(F.lit(x) for pair in _CONTROLS.items() for x in pair))

    def character(code: Column) -> Column:
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        own = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code).otherwise(0xFFFD)), 8, "0")), "UTF-32")
        return F.when(code.isNotNull(), F.coalesce(F.try_element_at(controls, code.cast("int")), own))

    def resolved(part: Column) -> Column:
        name = F.regexp_extract(part, "^(#[0-9]{1,9}|#[xX][0-9a-fA-F]{1,7}|[A-Za-z][A-Za-z0-9]*);", 1)
        number = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 9), 16, 10)).when(name.startswith("#"), F.substring(name, 2, 9)).try_cast("bigint")
        value = F.when(name != "", F.coalesce(character(number), F.try_element_at(names, name)))
        return F.when(value.isNull(), F.concat(F.lit("&"), part)).otherwise(F.concat(value, F.substr(part, F.length(name) + 2)))

    parts = F.transform(F.split(text, "&"), lambda p, i: F.when(i == 0, p).otherwise(resolved(p)))
    return F.when(text.contains("&"), F.array_join(parts, "")).otherwise(text)


def clean_caption(text: Column) -> Column:
    """Caption text without references, tags and position codes, spaces collapsed."""
    t = unescaped(F.coalesce(text, F.lit("")))
    t = F.regexp_replace(F.regexp_replace(t, "<[^>]+>", " "), r"\{\\[^}]+\}", " ")
    return F.trim(F.regexp_replace(t, r"[\s\x{00A0}]+", " "))


def clock_seconds(text: Column) -> Column:
    """Seconds of H:MM:SS,mmm, MM:SS or S text, to the millisecond; 0 if it can't be read."""
    parts = F.split(F.get(F.split(F.trim(F.replace(text, F.lit(","), F.lit("."))), r"\s+"), F.lit(0)), ":")
    whole = lambda i: F.get(parts, F.lit(i)).try_cast("int")
    real = lambda i: F.get(parts, F.lit(i)).try_cast("double")
    value = F.when(F.size(parts) == 3, whole(0) * 3600 + whole(1) * 60 + real(2)).when(F.size(parts) == 2, whole(0) * 60 + real(1)).when(F.size(parts) == 1, real(0))
    return F.round(F.coalesce(value, F.lit(0.0)), 3)


def clock_text(seconds: Column) -> Column:
    """HH:MM:SS,mmm of a number of seconds, half a millisecond to even."""
    ms = F.bround(F.greatest(seconds, F.lit(0.0)) * 1000).cast("bigint")
    return F.concat(F.lpad(F.floor(ms / 3600000).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.floor(ms / 60000) % 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.floor(ms / 1000) % 60).cast("string"), 2, "0"), F.lit(","), F.lpad((ms % 1000).cast("string"), 3, "0"))


def subtitle_segments(text: Column) -> Column:
    """Array of (sequence_index, start_sec, end_sec, text) of SubRip text; blocks without caption leave gaps in the index."""
    unix = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")
    blocks = F.filter(F.split(unix, r"\n\s*\n"), lambda b: F.trim(F.regexp_replace(b, r"\s+", " ")) != "")

    def parsed(block: Column, i: Column) -> Column:
        lines = F.filter(F.transform(F.split(block, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
        times = F.get(F.filter(lines, lambda x: x.contains("-->")), F.lit(0))
        caption = clean_caption(F.array_join(F.filter(lines, lambda x: ~x.contains("-->") & ~x.rlike("^[0-9]+$")), " "))
        arrow = F.split(times, "-->", 2)
        row = F.struct((i + 1).alias("sequence_index"), clock_seconds(F.get(arrow, F.lit(0))).alias("start_sec"), clock_seconds(F.get(arrow, F.lit(1))).alias("end_sec"), caption.alias("text"))
        return F.when((F.size(lines) >= 2) & times.isNotNull() & (caption != ""), row)

    return F.filter(F.transform(blocks, parsed), lambda r: r.isNotNull())


def subtitle_block(number: Column, start: Column, end: Column, text: Column) -> Column:
    return F.concat(number.cast("string"), F.lit("\n"), clock_text(start), F.lit(" --> "), clock_text(end), F.lit("\n"), collapse(text), F.lit("\n"))


def ellipsis(text: Column, n: int) -> Column:
    t = collapse(F.coalesce(text, F.lit("")))
    return F.when(F.length(t) > n, F.concat(F.rtrim(F.substring(t, 1, n - 3)), F.lit("..."))).otherwise(t)


def people_counts(text: Column) -> Column:
    """Struct (men, women) of `men=3 women=2` text; null where absent. `men=` also matches inside `women=`."""
    number = lambda word: F.nullif(F.regexp_extract(F.lower(text), rf"{word}\s*[=:]\s*([0-9]+)", 1), F.lit("")).try_cast("int")
    return F.struct(number("men").alias("men"), number("women").alias("women"))


def record_key_parts(key: Column) -> Column:
    """Struct (video_id, question_id) of `video:{video_id}:{question_id}`; the video id may hold colons."""
    return F.struct(F.regexp_extract(key, "^video:(.*):([^:]+)$", 1).alias("video_id"), F.regexp_extract(key, "^video:(.*):([^:]+)$", 2).alias("question_id"))
