"""Hard rows that every operator has to take, and plain helpers for brute-force versions."""

import random
import re

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, words string, key string, kept boolean, path string, fp bigint, _row int, token string, spans string"


def prose(seed, n, lang="en"):
    rng = random.Random(f"{seed}{lang}")
    parts = {"en": ["the", "ing", "tion", "er", "and", "wh"], "de": ["sch", "ung", "keit", "ein", "der", "ü"], "fr": ["eau", "le", "què", "ment", "oi", "é"]}[lang]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


def rows(texts, langs=("en", "de", "fr")):
    """Rows of SCHEMA with clashing further columns, ids from 0; a null language and a null source among them."""
    return [(i, t, None if i % 7 == 6 else langs[i % len(langs)], None if i % 5 == 4 else f"s{i % 2}", None if t is None else len(t), "x", "y", None, "z", 1, 2, "w", "v") for i, t in enumerate(texts)]


def frame(spark, texts, **kw):
    return spark.createDataFrame(rows(texts, **kw), SCHEMA)


HARD = [None, "", " \t\n", "one", "a b", "\x00 odd \x1f bytes 　 wide", "émoji 😀 ünï ÀÉ", "x" * 3000, "1" * 2000, "same same same same same same same same same same same same", "repeat me twice\nrepeat me twice\nrepeat me twice", None, "", "Licensed under the MIT License.", prose(1, 400), prose(1, 400), prose(2, 20000)]


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))
