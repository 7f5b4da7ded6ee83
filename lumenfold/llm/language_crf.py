"""Language identification by a linear-chain conditional random field over words.

A word is a maximal run of letters (a-z after lower-casing, and every non-ASCII byte). Its emission scores are sums of
learned weights of its byte bigrams and trigrams with their boundaries, its prefix and suffix of three bytes, and its
lexicon entry (the whole word); all are hashed into tables of 65,536 rows. Learned transitions tie neighbouring words, and
forward-backward gives each word's probability of each language. A document takes the language with the largest mean
probability, which is its score.

Every language of the labelled documents is learned, from a sample of at most SAMPLE_DOCS documents (the first by a hash of
doc_id and text). Of a text longer than SAMPLE_CHARS characters an excerpt is taken, of all texts fewer characters and words
where there are many languages, so that the sample's bound holds for any number of them. Sampled words are cut into windows of
WINDOW words; every fourth window is spliced with one of another language, so that the transitions see code-switching. Counts
and predictions cover all documents, and whole texts.

Prediction is text by text in Arrow batches: no shuffle, memory bounded by CHUNK_BYTES of text, or by one longer text.
word_labels() gives the language of each word of code-switched text.

Defined results: null text, or text without a letter (str.isalpha), is und with score 0, as is every text if nothing could be
learned; a language whose labelled documents have no letter can't be learned and isn't predicted;
ties go to the smallest label; a row without doc_id isn't held out and isn't learned from; repeated documents are judged
row by row; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.runtime import ship

#: Documents of a language in the sample; characters of one text at most, and over all languages; words times languages at most.
SAMPLE_DOCS, SAMPLE_CHARS, ALL_CHARS, WORK = 80, 20_000, 320_000, 8_000_000
WINDOW, STEPS, CHUNK_BYTES = 40, 25, 4 << 20
ROWS = 1 << 16
TABLES = ("bigram", "trigram", "prefix", "suffix", "lexicon")
ASCII_LETTER = re.compile("[A-Za-z]")
_P = np.uint64(0x9E3779B97F4A7C15)


def lettered(text: str | None) -> bool:
    """Whether there is a letter; number signs such as halves and superscripts are none."""
    return bool(text) and (bool(ASCII_LETTER.search(text)) or (not text.isascii() and any(map(str.isalpha, text))))


class Words:
    """Words of texts, and the table rows of their features."""

    def __init__(self, texts: list[str]):
        parts = [b" " + t.lower().encode("utf-8", "replace") + b" " for t in texts]
        self.bytes = b = np.frombuffer(b"".join(parts) + b"  ", np.uint8)
        letter = (b >= 0x80) | ((b >= 97) & (b <= 122))
        edge = np.flatnonzero(letter[1:] != letter[:-1]) + 1
        self.start, self.end = edge[::2], edge[1::2]
        ends_of_text = np.cumsum([len(p) for p in parts])
        self.first = np.searchsorted(self.start, ends_of_text - [len(p) for p in parts])
        self.count = np.searchsorted(self.start, ends_of_text) - self.first
        # a separator's byte counts as one boundary mark, so that punctuation doesn't matter
        c = np.where(letter, b, np.uint8(32)).astype(np.uint32)
        self.codes = c

    def rows(self, lo: int, hi: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Table rows of words lo to hi, and where each word's run of n-gram positions begins."""
        s, e = self.start[lo:hi], self.end[lo:hi]
        length = e - s + 1  # with the leading boundary
        offsets = np.concatenate(([0], np.cumsum(length)[:-1])) if len(length) else length
        at = np.repeat(s - 1 - offsets, length) + np.arange(int(length.sum()))
        c = self.codes
        a, b, d = c[at], c[at + 1], c[at + 2]
        big = a << 8 | b
        tri = ((big << np.uint32(8) | d) * np.uint32(2654435761)) >> np.uint32(16)
        mix = lambda x, y, z, k: ((((x << 8 | y) << 8 | z) + np.uint32(k)) * np.uint32(2246822519)) >> np.uint32(16)
        one = np.minimum(s + 1, e)
        prefix = mix(c[s], c[one], c[np.minimum(s + 2, e)], 1)
        suffix = mix(c[np.maximum(e - 3, s - 1)], c[np.maximum(e - 2, s - 1)], c[e - 1], 2)
        power = np.multiply.accumulate(np.full(int(length.max(initial=1)) + 1, _P))
        value = np.add.reduceat(b.astype(np.uint64) * power[at - np.repeat(s - 1, length)], offsets) if len(s) else np.zeros(0, np.uint64)
        lexicon = (value * _P) >> np.uint64(48)
        return {"bigram": big, "trigram": tri, "prefix": prefix, "suffix": suffix, "lexicon": lexicon.astype(np.int64)}, offsets


def emissions(words: Words, weights: dict[str, np.ndarray], cells: int = 1 << 19) -> np.ndarray:
    """Scores of each word and label, computed in blocks of words so that words times labels stay within cells."""
    out = np.zeros((len(words.start), weights["bigram"].shape[1]), np.float32)
    block = max(1 << 8, cells // max(1, out.shape[1]))
    for lo in range(0, len(out), block):
        rows, offsets = words.rows(lo, lo + block)
        grams = weights["bigram"][rows["bigram"]] + weights["trigram"][rows["trigram"]]
        out[lo : lo + block] = np.add.reduceat(grams, offsets, axis=0) + sum(weights[t][rows[t]] for t in TABLES[2:])
    return out


def marginals(scores: np.ndarray, first: np.ndarray, count: np.ndarray, transition: np.ndarray, total: bool = False):
    """Forward-backward over sequences of words (first, count): each word's probability of each label.

    All sequences advance together, longest first. With total, also the expected transitions, summed.
    """
    order = np.argsort(-count, kind="stable")
    first, count = first[order], count[order]
    lift = np.exp(scores - scores.max(axis=1, keepdims=True)) if len(scores) else scores
    forward, post, m = np.zeros_like(lift), np.zeros_like(lift), np.exp(transition).astype(lift.dtype)
    steps = int(count[0]) if len(count) else 0
    live = np.searchsorted(-count, -np.arange(steps), side="left")
    a = None
    for t in range(steps):
        n = live[t]
        here = first[:n] + t
        a = lift[here] if t == 0 else (a[:n] @ m) * lift[here]
        a /= a.sum(axis=1, keepdims=True)
        forward[here] = a
    back, pairs = np.zeros((0, m.shape[0]), lift.dtype), np.zeros_like(m, dtype=np.float64)
    for t in range(steps - 1, -1, -1):
        n = live[t]
        here = first[:n] + t
        ended = np.ones((n - len(back), m.shape[0]), lift.dtype)
        beta = np.concatenate((back, ended))  # those that go on come first
        p = forward[here] * beta
        p /= p.sum(axis=1, keepdims=True)
        post[here] = p
        into = lift[here] * beta
        if total and t:
            prior = forward[here - 1]
            joint = prior[:, :, None] * m * into[:, None, :]
            pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        back = into @ m.T
        back /= back.sum(axis=1, keepdims=True)
    return (post, pairs) if total else post


def train(rows: list[tuple[str, str]], labels: list[str], steps: int = STEPS, rate: float = 0.5, penalty: float = 1e-3) -> dict[str, np.ndarray]:
    """Weights from (text, label) rows: AdaGrad on the log-likelihood of the windows."""
    k = len(labels)
    words = Words([t for t, _ in rows])
    label = np.repeat([labels.index(y) for _, y in rows], words.count)
    features, offsets = words.rows(0, len(words.start))
    length = np.diff(np.append(offsets, len(features["bigram"])))
    spot = np.arange(len(label))
    windows = [spot[f + i : f + min(i + WINDOW, c)] for f, c in zip(words.first, words.count, strict=True) for i in range(0, c, WINDOW)]
    windows = [windows[i] for i in np.random.default_rng(1).permutation(len(windows))]
    spliced = []
    for i, w in enumerate(windows):  # half of one window, then half of the next of another language
        other = next((v for v in windows[i + 1 : i + 9] if label[v[0]] != label[w[0]]), None) if i % 4 == 0 else None
        spliced.append(w if other is None else np.concatenate((w[: WINDOW // 2], other[WINDOW // 2 :] if len(other) > WINDOW // 2 else other)))
    flat = np.concatenate(spliced)
    count = np.array([len(w) for w in spliced])
    first = np.concatenate(([0], np.cumsum(count)[:-1]))
    inner = np.ones(len(flat), bool)
    inner[first] = False
    seen = np.zeros((k, k))
    np.add.at(seen, (label[flat[:-1]][inner[1:]], label[flat[1:]][inner[1:]]), 1)
    weights = {t: np.zeros((ROWS, k), np.float32) for t in TABLES} | {"transition": np.zeros((k, k), np.float32)}
    past = {t: np.full(w.shape, 1e-8, np.float32) for t, w in weights.items()}
    # the mean gradient of a step; each word weighs the same
    for _ in range(steps):
        scores = emissions(words, weights)[flat]
        post, pairs = marginals(scores, first, count, weights["transition"], total=True)
        post[np.arange(len(flat)), label[flat]] -= 1
        error = np.zeros((len(label), k), np.float32)
        np.add.at(error, flat, post)
        slopes = {"transition": (pairs - seen).astype(np.float32)}
        for t in TABLES:
            rows_of = features[t].astype(np.int64)
            of_label = lambda j: np.repeat(error[:, j], length) if t in TABLES[:2] else error[:, j]  # noqa: B023, E731
            slopes[t] = np.stack([np.bincount(rows_of, of_label(j), ROWS) for j in range(k)], axis=1).astype(np.float32)
        for t, g in slopes.items():
            g = g / len(flat) + penalty * weights[t] / len(flat)
            past[t] += g * g
            weights[t] -= rate * g / np.sqrt(past[t])
    return weights


def predict(texts: list[str | None], labels: list[str], weights: dict[str, np.ndarray]) -> tuple[list[str], list[float]]:
    """Label and score of each text."""
    names, scores = ["und"] * len(texts), [0.0] * len(texts)
    known = [i for i, t in enumerate(texts) if labels and lettered(t)]
    words = Words([texts[i] for i in known])
    if len(words.start):
        post = marginals(emissions(words, weights), words.first, words.count, weights["transition"])
        mean = np.add.reduceat(post.astype(np.float64), words.first, axis=0) / words.count[:, None]
        for i, best, p in zip(known, mean.argmax(axis=1), np.clip(mean.max(axis=1), 0, 1), strict=True):
            names[i], scores[i] = labels[best], float(p)
    return names, scores


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def learned(docs: DataFrame, sample: int = SAMPLE_DOCS) -> tuple[list[str], dict[str, np.ndarray]]:
    """Labels and weights from documents that aren't held out."""
    usable = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    usable = usable.where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").where(~held_out())
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not counts:
        return [], {}
    most = max(500, min(SAMPLE_CHARS, ALL_CHARS // len(counts)))
    # some twice the sample passes the shares, so that it is nearly sure to be filled; the ranks then bound it
    shares = docs.sparkSession.createDataFrame([(y, min(1.0, (2 * sample + 16) / n)) for y, n in counts.items()], "lang string, share double")
    order = F.pmod(F.xxhash64("doc_id", "text", F.lit(9)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    chosen = usable.withColumn("o", order).join(F.broadcast(shares), "lang").where(F.col("o") < F.col("share"))
    # an excerpt from anywhere in the text, not only from its head
    start = F.floor(F.col("o") / F.col("share") * F.greatest(F.length("text") - most, F.lit(0))).cast("int") + 1
    chosen = chosen.select("lang", "o", F.substring("text", start, F.lit(most)).alias("text"))
    ranked = chosen.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("o", "text")))
    by: dict[str, list[str]] = {}
    for r in sorted(ranked.where(F.col("k") <= sample).collect(), key=lambda r: (r["lang"], r["k"])):
        if lettered(r["text"]):
            by.setdefault(r["lang"], []).append(r["text"])
    labels = sorted(by)
    if not labels:
        return [], {}
    each = max(4 * WINDOW, WORK // len(labels) ** 2)  # words of a label
    rows = []
    for y in labels:
        left = each
        for text in by[y]:
            words = text.split()
            rows.append((text if len(words) <= left else " ".join(words[:left]), y))
            left -= len(words)
            if left <= 0:
                break
    return labels, train(rows, labels)


def word_labels(docs: DataFrame, labels: list[str], weights: dict[str, np.ndarray]) -> DataFrame:
    """doc_id and words, an array of (word, lang_pred, score) in order: the language of each word by its own marginal.

    Words are lower-cased, as the model takes them; und stands for every word if nothing was learned.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((labels, weights))

    def of_text(text: str | None) -> list[dict]:
        labels, weights = shared.value
        words = Words([text or ""])
        raw = words.bytes.tobytes()
        names = [raw[a:b].decode("utf-8", "replace") for a, b in zip(words.start, words.end, strict=True)]
        if not labels:
            return [{"word": w, "lang_pred": "und", "score": 0.0} for w in names]
        post = marginals(emissions(words, weights), words.first, words.count, weights["transition"])
        return [{"word": w, "lang_pred": labels[p.argmax()], "score": float(p.max())} for w, p in zip(names, post, strict=True)]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("word", pa.string()), ("lang_pred", pa.string()), ("score", pa.float64())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([of_text(t.as_py()) for t in part.column(1)], kind)], ["doc_id", "words"])

    row = "array<struct<word:string,lang_pred:string,score:double>>"
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string")).mapInArrow(run, f"doc_id bigint, words {row}")


def identified(docs: DataFrame, labels: list[str], weights: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row. The weights (1.3 MB a label) go to executors as a broadcast."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((labels, weights))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        labels, weights = shared.value
        for batch in batches:
            texts, names, scores, pending, size = batch.column(2), [], [], [], 0
            for i in range(batch.num_rows):
                pending.append(t := texts[i].as_py())
                size += len(t or "")
                if size >= CHUNK_BYTES or i == batch.num_rows - 1:
                    found = predict(pending, labels, weights)
                    names, scores, pending, size = names + found[0], scores + found[1], [], 0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def op9_language_id(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return identified(docs, *learned(docs))
