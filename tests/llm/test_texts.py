"""Token counts, secret scans, language identification, the pipeline and the registry."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest

from lumenfold.llm import language_crf, queries, secret_scan, token_counts
from tests.llm.cases import HARD, SCHEMA, frame, prose, space_words


def brute_tokens(word, scores):
    """Best segmentation of one word: all of its prefixes, no sharing."""
    best = [(0.0, 0)]
    for j in range(1, len(word) + 1):
        options = [(best[i][0] + scores[word[i:j]], best[i][1] + 1) for i in range(j) if word[i:j] in scores]
        if word[j - 1] not in scores:
            n = len(word[j - 1].encode())
            options.append((best[j - 1][0] + n * token_counts.BYTE_SCORE, best[j - 1][1] + n))
        best.append(max(options, key=lambda o: (o[0], -o[1])))
    return best[-1][1]


@pytest.mark.skipif(not os.path.exists(token_counts.VOCABULARY), reason="no vocabulary")
def test_op7_equals_brute_force_and_a_public_library(spark, monkeypatch):
    texts = [*HARD[:-1], "Grüße, 東京 tokyo 😀 x\x85y", prose(9, 300, "fr"), "12345 https://example.com/a?b=c"]
    scores = token_counts.vocabulary()
    got = {r.doc_id: (r.n_words, r.n_tokens, r.n_bytes) for r in token_counts.op7_token_counts(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        words = space_words(t)
        assert got[i] == (len(words), sum(brute_tokens(token_counts.MARK + w, scores) for w in words), len((t or "").encode())), t
    from tokenizers.models import Unigram

    model = Unigram([("<unk>", -1e3), *scores.items()], 0, False)
    trie = token_counts.Trie(token_counts.Pieces(scores))
    for w in space_words(prose(10, 500, "de") + " " + prose(11, 500)):
        assert trie.insert(token_counts.MARK + w) == len(model.tokenize(token_counts.MARK + w))
    before = len(trie.best)
    trie.insert(token_counts.MARK + space_words(prose(10, 1, "de"))[0])
    assert len(trie.best) == before  # shared prefixes make no new node
    assert token_counts.op7_token_counts(frame(spark, [])).count() == 0


def test_trie_breaks_ties_by_fewer_tokens():
    trie = token_counts.Trie(token_counts.Pieces({"a": -1.0, "aa": -2.0, "b": -1.0}))
    assert [trie.insert(w) for w in ("a", "aa", "aaa", "aaaab", "é", "aéa")] == [1, 1, 2, 3, 2, 4]


PATTERNS = {"assign": r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}


def brute_secrets(text):
    found = [(m.start(), k, m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "", (re.I | re.A) if k == "assign" else 0)
             if {"assign": lambda m: len(m[2]) >= 6, "access": lambda m: len(m[0]) >= 20, "hex": lambda m: len(m[0]) >= 24}[k](m)]
    return sorted(found, key=lambda s: (s[0], list(PATTERNS).index(s[1])))


SECRETS = ["password: token: abcdefgh", "token=secret=abcdefgh", "API_KEY = 'abc-def/123=' apikey:\"x1\" ApiKey=123456", "AKIA" + "A" * 15 + " AKIA" + "B" * 16 + "c AKIAAKIA" + "9" * 20, "f" * 23 + " " + "a1" * 12 + "g" + "0" * 30,
           "ſecret=abcdefgh toKen=abcdefgh", "token = \"" + "ab12" * 10 + "\"", "😀 secret=aaaaaa", "secret\n=abcdefgh passwd   =   zzzzzz", "passwordpassword=123456password=1"]
KEY = "q7Zp0XvT9kLm3RsW8yBn2HdC5fGj1aEu"


def test_op8_base_equals_brute_force(spark):
    texts = [*HARD, *SECRETS]
    got = {r.doc_id: r for r in secret_scan.op8_secret_scan(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        base = brute_secrets(t)
        text = ",".join(f"{k}:{a}:{b}" for a, k, b in base)
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest(), t
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(k == x for _, k, _ in base) for x in PATTERNS]
        assert {s for s in got[i].spans.split(",") if not s.startswith("novel")} == set(text.split(","))
    assert secret_scan.op8_secret_scan(frame(spark, [])).count() == 0


def test_novelty_tells_keys_from_names():
    spans = lambda t: [t[a:b] for a, b, k in secret_scan.spans_of(t)[1] if k == "novel"]
    assert spans(f"Authorization: Bearer {KEY} ok") == [KEY]
    assert spans(f"private key {KEY}") == [KEY]
    assert spans(f"nothing about it here {KEY}") == []
    assert spans("key get_access_token_2 validate_token1") == []
    assert spans("auth abcdefghijklmnopqrstuvwxyz0123456789") == []
    assert spans(f"the key {KEY} and again the key {KEY}") == []  # a repeated value compresses against its surroundings
    assert not any(spans(prose(s, 400)) for s in range(10))
    rng = random.Random(5)
    random_keys = ["".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40)) for _ in range(50)]
    assert sum(spans(f"client secret is {k}.") == [k] for k in random_keys) >= 49


def test_novelty_after_a_word_within_an_earlier_reach():
    value = "Zk83hQ7Lw0pXs92VbT5r"
    text = f"The api for partners needs this long lived signing key: {value}"
    assert secret_scan.novel_spans(text, []) == [(56, 76, "novel")]
    assert secret_scan.redact(text).endswith("key: [SECRET]")
    for gap in range(48):  # a later word's reach counts, wherever it ends within an earlier one's
        assert secret_scan.novel_spans(f"secret a a a a a the key{' ' * gap}{value}", []) == [(24 + gap, 44 + gap, "novel") if gap else (21, 44, "novel")], gap


def brute_novel(text, taken):
    contexts = []
    for word in secret_scan.SENSITIVE.finditer(text):
        line = text[word.end() : word.end() + 48]
        stop = word.end() + (line.index("\n") if "\n" in line else 48)
        if contexts and word.end() < contexts[-1][1]:
            contexts[-1][1] = max(contexts[-1][1], stop)
        else:
            contexts.append([word.end(), stop])
    found, end = [], 0
    for at, reach in contexts:
        for m in secret_scan.CANDIDATE.finditer(text, max(at, end)):
            if m.start() >= reach:
                break
            end = m.end()
            around = text[max(0, m.start() - 256) : m.start()] + text[m.end() : m.end() + 256]
            if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) and not any(a < m.end() and m.start() < b for a, b, _ in taken) and secret_scan.novelty(m[0], around) >= secret_scan.NOVELTY:
                found.append((m.start(), m.end(), "novel"))
    return found


def test_novel_spans_equal_brute_force_on_random_texts():
    rng, found = random.Random(1), 0
    pieces = ["secret", "a", "b ", "key", " ", "\n", "token=", "api_key: ", "AKIA" + "B" * 16, "f" * 24, "x9" * 4, "auth"]
    for _ in range(1500):
        text = "".join(rng.choice(pieces) if rng.random() < 0.7 else "".join(rng.choices("ABCdefGHIjkl0123456789+/_", k=rng.randint(10, 30))) for _ in range(rng.randint(1, 40)))
        base = secret_scan.base_spans(text)
        got = secret_scan.novel_spans(text, base)
        assert got == brute_novel(text, base), text
        found += len(got)
    assert found > 300


def test_secrets_of_very_long_texts_take_linear_time():
    import time

    began = time.process_time()
    for text in ("some token filler line\n" * 220_000, "token " * 900_000, "key" + "x1" * 2_500_000):
        assert secret_scan.spans_of(text)[1] == []
    assert time.process_time() - began < 30  # about 3 seconds; the square of the length would be hours


def test_redacted_keeps_rows_and_columns(spark):
    texts = [None, "", "token = abcdef1234 end", f"key {KEY} x password=hunter22x", prose(1, 50)]
    docs = frame(spark, texts)
    out = secret_scan.redacted(docs.union(docs))
    assert out.schema.simpleString() == docs.schema.simpleString() and out.count() == 10
    got = {r.doc_id: r for r in out.collect()}
    assert [got[i].text for i in range(5)] == [None, "", "[SECRET] end", "key [SECRET] x [SECRET]", texts[4]]
    assert got[2].n_chars == len("[SECRET] end") and got[2].words == "x" and got[2].lang == docs.where("doc_id = 2").first().lang
    assert secret_scan.redact("a" + "token=" + "ab12" * 10) == "a[SECRET]"  # overlapping spans together
    assert secret_scan.redacted(frame(spark, [])).count() == 0


def test_op9_learns_and_is_held_to_account(spark):
    langs = ("en", "de", "fr")
    rows = [(i, prose(i, 20 + i % 60, langs[i % 3]), langs[i % 3]) for i in range(300)]
    rows += [(300, None, "en"), (301, "12 !!", "de"), (302, "", None), (303, prose(1, 30, "de"), None), (304, prose(2, 20000, "fr"), "fr"), (None, prose(3, 30), "de")]
    docs = spark.createDataFrame([(*r, "clash", 0.5) for r in rows], "doc_id bigint, text string, lang string, o string, score double")
    got = {r.doc_id: r for r in language_crf.op9_language_id(docs).collect()}
    assert len(got) == len(rows)
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(305)) and got[None].held_out is False
    out = [i for i in range(300) if got[i].held_out]
    assert sum(got[i].lang_pred == langs[i % 3] for i in out) >= 0.97 * len(out) > 40
    assert [(got[i].lang_pred, got[i].score) for i in (300, 301, 302)] == [("und", 0.0)] * 3
    assert (got[303].lang_pred, got[304].lang_pred, got[None].lang_pred) == ("de", "fr", "en")
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language_crf.op9_language_id(docs.limit(0)).count() == 0
    unlabelled = language_crf.op9_language_id(docs.selectExpr("doc_id", "text", "cast(null as string) lang"))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}


def test_forward_backward_equals_enumeration():
    import itertools

    rng = np.random.default_rng(0)
    k, counts = 3, [4, 1, 5]
    scores, transition = rng.normal(size=(sum(counts), k)), rng.normal(size=(k, k))
    first = np.cumsum([0, *counts[:-1]])
    post, pairs = language_crf.marginals(scores, first, np.array(counts), transition, total=True)
    want, joint = np.zeros_like(post), np.zeros((k, k))
    for f, n in zip(first, counts, strict=True):
        paths = list(itertools.product(range(k), repeat=n))
        weight = np.exp([sum(scores[f + t, y[t]] for t in range(n)) + sum(transition[y[t - 1], y[t]] for t in range(1, n)) for y in paths])
        weight /= weight.sum()
        for y, w in zip(paths, weight, strict=True):
            for t in range(n):
                want[f + t, y[t]] += w
                if t:
                    joint[y[t - 1], y[t]] += w
    assert np.allclose(post, want) and np.allclose(pairs, joint)


def test_words_of_code_switched_text_are_labelled():
    rows = [(prose(i, 60, lang), lang) for i in range(60) for lang in ("de", "en", "fr")]
    labels = ["de", "en", "fr"]
    weights = language_crf.train(rows, labels)
    assert weights["transition"].shape == (3, 3) and np.diag(weights["transition"]).min() > 0
    right = total = 0
    for i in range(200, 220):
        words = language_crf.Words([prose(i, 25, "de") + ", " + prose(i, 25, "fr")])
        post = language_crf.marginals(language_crf.emissions(words, weights), words.first, words.count, weights["transition"])
        right += sum(post.argmax(axis=1) == [0] * 25 + [2] * 25)
        total += 50
    assert right >= 0.95 * total


def test_word_labels_of_code_switched_text(spark):
    rows = [(prose(i, 60, lang), lang) for i in range(60) for lang in ("de", "fr")]
    weights = language_crf.train(rows, ["de", "fr"])
    texts = [prose(300, 20, "de") + ", " + prose(300, 20, "fr"), None, "12 !!", ""]
    got = {r.doc_id: r["words"] for r in language_crf.word_labels(frame(spark, texts), ["de", "fr"], weights).collect()}
    assert [w.lang_pred for w in got[0]] == ["de"] * 20 + ["fr"] * 20
    assert " ".join(w.word for w in got[0]) == re.sub("[^a-zà-ÿ]+", " ", texts[0].lower()) and all(0 <= w.score <= 1 for w in got[0])
    assert got[1] == got[2] == got[3] == []
    assert {w.lang_pred for r in language_crf.word_labels(frame(spark, ["a b"]), [], {}).collect() for w in r["words"]} == {"und"}


def test_op9_without_letters_to_learn_from(spark):
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(["123", "!!", "", "½ ²", "abc", None] * 5)], "doc_id bigint, text string, lang string")
    blank = language_crf.op9_language_id(docs.where("text IS NULL OR text != 'abc'")).collect()
    assert len(blank) == 25 and {(r.lang_pred, r.score) for r in blank} == {("und", 0.0)}
    got = language_crf.op9_language_id(docs).collect()
    assert {(r.lang_pred, r.doc_id % 6 == 4) for r in got} == {("en", True), ("und", False)}
    assert not language_crf.lettered("½ ² ٣") and language_crf.lettered("1é")


def test_op9_learns_languages_of_long_texts_and_many_languages(spark):
    import string

    long = [(i, prose(i, 6000, lang), lang) for i, lang in enumerate(["en", "de"] * 6)]
    docs = spark.createDataFrame(long, "doc_id bigint, text string, lang string")
    assert min(len(t) for _, t, _ in long) > language_crf.SAMPLE_CHARS
    got = {r.doc_id: r.lang_pred for r in language_crf.op9_language_id(docs).collect()}
    assert got == {i: lang for i, _, lang in long}
    rng = random.Random(4)
    rows = []
    for k in range(70):
        letters = rng.sample(string.ascii_lowercase, 6)
        rows += [(len(rows) + j, " ".join("".join(rng.choices(letters, k=5)) for _ in range(30)), f"l{k:02d}") for j in range(8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels, weights = language_crf.learned(docs)
    assert labels == sorted({r[2] for r in rows}) and len(labels) == 70
    got = {r.doc_id: r.lang_pred for r in language_crf.identified(docs, labels, weights).collect()}
    assert sum(got[i] == lang for i, _, lang in rows) >= 0.9 * len(rows)


def test_every_operator_is_registered_once():
    names = list(queries.queries())
    assert sorted(int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))) == list(range(1, 11))
    assert [n for n in names if not n.startswith("op")] == ["url_rules", "quality_base_counts", "secret_base_spans", "personal_base_spans"]
    assert set(queries.oracle_sql()) <= set(names)


def test_oracles(spark):
    duckdb = pytest.importorskip("duckdb")
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    db = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        got = queries.queries()[name](spark, folder).toPandas()
        want = db.execute(sql).df()[list(got.columns)]
        key = lambda df: sorted(map(str, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))
        assert key(got) == key(want), name


def test_pipeline_on_a_small_corpus(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    item = prose(900, 40)
    texts = [prose(i, 60).capitalize() for i in range(80)]
    texts += [texts[0], texts[1].replace(" ", "  "), prose(901, 30) + " " + item + " " + prose(902, 30), f"{prose(903, 40)} token = abcdef123456 {prose(904, 20)}", " ".join(w + "$$$" for w in prose(905, 90).split()), "too short", None, ""]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "benchmark_decontamination", "secret_scans", "source_mixing"]
    read, seen = docs, {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, read, str(tmp_path))
        if name != "source_mixing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        read = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r.doc_id for r in read.collect()}
    assert seen["quality_rules"] == set(range(84))
    assert seen["simhash_near_dedup"] == set(range(84)) - {80, 81}
    assert seen["benchmark_decontamination"] == seen["secret_scans"] == set(range(84)) - {80, 81, 82}
    redacted = spark.read.parquet(f"{tmp_path}/secret_scans").where("doc_id = 83").first()
    assert "[SECRET]" in redacted.text and "abcdef" not in redacted.text and redacted.n_chars == len(redacted.text)
    assert len(seen["source_mixing"]) > 70
    whole = pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, read.collect()))
    assert SCHEMA
