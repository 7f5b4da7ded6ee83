"""URL filters, mixing, licences and personal data."""

import hashlib
import math
import re
from collections import defaultdict

import pytest

from lumenfold.llm import licenses, mixing, pii, url_filter
from tests.llm.cases import HARD, frame, prose, space_words

URLS = ["http://www.example.com/en/1?x", "https://a.example.com/en/2", "https://Example.COM/EN/2", "https://example.com/en", "http://notexample.com/en/", "https://x.net/es/9#t", "https://net/fr/", "https://x.net/es", "http://spam-farm.example.org/win/free-bonus", "https://library.example.org/about", None, "", "no scheme/path", "ftp://h", "a://b://c/d", "http://h?q=/x", "http://q\nx.org/a\nb", "x" * 5000 + "://" + "y" * 5000 + "/z"]


def brute_url(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
    best = None
    for domain, prefix, verdict in url_filter.RULES:
        if (host == domain or host.endswith("." + domain)) and path.startswith(prefix) and (best is None or len(domain + prefix) > len(best[0])):
            best = (domain + prefix, verdict)
    return host, path, best


def test_op1_rules_equal_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "h", "p", 1) for i, u in enumerate(URLS)], "page_id bigint, url string, host string, html string, score int")
    got = {r.page_id: r for r in url_filter.op1_url_filter(pages).collect()}
    for i, url in enumerate(URLS):
        host, path, rule = brute_url(url)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule and rule[0])
        assert got[i].verdict == (rule[1] if rule else "block" if got[i].score >= 0.5 else "allow")
    assert got[8].verdict == "block" and got[9].verdict == "allow"
    assert url_filter.op1_url_filter(pages.limit(0)).count() == 0


def test_op1_scores_equal_plain_regression(spark):
    labels = spark.createDataFrame(url_filter.labelled_urls(), "url string, label int")
    weights = url_filter.train(labels)
    scored = url_filter.judged(labels, weights).collect()
    assert sum((r.score >= 0.5) == bool(r.label) for r in scored) >= 0.97 * len(scored)
    grams = labels.select("url", url_filter.buckets_of(url_filter.host_of(labels.url), url_filter.path_of(labels.url)).alias("f")).collect()
    by_url = {r.url: r.f for r in grams}
    for r in scored[:20]:
        f = by_url[r.url]
        assert math.isclose(r.score, 1 / (1 + math.exp(-(weights[-1] + sum(weights[b] for b in f) / math.sqrt(len(f))))), rel_tol=1e-9)
    assert len(by_url[scored[0].url]) == sum(max(0, len(x) + 2 - n + 1) for x in brute_url(scored[0].url)[:2] for n in url_filter.SIZES)
    with pytest.raises(ValueError):
        url_filter.train(spark.range(url_filter.MAX_LABELS + 1).selectExpr("'http://a.b/c' url", "1 label"), 64)


def test_op1_blocks_unseen_hosts(spark):
    """Every fifth host is held out."""
    import zlib

    name = lambda url: url.split("/")[2].split(".example")[0].split(".")[-1]
    rows = url_filter.labelled_urls()
    held = [r for r in rows if zlib.crc32(name(r[0]).encode()) % 5 == 0]
    weights = url_filter.train(spark.createDataFrame([r for r in rows if r not in held], "url string, label int"))
    scored = url_filter.judged(spark.createDataFrame(held, "url string, label int"), weights).collect()
    assert len({name(r.url) for r in scored if r.label}) > 8
    assert sum((r.score >= 0.5) == bool(r.label) for r in scored) >= 0.95 * len(scored)


def brute_exponent(tokens, most=None, entropy=None):
    total = sum(tokens)
    low, high = 0.0, 1.0

    def at(e):
        w = [(t / total) ** e for t in tokens]
        z = sum(w)
        return max(x / z * total / t for x, t in zip(w, tokens)), -sum(x / z * math.log(x / z) for x in w)

    for _ in range(40):
        mid = (low + high) / 2
        if (at(mid)[0] > most) if most else (at(mid)[1] >= entropy * math.log(len(tokens))):
            low = mid
        else:
            high = mid
    return low if entropy else high


@pytest.mark.parametrize("tokens", [[1000, 10, 10, 50], [5, 5, 5], [100000, 1]])
def test_exponent_is_bisected(spark, tokens):
    sources = spark.createDataFrame([(t,) for t in [*tokens, 0]], "tokens bigint")
    for most in (1.0, 1.25, 3.0):
        e = mixing.exponent(sources, max_repeats=most)
        if len(set(tokens)) == 1 or most * min(tokens) * len(tokens) >= sum(tokens):
            assert e == 0.0
        else:
            assert math.isclose(e, brute_exponent(tokens, most=most), abs_tol=1e-6)
    if len(set(tokens)) > 1:
        assert math.isclose(mixing.exponent(sources, target_entropy=0.9), brute_exponent(tokens, entropy=0.9), abs_tol=1e-6)


def test_mixture_realises_the_weights(spark):
    texts = [prose(i, 20 + i % 30) for i in range(600)]
    docs = spark.createDataFrame([(i, t, None if i % 50 == 49 else "big" if i % 3 else "small", "x") for i, t in enumerate(texts)], "doc_id bigint, text string, source string, block string")
    rows = mixing.mixture(docs, max_repeats=1.5, block_tokens=2000).collect()
    assert {(r.doc_id, r.epoch) for r in rows} and len({(r.doc_id, r.epoch) for r in rows}) == len(rows)
    tokens, drawn = defaultdict(int), defaultdict(int)
    for i, t in enumerate(texts):
        tokens[None if i % 50 == 49 else "big" if i % 3 else "small"] += len(space_words(t))
    for r in rows:
        drawn[r.source] += r.n_tokens
        assert r.n_tokens == len(space_words(texts[r.doc_id]))
    e, total = brute_exponent(list(tokens.values()), most=1.5), sum(tokens.values())
    z = sum((t / total) ** e for t in tokens.values())
    for s, t in tokens.items():
        assert abs(drawn[s] - (t / total) ** e / z * total) <= 0.06 * t + 50  # whole documents at each block's cut
    epochs = defaultdict(set)
    for r in rows:
        epochs[r.doc_id].add(r.epoch)
    assert all(e == set(range(len(e))) for e in epochs.values())
    places = defaultdict(set)
    for r in rows:
        if r.epoch == 0:
            places[r.source, r.block].add(r.place)
    assert max(map(len, places.values())) < 200 and len(places) > 6


def test_hot_sources_and_ids_are_split_into_blocks(spark):
    """A source without tokens, and one doc_id of many texts, are many blocks; every row is drawn once at rate 1."""
    rows = [(i, "", "none") for i in range(3000)] + [(7, f"w{i} x", "one") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    drawn = mixing.mixture(docs, max_repeats=1.0, block_rows=100, keep=("text",)).collect()
    assert sorted((r.doc_id, r.text, r.source) for r in drawn) == sorted(rows)
    sizes = defaultdict(int)
    for r in drawn:
        sizes[r.source, r.block] += 1
    assert max(sizes.values()) < 200 and len(sizes) == 60


def test_mixing_of_hard_rows(spark):
    docs = frame(spark, HARD)
    once = mixing.mixture(docs.union(docs), max_repeats=1.0).collect()
    assert sorted(r.doc_id for r in once) == sorted([*range(len(HARD))] * 2)  # rate 1 everywhere: each row once
    assert mixing.mixture(frame(spark, []), max_repeats=2.0).count() == 0
    assert mixing.mixture(frame(spark, [None, ""]), target_entropy=0.5).count() == 2
    with pytest.raises(ValueError):
        mixing.mixture(docs)


def grams_of(words):
    return {f"{a} {b}" for a, b in zip(words, words[1:])}


def brute_license(text):
    t = (text or "").lower()
    own = lambda x: re.findall("[a-z0-9]+", x)
    lines = [[own(p) for p in re.split("[.;:!?]+(?:[ \t\r]|$)", x)] for x in t.split("\n")]
    units = [sum(x, []) for x in lines] if len(lines) > 1 else []
    known = {g for x in licenses.TEMPLATES.values() for g in licenses.bigrams_of(x)}
    vocabulary = {w for g in known for w in g.split()}
    like = lambda w: 2 * sum(x in vocabulary for x in w) >= len(w) and 2 * len(grams_of(w) & known) >= len(grams_of(w))
    for x in lines:
        several = [w for w in x if w]
        units += [w for w in several if len(w) > 1 and like(w)] if len(several) > 1 else []
    if re.search("\n[^a-z0-9\n]*\n", t):
        units += [own(p) for p in re.split("\n[^a-z0-9\n]*\n[^a-z0-9]*", t)]
    run, alike = [], 0
    for words in [*sum(lines, []), None]:
        grams = grams_of(words or [])
        if words is None or (grams and not like(words)):
            units += [sum(run, [])] if alike > 1 else []
            run, alike = [], 0
        else:
            run.append(words)
            alike += bool(grams)
    units.append(sum(sum(lines, []), []))
    found = []
    for w in units:
        g = grams_of(w)
        for name, template in licenses.TEMPLATES.items():
            h = set(licenses.bigrams_of(template))
            if g and 2 * len(g & h) / (len(g) + len(h)) >= licenses.THRESHOLD:
                found.append((2 * len(g & h) / (len(g) + len(h)), name))
    return len(found), ",".join(sorted({n for _, n in found})), min(((-d, n) for d, n in found), default=(None, None))


def test_notices_over_paragraphs_and_within_lines_are_found(spark):
    t = licenses.TEMPLATES
    wide = lambda x: re.sub(r"(?<=[.:;]) ", "\n\n", x)
    texts = {
        f"{prose(1, 60)}\n\n{wide(t['bsd-2-clause'])}\n\n{prose(2, 60)}": "bsd-2-clause",
        f"{prose(3, 80)}\n{wide(t['apache-2.0-header'])}\n{prose(4, 80)}": "apache-2.0-header",
        f"Copyright (c) 2020 Nobody\n\n{wide(t['mit-full'])}": "mit-full",
        f"{prose(5, 40)}. Released under the MIT License. {prose(6, 40)}": "mit",
        f"{prose(7, 50)}\n{wide(t['bsd-3-clause-full'])}\n{prose(8, 50)}": "bsd-3-clause-full",
        prose(9, 300): None,
    }
    got = {r.doc_id: r.best_license for r in licenses.op5_license_scan(frame(spark, list(texts))).collect()}
    assert all((got[i] or "").startswith(want) if want else got[i] is None for i, want in enumerate(texts.values())), got


def test_short_notices_are_found_in_many_wordings(spark):
    verbs = ("Licensed", "Released", "Distributed", "Available", "This project is released")
    want = [(f"{v} under {called}.", name) for v in verbs for name, called in licenses.NAMES.items() if called.startswith("the ") or " " not in v]
    got = {r.doc_id: r.best_license for r in licenses.op5_license_scan(frame(spark, [f"some prose\n{t}\nmore" for t, _ in want])).collect()}
    assert [t for i, (t, name) in enumerate(want) if not (got[i] or "").startswith(name)] == []


def test_op5_equals_brute_force(spark):
    t = licenses.TEMPLATES
    texts = [*HARD, *t.values(), prose(1, 80) + "\n" + t["gpl-3.0"] + "\n" + prose(2, 60), "intro\n\n" + t["mit"].replace(". ", ".\n") + "\n \n" + prose(3, 30), t["apache-2.0-header"].upper().replace("AGREED TO", ""), t["mit"][: len(t["mit"]) // 2], "\n" + t["cc-by-nc-4.0"]]
    got = {r.doc_id: r for r in licenses.op5_license_scan(frame(spark, texts)).collect()}
    for i, text in enumerate(texts):
        n, names, (d, best) = brute_license(text)
        assert (got[i].n_matches, got[i].licenses, got[i].best_license) == (n, names, best), text
        assert (got[i].best_dice is None) == (d is None) and (d is None or math.isclose(got[i].best_dice, -d))
    assert licenses.op5_license_scan(frame(spark, [])).count() == 0
    assert licenses.license_matches(frame(spark, ["a b"]), {}).first().matches == []


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (c > "4") for i, c in enumerate(reversed(digits))) % 10 == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_pii(text):
    digits = lambda m: re.sub("[^0-9]", "", m)
    valid = {"email": lambda m: True, "ip": lambda m: all(int(p) <= 255 for p in m.split(".")), "card": lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m)), "phone": lambda m: 8 <= len(digits(m)) <= 15}
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid[k](m[0])]


PERSONAL = ["a@b.c@d.e x@y.z_w@v.u a@b@c.d .@..a@b..c x@y.z.", "1.2.3.4.5.6.7.8 256.1.1.1 0001.002.3.4 1.2.3 1.2.3.4.5", "4111 1111 1111 1111 5 4111111111111111 4111-1111-1111-1111x4111111111111111", "+1 (578) 555-6437 +1--- +12345678 ++1 234 5678 90.",
            "émoji😀 a@b.co 😀 +49 30 1234567 Ü", "a" * 3000 + "@b.c", "1 " * 3000, "+" * 2000 + "1" * 20 + "+1" + " " * 3000 + "2", "a@b.c" * 500, "10.0.0.1:80 +1234567890123456 4111 1111 1111 1112", "0" * 16, "1.1.1.1" * 50]


def test_op10_base_equals_brute_force(spark):
    texts = [*HARD, *PERSONAL]
    got = {r.doc_id: r for r in pii.op10_pii(frame(spark, texts)).collect()}
    for i, text in enumerate(texts):
        base = brute_pii(text)
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest(), text
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(k == x for x, *_ in base) for k in pii.BASE]
        assert got[i].spans.startswith(",".join(f"{k}:{a}:{b}" for k, a, b in base))
    assert pii.op10_pii(frame(spark, [])).count() == 0


def test_op10_adds_likely_spans_only(spark):
    good = ["My SSN is 123-45-6789.", "call me: (578) 555-6437", "write to john.smith [at] mail [dot] com", "IBAN DE89 3704 0044 0532 0130 00", "Patient name: Mr. John Smith"]
    bad = ["order 12345678", "invoice no 7654321", "version 2.10", "part 555-12-0000x", "ref 000-00-0000", prose(4, 200)]
    texts = (good + bad + ["a@b.com", "+49 30 1234567"]) * 20
    rows = pii.op10_pii(frame(spark, texts)).collect()
    n = len(good + bad) + 2
    for r in rows:
        k = r.doc_id % n
        if k < len(good):
            assert r.spans, good[k]
        elif k < len(good) + len(bad):
            assert not r.spans, bad[k - len(good)]


def test_op10_estimates_reliabilities():
    import random

    rng = random.Random(0)
    truth_tables = [(0.9, 0.2), (0.8, 0.3), (0.7, 0.1), (0.6, 0.4), (0.95, 0.3)]
    counts = defaultdict(int)
    for _ in range(20000):
        y = rng.random() < 0.4
        counts[0, tuple(int(rng.random() < (a if y else b)) for a, b in truth_tables)] += 1
    cells = [(k, v, n) for (k, v), n in sorted(counts.items())]
    tables, prior, post = pii.reliabilities(cells, 200)
    assert abs(prior[0] - 0.4) < 0.06
    for t, (a, b) in zip(tables, truth_tables):
        assert abs(t[1][1] - a) < 0.06 and abs(t[0][1] - b) < 0.06
    assert all(0 <= p <= 1 for p in post)
    assert pii.reliabilities([]) [2] == [] and len(pii.span_classifier([])) == pii.N_FEATURES


def test_op10_classifier_learns_beyond_the_votes():
    """A word before, on which no labeler votes, tells candidates with equal votes apart once it goes with votes elsewhere."""
    yes, no, unsure = (1, 1, 1, 2, 1), (0, 0, 0, 0, 0), (1, 2, 0, 2, 1)
    cells = [(7, yes, 1, 1, 5, 400), (7, no, 1, 1, 9, 400), (7, unsure, 1, 1, 5, 20), (7, unsure, 1, 1, 9, 20)]
    weights = pii.span_classifier(cells)
    odds = lambda word: sum(weights[f] for f in pii._features(7, unsure, 1, 1, word))
    assert odds(5) > odds(9) + 0.5
