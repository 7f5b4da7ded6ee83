import random

import pytest
import xxhash

from lumenfold.llm import components, simhash
from tests.llm.cases import HARD, ascii_lower, frame, prose, space_words


def brute_fingerprint(text, k):
    w = space_words(ascii_lower(text))
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(fps, most):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def near(text, seed):
    words = text.split()
    words[random.Random(seed).randrange(len(words))] = "changed"
    return " ".join(words)


def test_op6_equals_brute_force(spark):
    base = prose(5, 900)
    texts = [*HARD[:-1], base, base.upper(), *(near(base, s) for s in range(12)), *(prose(s, 3) for s in range(20, 40))]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op6_simhash_dedup(frame(spark, texts)).collect()}
    fps = [brute_fingerprint(t, 3) for t in texts]
    classes = brute_classes(fps, 2)
    assert got == {i: (f"{f:016x}", c) for i, (f, c) in enumerate(zip(fps, classes))}
    assert len(set(classes)) < len(set(fps))  # links between different fingerprints


def test_links_join_all_pairs_within_two_bits(spark):
    rng = random.Random(3)
    fps = set()
    for _ in range(30):
        f = rng.getrandbits(64)
        fps |= {f} | {f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(8)} | {f ^ (1 << rng.randrange(64)) for _ in range(4)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp bigint"))
    roots = {r.node: r.root for r in components.components(edges).collect()}
    got = [roots.get(f, f) for f in signed]
    want = brute_classes(fps, 2)
    assert len({*zip(got, want)}) == len(set(got)) == len(set(want))


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100), 200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_similar_groups_find_copies_and_leave_others(spark):
    bases = [prose(s, 400) for s in range(50, 60)]
    texts, group = [], []
    for g, base in enumerate(bases):
        for v in (base, base, near(base, 1), near(near(base, 2), 3), near(near(near(base, 4), 5), 6)):
            texts.append(v)
            group.append(g)
    texts += [prose(s, 400) for s in range(80, 100)]
    group += list(range(100, 120))
    keepers = {r.doc_id: r.keeper for r in simhash.similar_groups(frame(spark, texts)).collect()}
    assert all(group[k] == group[i] for i, k in keepers.items())  # none joined that aren't alike
    found = sum(keepers[i] == group.index(group[i]) for i in range(50))
    assert found >= 48
    kept = simhash.deduplicated(frame(spark, texts))
    assert kept.columns == frame(spark, []).columns
    assert {r.doc_id for r in kept.collect()} == {k for k in keepers.values()}


def jaccard(a, b, k=5):
    a, b = ({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def test_similar_groups_link_exactly_the_pairs_at_four_fifths(spark):
    texts = []
    for s in range(300, 340):
        base = prose(s, 300).split()
        cut = 30 + s % 10  # a new end leaves a Jaccard similarity of about 0.75 to 0.82
        texts += [" ".join(base), " ".join(base[:-cut] + prose(s + 1000, cut).split())]
    shared = prose(77, 230)
    texts += [f"{shared} {prose(s, 70)}" for s in range(400, 440)]
    linked = [jaccard(texts[i], texts[i + 1]) >= 0.8 for i in range(0, 80, 2)]
    assert any(linked) and not all(linked)
    keepers = {r.doc_id: r.keeper for r in simhash.similar_groups(frame(spark, texts)).collect()}
    assert [i for i in range(0, 80, 2) if keepers[i + 1] == i and not linked[i // 2]] == []
    assert all(keepers[i] == i for i in range(80, 120))


def test_similar_groups_miss_no_pair_beside_a_shared_passage(spark):
    shared = prose(78, 200)
    texts = []
    for s in range(500, 700):
        own = prose(s, 100).split()
        texts += [f"{shared} {' '.join(own)}", f"{' '.join(prose(s + 5000, 20).split())} {shared} {' '.join(own[:-8])}"]
    assert all(jaccard(texts[i], texts[i + 1]) >= 0.8 for i in range(0, 400, 2)) and jaccard(texts[0], texts[2]) < 0.6
    keepers = {r.doc_id: r.keeper for r in simhash.similar_groups(frame(spark, texts)).collect()}
    assert keepers == {i: i - i % 2 for i in range(400)}


def edited(words, rng, times, kinds):
    words = list(words)
    for _ in range(times):
        at = rng.randrange(len(words))
        words[at : at + 1] = {"change": [f"w{rng.random()}"], "drop": [], "add": [words[at], f"w{rng.random()}"]}[rng.choice(kinds)]
    return " ".join(words)


@pytest.mark.parametrize("kinds", [("change",), ("change", "drop", "add")])
def test_similar_groups_of_a_cloud_equal_brute_force_without_all_its_pairs(spark, monkeypatch, kinds):
    rng = random.Random(9)
    base = prose(90, 150).split()
    texts = [edited(base, rng, rng.randint(1, 9), kinds) for _ in range(600)]
    met = []
    write = simhash.written

    def seen(df, label):
        out = write(df, label)
        if label == "similar-met":
            met.append(out.count())
        return out

    monkeypatch.setattr(simhash, "written", seen)
    keepers = {r.doc_id: r.keeper for r in simhash.similar_groups(frame(spark, texts)).collect()}
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if 9 * shared >= 4 * (len(sets[i]) + len(sets[j])):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert keepers == {i: find(i) for i in range(len(sets))}
    assert 100 < len({*keepers.values()}) < 500  # many are similar to others, many to none
    assert met[-1] < 10 * len(texts)  # pairs compared at the end


def test_dedup_of_hard_rows(spark):
    docs = frame(spark, HARD)
    kept = simhash.deduplicated(docs.union(docs.where("doc_id IN (3, 14)")))  # rows repeated with their id
    ids = sorted(r.doc_id for r in kept.collect())
    assert ids == [0, 3, 4, 5, 6, 7, 8, 9, 10, 13, 14, 16]
    assert simhash.deduplicated(frame(spark, [])).count() == 0
    assert simhash.op6_simhash_dedup(frame(spark, [])).count() == 0
    nameless = simhash.op6_simhash_dedup(docs.selectExpr("cast(null as bigint) doc_id", "text"))
    assert nameless.count() == len(HARD) and nameless.where("component_id IS NOT NULL").count() == 0
