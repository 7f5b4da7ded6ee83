import hashlib
import random

from lumenfold.llm import decontam
from tests.llm.cases import HARD, alnum_words, frame, prose


def brute(texts, items):
    windows = {}
    for item, text in items:
        w = alnum_words(text)
        n = min(8, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = {}
    for d, text in enumerate(texts):
        w, hit, found = alnum_words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (k := windows.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= k
        ids = ",".join(sorted(map(str, found)))
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), len(found) >= 2)
    return out


def test_op4_equals_brute_force(spark):
    rng = random.Random(1)
    items = [(i, prose(300 + i, rng.randint(3, 60))) for i in range(12)] + [(12, None), (13, ""), (14, "the the the the the the the the the the"), (15, "Two words"), (16, prose(300, 60))]
    texts = [*HARD, *(prose(s, 700) for s in range(400, 410)), "the " * 700, "two  WORDS two-words"]
    for k in range(40):
        words = prose(500 + k, rng.randint(0, 1500)).split()
        for _ in range(rng.randint(1, 3)):
            item = alnum_words(rng.choice(items)[1])
            a = rng.randrange(max(1, len(item)))
            words[(p := rng.randint(0, len(words))) : p] = item[a : a + rng.randint(5, 30)]
        texts.append(" ".join(words).upper())
    docs, bench = frame(spark, texts), spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id bigint, text string, token string")
    want = brute(texts, items)
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.op4_decontamination(docs, bench).collect()}
    assert got == want
    twice = decontam.op4_decontamination(docs.union(docs), bench)
    assert twice.count() == 2 * len(texts) and {r.doc_id: r.n_hit for r in twice.collect()} == {k: v[1] for k, v in want.items()}


def test_op4_without_broadcasts_and_with_a_full_filter(spark, monkeypatch):
    items = [(i, prose(300 + i, 40)) for i in range(6)] + [(6, "a b c")]
    texts = [prose(900, 600) + " " + items[2][1] + " " + prose(901, 600), prose(902, 50), None, "x a b c y " * 50]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    monkeypatch.setattr(decontam, "MAX_BITS", 1 << 6)  # lets about every window through
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.op4_decontamination(frame(spark, texts), bench).collect()}
        kept = sorted(r.doc_id for r in decontam.decontaminated(frame(spark, texts), bench).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == brute(texts, items)
    assert kept == [1, 2]


def test_decontaminated_drops_by_containment(spark):
    items = [(1, prose(700, 40)), (2, prose(701, 5))]
    inside = lambda text: prose(702, 30) + " " + text + " " + prose(703, 30)
    texts = [inside(items[0][1]), inside(" ".join(items[0][1].split()[:20])), inside(" ".join(items[0][1].split()[:19])), inside(items[1][1]), prose(704, 300), None, ""]
    docs, bench = frame(spark, texts), spark.createDataFrame(items, "item_id bigint, text string")
    left = decontam.decontaminated(docs, bench)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [2, 4, 5, 6]
    assert decontam.decontaminated(docs, bench.limit(0)).count() == len(texts)
    assert decontam.op4_decontamination(frame(spark, []), bench).count() == 0


def brute_containment(text, item, slack=8):
    """The largest share of the item's words under its windows in any span of its length and the slack."""
    t, w = text.split(), item.split()
    windows = {}
    for o in range(len(w) - 7):
        windows.setdefault(tuple(w[o : o + 8]), []).append(o)
    hits = [(p, o) for p in range(len(t) - 7) for o in windows.get(tuple(t[p : p + 8]), ())]
    best = 0
    for start in {p for p, _ in hits}:
        best = max(best, len({o + k for p, o in hits if start <= p and p + 8 <= start + len(w) + slack for k in range(8)}))
    return best / len(w)


def test_containment_is_over_item_sized_windows(spark):
    item = [f"w{k}x" for k in range(59)]
    texts = [[*item[:30], "inserted", *item[30:]], [*item[:30], *item[31:]], item[:30], [*item[:30], *["other"] * 900, *item[30:]], [*item[:30], *["other"] * 6, *item[30:]], [*item, *item[:20], *item]]
    texts += [[*item[:k], "changed", *item[k + 1 :]] for k in (5, 29)]
    rng = random.Random(2)
    for _ in range(12):
        words = []
        for _ in range(rng.randint(1, 8)):
            a = rng.randrange(50)
            words += item[a : a + rng.randint(6, 30)] + ["other"] * rng.choice((0, 1, 3, 9, 40))
        texts.append(words)
    texts = [" ".join(t) for t in texts]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "the " * 30)], "item_id bigint, text string")
    got = {r.doc_id: {i.item_id: i.containment for i in r["items"]} for r in decontam.leaks(frame(spark, texts), bench, 8).collect()}
    want = {i: round(brute_containment(t, " ".join(item)), 6) for i, t in enumerate(texts)}
    assert {i: round(g.get(1, 0), 6) for i, g in got.items()} == want
    assert (want[0], want[3]) == (1.0, round(30 / 59, 6))
    for least in (0.3, 0.8):  # the prefix filter loses none
        some = {r.doc_id for r in decontam.leaks(frame(spark, texts), bench, 8, least).where("size(items) > 0").collect()}
        assert some == {i for i, c in want.items() if c >= least}


def test_one_changed_word_of_a_short_item_does_not_let_it_through(spark):
    item = [f"w{k}x" for k in range(16)]
    texts = [" ".join([prose(5, 20), *item[:k], "changed", *item[k + 1 :], prose(6, 20)]) for k in range(16)]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")
    assert decontam.decontaminated(frame(spark, texts), bench).count() == 0
