import math

import numpy as np

from lumenfold.llm import quality
from tests.llm.cases import HARD, frame, prose, space_words


def counts(text):
    w, lines = space_words(text), [x for x in (text or "").split("\n") if space_words(x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    repeated = {p for i, x in enumerate(windows) if windows.count(x) > 1 for p in range(i, i + 5)} if len(w) < 3000 else set()
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated)


def corpus():
    clean = [prose(s, 30 + s % 300).capitalize() + "." for s in range(300)]
    junk = [" ".join(x + "$$$" for x in prose(s, 120).split()) for s in range(5)] + [prose(s, 90).upper().replace(" ", "!! ") for s in range(5)]
    return clean + junk, range(300, 310)


def test_base_counts_equal_brute_force(spark):
    texts = [*HARD, "a b c d e f a b c d e", "z a b c d e f a b c d e x a b c d e", "#x $y\n\n|\n|\n |\n"]
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.op2_quality_rules(frame(spark, texts)).collect()}
    want = {i: counts(t) for i, t in enumerate(texts)}
    assert got == want
    failed = {r.doc_id for r in quality.op2_quality_rules(frame(spark, texts)).where("base_failed").collect()}
    assert failed == {i for i, c in want.items() if c[0] < 10 or 100 * c[4] > 20 * c[0]}


def brute_estimate(x):
    """The same concentration steps with exact order, to convergence, from both starts."""
    floor = np.array(quality.FLOOR)
    spread = lambda y: np.cov(y.T, bias=True) + np.diag(floor**2)
    found = []
    for m, c in ((np.median(x, 0), np.diag(np.maximum((np.quantile(x, 0.75, 0) - np.quantile(x, 0.25, 0)) / 1.349, floor) ** 2)), (x.mean(0), spread(x))):
        for _ in range(100):
            d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
            near = x[np.argsort(d, kind="stable")[: int(np.ceil(quality.H * len(x)))]]
            m, c = near.mean(0), spread(near)
        found.append((np.linalg.slogdet(c)[1], m, c))
    det, m, c = min(found, key=lambda f: f[0])
    d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
    return d / max(1.0, np.median(d) / quality.CHI_MEDIAN), det, m


def test_outliers_equal_an_exact_estimate(spark):
    texts, junk = corpus()
    docs = frame(spark, texts, langs=("en",)).selectExpr("doc_id", "text", "'en' lang", "'s' source", "n_chars")
    got = {r.doc_id: r for r in quality.op2_quality_rules(docs).collect()}
    assert {i for i, r in got.items() if not r.kept and not r.base_failed} == set(junk)
    rows = {r.doc_id: [r.x0, r.x1, r.x2, r.x3] for r in quality.measured(docs, "doc_id").collect() if not r.base_failed}
    distances, det, centre = brute_estimate(np.array(list(rows.values())))
    exact = dict(zip(rows, distances, strict=True))
    model = quality.fit(quality.measured(docs, "doc_id")).first()
    assert abs(model.det - det) < 0.1 and np.abs(np.array([model[f"m{j}"] for j in range(4)]) - centre).max() < 0.02
    ratios = [got[i].distance / exact[i] for i in exact]
    assert 0.9 < min(ratios) and max(ratios) < 1.1  # distances are binned, so that subsets may differ by a bin
    assert all(got[i].kept == (exact[i] <= quality.CUTOFF) for i in exact if not quality.CUTOFF / 1.1 < exact[i] < 1.1 * quality.CUTOFF)


def test_concentration_steps_converge_past_a_bad_start(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate((rng.normal(0, 1, (700, 4)) @ rng.normal(0, 1, (4, 4)), rng.normal(30, 0.5, (220, 4))))
    rows = spark.createDataFrame([("g", "p", False, *map(float, v)) for v in x], "g string, pool string, base_failed boolean, x0 double, x1 double, x2 double, x3 double")
    model, (_, det, centre) = quality.fit(rows).first(), brute_estimate(x)
    assert abs(model.det - det) < 0.1 and np.abs(np.array([model[f"m{j}"] for j in range(4)]) - centre).max() < 0.1


def test_filtered_agrees_and_keeps_columns(spark):
    texts, junk = corpus()
    docs = frame(spark, texts + HARD)
    kept = quality.filtered(docs)
    assert kept.columns == docs.columns
    want = {r.doc_id for r in quality.quality(docs).where("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == want
    assert want >= {i for i in range(300)} and not want & set(junk)


def test_small_and_empty_tables(spark):
    assert quality.op2_quality_rules(frame(spark, [])).count() == 0
    assert quality.filtered(frame(spark, [])).count() == 0
    few = quality.op2_quality_rules(frame(spark, [prose(1, 50), None])).collect()
    assert [(r.doc_id, r.kept, r.distance) for r in few] == [(0, True, None), (1, False, None)]
    assert math.isclose(quality.CHI_MEDIAN, 3.3567, abs_tol=1e-3)


def test_base_counts_equal_those_of_quality_in_one_pass(spark):
    docs = spark.createDataFrame([(i, "en", "web", " ".join(["word", "other#", "more"] * (i % 9))) for i in range(60)] + [(99, None, None, None)], "doc_id bigint, lang string, source string, text string")
    counts = quality.base_counts(docs)
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
    assert sorted(counts.collect()) == sorted(quality.quality(docs).select(*counts.columns).collect())
