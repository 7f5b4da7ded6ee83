"""Quality rules: fixed rules, then robust multivariate outliers per language and source.

Each text becomes a vector of four transformed statistics: log word length, log symbol density, log punctuation density and
the root of the share of capitals, each smoothed so that short texts don't stand out. Per group of language and source, a
regularised minimum-covariance-determinant estimate is found by concentration steps from two starts, coordinatewise medians
and quartiles, and the mean and covariance of all: order by Mahalanobis distance, take the H share of smallest distance,
re-estimate centre and covariance, until no group's log determinant moves by DRIFT or STEPS are done. Of the two the estimate
of the smaller determinant counts. A text is rejected if its squared distance is over CUTOFF times the group's scale (median
distance over the chi-square median, 1 at least).

Every step is one pass over the small table of vectors: distances fall into at most BINS logarithmic bins, and counts, sums
and cross products are aggregated by group and bin before the shuffle, so a group of any size costs its bins. Groups under
MIN_GROUP rows are pooled by language, then all together; a pool still under MIN_GROUP rejects nothing.

Defined results: null text has no words and fails the base rules; null language or source is a value like any other;
repeated documents are judged row by row and count as often as they occur; an empty table gives an empty result; further
columns are ignored by quality() and kept by filtered().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.common import let, space_words, text_of, written

DIMS = 4
H, STEPS, DRIFT, CUTOFF, MIN_GROUP, BINS = 0.75, 8, 0.01, 60.0, 40, 1024
_X = [f"x{j}" for j in range(DIMS)]
_MODEL = [*(f"m{j}" for j in range(DIMS)), *(f"c{j}{k}" for j in range(DIMS) for k in range(j + 1))]
#: Median of the chi-square distribution with DIMS degrees of freedom.
CHI_MEDIAN = 3.3567
#: Standard deviation added to each statistic (the regularisation).
FLOOR = (0.03, 0.1, 0.1, 0.02)
#: Bins per unit of the logarithm of distance.
CELLS = 64


def _repeated(words: Column) -> Column:
    """Words in 5-word windows that occur twice or more in the text."""

    def covered(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        twice = lambda s: F.filter(F.transform(s, lambda e, i: F.when(F.coalesce(F.get(s, i - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == e["h"], F.lit(False)), e["p"])), lambda p: p.isNotNull())
        spread = lambda p: F.aggregate(F.transform(p, lambda at, k: F.coalesce(F.least(F.get(p, k + 1) - at, F.lit(5)), F.lit(5))), F.lit(0), lambda n, x: n + x)
        return let(placed, lambda s: let(F.sort_array(twice(s)), spread))

    windows = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - 5), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(5))))
    counted = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(windows(h), lambda v: F.when(F.size(F.array_distinct(v)) == F.size(v), 0).otherwise(covered(v))))
    return F.when(F.size(words) < 6, 0).otherwise(counted)


def _statistics(text: Column) -> Column:
    """An array of one struct of all counts of a text."""

    def of(t: Column) -> Column:
        lines = lambda: F.filter(F.split(t, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
        only = lambda x, kept: F.length(F.regexp_replace(x, f"[^{kept}]+", ""))
        # one scan of the text leaves its capitals and marks, from which both and the symbols are counted
        marks = F.regexp_replace(t, "[^!-/:-`{-~]+", "")
        return let(space_words(t), lambda w: let(marks, lambda m: F.struct(
            F.size(w).cast("bigint").alias("n_words"), F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            only(m, "#*$%&|<>").cast("bigint").alias("n_symbols"), let(lines(), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
            _repeated(w).cast("bigint").alias("n_repeat_words"), only(m, "A-Z").alias("n_upper"), (F.length(m) - only(m, "A-Z")).alias("n_marks"))))

    return F.transform(F.array(text), of)


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns of keep, the base statistics, base_failed, x0 to x3, and the group keys g and pool."""
    # generated, not projected: a filter on the counts can't be pushed below, where Spark would count each text once more
    counts = F.inline_outer(_statistics(text_of()))
    s = docs.select(*keep, F.to_json(F.struct(F.col("lang").cast("string").alias("l"), F.col("source").cast("string").alias("s"))).alias("g"), F.to_json(F.struct(F.col("lang").cast("string").alias("l"))).alias("pool"), counts)
    chars = F.col("word_chars")
    vector = (F.log((chars + 150) / (F.col("n_words") + 30)), F.log((F.col("n_symbols") + 1) / (chars + 200)), F.log((F.col("n_marks") + 5) / (chars + 200)), F.sqrt((F.col("n_upper") + 2) / (chars + 50)))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return s.select(*keep, "g", "pool", *BASE, failed.alias("base_failed"), *(v.alias(f"x{j}") for j, v in enumerate(vector)))


def _distance() -> Column:
    """Squared Mahalanobis distance of x from m under the Cholesky factor c, by forward substitution."""
    y: list[Column] = []
    for j in range(DIMS):
        rest = F.col(f"x{j}") - F.col(f"m{j}")
        for k in range(j):
            rest = rest - F.col(f"c{j}{k}") * y[k]
        y.append(rest / F.col(f"c{j}{j}"))
    return sum((v * v for v in y[1:]), y[0] * y[0])


def _cell() -> Column:
    return F.least(F.floor(CELLS * F.log1p(_distance())), F.lit(BINS - 1)).cast("int")


def _sums() -> list[Column]:
    """Sums and cross products of the vector."""
    return [F.sum(x).alias(f"s{j}") for j, x in enumerate(_X)] + [F.sum(F.col(f"x{j}") * F.col(f"x{k}")).alias(f"p{j}{k}") for j in range(DIMS) for k in range(j + 1)]


def _factor(df: DataFrame) -> DataFrame:
    """estimate, start, m, c and det from counts n, sums s and products p: the mean, the regularised covariance's Cholesky factor and
    the logarithm of its determinant."""
    mean = lambda j: F.col(f"s{j}") / F.col("n")
    spread = lambda j, k: F.col(f"p{j}{k}") / F.col("n") - mean(j) * mean(k) + (FLOOR[j] ** 2 if j == k else 0.0)
    df = df.select("estimate", "start", *(mean(j).alias(f"m{j}") for j in range(DIMS)), *(spread(j, k).alias(f"v{j}{k}") for j in range(DIMS) for k in range(j + 1)))
    for j in range(DIMS):
        for k in range(j + 1):
            rest = F.col(f"v{j}{k}")
            for i in range(k):
                rest = rest - F.col(f"c{j}{i}") * F.col(f"c{k}{i}")
            df = df.withColumn(f"c{j}{k}", F.sqrt(F.greatest(rest, F.lit(FLOOR[j] ** 2 / 4))) if j == k else rest / F.col(f"c{k}{k}"))
    det = sum((2 * F.log(f"c{j}{j}") for j in range(1, DIMS)), 2 * F.log("c00"))
    return df.select("estimate", "start", *_MODEL, det.alias("det"))


def _starts(rows: DataFrame) -> DataFrame:
    """Two first estimates: medians and quartiles (start 0), counted in cells of half the regularisation, and all rows' mean and covariance (1)."""
    floors = F.array(*map(F.lit, FLOOR))
    cells = F.explode(F.array(*(F.struct(F.lit(j).alias("j"), F.floor(F.col(x) / (FLOOR[j] / 2)).alias("cell")) for j, x in enumerate(_X))))
    counts = rows.select("estimate", cells.alias("e")).groupBy("estimate", "e.j", "e.cell").agg(F.count("*").alias("n"))
    by = Window.partitionBy("estimate", "j")
    run = counts.withColumns({"upto": F.sum("n").over(by.orderBy("cell")), "all": F.sum("n").over(by)})
    at = lambda q: (F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("cell"))) + 0.5)
    width = F.get(floors, F.col("j")) / 2
    found = run.groupBy("estimate", "j").agg(at(0.5).alias("m"), ((at(0.75) - at(0.25)) / 1.349).alias("s")).select("estimate", "j", (F.col("m") * width).alias("m"), F.greatest(F.col("s") * width, F.get(floors, F.col("j"))).alias("s"))
    of = lambda c, j: F.max(F.when(F.col("j") == j, F.col(c)))
    wide = found.groupBy("estimate").agg(*(of("m", j).alias(f"m{j}") for j in range(DIMS)), *(of("s", j).alias(f"c{j}{j}") for j in range(DIMS)))
    wide = wide.withColumns({f"c{j}{k}": F.lit(0.0) for j in range(DIMS) for k in range(j)}).withColumns({"start": F.lit(0), "det": F.lit(float("inf"))})
    every = rows.groupBy("estimate").agg(F.count("*").alias("n"), *_sums()).withColumn("start", F.lit(1))
    return wide.select("estimate", "start", *_MODEL, "det").unionByName(_factor(every))


def _pools(rows: DataFrame) -> DataFrame:
    """g and estimate, the group whose estimate judges it (null if there are too few rows)."""
    sizes = written(rows.groupBy("g", "pool").agg(F.count_if(~F.col("base_failed")).alias("n")), "mcd-sizes")
    small = sizes.where(F.col("n") < MIN_GROUP)
    pools = written(small.groupBy("pool").agg(F.sum("n").alias("pooled")), "mcd-pools")
    rest = pools.where(F.col("pooled") < MIN_GROUP).agg(F.sum("pooled")).first()[0] or 0
    chosen = F.when(F.col("n") >= MIN_GROUP, F.col("g")).when(F.col("pooled") >= MIN_GROUP, F.col("pool")).when(F.lit(rest >= MIN_GROUP), F.lit("*"))
    return written(sizes.join(pools, "pool", "left").select("g", chosen.alias("estimate")), "mcd-groups")


def fit(rows: DataFrame) -> DataFrame:
    """By g: estimate, centre m, factor c, det and scale, from the measured rows that pass the base rules."""
    groups = _pools(rows)
    placed = rows.where(~F.col("base_failed")).join(groups, "g").where("estimate IS NOT NULL").select("estimate", *_X)
    placed = written(placed, "mcd-placed")
    if placed.isEmpty():
        return groups.withColumns({c: F.lit(None).cast("double") for c in [*_MODEL, "det", "scale"]})
    model = written(_starts(placed), "mcd-model")

    def nearest(share: float, *more: Column) -> DataFrame:
        """Bins of the share of rows nearest to each estimate."""
        by = Window.partitionBy("estimate", "start")
        binned = placed.join(model, "estimate").withColumn("cell", _cell()).groupBy("estimate", "start", "cell").agg(F.count("*").alias("n"), *more)
        binned = binned.withColumns({"before": F.sum("n").over(by.orderBy("cell")) - F.col("n"), "all": F.sum("n").over(by)})
        return binned.where(F.col("before") < share * F.col("all"))

    for _ in range(STEPS):
        near = nearest(H, *_sums())
        near = near.groupBy("estimate", "start").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in near.columns if c[0] in "sp" and c[1:].isdigit()))
        before = model.select("estimate", "start", F.col("det").alias("last"))
        model = written(_factor(near).join(before, ["estimate", "start"]), "mcd-model")
        drift = model.agg(F.max(F.abs(F.col("det") - F.col("last")))).first()[0]
        model = model.drop("last")
        if drift < DRIFT:
            break
    best = F.row_number().over(Window.partitionBy("estimate").orderBy("det", "start"))
    model = written(model.withColumn("_rank", best).where("_rank = 1").drop("_rank"), "mcd-model")
    # under 1 the regularisation prevails, and stretching distances would undo it
    scale = nearest(0.5).groupBy("estimate").agg(F.greatest(F.lit(1.0), F.expm1((F.max("cell") + 1) / float(CELLS)) / CHI_MEDIAN).alias("scale"))
    return written(groups.join(model.drop("start").join(scale, "estimate"), "estimate", "left"), "mcd-model")


def _judged(rows: DataFrame, model: DataFrame) -> DataFrame:
    """rows with distance (squared, over the group's scale; null without an estimate) and kept."""
    distance = F.when(F.col("scale").isNotNull(), _distance() / F.col("scale"))
    joined = rows.join(model, "g", "left").withColumn("distance", distance)
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUTOFF, F.lit(True)))


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, the base statistics and base_failed of each row, as quality() has them, in one pass: they need no estimate."""
    return measured(docs, "doc_id").select("doc_id", *BASE, "base_failed")


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, the base statistics, base_failed, distance and kept of each row."""
    rows = written(measured(docs, "doc_id"), "mcd-rows")
    return _judged(rows, fit(rows)).select("doc_id", *BASE, "base_failed", "kept", "distance")


def filtered(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, all columns. Rows are written with their statistics, so texts are measured once and never shuffled."""
    whole = docs.select(F.struct("*").alias("_row"), "lang", "source", "text")
    rows = written(measured(whole, "_row"), "mcd-whole")
    return _judged(rows, fit(rows.drop("_row"))).where("kept").select("_row.*")


def op2_quality_rules(docs: DataFrame) -> DataFrame:
    """The contract's columns and the distance."""
    return quality(docs)
