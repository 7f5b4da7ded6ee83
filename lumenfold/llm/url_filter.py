"""URL filters: allow and block rules first, then logistic regression on hashed character n-grams of host and path.

The model is trained from a small labelled URL table, at most MAX_LABELS rows (an error beyond), on the driver: Spark
counts each URL's n-gram buckets, and a fixed number of gradient steps fits one weight per bucket. Scoring is one map
stage: a sum of weights over the n-grams of each URL, the weights being a constant of the plan (8 * buckets bytes).

Defined results: a null url, or one without "://", has empty host and path, matches no rule and takes the method's verdict
on empty features (the intercept); of rules of one length the later wins; repeated rows are judged row by row; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import UPPER, let

MAX_LABELS = 10_000
BUCKETS = 4096
SIZES = (3, 4)

#: The contract's rules: host, path, verdict.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))

# Words of the labelled table. Good hosts are topics, alone or with a common companion; those to be blocked
# join what such sites offer with how they draw visitors.
TOPICS = ("library", "gardening", "museum", "weather", "recipes", "history", "physics", "travelnotes", "openmaps", "journal", "schoolbook", "townhall", "birdwatch", "chess", "astronomy", "poetry",
          "orchestra", "railway", "harbour", "botanic", "theatre", "geology", "village", "mountain", "cooking", "pottery", "painting", "grammar", "sailing", "insects", "medieval", "harvest")
COMPANIONS = ("city", "old", "north", "river", "my", "open", "little", "world")
OFFERS = ("casino", "poker", "bets", "slots", "pills", "viagra", "loans", "adult", "cams", "singles", "replica", "followers", "warez", "essay", "spam", "ads", "crypto", "lottery")
LURES = ("free", "cheap", "win", "bonus", "hot", "farm", "track", "click", "money", "x", "buy", "fast")
GOOD_PATHS = ("/en/12", "/de/340.html", "/fr/5/", "/es/77?page=2&ref=x", "/about", "/articles/2019/river")
SPAM_PATHS = ("/en/12", "/de/340.html", "/fr/5/", "/es/77?utm_source=feed", "/buy-now", "/win/free-bonus")
SUBDOMAINS, TOPS = ("", "www.", "m.", "blog."), ("com", "net", "org")


def labelled_urls() -> list[tuple[str, int]]:
    """The default table (0 good, 1 to be blocked): every topic with three companions or none, every offer with four lures, in either
    order; good hosts with four paths, others with two, under subdomains and top-level domains in turn."""
    good = [t if k == 0 else f"{COMPANIONS[(i + 3 * k) % 8]}{'-' if k == 1 else ''}{t}" for i, t in enumerate(TOPICS) for k in range(4)]
    spam = [f"{o}-{lure}" if (i + k) % 2 else f"{lure}-{o}" for i, o in enumerate(OFFERS) for k in range(4) for lure in [LURES[(i + 3 * k + k // 2) % 12]]]
    named = lambda n, host, path: f"https://{SUBDOMAINS[n % 4]}{host}.example.{TOPS[n % 3]}{path}"
    return [(named(2 * i + k, host, paths[(i + 3 * k) % 6]), label) for label, hosts, paths, n in ((0, good, GOOD_PATHS, 4), (1, spam, SPAM_PATHS, 2)) for i, host in enumerate(hosts) for k in range(n)]


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def buckets_of(host: Column, path: Column, buckets: int = BUCKETS) -> Column:
    """Bucket of every character n-gram of ^host$ and of ^path$; host and path n-grams hash apart."""

    def grams(kind: str, text: Column, n: int) -> Column:
        starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.lit(kind), F.substring(text, i, F.lit(n))), F.lit(buckets)).cast("int"))

    return let(F.concat(F.lit("^"), host, F.lit("$")), lambda h: let(F.concat(F.lit("^"), path, F.lit("$")), lambda p: F.concat(*(grams("h", h, n) for n in SIZES), *(grams("p", p, n) for n in SIZES))))


def train(labels: DataFrame, buckets: int = BUCKETS, steps: int = 300, rate: float = 12.0, penalty: float = 2e-4) -> list[float]:
    """Weights by bucket, then the intercept, from the columns url and label (1 is to be blocked): gradient descent on the mean log-loss."""
    found = labels.select(F.col("label").cast("int").alias("label"), buckets_of(host_of(F.col("url")), path_of(F.col("url")), buckets).alias("f"))
    found = found.where("label IS NOT NULL").limit(MAX_LABELS + 1).collect()
    if len(found) > MAX_LABELS:
        raise ValueError(f"the labelled table may have {MAX_LABELS} rows")
    rows = sorted((r["label"], r["f"]) for r in found)
    if not rows:
        return [0.0] * (buckets + 1)
    label = np.array([y for y, _ in rows], dtype=float)
    at = np.repeat(np.arange(len(rows)), [len(f) for _, f in rows])
    gram = np.array([b for _, f in rows for b in f], dtype=np.int64)
    share = np.repeat([1 / math.sqrt(max(1, len(f))) for _, f in rows], [len(f) for _, f in rows])
    weights, bias = np.zeros(buckets), 0.0
    for _ in range(steps):
        odds = bias + np.bincount(at, weights[gram] * share, len(rows))
        error = (1 / (1 + np.exp(-np.clip(odds, -30, 30))) - label) / len(rows)
        bias -= rate * error.sum()
        weights -= rate * (np.bincount(gram, error[at] * share, buckets) + penalty * weights)
    return [*map(float, weights), float(bias)]


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for domain, prefix, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(prefix)
        found = F.when(fits, F.struct(F.lit(domain + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def judged(pages: DataFrame, weights: list[float], rules=RULES) -> DataFrame:
    """pages with host, path, rule, verdict and score (the method's probability of block)."""
    model = F.split(F.lit(",".join(map(repr, weights[:-1]))), ",").cast("array<double>")
    buckets = len(weights) - 1

    def score(f: Column) -> Column:
        total = F.aggregate(f, F.lit(0.0), lambda s, b: s + F.get(F.col("_model"), b))
        return 1 / (1 + F.exp(-(F.lit(weights[-1]) + total / F.sqrt(F.size(f)))))

    named = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url")), "_model": model})
    named = named.withColumns({"_rule": rule_for(F.col("host"), F.col("path"), rules), "score": let(buckets_of(F.col("host"), F.col("path"), buckets), lambda f: F.when(F.size(f) > 0, score(f)).otherwise(1 / (1 + math.exp(-weights[-1]))))})
    return named.withColumns({"rule": F.col("_rule.rule"), "verdict": F.coalesce(F.col("_rule.verdict"), F.when(F.col("score") >= 0.5, "block").otherwise("allow"))}).drop("_rule", "_model")


def op1_url_filter(pages: DataFrame) -> DataFrame:
    """The contract's columns and the score."""
    spark: SparkSession = pages.sparkSession
    rows = ", ".join(f"('{url}', {label})" for url, label in labelled_urls())
    weights = train(spark.sql(f"SELECT * FROM VALUES {rows} AS t(url, label)"))
    return judged(pages.select("page_id", "url"), weights).select("page_id", "host", "path", "rule", "verdict", "score")
