"""Personal data: fixed patterns, and spans that weak supervision adds.

Candidates are the base spans and the matches of wider patterns. Five labelers vote on each (yes, no or abstain): a format
check, a gazetteer, the words before it in favour, the words before it against, and its boundaries. Candidates are counted by
kind, votes, length class, shape and hashed word before, a table bounded by its cells whatever the corpus; on it,
expectation-maximisation estimates each labeler's reliability and each candidate's probability of being personal, and a
logistic span classifier is trained on these probabilities. It sees shapes and words, which no labeler votes on, so it tells
candidates with equal votes apart. Candidates of the wider kinds that the classifier accepts, and that touch no base span, are added.

One map stage finds spans and votes; the small table that it writes is counted, then scored. Offsets come from the lengths of
matches and of the text between them. The patterns are possessive and anchored at the start of a run, so that they take time in
proportion to the text and no stack, and match what the contract's patterns match.

Defined results: null is the empty text, which has no spans; without candidates nothing is added; repeated documents are
judged and counted row by row; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import let, text_of, written

BASE = ("email", "ip", "card", "phone")
WIDER = ("mail_words", "iban", "national_id", "local_phone", "name", "number")
KINDS = BASE + WIDER
LABELERS = ("format", "gazetteer", "context", "against", "boundary")
#: Wider kinds that may be added; number only gives the labelers something to reject.
ADDED = WIDER[:-1]
ACCEPT = 0.5
#: Classes of length and shape, and buckets of the word before.
SIZES, SHAPES, WORD_BUCKETS = 8, 8, 32

_LOCAL = "A-Za-z0-9._%+-"
#: Pattern of each kind, and a cheaper one that texts without a match fail.
PATTERNS = {
    "email": (rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]++\.[0-9]"),
    "card": (r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])", r"[0-9](?:[ -]?[0-9]){15}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
    "mail_words": (r"(?i)(?<![a-z0-9._-])[a-z0-9._-]{2,64}+ ?[\[(]at[\])] ?[a-z0-9-]{2,64}+(?: ?(?:[\[(]dot[\])]|\.) ?[a-z0-9-]{2,32}+){1,4}+", r"(?i)[\[(]at[\])]"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}+(?: ?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}[A-Z0-9 ]"),
    "national_id": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]-[0-9]{2}-[0-9]"),
    "local_phone": (r"(?<![0-9+().-])(?<![0-9)] )(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])", r"[0-9]{3}[ .-][0-9]{4}"),
    "name": (r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.? [A-Z][a-z]{2,30}+(?: [A-Z][a-z]{2,30}+)?+", r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.? [A-Z]"),
    "number": (r"(?<![0-9A-Za-z.,+-])(?<![0-9)] )[0-9]{7,40}+(?![0-9A-Za-z-])", r"[0-9]{7}"),
}
#: Gazetteers: top-level domains, country calling codes, issuer digits, given names.
DOMAINS = ("com", "org", "net", "edu", "gov", "info", "biz", "io", "de", "fr", "es", "uk", "it", "nl", "eu", "us", "ca", "ch", "at", "be", "mx", "br", "jp", "in", "au")
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98")
ISSUERS = ("2", "3", "4", "5", "6")
GIVEN = ("Anna", "Carlos", "Charles", "David", "Elena", "Emma", "Hans", "James", "Jean", "John", "Jose", "Juan", "Karl", "Laura", "Louis", "Lucas", "Maria", "Marie", "Martin", "Mary", "Michael", "Paul", "Peter", "Pierre", "Robert", "Sarah", "Sofia", "Thomas", "William")
FOR = r"(?i)(?:mail|contact|write to|phone|\btel|\bcall|fax|mobile|cell|\bssn|social security|passport|card|visa|mastercard|iban|account|konto|compte|cuenta|\bip\b|address|adresse|name|patient|born|customer|client)[^\n]{0,24}$"
AGAINST = r"(?i)(?:order|invoice|version|\bv|isbn|issn|page|item|sku|\bref|build|release|figure|table|serial|total|price|[$€£#])[^\n0-9]{0,12}$"


def _match(pattern: str, gate: str, text: Column, valid=None) -> Column:
    """Array of (start, end, m) of the pattern's matches that are valid, in code points."""
    def walk(found: Column, gaps: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,m:string>>").alias("out"))

        def step(acc: Column, i: Column) -> Column:
            def with_start(a: Column) -> Column:
                m = F.get(found, i)
                span = F.struct(a.alias("start"), (a + F.length(m)).alias("end"), m.alias("m"))
                out = F.array_append(acc["out"], span)
                return F.struct((a + F.length(m)).alias("at"), (out if valid is None else F.when(valid(m), out).otherwise(acc["out"])).alias("out"))

            return let(acc["at"] + F.length(F.get(gaps, i)), with_start)

        return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), start, step, lambda acc: acc["out"])

    none = F.array().cast("array<struct<start:int,end:int,m:string>>")
    seen = F.contains(text, F.lit(gate)) if gate == "@" else text.rlike(gate)
    return F.when(seen, let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, let(F.split(text, pattern, -1), lambda g: walk(m, g))).otherwise(none))).otherwise(none)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]+", "")


def _luhn(m: Column) -> Column:
    def total(d: Column) -> Column:
        digit = lambda i: F.substring(d, F.length(d) - i, F.lit(1)).cast("int")
        value = lambda i: F.when(i % 2 == 0, digit(i)).otherwise(2 * digit(i) - F.when(digit(i) > 4, 9).otherwise(0))
        return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), lambda s, i: s + value(i)) % 10 == 0

    return let(_digits(m), total)


def _octets(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda part: let(F.regexp_replace(part, "^0+", ""), lambda p: F.when(F.length(p) > 3, F.lit(False)).otherwise(F.coalesce(F.when(p != "", p).cast("int"), F.lit(0)) <= 255)))


VALID = {"email": None, "ip": _octets, "card": _luhn, "phone": lambda m: F.length(_digits(m)).between(8, 15)}


def _vote(yes: Column, no: Column | None = None) -> Column:
    """1 for yes, 0 for no, 2 to abstain."""
    return F.when(yes, 1).when(F.lit(True) if no is None else no, 0).otherwise(2)


def _votes(kind: str, text: Column, span: Column) -> list[Column]:
    m = span["m"]
    never = F.lit(False)
    first = F.substring(_digits(m), 1, 2)
    formats = {"email": F.regexp_like(m, F.lit(r"\.[A-Za-z]{2,24}$")), "ip": F.lit(True), "card": F.lit(True), "phone": F.length(_digits(m)) >= 9, "mail_words": F.regexp_like(m, F.lit(r"[a-zA-Z]{2,24}$")),
               "iban": F.length(F.regexp_replace(m, " ", "")).between(15, 34), "national_id": ~F.regexp_like(m, F.lit("^(?:000|666|9)")) & ~F.regexp_like(m, F.lit("-00-|-0000$")), "local_phone": F.regexp_like(m, F.lit(r"^\(?[2-9]")), "name": F.lit(True), "number": never}
    lists = {"email": _vote(F.regexp_extract(m, r"\.([A-Za-z0-9-]+)$", 1).isin(*DOMAINS), never), "ip": _vote(~F.regexp_like(m, F.lit(r"^(?:0|127|255)\.")), None), "card": _vote(F.substring(first, 1, 1).isin(*ISSUERS)),
             "phone": _vote(first.isin(*CALLING) | F.substring(first, 1, 1).isin("1", "7")), "mail_words": _vote(F.regexp_extract(F.lower(m), "([a-z]+)$", 1).isin(*DOMAINS), never), "iban": F.lit(2), "national_id": F.lit(2), "local_phone": F.lit(2),
             "name": _vote(F.regexp_extract(m, "([A-Z][a-z]+)(?: [A-Z][a-z]+)?$", 1).isin(*GIVEN), never), "number": F.lit(2)}
    before = F.substring(text, F.greatest(span["start"] - 47, F.lit(1)), F.least(span["start"], F.lit(48)))
    around = F.concat(F.when(span["start"] > 0, F.substring(text, span["start"], F.lit(1))).otherwise(F.lit(" ")), F.substring(text, span["end"] + 1, F.lit(1)))
    return [_vote(formats[kind]), lists[kind], let(before, lambda b: _vote(F.regexp_like(b, F.lit(FOR)), never)), let(before, lambda b: F.when(F.regexp_like(b, F.lit(AGAINST)), 0).otherwise(2)), F.when(F.regexp_like(around, F.lit("[A-Za-z0-9]")), 0).otherwise(1)]


def _shape(m: Column) -> Column:
    """Class of the characters: digits, digits with marks, digits and letters, no digits; twice that if a run of four equal characters is in it."""
    kind = F.when(~m.rlike("[0-9]"), 3).when(m.rlike("[A-Za-z]"), 2).when(m.rlike("[^0-9]"), 1).otherwise(0)
    return (kind + F.when(m.rlike(r"(.)\1{3}"), 4).otherwise(0)).cast("int")


def _word_before(text: Column, span: Column) -> Column:
    """Bucket from 1 of the lower-cased word before the span on its line, 0 if there is none."""
    before = F.substring(text, F.greatest(span["start"] - 31, F.lit(1)), F.least(span["start"], F.lit(32)))
    word = F.regexp_extract(before, r"([A-Za-z]{2,24})[^A-Za-z\n]{0,8}$", 1)
    return F.when(word == "", 0).otherwise(1 + F.pmod(F.xxhash64(F.lower(word)), F.lit(WORD_BUCKETS - 1))).cast("int")


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and spans: arrays of (kind, start, end, votes, size, shape, word) of all kinds, by kind as listed, then start."""
    def of_kind(text: Column, k: int) -> Column:
        kind = KINDS[k]
        found = _match(*PATTERNS[kind], text, VALID.get(kind))
        return F.transform(found, lambda s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.array(*_votes(kind, text, s)).alias("votes"), F.least(F.floor((s["end"] - s["start"]) / 8), F.lit(SIZES - 1)).cast("int").alias("size"),
            _shape(s["m"]).alias("shape"), _word_before(text, s).alias("word")))

    return docs.select("doc_id", let(text_of(), lambda t: F.concat(*(of_kind(t, k) for k in range(len(KINDS))))).alias("spans"))


def reliabilities(cells: list[tuple[int, tuple[int, ...], int]], rounds: int = 60) -> tuple[list, dict[int, float], list[float]]:
    """Expectation-maximisation over (kind, votes, count): by labeler [P(vote | not), P(vote | personal)], the prior of each kind,
    and the posterior of each cell. Votes are independent given the truth; the start is the majority of the votes."""
    post = [(1 + sum(v == 1 for v in votes)) / (2 + sum(v != 2 for v in votes)) for _, votes, _ in cells]
    tables: list = []
    prior: dict[int, float] = {}
    for _ in range(rounds):
        tables = [[[6.0, 1.0, 3.0], [1.0, 6.0, 3.0]] for _ in LABELERS]  # ten votes' worth of trust in each labeler
        mass: dict[int, list[float]] = {}
        for (kind, votes, n), p in zip(cells, post, strict=True):
            m = mass.setdefault(kind, [1.0, 1.0])
            m[0] += n * (1 - p)
            m[1] += n * p
            for t, v in zip(tables, votes, strict=True):
                t[0][v] += n * (1 - p)
                t[1][v] += n * p
        tables = [[[x / sum(side) for x in side] for side in t] for t in tables]
        prior = {k: m[1] / (m[0] + m[1]) for k, m in mass.items()}
        post = []
        for kind, votes, _ in cells:
            odds = math.log(prior[kind] / (1 - prior[kind])) + sum(math.log(t[1][v] / t[0][v]) for t, v in zip(tables, votes, strict=True))
            post.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
    return tables, prior, post


#: Where the features of each sort begin: kinds, votes, sizes, shapes, words.
_AT = [0]
for _n in (len(KINDS), 3 * len(LABELERS), SIZES, SHAPES, WORD_BUCKETS):
    _AT.append(_AT[-1] + _n)
N_FEATURES = _AT[-1]


def _features(kind: int, votes, size: int, shape: int, word: int) -> list[int]:
    """Active features: the kind, each labeler's vote, the classes of length and shape, the word before."""
    return [kind, *(_AT[1] + 3 * j + v for j, v in enumerate(votes)), _AT[2] + size, _AT[3] + shape, _AT[4] + word]


def span_classifier(cells: list[tuple], steps: int = 300, rate: float = 0.3) -> list[float]:
    """Weights by feature of a logistic regression (AdaGrad) on the posteriors of (kind, votes, size, shape, word, count)."""
    if not cells:
        return [0.0] * N_FEATURES
    counts: dict[tuple, int] = {}
    for kind, votes, *_, n in cells:
        counts[kind, votes] = counts.get((kind, votes), 0) + n
    keys = sorted(counts)
    post = dict(zip(keys, reliabilities([(*k, counts[k]) for k in keys])[2], strict=True))
    target = np.array([post[c[0], c[1]] for c in cells])
    on = np.array([_features(*c[:-1]) for c in cells])
    weight = np.sqrt([c[-1] for c in cells])  # damped, so that frequent cells don't decide alone
    weight = weight / weight.sum()
    weights, past = np.zeros(N_FEATURES), np.full(N_FEATURES, 1e-6)
    for _ in range(steps):
        error = (1 / (1 + np.exp(-np.clip(weights[on].sum(axis=1), -30, 30))) - target) * weight
        slope = 1e-4 * weights + np.bincount(on.ravel(), np.repeat(error, on.shape[1]), N_FEATURES)
        past += slope * slope
        weights -= rate * slope / np.sqrt(past)
    return [float(w) for w in weights]


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id and spans: arrays of (kind, start, end, probability, added) of base spans and added ones, by kind as listed, then start."""
    table = written(candidates(docs), "pii-spans")
    # the cells that occur, at most kinds * 3 ** labelers * sizes * shapes * words
    by = ["kind", "votes", "size", "shape", "word"]
    rows = table.select(F.explode("spans").alias("s")).groupBy(*(f"s.{c}" for c in by)).agg(F.count("*").alias("n")).orderBy(*by).collect()
    weights = span_classifier([(r["kind"], tuple(r["votes"]), r["size"], r["shape"], r["word"], r["n"]) for r in rows])
    model = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    names = F.array(*map(F.lit, KINDS))

    def judged(s: Column) -> Column:
        votes = F.aggregate(F.transform(s["votes"], lambda v, j: F.get(model, F.lit(_AT[1]) + 3 * j + v)), F.lit(0.0), lambda a, x: a + x)
        own = [F.get(model, F.lit(at) + s[c]) for at, c in zip(_AT, ("kind", None, "size", "shape", "word"), strict=False) if c]
        odds = sum(own, votes)
        return F.struct(s["kind"].alias("k"), F.get(names, s["kind"]).alias("kind"), s["start"].cast("bigint").alias("start"), s["end"].cast("bigint").alias("end"), (1 / (1 + F.exp(-odds))).alias("probability"), (s["kind"] >= len(BASE)).alias("added"))

    def chosen(all_spans: Column) -> Column:
        base = F.filter(all_spans, lambda s: ~s["added"])
        touches = lambda s: F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        return F.filter(all_spans, lambda s: ~s["added"] | ((s["probability"] >= ACCEPT) & s["kind"].isin(*ADDED) & ~touches(s)))

    return table.select("doc_id", F.when(F.size("spans") > 0, let(F.transform("spans", judged), chosen)).otherwise(F.array().cast("array<struct<k:int,kind:string,start:bigint,end:bigint,probability:double,added:boolean>>")).alias("spans"))


def op10_pii(docs: DataFrame) -> DataFrame:
    """The contract's digest of personal_data()."""
    of_kind = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return personal_data(docs).select("doc_id", *(of_kind(k).alias(f"n_{k}") for k in BASE), F.sha2(joined(F.filter("spans", lambda s: ~s["added"])), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
