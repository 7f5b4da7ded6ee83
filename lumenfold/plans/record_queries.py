"""Queries over run records: token accounting, authoritative records, summaries, comparisons, samples and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.functions.buckets import answer_kind, question_kind, record_source
from lumenfold.functions.numbers import ratio
from lumenfold.functions.text import answer_letter, record_key_parts
from lumenfold.operators import metrics, sampling
from lumenfold.plans.standins import ANSWERS, RUNS, dealt, runs, sql_list, table
from lumenfold.plans.text_queries import letter_sql


def metered(spark, sf_dir):
    return metrics.token_metrics(runs(spark, sf_dir))


def run_summary(spark, sf_dir):
    return metrics.summarize(metrics.authoritative(metered(spark, sf_dir), "a"), "modality")


def _best(order: str, where: str = "TRUE") -> str:
    return f"best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY record_key ORDER BY {order}) AS rk FROM metered WHERE {where}) WHERE rk = 1)"


_A = _best("(status = 'completed') DESC, CASE WHEN status = 'completed' THEN -ord ELSE ord END")
_B = _best("(status = 'completed') DESC, CASE WHEN status = 'completed' THEN ord ELSE -ord END")
_D = _best("ord", "status = 'completed'")
_E = _best("ord DESC", "status = 'completed'")

SUMMARY = """SELECT modality, count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (correct) AS correct,
  count(*) FILTER (compression_expanded) AS expanded_count, round(sum(elapsed_seconds), 3) AS elapsed_seconds,
  round(count(*) FILTER (correct)::DOUBLE / nullif(count(*) FILTER (status = 'completed'), 0), 4) AS accuracy, round(avg(compression_ratio), 4) AS avg_compression_ratio,
  round(avg(token_saving_ratio), 4) AS avg_token_saving_ratio, round(avg(token_saving_ratio) FILTER (NOT compression_expanded), 4) AS avg_token_saving_ratio_positive_only"""


def _dedup(rule):
    return lambda spark, sf_dir: metrics.authoritative(metered(spark, sf_dir), rule).select("record_key", "ord", "status", "correct", "token_saving_ratio_raw")


def dedup_c(spark, sf_dir):
    """Every thirteenth record has no key."""
    some = metered(spark, sf_dir).withColumn("record_key", F.when(F.col("ord") % 13 > 0, F.col("record_key")))
    return metrics.authoritative(some, "c").select("record_key", "ord", "status", "correct", "token_saving_ratio_raw")


def _dedup_sql(best):
    return f"WITH {RUNS}, {best} SELECT record_key, ord, status, correct, token_saving_ratio_raw FROM best"


def paired_rollup(spark, sf_dir):
    m = metered(spark, sf_dir)
    side = lambda c: metrics.authoritative(m.where(F.col("config") == c), "a")
    return metrics.paired(side("A"), side("B"), F.regexp_extract("record_key", "^video:([^:]+):", 1))


def votes(spark, sf_dir):
    m = metered(spark, sf_dir)
    run = lambda n: metrics.authoritative(m.where(F.col("ord") % 3 == n), "e")
    return metrics.majority_vote(run(0), run(1), run(2))


_VOTES = f"""WITH {RUNS}, r AS (SELECT record_key, ord % 3 AS n, correct FROM (SELECT *, row_number() OVER (PARTITION BY record_key, ord % 3 ORDER BY ord DESC) AS rk FROM metered WHERE status = 'completed') WHERE rk = 1),
joined AS (SELECT a.record_key, a.correct AS v1, b.correct AS v2, c.correct AS v3 FROM (FROM r WHERE n = 0) a LEFT JOIN (FROM r WHERE n = 1) b USING (record_key) LEFT JOIN (FROM r WHERE n = 2) c USING (record_key)),
tallied AS (SELECT *, v1::INT + coalesce(v2::INT, 0) + coalesce(v3::INT, 0) AS yes, 1 + (v2 IS NOT NULL)::INT + (v3 IS NOT NULL)::INT AS n FROM joined),
votes AS (SELECT record_key, v1 AS vote1, CASE WHEN 2 * yes > n THEN TRUE WHEN 2 * yes < n THEN FALSE ELSE v1 END AS majority, yes > 0 AND yes < n AS unstable FROM tallied)"""


def weighted_averages(spark, sf_dir):
    groups = metered(spark, sf_dir).groupBy("source").agg((100 * ratio(F.count_if("correct"), F.count_if(F.col("status") == "completed"), 6)).alias("accuracy"), F.count_if(F.col("status") == "completed").alias("n"))
    return metrics.weighted_averages(groups)


def breakdown(spark, sf_dir):
    r = runs(spark, sf_dir).withColumns({"answer_kind": answer_kind(F.col("answer_text")), "question_kind": question_kind(F.col("question"))})
    return metrics.breakdown(r, "source", "answer_kind", "question_kind")


def _case(text: str, table_) -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'contains({text}, {sql_list([w])})' for w in words)} THEN '{name}'" for name, words in table_) + " ELSE 'other' END"


def _kinds() -> str:
    from lumenfold.functions import terms

    t = "trim(coalesce(answer_text, ''), ' ')"
    return f"""kinds AS (SELECT *, CASE WHEN regexp_full_match({t}, '[A-Fa-f]') THEN 'mcq_letter' WHEN lower({t}) IN ('yes', 'no') THEN 'yes_no' WHEN regexp_full_match({t}, '-?[0-9]+(\\.[0-9]+)?') THEN 'number'
  WHEN lower({t}) IN ({sql_list(terms.COLORS)}) THEN 'color' ELSE 'short_text' END AS answer_kind, {_case('lower(question)', terms.QUESTION_BUCKETS)} AS question_kind FROM runs)"""


def merged(spark, sf_dir):
    m = metered(spark, sf_dir)
    done = lambda c, rule: metrics.authoritative(m.where(F.col("config") == c), rule)
    out = metrics.merged_runs(done("A", "a"), done("B", "a"))
    return out.groupBy("config").agg(F.count("*").alias("records"), F.count_if("correct").alias("correct"))


def rechecked(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    rows = d.select(dealt(("A", "B", "C", "D", "E"), F.col("doc_id")).alias("truth"), answer_letter(dealt(ANSWERS, F.col("doc_id"))).alias("answer"), F.when(F.col("doc_id") % 3 == 0, dealt(("C", "B", "A"), F.expr("doc_id div 3"))).alias("rechecked"))
    return metrics.rechecked_accuracy(rows)


def slice_accuracy(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") + 1).alias("position"), dealt(("A", "B", "C", "D", "E"), F.col("doc_id")).alias("truth"), F.nullif(dealt(("C", "B", "", "D"), F.col("doc_id")), F.lit("")).alias("answer"))
    return metrics.slice_accuracy(d, "position", 11, 400)


def keyword_scores(spark, sf_dir):
    r = runs(spark, sf_dir)
    rows = r.select("modality", F.lower("answer_text").rlike(r"\b(answer|option)\b").alias("hit"), F.lower("answer_text").rlike("no letter|cannot").alias("refused"), F.when(F.col("ord") % 5 > 0, F.col("source_bytes")).alias("tokens"))
    return metrics.keyword_scores(rows, "modality")


def box_statistics(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem")
    boxes = e.select(F.when(F.col("l_linenumber") < 7, F.array(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 40, F.col("l_quantity") / 50)).alias("box"))
    return metrics.box_statistics(boxes)


def resume_anti_join(spark, sf_dir):
    r = runs(spark, sf_dir)
    return sampling.pending(r.select("record_key", "ord"), r.where("status = 'completed' AND config = 'A'"), "record_key")


def availability_semi_join(spark, sf_dir):
    have = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(have, "c_custkey", "left_semi").select("c_custkey", "c_name")


def category_left_join(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    number = F.regexp_extract("s_name", "([0-9]+)$", 1).try_cast("int") % 30
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("category"))
    return s.withColumn("k", number).join(n, F.col("k") == F.col("n_nationkey"), "left").select("s_suppkey", "s_name", "category")


def threshold_counts(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    wide = lambda size, price: F.count_if((F.col("p_size") >= size) & (F.col("p_retailprice") >= price))
    return p.groupBy("p_brand").agg(F.count("*").alias("total"), wide(20, 1000).alias("high"), wide(40, 1200).alias("very_high"))


def top_samples(spark, sf_dir):
    return table(spark, sf_dir, "part").orderBy(F.desc("p_size"), F.desc("p_retailprice"), "p_partkey").limit(5).select("p_partkey", "p_size", "p_retailprice")


def round_robin_sample(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return sampling.round_robin(o, "o_orderpriority", "o_orderkey", 180, seed=7)


def seeded_sample(spark, sf_dir):
    return sampling.sample(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 100, seed=3)


def shard_assign(spark, sf_dir):
    return sampling.shards(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey", 4)


def first_per_group(spark, sf_dir):
    return sampling.first_of_each(runs(spark, sf_dir).select("source", "ord", "record_key", "status"), "source", "ord")


def _keys(spark, sf_dir):
    return runs(spark, sf_dir).groupBy("record_key").agg(F.min("ord").alias("position"))


def covered_keys(spark, sf_dir):
    return sampling.covered_keys(_keys(spark, sf_dir), runs(spark, sf_dir).where("status = 'completed'"), "record_key", "position", 120).select("record_key", "position")


def uncovered_keys(spark, sf_dir):
    return sampling.uncovered_keys(_keys(spark, sf_dir), runs(spark, sf_dir).where("status = 'completed'"), "record_key", "position", 200).select("record_key", "position")


def ordinal_split(spark, sf_dir):
    head, tail = sampling.split_at(table(spark, sf_dir, "documents").select((F.col("doc_id") + 1).alias("position"), "lang"), "position", 300)
    return head.withColumn("half", F.lit(1)).unionByName(tail.withColumn("half", F.lit(2))).groupBy("half", "lang").agg(F.count("*").alias("n"), F.min("position").alias("first"))


def requested_order(spark, sf_dir):
    r = runs(spark, sf_dir)
    wanted = r.where("ord % 11 = 0").groupBy("record_key").agg(F.max("ord").alias("position"))
    return r.join(wanted, "record_key", "left").groupBy("record_key").agg(F.max("position").alias("position"), F.count("*").alias("n"))


def key_sets(spark, sf_dir):
    """Intersection, difference and union of completed keys of two configurations."""
    r = runs(spark, sf_dir).where("status = 'completed'")
    a, b = (r.where(F.col("config") == c).select("record_key") for c in "AB")
    named = lambda df, n: df.distinct().withColumn("part", F.lit(n))
    return named(a.intersect(b), "both").unionByName(named(a.subtract(b), "only_a")).unionByName(named(a.union(b), "any"))


def record_keys(spark, sf_dir):
    return runs(spark, sf_dir).select("ord", record_key_parts(F.col("record_key")).alias("k"), record_source(F.col("record_key"), F.col("source")).alias("dataset")).select("ord", "k.video_id", "k.question_id", "dataset")


_SEED = "md5({}::VARCHAR || ':{}')"
QUERIES = {
    "run_summary": (run_summary, f"WITH {RUNS}, {_A} {SUMMARY} FROM best GROUP BY modality"),
    "run_summary_all": (lambda s, d: metrics.summarize(metered(s, d), "modality"), f"WITH {RUNS} {SUMMARY} FROM metered GROUP BY modality"),
    "token_metrics": (lambda s, d: metered(s, d).select("ord", "original_tokens", "compressed_tokens", "compression_ratio", "token_saving_ratio", "token_saving_ratio_raw", "compression_expanded"),
                      f"WITH {RUNS} SELECT ord, original_tokens, compressed_tokens, compression_ratio, token_saving_ratio, token_saving_ratio_raw, compression_expanded FROM metered"),
    "dedup_a": (_dedup("a"), _dedup_sql(_A)), "dedup_b": (_dedup("b"), _dedup_sql(_B)), "dedup_c": (dedup_c, _dedup_sql("keyed AS (SELECT * FROM metered WHERE ord % 13 > 0), " + _A.replace("metered", "keyed"))), "dedup_d": (_dedup("d"), _dedup_sql(_D)), "dedup_e": (_dedup("e"), _dedup_sql(_E)),
    "accuracy_interval": (lambda s, d: metrics.accuracy_interval(metered(s, d), "modality", "config"), f"""WITH {RUNS} SELECT modality, config, count(*) AS n, round(100 * avg(correct::INT::DOUBLE), 4) AS accuracy_pct,
  round(100 * 1.96::DOUBLE * sqrt(avg(correct::INT::DOUBLE) * (1 - avg(correct::INT::DOUBLE)) / count(*)), 4) AS half_width_pct, round(100 * avg(token_saving_ratio_raw), 4) AS mean_saving_pct, round(100 * median(token_saving_ratio_raw), 4) AS median_saving_pct,
  round(100 * min(token_saving_ratio_raw), 4) AS min_saving_pct, round(100 * max(token_saving_ratio_raw), 4) AS max_saving_pct, count(*) FILTER (token_saving_ratio_raw > 0) AS positive FROM metered WHERE status = 'completed' GROUP BY modality, config"""),
    "failure_topk": (lambda s, d: metrics.failure_topk(runs(s, d), 5, 20), f"WITH {RUNS} SELECT substr(error, 1, 20) AS error, count(*) AS n, min(ord) AS first_ord FROM runs WHERE status <> 'completed' GROUP BY 1 ORDER BY n DESC, first_ord LIMIT 5"),
    "weighted_averages": (weighted_averages, f"""WITH {RUNS}, g AS (SELECT source, 100 * round(count(*) FILTER (correct)::DOUBLE / nullif(count(*) FILTER (status = 'completed'), 0), 6) AS a, count(*) FILTER (status = 'completed') AS n FROM runs GROUP BY source)
SELECT round(sum(a * n) / nullif(sum(n), 0), 4)::DOUBLE AS weighted_mean, round(avg(a), 4) AS simple_mean FROM g"""),
    "breakdown": (breakdown, f"""WITH {RUNS}, {_kinds()} SELECT CASE WHEN grouping(source) = 0 THEN 'source' WHEN grouping(answer_kind) = 0 THEN 'answer_kind' ELSE 'question_kind' END AS dimension,
  coalesce(source, answer_kind, question_kind) AS bucket, count(*) AS total, count(*) FILTER (NOT coalesce(correct, FALSE)) AS wrong FROM kinds GROUP BY GROUPING SETS ((source), (answer_kind), (question_kind))"""),
    "paired_rollup": (paired_rollup, f"""WITH {RUNS}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY config, record_key ORDER BY (status = 'completed') DESC, CASE WHEN status = 'completed' THEN -ord ELSE ord END) AS rk FROM metered) WHERE rk = 1 AND status = 'completed'),
both_ AS (SELECT regexp_extract(a.record_key, '^video:([^:]+):', 1) AS grp, a.correct::INT AS a_ok, b.correct::INT AS b_ok, a.token_saving_ratio_raw AS a_raw, b.token_saving_ratio_raw AS b_raw FROM (FROM best WHERE config = 'A') a JOIN (FROM best WHERE config = 'B') b USING (record_key))
SELECT grp, count(*) AS shared, sum(a_ok)::BIGINT AS a_correct, sum(b_ok)::BIGINT AS b_correct, round(100 * avg(a_ok - b_ok), 4) AS delta_points, round(100 * median(a_raw), 4) AS a_median_saving, round(100 * median(b_raw), 4) AS b_median_saving,
  count(*) FILTER (a_ok = 1 AND b_ok = 0) AS only_a, count(*) FILTER (a_ok = 0 AND b_ok = 1) AS only_b FROM both_ GROUP BY ROLLUP (grp)"""),
    "majority_vote": (votes, f"{_VOTES} SELECT * FROM votes"),
    "vote_totals": (lambda s, d: metrics.vote_totals(votes(s, d)), f"""{_VOTES} SELECT count(*) AS keys, count(*) FILTER (vote1) AS run1_correct, count(*) FILTER (majority) AS majority_correct, count(*) FILTER (unstable) AS unstable,
  count(*) FILTER (NOT vote1 AND majority) AS flips_up, count(*) FILTER (vote1 AND NOT majority) AS flips_down, count(*) FILTER (NOT vote1 AND NOT majority) AS still_wrong FROM votes"""),
    "merged_runs": (merged, f"""WITH {RUNS}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY config, record_key ORDER BY (status = 'completed') DESC, CASE WHEN status = 'completed' THEN -ord ELSE ord END) AS rk FROM metered) WHERE rk = 1),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY record_key ORDER BY config DESC) AS k FROM best) WHERE k = 1) SELECT config, count(*) AS records, count(*) FILTER (correct) AS correct FROM last GROUP BY config"""),
    "rechecked_accuracy": (rechecked, f"""WITH l AS ({letter_sql()}), r AS (SELECT (['A', 'B', 'C', 'D', 'E'])[doc_id % 5 + 1] AS truth, letter AS answer, CASE WHEN doc_id % 3 = 0 THEN (['C', 'B', 'A'])[(doc_id // 3) % 3 + 1] END AS rechecked FROM l),
f AS (SELECT *, coalesce(rechecked, answer) AS final FROM r) SELECT count(rechecked) AS rechecked_rows, round(count(*) FILTER (rechecked = truth)::DOUBLE / nullif(count(rechecked), 0), 6) AS rechecked_accuracy,
  count(final) AS answered, round(count(*) FILTER (final = truth)::DOUBLE / nullif(count(final), 0), 6) AS combined_accuracy FROM f"""),
    "slice_accuracy": (slice_accuracy, """WITH r AS (SELECT doc_id + 1 AS position, (['A', 'B', 'C', 'D', 'E'])[doc_id % 5 + 1] AS truth, nullif((['C', 'B', '', 'D'])[doc_id % 4 + 1], '') AS answer FROM documents WHERE doc_id + 1 BETWEEN 11 AND 400)
SELECT count(answer) AS processed, count(*) - count(answer) AS skipped, count(*) FILTER (truth = answer) AS correct, round(count(*) FILTER (truth = answer)::DOUBLE / nullif(count(answer), 0), 6) AS accuracy FROM r"""),
    "keyword_scores": (keyword_scores, f"""WITH {RUNS} SELECT modality, count(*) AS n, round(avg(regexp_matches(lower(answer_text), '\\b(answer|option)\\b')::INT::DOUBLE), 6) AS keyword_accuracy,
  round(avg((NOT regexp_matches(lower(answer_text), 'no letter|cannot'))::INT::DOUBLE), 6) AS answerability, sum(source_bytes) FILTER (ord % 5 > 0)::BIGINT AS tokens FROM runs GROUP BY modality"""),
    "checkpoint_counts": (lambda s, d: metrics.checkpoint_counts(runs(s, d), "source"), f"WITH {RUNS} SELECT source, count(DISTINCT record_key) AS seen, count(DISTINCT record_key) FILTER (status = 'completed') AS completed FROM runs GROUP BY source"),
    "box_statistics": (box_statistics, """WITH b AS (SELECT l_linenumber < 7 AS has, l_discount AS x1, l_tax AS y1, l_quantity / 40 AS x2, l_quantity / 50 AS y2 FROM lineitem),
v AS (SELECT *, coalesce(has AND x1 >= 0 AND x1 < x2 AND x2 <= 1 AND y1 >= 0 AND y1 < y2 AND y2 <= 1, FALSE) AS ok, (x2 - x1) * (y2 - y1) AS area FROM b)
SELECT count(*) FILTER (ok AND area < 0.1::DOUBLE) AS under_tenth, count(*) FILTER (ok AND area >= 0.1::DOUBLE) AS from_tenth, count(*) FILTER (NOT ok) AS invalid, round(avg(area) FILTER (ok), 6) AS mean_area FROM v"""),
    "resume_anti_join": (resume_anti_join, f"WITH {RUNS} SELECT record_key, ord FROM runs WHERE record_key NOT IN (SELECT record_key FROM runs WHERE status = 'completed' AND config = 'A')"),
    "availability_semi_join": (availability_semi_join, "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')"),
    "category_left_join": (category_left_join, "SELECT s_suppkey, s_name, n_name AS category FROM supplier LEFT JOIN nation ON try_cast(regexp_extract(s_name, '([0-9]+)$', 1) AS INT) % 30 = n_nationkey"),
    "threshold_counts": (threshold_counts, "SELECT p_brand, count(*) AS total, count(*) FILTER (p_size >= 20 AND p_retailprice >= 1000) AS high, count(*) FILTER (p_size >= 40 AND p_retailprice >= 1200) AS very_high FROM part GROUP BY p_brand"),
    "top_samples": (top_samples, "SELECT p_partkey, p_size, p_retailprice FROM part ORDER BY p_size DESC, p_retailprice DESC, p_partkey LIMIT 5"),
    "round_robin_sample": (round_robin_sample, f"""WITH t AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_SEED.format('o_orderkey', 7)}, o_orderkey)::INT AS turn FROM orders)
SELECT o_orderkey, o_orderpriority, turn FROM t ORDER BY turn, o_orderpriority, o_orderkey LIMIT 180"""),
    "seeded_sample": (seeded_sample, f"SELECT o_orderkey, o_orderstatus FROM orders ORDER BY {_SEED.format('o_orderkey', 3)}, o_orderkey LIMIT 100"),
    "shard_assign": (shard_assign, "SELECT c_custkey, c_mktsegment, ((row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(c_custkey::VARCHAR || ':0'), c_custkey) - 1) % 4)::INT AS shard FROM customer"),
    "first_per_group": (first_per_group, f"WITH {RUNS} SELECT source, ord, record_key, status FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ord) AS k FROM runs) WHERE k = 1"),
    "covered_keys": (covered_keys, f"WITH {RUNS} SELECT record_key, min(ord) AS position FROM runs GROUP BY record_key HAVING count(*) FILTER (status = 'completed') > 0 ORDER BY position LIMIT 120"),
    "uncovered_keys": (uncovered_keys, f"WITH {RUNS}, k AS (SELECT record_key, min(ord) AS position, count(*) FILTER (status = 'completed') AS c FROM runs GROUP BY record_key ORDER BY position LIMIT 200) SELECT record_key, position FROM k WHERE c = 0"),
    "ordinal_split": (ordinal_split, "SELECT CASE WHEN doc_id + 1 <= 300 THEN 1 ELSE 2 END AS half, lang, count(*) AS n, min(doc_id + 1) AS first FROM documents GROUP BY 1, 2"),
    "requested_order": (requested_order, f"WITH {RUNS} SELECT record_key, max(ord) FILTER (ord % 11 = 0) AS position, count(*) AS n FROM runs GROUP BY record_key"),
    "key_sets": (key_sets, f"""WITH {RUNS}, a AS (SELECT DISTINCT record_key FROM runs WHERE status = 'completed' AND config = 'A'), b AS (SELECT DISTINCT record_key FROM runs WHERE status = 'completed' AND config = 'B')
(SELECT record_key, 'both' AS part FROM a INTERSECT SELECT record_key, 'both' FROM b) UNION ALL (SELECT record_key, 'only_a' FROM a WHERE record_key NOT IN (FROM b)) UNION ALL (SELECT DISTINCT record_key, 'any' FROM (FROM a UNION FROM b))"""),
    "record_keys": (record_keys, f"WITH {RUNS} SELECT ord, regexp_extract(record_key, '^video:(.*):([^:]+)$', 1) AS video_id, regexp_extract(record_key, '^video:(.*):([^:]+)$', 2) AS question_id, source AS dataset FROM runs"),
}
