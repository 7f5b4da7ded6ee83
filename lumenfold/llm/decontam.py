"""Benchmark decontamination by a prefix-filtered set join over shingles.

Shingles are windows of `window` words. One map stage over the documents hashes every window and keeps those that a Bloom
filter of the benchmark's windows lets through, with the MD5 of their words; from then on only these rows move. They count
each shingle's documents, which orders an item's shingles by rarity. To cover the share `least` of an item's words, a
document has to hold one of its rarest shingles, the necessary prefix: only prefix shingles are joined (without `least` a
single shingle is a leak, so the prefix is the item). A candidate passes the length bound if it has enough words; all
its shingles of the item are then joined, and containment is taken over item-sized windows of the document: the largest
share of the item's words that its shingles cover there, in any alignments, so an inserted, missing or changed word costs
only the words around it.

The Bloom filter is a constant of the plan of at most MAX_BITS bits. Beyond what it can hold, more rows pass to the exact
join and nothing else changes. No text is joined or shuffled here.

Defined results: null and empty texts have no words and no hits; null or wordless items match nothing; an item shorter
than a window is one window; repeated items count by item_id, and a null item_id isn't counted; repeated documents are
judged row by row; empty tables give empty or hitless results; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.common import alnum_words, let, text_of, without, written

#: Bits of the filter: BITS_EACH for each benchmark window, up to a megabyte.
MAX_BITS, BITS_EACH = 1 << 23, 16
#: Share of an item's words from which decontaminated() drops a document.
CONTAINMENT = 0.5
_HIT = "array<struct<pos:int,w:int,h:bigint,digest:binary>>"


def _windows(hashes: Column, w: int) -> Column:
    """Hash of each window of w words, from the words' hashes; at least w of them."""
    return F.transform(F.sequence(F.lit(0), F.size(hashes) - w), lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(w))))


def _found(words: Column, sizes: list[int], passes) -> Column:
    """(pos, w, h, digest) of the windows of these sizes whose hash passes."""

    def of_size(hashes: Column, w: int) -> Column:
        kept = F.transform(_windows(hashes, w), lambda h, i: F.when(passes(h), F.struct(i.alias("pos"), F.lit(w).alias("w"), h.alias("h"))))
        return F.when(F.size(hashes) >= w, F.filter(kept, lambda s: s.isNotNull())).otherwise(F.array().cast("array<struct<pos:int,w:int,h:bigint>>"))

    def named(s: Column) -> Column:
        own = F.array_join(F.slice(words, s["pos"] + 1, s["w"]), " ")
        return F.struct(s["pos"].alias("pos"), s["w"].alias("w"), s["h"].alias("h"), F.unhex(F.md5(own)).alias("digest"))

    if not sizes:
        return F.array().cast(_HIT)
    hits = let(F.transform(words, lambda x: F.xxhash64(x)), lambda hashes: F.concat(*(of_size(hashes, w) for w in sizes)))
    return F.transform(hits, named).cast(_HIT)


def _index(benchmark: DataFrame, window: int) -> tuple[DataFrame, list[int]]:
    """A row for each item and distinct window: item_id, variant (of items with one id), size (words), w, h, digest, offs (its
    places); and the window sizes that occur."""
    items = benchmark.select("item_id", alnum_words(text_of()).alias("words")).where(F.size("words") > 0)
    items = items.withColumns({"size": F.size("words"), "variant": F.xxhash64("words")}).withColumn("least", F.least("size", F.lit(window)))
    placed = []
    for w in range(1, window + 1):
        found = _found(F.col("words"), [w], lambda h: F.lit(True))
        placed.append(items.where(F.col("least") == w).select("item_id", "variant", "size", F.inline(found)))
    rows = placed[0]
    for more in placed[1:]:
        rows = rows.unionByName(more)
    index = rows.groupBy("item_id", "variant", "size", "w", "h", "digest").agg(F.array_sort(F.collect_set("pos")).alias("offs"))
    index = written(index, "leak-index")
    return index, sorted(r["w"] for r in index.select("w").distinct().collect())


def _filter(index: DataFrame):
    """A predicate on a window's hash that every window of the index fulfils, and few others do."""
    bits = 1 << 12
    while bits < min(MAX_BITS, BITS_EACH * index.count()):
        bits *= 2
    at = lambda h, k: (F.shiftrightunsigned(h, 41) if k else h).bitwiseAND(F.lit(bits - 1))
    places = index.select(F.explode(F.array(at(F.col("h"), 0), at(F.col("h"), 1))).alias("b"))
    set_bits = places.groupBy(F.shiftright("b", 6).cast("int").alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, int(b & 63))")).alias("x"))
    cells = [0] * (bits // 64)
    for r in set_bits.collect():  # at most MAX_BITS / 64 rows
        cells[r["cell"]] = r["x"]
    table = F.split(F.lit(",".join(map(str, cells))), ",").cast("array<bigint>")
    holds = lambda b: F.getbit(F.get(table, F.shiftright(b, 6).cast("int")), b.bitwiseAND(F.lit(63)).cast("int")) == 1
    return lambda h: holds(at(h, 0)) & holds(at(h, 1))


def _coverage(hits: Column, size: Column) -> Column:
    """The largest share of the item's words that hits (pos, w, offs) cover within a span of its size and one window's slack."""
    span = lambda hs: size + F.get(hs, F.lit(0))["w"]
    covered = lambda hs: F.size(F.array_distinct(F.flatten(F.transform(hs, lambda x: F.flatten(F.transform(x["offs"], lambda o: F.sequence(o, o + x["w"] - 1)))))))
    inside = lambda hs, s: F.filter(hs, lambda x: (x["pos"] >= s["pos"]) & (x["pos"] + x["w"] <= s["pos"] + span(hs)))
    short = lambda hs: F.get(F.reverse(hs), F.lit(0))["pos"] + F.get(hs, F.lit(0))["w"] - F.get(hs, F.lit(0))["pos"] <= span(hs)
    most = let(F.array_sort(hits), lambda hs: F.when(short(hs), covered(hs)).otherwise(F.array_max(F.transform(hs, lambda s: covered(inside(hs, s))))))
    return most / size


def leaks(documents: DataFrame, benchmark: DataFrame, window: int = 8, least: float | None = None) -> DataFrame:
    """Per row of documents: doc_id, text_hash, n_words, spans (word intervals [a, b) under the items' windows, in order) and
    items (array of item_id, containment, by item_id). With least, only items of at least that containment."""
    index, sizes = _index(benchmark, window)
    passes = _filter(index)
    found = let(alnum_words(text_of()), lambda words: F.struct(F.size(words).alias("n_words"), _found(words, sizes, passes).alias("hits")))
    docs = documents.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.xxhash64("text").alias("text_hash"), found.alias("f"))
    docs = written(docs.select("uid", "doc_id", "text_hash", F.col("f.n_words").cast("bigint").alias("n_words"), F.col("f.hits").alias("hits")), "leak-windows")
    hits = docs.where(F.size("hits") > 0).select("uid", "n_words", F.inline("hits"))
    shingle = ["h", "digest", "w"]
    if least is None:
        met = hits.join(index, shingle)
    else:
        counts = hits.groupBy(shingle).agg(F.count("*").alias("df"))
        rare = Window.partitionBy("item_id", "variant").orderBy(F.coalesce("df", F.lit(0)), "h", "digest")
        own = Window.partitionBy("item_id", "variant")
        ranked = index.join(counts, shingle, "left").withColumns({"rank": F.row_number().over(rare), "m": F.count("*").over(own), "twice": F.max(F.size("offs")).over(own)})
        # so many shingles, each at most in its places, are needed to cover the share
        need = F.greatest(F.lit(1), F.ceil(F.lit(least) * F.col("size") / (F.col("w") * F.col("twice"))))
        prefix = ranked.where(F.col("rank") <= F.col("m") - need + 1).select("item_id", "variant", "size", *shingle)
        met = hits.join(prefix, shingle).where(F.col("n_words") >= F.lit(least) * F.col("size")).select("uid", "item_id", "variant").distinct()
        met = hits.join(met, "uid").join(index.withColumnsRenamed({"item_id": "i", "variant": "v"}), shingle).where(F.col("item_id").eqNullSafe(F.col("i")) & (F.col("variant") == F.col("v")))
    met = met.select("uid", "item_id", "variant", "size", F.struct("pos", "w", "offs").alias("hit")).repartition("uid")
    # any item-sized span lies in two neighbouring blocks of its length, so a group has at most that many hits
    block = F.floor(F.col("hit.pos") / (F.col("size") + F.col("hit.w")))
    met = met.withColumn("block", F.explode(F.array(block - 1, block)))
    spans = met.groupBy("uid", "item_id", "variant", "size", "block").agg(F.collect_list("hit").alias("hits"))
    spans = spans.withColumn("containment", _coverage(F.col("hits"), F.col("size")))
    items = spans.groupBy("uid", "item_id").agg(F.max("containment").alias("containment"), F.flatten(F.collect_list(F.transform("hits", lambda x: F.struct(x["pos"].alias("pos"), x["w"].alias("w"))))).alias("at"))
    if least is not None:
        items = items.where(F.col("containment") >= least)
    named = F.filter(F.array_sort(F.collect_list(F.struct("item_id", "containment"))), lambda i: i["item_id"].isNotNull())
    rows = items.groupBy("uid").agg(named.alias("items"), F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"))
    words = F.array_sort(F.array_distinct(F.flatten(F.transform("at", lambda x: F.sequence(x["pos"], x["pos"] + x["w"] - 1)))))
    edges = lambda c, step: F.filter(c, lambda x, i: ~F.coalesce(F.get(c, i + step) == x + step, F.lit(False)))
    runs = let(words, lambda c: F.zip_with(edges(c, -1), edges(c, 1), lambda a, b: F.struct(a.alias("a"), (b + 1).alias("b"))))
    rows = rows.select("uid", "items", runs.alias("spans"))
    out = docs.drop("hits").join(rows, "uid", "left").drop("uid")
    nothing = lambda c: F.coalesce(F.col(c), F.array().cast(rows.schema[c].dataType)).alias(c)
    return out.select("doc_id", "text_hash", "n_words", nothing("spans"), nothing("items"))


def op4_decontamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's digest of leaks()."""
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i["item_id"].cast("string"))), ",")
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, r: n + r["b"] - r["a"])
    return leaks(documents, benchmark, 8).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"), (F.size("items") >= 2).alias("contaminated"))


def decontaminated(documents: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT, window: int = 8) -> DataFrame:
    """The documents, all columns, in which no item is contained to the given share of its words."""
    bad = leaks(documents, benchmark, window, containment).where(F.size("items") > 0).select("doc_id", "text_hash").distinct()
    return without(documents, written(bad, "leak-bad"))
