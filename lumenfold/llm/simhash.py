"""SimHash near-dedup by multi-index hashing.

Each text becomes a 64-bit fingerprint. Two fingerprints link if they differ in at most two bits. The index has a table for
each of two segments of 32 bits, in which a fingerprint stands under its segment's value. Of two fingerprints that link, one
segment differs in a bit at most: each fingerprint looks up the Hamming ball of radius 1 around its segment (only the flips
that set a bit, as the other of the two has it set), and the complete distance of each match is verified.

A segment value that more than CROWD fingerprints share is split by the rest of the fingerprint: all that would look it up
register under their full Hamming ball of radius 1, the other segment unchanged or flipped. Two at most 2 bits apart share
such a key, a key has at most 65 fingerprints, all within 2 bits of each other, and each is linked with its neighbour there,
which makes the same components as all pairs. So no group is a full bucket, whatever its size.

Defined results: null or empty text has fingerprint zero, which links like any other; copies share a fingerprint and
are one node; rows with the same doc_id are separate rows of the result; an empty table gives an empty result;
further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.common import discard, perhaps_within, sifted, without, written
from lumenfold.llm.components import components
from lumenfold.runtime import ship

BITS = 64


def fingerprint_of(text: bytes, shingle: int) -> int:
    """The fingerprint of UTF-8 text as an unsigned number."""
    import numpy as np
    import xxhash

    words = text.lower().split()  # on bytes: A-Z and the six ASCII separators only
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return h(b" ".join(words), 42)
    hashes = np.fromiter((h(b" ".join(s), 42) for s in zip(*(words[k:] for k in range(shingle)), strict=False)), dtype=np.uint64, count=len(words) - shingle + 1)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        ones += np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fingerprint (bigint, two's complement) of each row."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            found = []
            for k in range(len(texts)):
                n = fingerprint_of(texts[k].as_py() or b"", shingle)
                found.append(n - (1 << BITS) if n >> (BITS - 1) else n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    ship(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id bigint, fp bigint")


#: Segments of a fingerprint and bits of each; fingerprints that may share a segment's value before it is split.
SEGMENTS, CROWD = 2, 64
SEGMENT_BITS = BITS // SEGMENTS


def _signed(n: int) -> int:
    return n - (1 << BITS) if n >> (BITS - 1) else n


def _flipped(bit: int) -> F.Column:
    return F.col("fp").bitwiseXOR(F.lit(_signed(1 << bit)))


def _segment_key(s: int) -> F.Column:
    """The value of segment s, counted from the right, under the segment's number."""
    value = F.shiftrightunsigned("fp", SEGMENT_BITS * s).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))
    return value.bitwiseOR(F.lit(s << SEGMENT_BITS))


def links(nodes: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Edges (a, b), a > b, between distinct fingerprints of the column fp that keep all components of distance <= 2."""
    table = nodes.select("fp", F.explode(F.array(*map(_segment_key, range(SEGMENTS)))).alias("key"))
    sizes = table.groupBy("key").agg(F.count("*").alias("n"))
    crowded = written(sizes.where(F.col("n") > crowd).select("key"), "simhash-crowded")

    def probes(s: int) -> list[F.Column]:
        sets = lambda bit: F.when(_segment_key(s).bitwiseAND(F.lit(1 << bit)) == 0, _segment_key(s).bitwiseXOR(F.lit(1 << bit)))
        return [_segment_key(s), *map(sets, range(SEGMENT_BITS))]

    looked = nodes.select("fp", F.explode(F.array_compact(F.array(*(k for s in range(SEGMENTS) for k in probes(s))))).alias("key"))
    open_table = table.join(crowded, "key", "left_anti").withColumnRenamed("fp", "other")
    within = lambda: (F.col("fp") != F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= 2)
    met = looked.join(open_table.hint("shuffle_hash"), "key").where(within())
    dense = looked.join(crowded, "key", "left_semi").select("fp").distinct()
    ball = dense.select("fp", F.explode(F.array(F.col("fp"), *map(_flipped, range(BITS)))).alias("key"))
    chained = ball.withColumn("other", F.lag("fp").over(Window.partitionBy("key").orderBy("fp"))).where("other IS NOT NULL").where(within())
    pairs = met.select("fp", "other").unionByName(chained.select("fp", "other"))
    return pairs.select(F.greatest("fp", "other").alias("a"), F.least("fp", "other").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id that links reach) of each row."""
    marked = written(fingerprints(docs, shingle), "simhash-fp")
    nodes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-nodes")
    roots = components(written(links(nodes.select("fp")), "simhash-links"))
    joined = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # written, so that the join shuffles both sides and Spark can split a large component
    classes = written(joined.groupBy("root").agg(F.min("first_id").alias("component_id")), "simhash-roots")
    classes = written(joined.join(classes, "root").select("fp", "component_id"), "simhash-classes")
    return marked.join(classes, "fp", "left").select("doc_id", "fp", "component_id")


#: similar_groups(): fingerprints of WORDS * 64 bits in parts of PART bits; DISTANCE bits of 256 stand for a Jaccard similarity
#: of word shingles of about 0.75, so candidates are wider than links. Balls are over the LOW bits of a part that were decided most narrowly.
WORDS, PART, DISTANCE, LOW = 4, 32, 44, 6
PARTS = WORDS * BITS // PART
#: A shingle of more texts than COMMON comes last in the order of shingles. A key misses a pair with at most this probability.
COMMON, MISS = 64, 1e-10
#: Bits of the filter of common shingles (512 KB), shingles counted at once, rounds in which keys are chosen anew, pairs of a key row beyond which they are.
COMMON_BITS, COUNTED, ROUNDS, CROSSED = 1 << 22, 1 << 20, 3, 8
#: Smallest shingles kept of each set, and how many of the smallest of two sets together both must have: with a similarity of 0.8 or
#: more, fewer have a probability under MISS (a binomial distribution).
SKETCH, SKETCH_LEAST = 64, 27
_ROW = [f"f{w}" for w in range(WORDS)]


def shingle_hashes(text: bytes, shingle: int):
    """XXH64 of every shingle of words, with repeats; fewer words are one shingle, and no words are the hash 0."""
    import numpy as np
    import xxhash

    words = text.lower().split()
    h = xxhash.xxh64_intdigest
    if len(words) < shingle:
        return np.array([h(b" ".join(words), 42) if words else 0], dtype=np.uint64)
    return np.fromiter((h(b" ".join(s), 42) for s in zip(*(words[k:] for k in range(shingle)), strict=False)), dtype=np.uint64, count=len(words) - shingle + 1)


def shingle_set(hashes) -> tuple:
    """The distinct hashes in order, and the signed hash that names the set."""
    import numpy as np
    import xxhash

    distinct = np.unique(hashes)
    return distinct, _signed(xxhash.xxh64_intdigest(distinct.tobytes(), 42))


def wide_fingerprint(hashes) -> tuple[list[int], list[int]]:
    """WORDS signed 64-bit words, and for each part its LOW bits of the narrowest majority, counted from the right.

    Each shingle's XXH64 is mixed anew for every word.
    """
    import numpy as np

    n = len(hashes)
    ones = np.zeros(WORDS * BITS, dtype=np.int64)
    for at in range(0, n, 255):  # sums fit into a byte
        x = hashes[at : at + 255]
        mixed = np.empty((len(x), WORDS), dtype=">u8")
        for w in range(WORDS):
            mixed[:, w] = x
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(32)
        ones += np.add.reduce(np.unpackbits(mixed.view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    narrow = np.argsort(np.abs(2 * ones - n).reshape(PARTS, PART), axis=1, kind="stable")[:, :LOW]
    return np.packbits(2 * ones > n).view(">i8").tolist(), (PART - 1 - narrow).ravel().tolist()


def chosen_keys(distinct, common) -> tuple:
    """The shingles of a set of which every set with a Jaccard similarity of 0.8 shares one with it, and how many of them, at the
    head, aren't common.

    All sets order shingles alike: common ones last, else by hash. Of n shingles the first n - 0.8n + 1 suffice whatever the order
    (prefix filter). As the order of the others is random, fewer do: if a share r of them at most isn't shared, the first k all
    miss with probability r ** k.
    """
    import math

    import numpy as np

    n = len(distinct)
    mark = lambda h: (common[h >> np.uint64(6)] >> (h & np.uint64(63))) & np.uint64(1)
    low = np.uint64(COMMON_BITS - 1)
    last = (mark(distinct & low) & mark((distinct >> np.uint64(22)) & low)).astype(bool)
    calm = distinct[~last]
    most, apart = n - (4 * n + 4) // 5 + 1, 0.25 * n / max(len(calm), 1e-9)
    k = most if apart >= 1 else min(most, math.ceil(math.log(MISS) / math.log(apart)))
    head = calm[:k]
    return np.concatenate((head, distinct[last][: k - len(head)])), len(head)


def _apart(a: str, b: str):
    """Differing bits of two wide fingerprints, given as structs or prefixes."""
    differ = [F.bit_count(F.col(f"{a}{c}").bitwiseXOR(F.col(f"{b}{c}"))) for c in _ROW]
    return sum(differ[1:], differ[0])


def _marked(docs: DataFrame, shingle: int) -> DataFrame:
    """A row (doc_id, text_hash, id, f0 to f3, low, sketch) of each text: id names its set of shingles, and sketch has the first
    32 bits, as signed numbers in order, of its SKETCH smallest. And rows (id, df) of shingles that
    three of a task's different sets or more have, of every COUNTED shingles: what is common shows there."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        seen: dict[int, object] = {}
        size = 0
        names = ["doc_id", "text_hash", "id", *_ROW, "low", "sketch", "df"]
        kinds = [pa.int64()] * (3 + WORDS) + [pa.list_(pa.int8()), pa.list_(pa.int32()), pa.int64()]

        def frequent() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(list(seen.values())), return_counts=True)
            often = counts > 2
            values, counts = values[often].view(np.int64), counts[often].astype(np.int64)
            columns = {"id": pa.array(values), "df": pa.array(counts)}
            return pa.RecordBatch.from_arrays([columns.get(n, pa.nulls(len(values), k)) for n, k in zip(names, kinds, strict=True)], names)

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found, ids, sketches = [], [], []
                for t in part.column(2).cast(pa.binary()):
                    hashes = shingle_hashes(t.as_py() or b"", shingle)
                    distinct, name = shingle_set(hashes)
                    found.append(wide_fingerprint(hashes))
                    ids.append(name)
                    sketches.append(((distinct[:SKETCH] >> np.uint64(32)).astype(np.int64) - (1 << 31)).astype(np.int32))
                    if name not in seen:
                        seen[name] = distinct
                        size += len(distinct)
                words = [pa.array([f[w] for f, _ in found], pa.int64()) for w in range(WORDS)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ids, pa.int64()), *words, pa.array([low for _, low in found], kinds[-3]), pa.array(sketches, kinds[-2]), pa.nulls(part.num_rows, pa.int64())], names)
                if size >= COUNTED:
                    yield frequent()
                    seen.clear()
                    size = 0
        if seen:
            yield frequent()

    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.col("text")).alias("text_hash"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, f"doc_id bigint, text_hash bigint, id bigint, {', '.join(f'{c} bigint' for c in _ROW)}, low array<tinyint>, sketch array<int>, df bigint")


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """id and shingles (the distinct hashes) of each row."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                found = [shingle_set(shingle_hashes(t.as_py() or b"", shingle)) for t in batch.column(0).slice(at, 500).cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array([i for _, i in found], pa.int64()), pa.array([s.view(np.int64) for s, _ in found], pa.list_(pa.int64()))], ["id", "shingles"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "id bigint, shingles array<bigint>")


def _hopeful(a, b):
    """Whether two sketches allow a similarity of 0.8: enough of the smallest shingles of both sets are common. Sets that are
    smaller than a sketch are compared whole, with some room for equal first halves of hashes."""
    smallest = F.slice(F.array_sort(F.array_union(a, b)), 1, SKETCH)
    common = F.size(F.array_intersect(smallest, F.array_intersect(a, b)))
    return F.when(F.size(smallest) < SKETCH, common >= 0.75 * F.size(smallest)).otherwise(common >= SKETCH_LEAST)


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """Edges (a, b), a written table, of the pairs (id, other) whose sets of shingles have a Jaccard similarity of 0.8 or more.

    Sketches rule most others out. Only texts that stand in a pair that is left are read again, and counted exactly.
    """
    met = written(pairs.distinct(), "similar-met")
    both_ids = lambda p: p.select("id").unionByName(p.select(F.col("other").alias("id"))).distinct()
    sketches, _ = sifted(nodes.select("id", "sketch"), F.xxhash64("id"), both_ids(met), F.xxhash64("id"))
    both = met.join(sketches, "id").join(sketches.select(F.col("id").alias("other"), F.col("sketch").alias("other_sketch")), "other")
    pairs = written(both.where(_hopeful(F.col("sketch"), F.col("other_sketch"))).select("id", "other"), "similar-pairs")
    if pairs.isEmpty():
        return pairs.select(F.col("id").alias("a"), F.col("other").alias("b"))
    wanted = written(nodes.select("id", "first").join(both_ids(pairs), "id").select("first.doc_id", "first.text_hash"), "similar-wanted")
    sets = written(_sets(perhaps_within(docs, wanted), shingle).dropDuplicates(["id"]), "similar-sets")
    both = pairs.join(sets, "id").join(sets.select(F.col("id").alias("other"), F.col("shingles").alias("others")), "other")
    alike = both.where(9 * F.size(F.array_intersect("shingles", "others")) >= 4 * (F.size("shingles") + F.size("others")))
    edges = written(alike.select(F.col("id").alias("a"), F.col("other").alias("b")), "similar-edges")
    discard(met, pairs, wanted, sets)
    return edges


def _fast_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (id, other) of multi-index hashing over the wide fingerprints, at most DISTANCE bits apart."""
    per_word = BITS // PART
    values = [F.shiftrightunsigned(c, PART * (per_word - 1 - k)).bitwiseAND(F.lit((1 << PART) - 1)) for c in _ROW for k in range(per_word)]
    keys = F.explode(F.array(*(F.struct(v.bitwiseOR(F.lit(t << PART)).alias("key"), F.slice("low", t * LOW + 1, LOW).alias("low")) for t, v in enumerate(values))))
    parts = nodes.select("id", *_ROW, keys.alias("s")).select("id", *_ROW, "s.key", "s.low")
    hubs = parts.groupBy("key").agg(F.min_by(F.struct("id", *_ROW), F.xxhash64("id", "key")).alias("hub"), F.count("*").alias("n")).where("n > 1").select("key", "hub")
    near = parts.join(hubs, "key").where(F.col("id") != F.col("hub.id")).where(_apart("", "hub.") <= DISTANCE)
    near = written(near.select("id", "key", F.col("hub.id").alias("other")), "similar-near")
    rest = parts.select("id", "key", "low").join(near.select("id", "key"), ["id", "key"], "left_anti")
    flips = [F.lit(0).cast("bigint"), *(F.expr(f"shiftleft(1L, low[{k}])") for k in range(LOW))]
    ball = rest.select("id", F.explode(F.array(*(F.col("key").bitwiseXOR(f) for f in flips))).alias("key"))
    order = Window.partitionBy("key").orderBy("id")
    met = ball.select("id", F.array(*(F.lag("id", k).over(order) for k in (1, 2, 3))).alias("others")).where("others[0] IS NOT NULL")
    pairs = met.select("id", F.explode("others").alias("other")).where("other IS NOT NULL").distinct()
    named = lambda side: nodes.select(F.col("id").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in _ROW))
    linked = pairs.join(named("id"), "id").join(named("other"), "other").where(_apart("id_", "other_") <= DISTANCE).select("id", "other")
    return near.select("id", "other").unionByName(linked)


def _keys(docs: DataFrame, frequent: DataFrame, shingle: int) -> DataFrame:
    """id, n (shingles), key, place (of the key in the order of the set's shingles) and common: the chosen keys of each set, a written table.

    While common keys would make many pairs, they are put last and all keys chosen anew, at most ROUNDS times; any order gives the
    same groups.
    """
    import numpy as np

    spark = docs.sparkSession
    bits = np.zeros(COMMON_BITS // 64, np.uint64)

    def add(shingles: DataFrame) -> None:
        """Set the bits of the column key; at most COMMON_BITS / 64 rows reach the driver."""
        places = shingles.select(F.explode(F.array(*(F.shiftrightunsigned("key", s).bitwiseAND(F.lit(COMMON_BITS - 1)) for s in (0, 22)))).alias("b"))
        for r in places.groupBy(F.shiftright("b", 6).cast("int").alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, int(b & 63))")).alias("x")).collect():
            bits[r["cell"]] |= np.uint64(r["x"] & (1 << BITS) - 1)

    def of_texts() -> DataFrame:
        shared = spark.sparkContext.broadcast(bits.copy())

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                for at in range(0, batch.num_rows, 1000):
                    ids, sizes, chosen, calm = [], [], [], []
                    for t in batch.column(0).slice(at, 1000).cast(pa.binary()):
                        distinct, name = shingle_set(shingle_hashes(t.as_py() or b"", shingle))
                        keys, n = chosen_keys(distinct, shared.value)
                        ids.append(name)
                        sizes.append(len(distinct))
                        chosen.append(keys.view(np.int64))
                        calm.append(n)
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(chosen, pa.list_(pa.int64())), pa.array(calm, pa.int32())], ["id", "n", "chosen", "calm"])

        rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "id bigint, n bigint, chosen array<bigint>, calm int")
        each = F.transform("chosen", lambda k, at: F.struct(k.alias("key"), at.alias("place"), (at >= F.col("calm")).alias("common")))
        return written(rows.select("id", "n", F.inline(each)).distinct(), "similar-keys")

    add(frequent.groupBy(F.col("id").alias("key")).agg(F.sum("df").alias("df")).where(F.col("df") > COMMON))
    for _ in range(ROUNDS):
        keys = of_texts()
        often = written(keys.where("NOT common").groupBy("key").agg(F.count("*").alias("df")).where(F.col("df") > COMMON), "similar-common")
        crossed = often.agg(F.sum(F.col("df").cast("double") * F.col("df"))).first()[0] or 0.0
        if crossed <= CROSSED * keys.count():
            discard(often)
            return keys
        add(often)
        discard(keys, often)
    return of_texts()


def _rooted(keys: DataFrame, roots: DataFrame) -> DataFrame:
    """id, n, key, place and root of the keys that more than one component has, a written table."""
    rooted = keys.select("id", "n", "key", "place").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    open_keys = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    return written(rooted.join(open_keys, "key"), "similar-rooted")


def _across(rooted: DataFrame, every: bool) -> DataFrame:
    """Pairs (id, other) of one key that aren't in one component yet and of which a similarity of 0.8 is possible.

    First each set with a hub of the key, another one for each key, if their sizes allow it. With every, each set outside the key's
    largest component with all of the key for which the key can be the first shingle that both have: a pair shares none before
    its first, so of n shingles, place of them before the key, n - place at most are shared, and 9(n - place) >= 4(n + m) bounds the
    other's size m by the reach (5n - 9 place) / 4, for either side. Any similar pair is met at its first shared key. Sets look
    up the sizes that a key has within their reach, then the sets of these sizes.
    """
    if not every:
        other = [F.col("id").alias("other"), F.col("n").alias("m"), F.col("root").alias("other_root")]
        hubs = rooted.groupBy("key").agg(F.min_by(F.struct(*other), F.xxhash64("id", "key")).alias("hub")).select("key", "hub.*")
        met = rooted.join(hubs, "key").where("root != other_root AND 5 * least(n, m) >= 4 * greatest(n, m)")
    else:
        rooted = rooted.withColumn("reach", F.expr("(5 * n - 9 * place) div 4"))
        sizes = rooted.groupBy("key", "root").agg(F.count("*").alias("c"))
        largest = sizes.groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("main"))
        side = rooted.join(largest, "key").where("root != main")
        spread = rooted.groupBy("key", F.col("n").alias("m")).agg(F.max("reach").alias("far"))
        looked = side.join(spread, "key").where("m <= reach AND n <= far").select("key", "m", F.col("id").alias("other"), F.col("n").alias("other_n"), F.col("root").alias("other_root"))
        met = rooted.withColumnRenamed("n", "m").join(looked, ["key", "m"]).where("root != other_root AND other_n <= reach")
    return met.select(F.greatest("id", "other").alias("id"), F.least("id", "other").alias("other"))


def similar_groups(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """doc_id, text_hash, keeper (doc_id) and stays (true for one text of each group) of each row.

    Groups are the components of all pairs of texts whose sets of word shingles have a Jaccard similarity of 0.8 or more, counted
    exactly. Texts with the same set are one node. Multi-index hashing gives the first candidates: wide fingerprints with an equal
    part are compared with a hub of them; those found near need no ball there, so a large group of copies is one row per
    member, not a full bucket under every key. All others register under the ball of radius 1 over the part's most
    uncertain bits, where alike texts differ, and meet their neighbours there.

    That joins most of each group. The rest is complete but for a chance of MISS for each pair: any two similar sets share one of
    their chosen keys, and those that do and aren't in one component yet are compared, first with a hub of the key, then all for
    which the key can be the first that both have.
    """
    ship(docs.sparkSession)
    table = written(_marked(docs, shingle), "similar-fp")
    marked = table.where("df IS NULL")
    own = ("low", "sketch", *_ROW)
    nodes = marked.groupBy("id").agg(F.min(F.struct("doc_id", "text_hash", *own)).alias("first"))
    nodes = written(nodes.select("id", F.struct("first.doc_id", "first.text_hash").alias("first"), *(F.col(f"first.{c}").alias(c) for c in own)), "similar-nodes")
    edges = _verified(_fast_pairs(nodes), nodes, docs, shingle)
    keys = _keys(docs, table.where("df IS NOT NULL").select("id", "df"), shingle)
    roots = written(components(edges), "similar-roots")
    for every in (False, True):
        rooted = _rooted(keys, roots)
        discard(keys)
        keys = rooted
        more = _verified(_across(rooted, every), nodes, docs, shingle)
        if not more.isEmpty():  # what is joined already is a star to its root
            roots = written(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)), "similar-roots")
    joined = nodes.select("id", "first").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    keepers = written(joined.groupBy("root").agg(F.min("first").alias("keeper")), "similar-keepers")
    classes = written(joined.join(keepers, "root").select("id", "keeper"), "similar-classes")
    own = F.col("doc_id").eqNullSafe(F.col("keeper.doc_id")) & F.col("text_hash").eqNullSafe(F.col("keeper.text_hash"))
    return marked.join(classes, "id", "left").select("doc_id", "text_hash", F.col("keeper.doc_id").alias("keeper"), own.alias("stays"))


def deduplicated(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """docs, all columns, with one row of each group of similar texts: that of the smallest doc_id."""
    groups = written(similar_groups(docs, shingle), "similar-groups")
    gone = written(groups.where("NOT stays").select("doc_id", "text_hash").distinct(), "similar-gone")
    left = without(docs, gone)
    again = groups.where("stays").groupBy("doc_id", "text_hash").count().where("count > 1")
    return left if again.isEmpty() else left.withColumn("_simhash_text", F.xxhash64("text")).dropDuplicates(["doc_id", "_simhash_text"]).drop("_simhash_text")


def op6_simhash_dedup(docs: DataFrame) -> DataFrame:
    """The contract's digest: doc_id, fingerprint in hex, component_id."""
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
