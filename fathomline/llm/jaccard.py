"""N-gram Jaccard join by prefix trees over globally ordered shingle sets.

A document is the set of its 5-word shingles; documents link at a Jaccard similarity of 0.75 or more.

1. One pass hashes every text's shingles, notes a signature of each whole set (equal sets are one from
   here on) and counts all shingles in a bounded table of hash buckets.
2. The global order of shingles is by rarity class of the bucket, then by hash.  Of each set the prefix
   that any partner must touch (n - ceil(0.75 n) + 1 shingles) is dealt by shingle.
3. Each set meets one set of each of its prefix lists only: the pivot, which shares lists with the most
   sets.  Of a group of near copies that is a text close to their common origin, so that most members link
   to it at once, at the cost of one row a member and list.  Pairs that share too few prefix shingles to
   reach 0.75 are dropped by count; of the others, that with most in common is verified.
4. Verification gathers the partners of one set in blocks.  Their ordered sets form a trie (in sorted
   order, each shares the nodes of its common prefix with the one before); it is walked with the
   overlaps so far, and branches whose remaining lengths can't reach the bound are pruned.
5. The found links give components.  Lists that still span more than one component give their pairs across
   components, at those shared shingles only from which on both sets have as many such lists left as the
   least overlap asks for.  Pairs that then share enough of them are verified too.  No link between
   components is lost, and pairs inside one are not made.

Shingles are told apart by 64-bit hashes (58 bits below the rarity class).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import connected_components, forest_roots
from .shared import small_batches, table, written

WORDS = 5
#: Buckets of the shingle counts (a bounded table on the driver and in each worker) and slices they travel in.
BUCKETS, SLICE = 1 << 20, 1 << 14
#: Partners of one set that are verified together.
BLOCK = 256
#: Rows up to which a list of sets is broadcast (24 bytes each); beyond, a shuffled join.
BROADCAST_ROWS = 500_000
#: Odd multipliers of the word hash and of the shingle hash.
BYTE, WORD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
LAST_ID = 2**63 - 1

_powers: list[np.ndarray] = []


def powers(n: int) -> list[np.ndarray]:
    """Powers of BYTE and of its inverse modulo 2 ** 64."""
    if not _powers or len(_powers[0]) < n:
        _powers.clear()
        for b in (BYTE, pow(BYTE, -1, 2**64)):
            p = np.full(max(n, 1 << 17), b, dtype=np.uint64)
            p[0] = 1
            _powers.append(np.cumprod(p, dtype=np.uint64))
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The distinct shingles of a whole text as sorted 64-bit hashes; A-Z lower-cased, words between white
    space (space, tab to carriage return); a text of fewer words is one shingle, one without words none."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    if not len(data):
        return np.zeros(0, dtype=np.uint64)
    space = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    edge = np.flatnonzero(np.diff(np.concatenate([[1], space.view(np.int8), [1]])))
    begin, end = edge[::2], edge[1::2]
    if not len(begin):
        return np.zeros(0, dtype=np.uint64)
    data = data.astype(np.uint64) + np.uint64(1)
    data[(data >= 0x42) & (data <= 0x5B)] += np.uint64(0x20)
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(data * up[: len(data)], out=total[1:])
    word = mix((total[end] - total[begin]) * down[begin])
    size = min(words, len(word))
    out = np.full(len(word) - size + 1, np.uint64(size))
    for i in range(size):
        out = out * np.uint64(WORD) + word[i : i + len(out)]
    return np.unique(mix(out))


def bucket_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(BUCKETS - 1)).astype(np.intp)


def ordered(hashes: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The shingles in global order: the class of their bucket in the top 6 bits, then 58 bits of hash."""
    return np.sort(classes[bucket_of(hashes)].astype(np.uint64) << np.uint64(58) | hashes >> np.uint64(6))


def signature(hashes: np.ndarray) -> int:
    """A 64-bit mark of the whole set."""
    place = np.arange(1, len(hashes) + 1, dtype=np.uint64)
    value = mix(np.array([mix(hashes * (place * np.uint64(2) + np.uint64(1)) + place).sum() + np.uint64(len(hashes))], dtype=np.uint64))
    return int(value.view(np.int64)[0])


def prefix_length(n):
    return n - (3 * n + 3) // 4 + 1


def least_overlap(a, b):
    return (3 * (a + b) + 6) // 7


def first_pass(docs: DataFrame) -> DataFrame:
    """kind 0: doc_id, th, n, sig of every row.  kind 1: slice and counts of the shingle buckets of a partition."""
    schema = "kind int, doc_id long, th long, n long, sig long, slice int, counts binary"
    names = ["kind", "doc_id", "th", "n", "sig", "slice", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, dtype=np.uint32)
        seen = False
        for b in batches:
            n, sig = [], []
            for t in b.column(2).to_pylist():
                s = shingles(t or "")
                n.append(len(s))
                sig.append(signature(s))
                np.add.at(counts, bucket_of(s), 1)
            seen = True
            k = b.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array([0] * k, pa.int32()), b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(sig, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=names
            )
        if seen:
            parts = [(i, counts[i * SLICE : (i + 1) * SLICE]) for i in range(BUCKETS // SLICE)]
            parts = [(i, c.astype("<u4").tobytes()) for i, c in parts if c.any()]
            k = len(parts)
            none = pa.nulls(k, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([1] * k, pa.int32()), none, none, none, none, pa.array([i for i, _ in parts], pa.int32()), pa.array([c for _, c in parts], pa.binary())], names=names
            )

    return docs.mapInArrow(run, schema)


def rarity_classes(first: DataFrame) -> np.ndarray:
    """A class of 0 to 63 for each bucket, from the counts of all shingles of all documents."""

    def add(key, rows):  # SLICE counts from each partition
        total = np.zeros(SLICE, dtype=np.uint64)
        for c in rows.column("counts").to_pylist():
            total += np.frombuffer(c, dtype="<u4")
        classes = np.minimum(np.floor(2 * np.log2(total + 1.0)), 63).astype(np.uint8)
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "classes": pa.array([classes.tobytes()], pa.binary())})

    out = np.zeros(BUCKETS, dtype=np.uint8)
    # BUCKETS bytes in all, whatever the corpus
    for x in first.where("kind = 1").select("slice", "counts").groupBy("slice").applyInArrow(add, "slice int, classes binary").collect():
        out[x.slice * SLICE : (x.slice + 1) * SLICE] = np.frombuffer(x.classes, dtype=np.uint8)
    return out


def postings(docs: DataFrame, classes) -> DataFrame:
    """A row per shingle in the prefix of each distinct set (once a partition): h, sig, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            keys, sigs, sizes = [], [], []
            for t in b.column(0).to_pylist():
                s = shingles(t or "")
                sig = signature(s)
                if len(s) and sig not in seen:
                    seen.add(sig)
                    k = ordered(s, classes.value)[: prefix_length(len(s))]
                    keys.append(k)
                    sigs.append(np.full(len(k), sig, dtype=np.int64))
                    sizes.append(np.full(len(k), len(s), dtype=np.int32))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(sigs)), pa.array(np.concatenate(sizes))], names=["h", "sig", "n"])

    return docs.select("text").mapInArrow(run, "h long, sig long, n int")


def trie_overlaps(probe: np.ndarray, sets: list[np.ndarray], step: int = 64) -> list[bool]:
    """Whether each ordered set reaches 0.75 with the probe.

    The sets are taken in lexicographic order, which is a depth-first walk of their trie: each keeps the
    overlaps counted at the nodes that it shares with the set before.  A branch ends as soon as its overlap
    and what remains of the set and of the probe can't reach the least overlap.
    """
    out = [False] * len(sets)
    before = np.zeros(0, dtype=np.uint64)
    counted = np.zeros(1, dtype=np.int64)  # overlap after each node of the path of `before`
    for i in sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes()):
        s = sets[i]
        need = least_overlap(len(probe), len(s))
        m = min(len(s), len(before), len(counted) - 1)
        differ = np.flatnonzero(s[:m] != before[:m])
        shared = int(differ[0]) if len(differ) else m
        path = [counted[: shared + 1]]
        have, at = int(counted[shared]), shared
        while True:
            behind = int(np.searchsorted(probe, s[at - 1], side="right")) if at else 0
            if have + min(len(s) - at, len(probe) - behind) < need:
                break
            if at == len(s):
                out[i] = True
                break
            part = s[at : at + step]
            spot = np.minimum(np.searchsorted(probe, part), len(probe) - 1)
            more = have + np.cumsum(probe[spot] == part)
            path.append(more)
            have, at = int(more[-1]), at + len(part)
        before, counted = s, np.concatenate(path)
    return out


def verify(pairs: DataFrame, sets: DataFrame, classes) -> DataFrame:
    """The pairs (a, b) that link.  sets: sig and text of every set in pairs."""
    per = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("m"))
    dealt = pairs.join(per, "a").withColumn("block", F.pmod(F.xxhash64("b"), F.ceil(F.col("m") / F.lit(BLOCK))).cast("int")).select("a", "block", "b")
    probes = dealt.select("a", "block").distinct().withColumn("sig", F.col("a")).withColumn("role", F.lit(0))
    others = dealt.select("a", "block", F.col("b").alias("sig"), F.lit(1).alias("role"))
    rows = probes.unionByName(others).join(sets, "sig").select("a", "block", "role", "sig", "text")
    rows = rows.repartition("a", "block").sortWithinPartitions("a", "block", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, probe, held = None, None, []

        def flush():
            if held and probe is not None:
                good = trie_overlaps(probe, [s for _, s in held])
                found = [sig for (sig, _), g in zip(held, good) if g]
                if found:
                    return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(found), pa.int64()), pa.array(found, pa.int64())], names=["a", "b"])
            return None

        for batch in batches:
            for a, block, role, sig, text in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if (a, block) != key:
                    if (out := flush()) is not None:
                        yield out
                    key, probe, held = (a, block), None, []
                s = ordered(shingles(text), classes.value)
                if role == 0:
                    probe = s
                else:
                    held.append((sig, s))
        if (out := flush()) is not None:
            yield out

    return rows.mapInArrow(run, "a long, b long")


def _least_shared(a: str, b: str):
    """How many prefix shingles sets of the sizes a and b share at least where they reach 0.75."""
    beyond = F.greatest(F.col(a) - prefix_floor(a), F.col(b) - prefix_floor(b))
    return F.floor((3 * (F.col(a) + F.col(b)) + 6) / F.lit(7)) - beyond


def prefix_floor(n: str):
    c = F.col(n)
    return c - F.floor((3 * c + 3) / F.lit(4)) + 1


def near(a: str, b: str):
    """The length filter: the smaller set has at least 0.75 of the larger's size."""
    return 4 * F.least(F.col(a), F.col(b)) >= 3 * F.greatest(F.col(a), F.col(b))


def with_signature(docs: DataFrame, name: str, text: str = "text") -> DataFrame:
    """docs with the mark of each text's set of shingles, the sig of jaccard_components."""
    small_batches(docs.sparkSession)
    schema = docs.select("*", F.lit(0).cast("long").alias(name)).schema
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sigs = pa.array([signature(shingles(t or "")) for t in b.column(at).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, sigs], names=schema.names)

    return docs.mapInArrow(run, schema)


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """marked_components without part."""
    return marked_components(docs, key, text).drop("part")


def marked_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest key that links reach) sig, a mark of the
    set, and part, a mark of the component (null without shingles).

    Null and empty texts have no shingle and link with nothing, so component_id is their own key.  A row
    in gives a row out, repeated or not; different texts of one key are nodes of their own.  Null keys link
    like others; component_id is null where no row
    of the component has a key.  An empty table gives no rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LAST_ID)).alias("doc_id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("text"))
    first = written(first_pass(source), "jaccard-sets")
    marked = first.where("kind = 0").select("doc_id", "th", "n", "sig")
    classes = spark.sparkContext.broadcast(rarity_classes(first))  # BUCKETS bytes
    # of each set the row with the smallest key
    nodes = marked.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.min_by("th", "doc_id").alias("th"))

    # lists of two sets and more, and the pivot of each
    spread = written(postings(source, classes), "jaccard-postings")
    shared = spread.groupBy("h").agg(F.min("sig").alias("lo"), F.max("sig").alias("hi")).where("lo <> hi").select("h")
    live = written(spread.join(shared, "h").distinct(), "jaccard-lists")
    sized = live.join(live.groupBy("h").agg(F.count(F.lit(1)).alias("m")), "h")
    weighed = live.join(sized.groupBy("sig").agg(F.sum("m").alias("weight")), "sig")
    pivots = weighed.groupBy("h").agg(F.max("weight").alias("top"), F.max_by("sig", F.struct("weight", "sig")).alias("a"), F.max_by("n", F.struct("weight", "sig")).alias("na"))
    one = live.withColumnRenamed("sig", "b").withColumnRenamed("n", "nb").join(pivots.select("h", "a", "na"), "h").where((F.col("a") != F.col("b")) & near("na", "nb"))
    counted = one.groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= _least_shared("na", "nb"))
    best = counted.groupBy("b").agg(F.max_by("a", F.struct("c", "a")).alias("a"))  # one link a member
    tried = written(best.select("a", "b"), "jaccard-pairs")
    linked = written(verify(tried, _texts(source, nodes, tried), classes), "jaccard-links")
    label = forest_roots(linked, "b", "a")  # a pivot outweighs those that it is met by: no cycles

    # lists that span components: their pairs across components that were not tried
    named = written(live.join(label, live.sig == label.node, "left").select("h", "sig", "n", F.coalesce("component", "sig").alias("part")), "jaccard-named")
    spans = named.groupBy("h").agg(F.min("part").alias("least"), F.max("part").alias("most")).where("least <> most").select("h")
    own = Window.partitionBy("sig")  # the prefix of one set
    open_ = named.join(spans, "h").withColumn("left", F.count(F.lit(1)).over(own) - F.row_number().over(own.orderBy("h")) + 1)
    open_ = written(open_, "jaccard-open")
    sides = [open_.select("h", F.col("sig").alias(c), F.col("n").alias(f"n{c}"), F.col("part").alias(f"p{c}"), F.col("left").alias(f"l{c}")) for c in "ab"]
    enough = F.least("la", "lb") >= _least_shared("na", "nb")
    across = sides[0].join(sides[1], "h").where((F.col("a") < F.col("b")) & (F.col("pa") != F.col("pb")) & near("na", "nb") & enough)
    pairs = written(across.select("a", "b", "na", "nb").distinct(), "jaccard-across")
    both = pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).distinct()
    held = open_.join(both, "sig", "left_semi").groupBy("sig").agg(F.collect_list("h").alias("hs"))  # the prefix of one set
    held = written(held, "jaccard-prefixes")
    met = pairs.join(held.toDF("a", "ha"), "a").join(held.toDF("b", "hb"), "b").where(F.size(F.array_intersect("ha", "hb")) >= _least_shared("na", "nb"))
    back = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = written(met.select("a", "b").join(back, ["a", "b"], "left_anti"), "jaccard-more-pairs")
    more = written(verify(rest, _texts(source, nodes, rest), classes), "jaccard-more-links")
    if not more.isEmpty():  # links between whole components
        of = lambda c: label.select(F.col("node").alias(c), F.col("component").alias(f"{c}_part"))
        ends = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_part", "a").alias("a"), F.coalesce("b_part", "b").alias("b"))
        joined = connected_components(ends, "a", "b").select(F.col("node").alias("component"), F.col("component").alias("whole"))
        moved = label.join(joined, "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
        label = moved.unionByName(joined.select(F.col("component").alias("node"), F.col("whole").alias("component")))

    part = nodes.join(label, nodes.sig == label.node, "left").select("sig", "doc_id", F.coalesce("component", "sig").alias("part"))
    smallest = part.groupBy("part").agg(F.min("doc_id").alias("component_id"))
    of_set = part.join(smallest, "part").select("sig", "component_id", "part")
    out = marked.join(of_set, "sig", "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    real = lambda c: F.when(F.col(c) != LAST_ID, F.col(c))
    return out.select(real("doc_id").alias("doc_id"), F.col("n").alias("n_shingles"), real("component_id").alias("component_id"), "sig", "part")


def _texts(source: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """sig and text of the sets in pairs, each once."""
    wanted = pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).distinct().join(nodes, "sig")
    wanted = written(wanted.select("sig", "doc_id", "th"), "jaccard-wanted")
    few = wanted.count() <= BROADCAST_ROWS
    picked = source.join(F.broadcast(wanted) if few else wanted, ["doc_id", "th"]).select("sig", "text")
    return picked.dropDuplicates(["sig"])  # rows that agree in key and text


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: every document's shingle count and component."""
    return jaccard_components(table(spark, sf_dir, "documents")).drop("sig")
