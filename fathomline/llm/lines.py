"""Line deduplication by an exact set-similarity join, in DataFrame functions only.

A line is a set of words.  It is removed if an earlier line has a Jaccard similarity of 0.8 or more with
it; earlier is by document key, then by line number.  Whether the earlier line is itself removed makes no
difference, so the result doesn't depend on an order of work.

1. Equal lines (trimmed, lower-cased) are one from here on; all but the first go.
2. Words are ordered by rarity: word counts of all lines in a bounded table of hash buckets give a class,
   and ties go by hash.  A line's prefix is what any partner must touch: n - ceil(0.8 n) + 1 words.
3. Neighbouring words of the prefix are a key.  Each line meets the first line of each of its keys, if the
   length and parity filters let it, and is verified against the one met most often: one pair a line, so
   that a group of thousands of variants of a line costs a pair a member.  Lines that this removes don't
   probe.
4. The others meet all earlier lines on their prefix words, under the length filter, the positional
   filter and a 128-bit parity of the word sets, 64 bits for the rarer words and 64 for the others (its
   Hamming distance is at most the symmetric difference).
5. What remains is verified on the words themselves.

Equal lines are told by 64-bit hashes.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import free_prefix, table, written

#: Buckets of the word counts: the bound of the rarity table.
BUCKETS = 1 << 18
#: Rows up to which a list of lines is broadcast (about 50 bytes each); beyond, shuffled joins.
BROADCAST_ROWS = 400_000
#: Documents and line numbers in all up to which the list of removed lines is broadcast (8 to 40 bytes each):
#: beyond, whole texts are shuffled.
BROADCAST_NUMBERS = 1_000_000
#: Keys of a line in the round of leaders; what it leaves meets all earlier lines.
KEYS = 8
FIRST_KEY = -(2**63)
HASH_BITS = 50
#: What is trimmed from both ends of a line.
BLANKS = " \t\r\u000b\u000c"
#: Buckets that one row of the word counts holds: fewer rows than words are counted in a table that fits caches.
LANES = 8


def _broadcast_if_small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint where its rows, counted, are few enough; df is a written table."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    k = F.coalesce(F.col(key).cast("long"), F.lit(FIRST_KEY))
    return docs.select(k.alias("k"), F.xxhash64(F.col(text)).alias("rk"), F.col(text).alias("text"))


def lines_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """k, rk, line_no, norm and lid of every line that isn't blank."""
    line = F.col("line")
    padded = reduce(or_, [f(F.lit(c)) for c in BLANKS for f in (line.startswith, line.endswith)])
    trimmed = F.when(padded, F.btrim(line, F.lit(BLANKS))).otherwise(line)  # btrim visits each character
    lines = _rows(docs, key, text).select("k", "rk", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(trimmed != "")
    return lines.select("k", "rk", "line_no", F.lower(trimmed).alias("norm")).withColumn("lid", F.xxhash64("norm"))


def words(norm: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(norm, " "), ""))


def least_overlap(total: Column) -> Column:
    """The smallest intersection of two sets of ``total`` members in all at a similarity of 0.8."""
    return F.floor((4 * total + 8) / F.lit(9))


def prefix_length(n: Column) -> Column:
    return n - F.floor((4 * n + 4) / F.lit(5)) + 1


def index_length(n: Column) -> Column:
    """The prefix that a partner of no smaller size must touch."""
    return n - F.floor((8 * n + 8) / F.lit(9)) + 1


def _parity(tokens: Column) -> Column:
    """A token flips the bit that 6 bits of its hash name."""
    one = F.lit(1).cast("long")
    return F.aggregate(tokens, F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(F.call_function("shiftleft", one, x.bitwiseAND(F.lit(63)).cast("int"))))


def bucket(word: Column) -> Column:
    return F.hash(word).bitwiseAND(F.lit(BUCKETS - 1))


def word_counts(reps: DataFrame) -> DataFrame:
    """b and c of each bucket: the words of all lines in it."""
    b = reps.select(F.explode(F.split("norm", " ")).alias("w")).select(bucket(F.col("w")).alias("b"))
    lane = F.col("b").bitwiseAND(F.lit(LANES - 1))
    rows = b.groupBy((F.col("b") - lane).alias("of")).agg(*[F.sum((lane == i).cast("long")).alias(f"c{i}") for i in range(LANES)])
    return rows.select("of", F.posexplode(F.array(*[f"c{i}" for i in range(LANES)])).alias("i", "c")).select((F.col("of") + F.col("i")).alias("b"), "c")


def rarity(counts: DataFrame) -> list[int]:
    """The class of each bucket by its words' count c.  BUCKETS rows at most reach the driver, as columns: as
    rows they would take some hundred bytes each."""
    table = counts.toArrow()
    classes = np.zeros(BUCKETS, dtype=np.int64)
    classes[table["b"].to_numpy()] = 16 * np.log2(table["c"].to_numpy() + 1)
    return classes.tolist()


def middle(classes: list[int]) -> int:
    """The token below which about half of all words lie, by the classes of the buckets."""
    weights = np.bincount(classes, weights=2.0 ** (np.asarray(classes) / 16) - 1)
    upto = np.cumsum(weights)
    c = int(np.searchsorted(upto, upto[-1] / 2))
    share = (upto[c] - upto[-1] / 2) / weights[c] if weights[c] else 0
    return (c << HASH_BITS) + int((1 - share) * (1 << HASH_BITS))


def line_sets(reps: DataFrame, classes: list[int]) -> DataFrame:
    """Of each distinct line: lid, k, n, parity and prefix.

    A token is its rarity class above HASH_BITS bits of hash, so tokens sort by rarity.  Functions of lambdas run
    interpreted, a call a node and word, so there is one for the tokens, and each word is in one half of the parity:
    words rarer than the middle flip bits of b1, the others bits of b2."""
    held = F.split(F.lit(",".join(map(str, classes))), ",").cast("array<bigint>")  # BUCKETS numbers
    hashed = lambda w: F.call_function("shiftrightunsigned", F.xxhash64(w), F.lit(64 - HASH_BITS))
    token = lambda w: F.call_function("shiftleft", held[bucket(w)], F.lit(HASH_BITS)).bitwiseOR(hashed(w))
    tokens = F.sort_array(F.array_distinct(F.transform(F.array_remove(F.split("norm", " "), ""), token)))
    cut = F.lit(middle(classes)).cast("long")
    sets = reps.select("lid", "k", tokens.alias("tokens"))
    sets = sets.select("lid", "k", "tokens", F.size("tokens").alias("n"), (F.array_position(F.sort_array(F.array_append("tokens", cut)), cut) - 1).cast("int").alias("rarer"))
    return sets.select(
        "lid", "k", "n",
        _parity(F.slice("tokens", F.lit(1), F.col("rarer"))).alias("b1"),
        _parity(F.slice("tokens", F.col("rarer") + 1, F.col("n") - F.col("rarer"))).alias("b2"),
        F.slice("tokens", F.lit(1), prefix_length(F.col("n")).cast("int")).alias("prefix"),
    )


def _alike(na: Column, nb: Column, a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Length and parity filters."""
    apart = F.bit_count(a1.bitwiseXOR(b1)) + F.bit_count(a2.bitwiseXOR(b2))
    return (5 * F.least(na, nb) >= 4 * F.greatest(na, nb)) & (apart <= na + nb - 2 * least_overlap(na + nb))


def verified(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """lid of the lines x of pairs (x, y), each given once, for which y is earlier and similar enough."""
    pairs = written(pairs, "line-pairs")
    ids = written(pairs.select(F.col("x").alias("lid")).union(pairs.select("y")).distinct(), "line-ids")
    some = reps.join(_broadcast_if_small(ids), "lid", "left_semi")
    side = lambda s: some.select(F.col("lid").alias(s), F.struct("k", "rk", "line_no").alias(f"at_{s}"), words(F.col("norm")).alias(f"w_{s}"))
    both = pairs.join(side("x"), "x").join(side("y"), "y").where("at_y < at_x")
    common = F.size(F.array_intersect("w_x", "w_y"))
    return both.where(9 * common >= 4 * (F.size("w_x") + F.size("w_y"))).select(F.col("x").alias("lid")).distinct()


def distinct_lines(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """lid, k, rk, line_no and norm of each different line where it first stands; k, rk, line_no of its copies."""
    lines = lines_of(docs, key, text)
    at = F.struct("k", "rk", "line_no")
    again = written(lines.groupBy("lid").agg(F.min(at).alias("at"), F.count(F.lit(1)).alias("c")).where("c > 1").select("lid", "at"), "line-copies")
    marked = lines.join(_broadcast_if_small(again), "lid", "left").withColumn("often", F.col("at").isNotNull()).withColumn("first", F.coalesce(F.col("at") == at, F.lit(True)))
    marked = written(marked.select("lid", "k", "rk", "line_no", "often", "first", F.when(F.col("first"), F.col("norm")).alias("norm")), "lines")
    reps = marked.where("first").select("lid", "k", "rk", "line_no", "norm")
    if not marked.where("first and often").groupBy("lid").agg(F.count(F.lit(1)).alias("c")).where("c > 1").isEmpty():  # rows that agree in key and text
        reps = written(reps.dropDuplicates(["lid"]), "lines-once")
    return reps, marked.where("not first").select("k", "rk", "line_no")


def leaders(sets: DataFrame) -> DataFrame:
    """x and y: of the first lines of x's keys that the filters let x meet, that met most often."""
    pairs = F.array(*[F.xxhash64(F.get("prefix", F.lit(i)), F.get("prefix", F.lit(i + 1))) for i in range(KEYS)])
    m = F.explode(F.slice(pairs, F.lit(1), F.least(index_length(F.col("n")), F.lit(KEYS)).cast("int"))).alias("m")
    first = sets.select("lid", "k", m).groupBy("m").agg(F.min_by("lid", "k").alias("lid"), F.count(F.lit(1)).alias("c")).where("c > 1")  # where keys tie, any
    lead = first.select("m", "lid").join(sets.select("lid", "n", "b1", "b2"), "lid").toDF("y", "m", "y_n", "y_b1", "y_b2")
    fits = _alike(F.col("n"), F.col("y_n"), F.col("b1"), F.col("b2"), F.col("y_b1"), F.col("y_b2"))
    met = sets.select("lid", "n", "b1", "b2", m).join(lead, "m").where((F.col("lid") != F.col("y")) & fits)
    return met.groupBy(F.col("lid").alias("x"), "y").agg(F.count(F.lit(1)).alias("times")).groupBy("x").agg(F.max_by("y", "times").alias("y"))


def removed_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """k, rk, line_no of every line that goes."""
    reps, copies = distinct_lines(docs, key, text)
    sets = written(line_sets(reps, rarity(word_counts(reps))), "line-sets")
    covered = written(verified(leaders(sets), reps), "line-covered")

    # the others against all earlier lines; a covered line has its size negated, which no probe passes
    flagged = sets.join(_broadcast_if_small(covered.withColumn("covered", F.lit(True))), "lid", "left")
    size = F.when(F.col("covered"), -F.col("n")).otherwise(F.col("n"))
    posted = flagged.select("lid", "k", size.alias("n"), "b1", "b2", F.posexplode("prefix").alias("i", "w"))
    x = posted.select(*[F.col(c).alias(f"x_{c}") for c in ("lid", "k", "n", "b1", "b2", "i", "w")])
    y = posted.select(*[F.col(c).alias(f"y_{c}") for c in ("lid", "k", "n", "b1", "b2", "i", "w")])
    xn, yn = F.col("x_n"), F.abs("y_n")
    need = least_overlap(xn + yn)
    found = x.join(
        y,
        (F.col("x_w") == F.col("y_w"))
        & (F.col("y_k") <= F.col("x_k"))
        & (F.col("x_lid") != F.col("y_lid"))
        & _alike(xn, yn, F.col("x_b1"), F.col("x_b2"), F.col("y_b1"), F.col("y_b2"))
        & (F.least(xn - F.col("x_i"), yn - F.col("y_i")) >= need),
    ).select(F.col("x_lid").alias("x"), F.col("y_lid").alias("y"))
    similar = verified(found.distinct(), reps)
    gone = reps.select("lid", "k", "rk", "line_no").join(_broadcast_if_small(written(covered.union(similar).distinct(), "line-gone")), "lid", "left_semi")
    return copies.unionByName(gone.select("k", "rk", "line_no"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with n_lines, n_removed and ``text`` without the lines that an earlier line resembles.

    Lines are what "\\n" parts; words are what spaces part, lower-cased.  Blank lines are never removed
    and never match.  Null texts stay null (0 lines), empty ones empty (1 line).  Rows that agree in key
    and text are one document and all keep their lines; a null key comes first.  Other columns pass
    through; columns already named like the counts are replaced.  An empty table stays empty.
    """
    docs = docs.drop(*[c for c in ("n_lines", "n_removed") if c in docs.columns])
    own = free_prefix(docs.columns)
    k, rk, gone, parts, new = (own + c for c in ("k", "rk", "gone", "parts", "text"))
    lists = removed_lines(docs, key, text).groupBy(F.col("k").alias(k), F.col("rk").alias(rk)).agg(F.collect_set("line_no").alias(gone))  # within a document
    lists = written(lists, "line-removed")
    few = lists.agg(F.count(F.lit(1)) + F.coalesce(F.sum(F.size(gone)), F.lit(0))).first()[0] <= BROADCAST_NUMBERS
    joined = docs.withColumns({k: F.coalesce(F.col(key).cast("long"), F.lit(FIRST_KEY)), rk: F.xxhash64(F.col(text))})
    joined = joined.join(F.broadcast(lists) if few else lists, [k, rk], "left").withColumn(parts, F.when(F.col(gone).isNotNull(), F.split(F.col(text), "\n")))
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(gone))
    clean = F.when(F.col(gone).isNull(), F.col(text)).otherwise(F.array_join(F.transform(kept, lambda i: F.element_at(F.col(parts), i + 1)), "\n"))
    breaks = F.octet_length(F.col(text)) - F.octet_length(F.replace(F.col(text), F.lit("\n"), F.lit("")))
    n_lines = F.coalesce(breaks + 1, F.lit(0)).cast("long")
    out = joined.withColumns({"n_lines": n_lines, "n_removed": F.coalesce(F.size(gone), F.lit(0)).cast("long"), new: clean})
    return out.select(*[F.col(new).alias(text) if c == text else F.col(c) for c in docs.columns], "n_lines", "n_removed")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: every document without its repeated lines."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", "n_lines", "n_removed", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))
