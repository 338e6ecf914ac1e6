"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over a window of bytes ends a chunk wherever it hits a value that depends on the block
size; each chunk gives one character.  The fingerprint is ``block:signature:signature`` with the second
signature at twice the block size.  Two fingerprints are compared at a common block size (equal, or
apart by a factor of two) by the edit distance of their signatures: insertions and deletions cost 1,
replacements 2, so likeness is 2 * LCS / (length + length).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import shuffle_partitions, small_batches, table

#: Bytes in the rolling window, the smallest block, and the longest signature.
ROLL, SMALLEST, LONGEST = 7, 3, 64
ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: Odd multipliers: of the rolling hash and of the chunk hash.
ROLLING, CHUNK = 0x01000193, 0x9E3779B97F4A7C15

_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of CHUNK and of its inverse modulo 2 ** 64."""
    if "up" not in _tables or len(_tables["up"]) < n:
        for name, b in (("up", CHUNK), ("down", pow(CHUNK, -1, 2**64))):
            p = np.full(max(n, 1 << 17), b, dtype=np.uint64)
            p[0] = 1
            _tables[name] = np.cumprod(p, dtype=np.uint64)
    return _tables["up"], _tables["down"]


def rolling(data: np.ndarray) -> np.ndarray:
    """At each byte, a 32-bit hash of the window that ends there (bytes before the start count as 0)."""
    d = data.astype(np.uint32) + np.uint32(1)
    out = d.copy()
    weight = 1
    for k in range(1, min(ROLL, len(d))):
        weight = weight * ROLLING & 0xFFFFFFFF
        out[k:] += d[:-k] * np.uint32(weight)
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x2C1B3C6D)
    return out ^ (out >> np.uint32(12))


def signature(ends: np.ndarray, sums: np.ndarray, n: int) -> bytes:
    """A character per chunk; beyond LONGEST chunks the last character covers the remainder."""
    ends = ends[: LONGEST - 1]
    begins = np.append(0, ends)
    stops = np.append(ends, n)
    if len(ends) and ends[-1] == n:
        begins, stops = begins[:-1], stops[:-1]
    _, down = _powers(n + 1)
    value = (sums[stops] - sums[begins]) * down[begins]
    value ^= value >> np.uint64(31)
    value *= np.uint64(0xBF58476D1CE4E5B9)
    return np.frombuffer(ALPHABET, dtype=np.uint8)[(value >> np.uint64(58)).astype(np.intp)].tobytes()


def fingerprint(text: str) -> str:
    """The fingerprint of a whole text; that of the empty text is "3::"."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    n = len(data)
    if not n:
        return f"{SMALLEST}::"
    level = 0
    while SMALLEST << level << 6 < n:
        level += 1
    roll = rolling(data)
    up, _ = _powers(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    while True:
        block = SMALLEST << level
        ends = np.flatnonzero(roll % np.uint32(block) == block - 1) + 1
        if level == 0 or len(ends) >= LONGEST // 2:
            break
        level -= 1
    wide = ends[roll[ends - 1] % np.uint32(2 * block) == 2 * block - 1]
    return f"{block}:{signature(ends, sums, n).decode()}:{signature(wide, sums, n).decode()}"


def common_subsequence(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """The length of the longest common subsequence of each pair of strings of at most 64 bytes, all pairs at once.

    Bit-parallel: a 64-bit row per pair, one step per character of b.
    """
    n = len(a)
    la = np.fromiter(map(len, a), dtype=np.int64, count=n)
    lb = np.fromiter(map(len, b), dtype=np.int64, count=n)
    row = np.repeat(np.arange(n), la)
    place = np.arange(len(row)) - np.repeat(np.cumsum(la) - la, la)
    where = np.zeros((n, 256), dtype=np.uint64)  # for each character, the places in a
    np.bitwise_or.at(where, (row, np.frombuffer(b"".join(a), dtype=np.uint8)), np.uint64(1) << place.astype(np.uint64))
    chars = np.frombuffer(b"".join(x.ljust(LONGEST, b"\0") for x in b), dtype=np.uint8).reshape(n, LONGEST)
    v = np.full(n, 2**64 - 1, dtype=np.uint64)
    every = np.arange(n)
    for j in range(int(lb.max()) if n else 0):
        hit = where[every, chars[:, j]]
        u = v & hit
        v = (v + u) | (v - u)
    used = np.where(la == 64, np.uint64(2**64 - 1), (np.uint64(1) << np.minimum(la, 63).astype(np.uint64)) - np.uint64(1))
    return np.bitwise_count(~v & used).astype(np.int64)


def likeness(left: list[str], right: list[str]) -> np.ndarray:
    """0 to 1 for each pair of fingerprints: 1 for equal ones, 0 where no block sizes are compatible."""
    a, b, owner = [], [], []
    out = np.zeros(len(left))
    for i, (x, y) in enumerate(zip(left, right)):
        if x == y:
            out[i] = 1.0
            continue
        bx, x1, x2 = x.split(":")
        by, y1, y2 = y.split(":")
        bx, by = int(bx), int(by)
        pairs = [(x1, y1), (x2, y2)] if bx == by else [(x2, y1)] if by == 2 * bx else [(x1, y2)] if bx == 2 * by else []
        for p, q in pairs:
            if p and q:
                a.append(p.encode())
                b.append(q.encode())
                owner.append(i)
    for lo in range(0, len(a), 2000):
        p, q = a[lo : lo + 2000], b[lo : lo + 2000]
        total = np.fromiter((len(x) + len(y) for x, y in zip(p, q)), dtype=float, count=len(p))
        np.maximum.at(out, owner[lo : lo + 2000], 2.0 * common_subsequence(p, q) / total)
    # only equal fingerprints are wholly alike
    return np.where((out >= 1.0) & (np.array(left, dtype=object) != np.array(right, dtype=object)), 0.99, out)


def add_fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """df with a fingerprint of each whole text (null: as empty); a column already named ``out`` is replaced."""
    df = df.drop(out) if out in df.columns else df
    schema = df.select("*", F.lit("").alias(out)).schema
    names = schema.names
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = [fingerprint(t or "") for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(prints, pa.string())], names=names)

    return df.mapInArrow(run, schema)


LOWEST = -(2**63)


def part_of(edges: Column, n: int, k: Column) -> Column:
    """How many of n rising edges are at k or above: a binary search, a power of two a step."""
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(max(n, 1).bit_length()))])
    below = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= n) & (F.get(edges, at + step - 1) < k), at + step).otherwise(at))
    return F.lit(n) - below


def with_neighbour(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows dealt to range partitions of descending key, so that the next document is at hand there.

    The cuts are quantiles of the key; there are as many ranges as the input has partitions, or shuffle
    partitions if those are more, so a range doesn't grow with the data.  Each partition also gets, as
    guests, the rows that come first in the next partition that has any (after the last, the first).
    Columns: part, guest, k, key and text.
    """
    d = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(key).cast("long"), F.lit(LOWEST)).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = max(2, shuffle_partitions(docs.sparkSession), d.rdd.getNumPartitions())
    cuts = sorted({int(c) for c in d.approxQuantile("k", [i / parts for i in range(1, parts)], 0.1 / parts)})
    edges = F.from_json(F.lit(str(cuts)), "array<bigint>")
    # the part number grows as the key falls
    d = d.withColumn("part", part_of(edges, len(cuts), F.col("k")))
    tops = d.groupBy("part").agg(F.max("k").alias("top")).collect()  # one row a partition
    order = sorted((x.part, x.top) for x in tops)
    guests = [(order[(i + 1) % len(order)][1], p) for i, (p, _) in enumerate(order)]
    if not guests:
        return d.withColumn("guest", F.lit(0)).select("part", "guest", "k", "doc_id", "text")
    spark = docs.sparkSession
    ask = F.broadcast(spark.createDataFrame(guests, "k long, part int"))  # one row a partition
    own = d.withColumn("guest", F.lit(0)).select("part", "guest", "k", "doc_id", "text")
    lent = d.drop("part").join(ask, "k").withColumn("guest", F.lit(1))
    return own.unionByName(lent.select("part", "guest", "k", "doc_id", "text")).repartition(len(order), "part").sortWithinPartitions("part", "guest", F.desc("k"), "text")


def edited(text: str, after: str) -> str:
    """text with its last floor(n / 2) code points replaced by the first as many (or all) of ``after``."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def fingerprint_with_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and how alike they are.

    The next document is that of the next smaller key (null keys last, equal keys by text); after the
    last comes the first.  A single document is its own next.  Null texts count as empty.  Repeated rows
    are documents of their own.  An empty table gives no rows.  Other columns are not read.
    """
    small_batches(docs.sparkSession)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def digest(rows: list[tuple]) -> pa.RecordBatch:
        own, new, nxt = [r[3] for r in rows], [r[4] for r in rows], [r[5] for r in rows]
        columns = [[r[i] for r in rows] for i in range(3)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array(own, pa.string()),
                pa.array(new, pa.string()), pa.array(likeness(own, new), pa.float64()), pa.array(likeness(own, nxt), pa.float64()),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row whose successor is awaited: part, key, text, fingerprint
        rows: list[tuple] = []
        for b in batches:
            part, guest, ids = (b.column(i).to_pylist() for i in (0, 1, 3))
            for p, g, i, t in zip(part, guest, ids, b.column(4).to_pylist()):
                mark = fingerprint(t)
                if held is not None and held[0] == p:
                    whole = edited(held[2], t)
                    rows.append((held[1], len(held[2]), hashlib.sha256(whole.encode()).hexdigest(), held[3], fingerprint(whole), mark))
                held = None if g else (p, i, t, mark)
                if len(rows) >= 2000:
                    yield digest(rows)
                    rows = []
        if rows:
            yield digest(rows)

    return with_neighbour(docs, key, text).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: every document's fingerprint beside its edited text's and the next document's."""
    return fingerprint_with_edits(table(spark, sf_dir, "documents"))
