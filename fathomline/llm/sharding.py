"""Sharding by vector bin packing over bytes, tokens and rows.

Groups of rows that belong together (equal texts) are hashed into a bounded number of buckets; the
vector (bytes, tokens, rows) of each bucket is summed in Spark and only these sums reach the driver.
There the buckets, largest first, go to the shard whose residual capacity has the highest dot product
with the bucket's vector.  A group too large for even shards is heavy: its rows are salted by their
own key, so that each salted part is a small item of its own and no task or shard holds it whole.

Bounds: at most ``buckets`` buckets, and ``heavy_parts * shards`` heavy groups (a group is heavy when it
has more than 1 / (heavy_parts * shards) of the bytes or rows), each in ``salts`` parts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import table, written

N_SHARDS = 8


def place(vectors: np.ndarray, shards: int) -> np.ndarray:
    """A shard for each row of ``vectors`` (non-negative, one column a resource).

    Items go in order of their largest normalised component.  Of the shards that can still take the
    item whole, that with the highest dot product of item and residual capacity wins (ties: the
    smallest shard number); when none can, the shard whose tightest residual stays largest.
    """
    total = vectors.sum(axis=0).astype(float)
    v = vectors / np.where(total > 0, total, 1)
    left = np.full((shards, v.shape[1]), 1.0 / shards)
    out = np.zeros(len(v), dtype=np.int64)
    for i in np.argsort(-v.max(axis=1), kind="stable"):
        fits = (left >= v[i] - 1e-12).all(axis=1)
        score = np.where(fits, left @ v[i], -np.inf) if fits.any() else (left - v[i]).min(axis=1)
        best = int(np.argmax(score))
        out[i] = best
        left[best] -= v[i]
    return out


def even_out(sizes: np.ndarray, shard: np.ndarray, shards: int, rounds: int = 200) -> np.ndarray:
    """Swaps items between the fullest and the emptiest shard while that brings their sizes closer."""
    shard = shard.copy()
    for _ in range(rounds if len(sizes) else 0):
        held = np.bincount(shard, weights=sizes, minlength=shards)
        high, low = int(held.argmax()), int(held.argmin())
        gap = held[high] - held[low]
        ours, theirs = np.flatnonzero(shard == high), np.flatnonzero(shard == low)
        if gap <= 1 or not len(ours):
            break
        theirs = theirs[np.argsort(sizes[theirs], kind="stable")]
        small = np.append(sizes[theirs], 0.0) if not len(theirs) else sizes[theirs]
        near = np.clip(np.searchsorted(small, sizes[ours] - gap / 2), 0, len(small) - 1)
        moved = sizes[ours] - small[near]
        gain = np.minimum(moved, gap - moved)
        best = int(gain.argmax())
        if gain[best] <= 0:
            break
        if len(theirs):
            shard[theirs[near[best]]] = high
        shard[ours[best]] = low
    return shard


def _measured(docs: DataFrame, text: str, key: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    raw = t.cast("binary")
    return docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(t).cast("long") + F.lit(1)).alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.when(F.trim(t) == "", F.lit(0)).otherwise(F.size(F.split(F.trim(t), r"\s+"))).cast("long").alias("tokens"),
        F.xxhash64(t, F.octet_length(t)).alias("grp"),
        F.xxhash64(F.col(key), F.lit("salt")).alias("row_hash"),
    )


def _lookup(values: list[int], index: Column) -> Column:
    """values[index] as an expression; values is bounded by the callers."""
    held = F.from_json(F.lit("[" + ",".join(map(str, values)) + "]"), T.ArrayType(T.IntegerType(), False))
    return F.element_at(held, (index + 1).cast("int"))


def shard_documents(
    docs: DataFrame, shards: int = N_SHARDS, text: str = "text", key: str = "doc_id", buckets: int = 4096, heavy_parts: int = 32, salts: int = 256
) -> DataFrame:
    """doc_id, size, text_crc32, tokens, shard and slot (gapless from 0 in each shard) of every row.

    Null texts count as empty (size 1, checksum 0).  Equal texts share a shard unless their group is
    heavy.  Null keys are rows like any other; repeated rows are all kept.  An empty table gives no rows.
    Slots follow the written table, so a lost executor doesn't change them.  Other columns are not read.
    """
    spark = docs.sparkSession
    rows = written(_measured(docs, text, key).withColumn("pid", F.spark_partition_id()), "shards")

    groups = rows.groupBy("grp").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("r"))
    total = rows.agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("r")).first()
    limit = heavy_parts * shards
    heavy = [
        x.grp
        for x in groups.where(
            (F.col("r") > 1) & ((F.col("b") * limit > int(total.b or 0)) | (F.col("r") * limit > int(total.r or 0)))
        ).select("grp").collect()  # at most 2 * limit groups can exceed a share of 1 / limit
    ]
    heavy.sort()
    at = F.array_position(F.from_json(F.lit(str(heavy)), T.ArrayType(T.LongType(), False)), F.col("grp")) if heavy else F.lit(0)
    item = F.when(at > 0, F.lit(buckets) + (at - 1) * salts + F.pmod(F.col("row_hash"), F.lit(salts))).otherwise(F.pmod(F.col("grp"), F.lit(buckets)))
    rows = rows.withColumn("item", item.cast("int"))

    sums = rows.groupBy("item").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("r")).collect()
    shard_of = [0] * (buckets + len(heavy) * salts)
    if sums:
        sums.sort(key=lambda x: x.item)
        vectors = np.array([[x.b, x.t, x.r] for x in sums], dtype=float)
        for x, s in zip(sums, even_out(vectors[:, 0], place(vectors, shards), shards)):
            shard_of[x.item] = int(s)
    placed = rows.withColumn("shard", _lookup(shard_of, F.col("item")))
    return _slots(placed).select("doc_id", "size", "text_crc32", "tokens", "shard", "slot")


def _slots(placed: DataFrame) -> DataFrame:
    """Adds slot: ranks inside (source partition, shard) plus the rows of earlier partitions in that shard."""
    from pyspark.sql import Window

    counts = placed.groupBy("pid", "shard").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("pid", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("pid", "shard").orderBy("row_hash", "doc_id", "text_crc32")
    ranked = placed.withColumn("rank", F.row_number().over(inside) - 1)
    return ranked.join(base, ["pid", "shard"]).withColumn("slot", (F.col("base") + F.col("rank")).cast("long"))


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, key: str = "doc_id") -> None:
    """The documents as Parquet files, one folder a shard; keys must be unique for this."""
    docs.join(assigned.select(F.col("doc_id").alias(key), "shard"), key).write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: all documents in shards 0 to 7 under the law of near-equal bytes."""
    out = shard_documents(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
        F.lit(None).cast("int").alias("grown_shard"), "tokens",
    )
