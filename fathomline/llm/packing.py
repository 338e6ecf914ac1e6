"""Packing documents into fixed windows by non-negative least squares over length combinations.

Every document's ids are cut into full windows and one rest.  The histogram of the rests (at most
window - 1 lengths, whatever the corpus) goes to the driver, which enumerates the shallow combinations
of lengths that fill a window exactly (one to three pieces) and solves by non-negative least squares how
often each should repeat so that together they use up the histogram.  An active set keeps the solution
to few combinations with large counts; these are rounded down, then up where the histogram still allows.
What is left is packed greedily: first by any combination that still fits, then the residual pieces,
longest first, go into the open sequence and are cut where it ends.

Which piece takes which place follows from ranks: a piece's length, its rank among the pieces of that
length (a count a source partition, plus the rank inside the partition) and the table of planned ranks.
So no group of equal lengths ever meets in one task, and only residual pieces move with their ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import model, slices, vocabulary_path
from .shared import small_batches, table, written

WINDOW = 2048
END_ID = 1


# the plan, on the driver


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """All (a, b, c), a >= b >= c, c or both b and c possibly 0, of the given lengths that sum to the window."""
    have = np.zeros(window + 1, dtype=bool)
    have[lengths] = True
    a, b = np.meshgrid(np.arange(window + 1), np.arange(window + 1), indexing="ij")
    c = window - a - b
    ok = (a >= b) & (b >= c) & (c >= 0) & have[a] & (have[b] | (b == 0))
    a, b, c = a[ok], b[ok], c[ok]
    ok = have[c] | (c == 0)
    return np.stack([a[ok], b[ok], c[ok]], axis=1)


def descend(columns: np.ndarray, histogram: np.ndarray, x: np.ndarray, steps: int) -> np.ndarray:
    """Accelerated projected gradient steps from x on the least squares of these columns alone."""
    flat, n = columns.ravel(), len(histogram)
    uses = np.bincount(flat, minlength=n).astype(float)
    uses[0] = 0.0
    step = 1.0 / uses[columns].sum(axis=1).max()  # the largest row sum of A' A bounds its largest eigenvalue
    y, t = x, 1.0
    for _ in range(steps):
        over = np.bincount(flat, weights=np.repeat(y, 3), minlength=n) - histogram
        over[0] = 0.0
        nxt = np.maximum(y - step * over[columns].sum(axis=1), 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = nxt + (t - 1) / t2 * (nxt - x), nxt, t2
    return x


def solve(columns: np.ndarray, histogram: np.ndarray, rounds: int = 16, steps: int = 150) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative least squares by an active set: which columns, and x > 0 of each, that make
    sum_j x_j * (uses of each length by column j) close to the histogram.

    A round admits the columns of steepest descent, at most one for each length, solves for all admitted
    ones and lets go of those at zero; so no length is shared by more than ``rounds`` columns, which keeps
    the system well scaled and the solution sparse.
    """
    active, x = np.zeros(0, dtype=np.int64), np.zeros(0)
    if not len(columns):
        return active, x
    n = len(histogram)
    twice = (columns[:, 0] == columns[:, 1]).astype(float) + ((columns[:, 1] == columns[:, 2]) & (columns[:, 1] > 0)) + ((columns[:, 0] == columns[:, 2]))
    norm = np.sqrt((columns > 0).sum(axis=1) + 2 * twice)
    for _ in range(rounds):
        left = histogram - np.bincount(columns[active].ravel(), weights=np.repeat(x, 3), minlength=n)
        left[0] = 0.0
        gain = left[columns].sum(axis=1) / norm
        gain[active] = 0.0
        best = np.flatnonzero(gain > 1e-3 * max(1.0, histogram.max() * 1e-3))
        if len(best) > 16 * n:
            best = best[np.argpartition(-gain[best], 16 * n)[: 16 * n]]
        taken, new = {-1}, []
        for j, parts in zip(best[(order := np.argsort(-gain[best], kind="stable"))].tolist(), columns[best[order]].tolist()):
            parts = {p for p in parts if p}
            if not parts & taken:
                taken |= parts
                new.append(j)
        if not new:
            break
        active, x = np.concatenate([active, np.array(new, dtype=np.int64)]), np.concatenate([x, np.zeros(len(new))])
        x = descend(columns[active], histogram, x, steps)
        active, x = active[x > 1e-6], x[x > 1e-6]
    return active, x


def plan(histogram: np.ndarray, window: int) -> dict[str, np.ndarray]:
    """Where the pieces of each length go, by rank.

    ``planned[r]`` pieces of length r have a planned place.  Interval i says that the ranks from
    ``rank[i]`` to the next interval's of length ``length[i]`` go to consecutive sequences from
    ``sequence[i]`` on, at ``offset[i]``.  The residual pieces of length r begin at ``residual[r]`` of the
    stream that fills the sequences from ``planned_sequences`` on; the first ``solved_sequences`` come from
    the least squares.
    """
    left = histogram.astype(np.int64).copy()
    columns = combinations(np.flatnonzero(left), window)
    active, x = solve(columns, left.astype(float))
    rows, taken, base = [], np.zeros(window + 1, dtype=np.int64), 0

    def use(j: int, most: float) -> int:
        nonlocal base
        parts = columns[j][columns[j] > 0]
        kinds, uses = np.unique(parts, return_counts=True)
        count = int(min(most, (left[kinds] // uses).min()))
        if count > 0:
            left[kinds] -= uses * count
            offset = 0
            for r in parts:
                rows.append((int(r), int(taken[r]), base, offset))
                taken[r] += count
                offset += int(r)
            base += count
        return count

    for j, v in zip(active, np.floor(x)):  # down
        use(j, v)
    for j in active[np.argsort(np.floor(x) - x, kind="stable")]:  # then up, the largest fractions first
        use(j, 1)
    solved = base
    # combinations that still fit, those of few pieces first
    open_ = np.flatnonzero(((left[columns] > 0) | (columns == 0)).all(axis=1))
    for j in open_[np.argsort((columns[open_] > 0).sum(axis=1), kind="stable")]:
        use(j, np.inf)
    rows.sort()
    table_ = np.array(rows, dtype=np.int64).reshape(-1, 4)
    longest_first = np.arange(window + 1)[::-1]
    before = np.cumsum((left * np.arange(window + 1))[longest_first])
    residual = np.zeros(window + 1, dtype=np.int64)
    residual[longest_first] = before - (left * np.arange(window + 1))[longest_first]
    return {
        "planned": taken, "length": table_[:, 0], "rank": table_[:, 1], "sequence": table_[:, 2], "offset": table_[:, 3],
        "residual": residual, "planned_sequences": np.int64(base), "solved_sequences": np.int64(solved), "residual_tokens": np.int64((left * np.arange(window + 1)).sum()),
    }


# the pieces, on the executors


def tokenized(docs: DataFrame, path: str, text: str, key: str, window: int, end_id: int) -> DataFrame:
    """A row per document: its full windows' checksums, its rest, and its ranks inside its partition."""
    schema = "pid int, doc_id long, doc_tokens long, rest int, rest_rank long, full_rank long, full_crcs array<long>, rest_crc long, rest_ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        seen = np.zeros(window, dtype=np.int64)
        full_seen = 0
        for b in batches:
            texts = [t or "" for t in b.column(2).to_pylist()]
            for lo, hi in slices(texts):
                ids, counts = bpe.encode(texts[lo:hi])
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, end_id).astype("<u4")
                counts = counts + 1
                ends = np.cumsum(counts)
                raw = memoryview(ids.tobytes())
                rest = counts % window
                rest_rank, full_rank, crcs, rest_crc, rest_ids = [], [], [], [], []
                for end, n, r in zip(ends.tolist(), counts.tolist(), rest.tolist()):
                    begin = end - n
                    full_rank.append(full_seen)
                    full_seen += n // window
                    crcs.append([zlib.crc32(raw[4 * i : 4 * (i + window)]) for i in range(begin, end - r, window)])
                    rest_rank.append(int(seen[r]))
                    seen[r] += 1
                    piece = raw[4 * (end - r) : 4 * end]
                    rest_crc.append(zlib.crc32(piece))
                    rest_ids.append(bytes(piece))
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1), pa.array(counts, pa.int64()), pa.array(rest, pa.int32()), pa.array(rest_rank, pa.int64()),
                        pa.array(full_rank, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(rest_crc, pa.int64()), pa.array(rest_ids, pa.binary()),
                    ],
                    names=["pid", "doc_id", "doc_tokens", "rest", "rest_rank", "full_rank", "full_crcs", "rest_crc", "rest_ids"],
                )

    return docs.select(F.spark_partition_id().alias("pid"), F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is the ids of its whole text (null: none) and then ``end_id``, so an empty one has one
    id.  Each id lies in exactly one piece, and pieces of a sequence follow each other without a gap.
    Only the very last sequence can have padding.  Null keys and repeated rows are documents like any
    other.  An empty table gives no rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = written(tokenized(docs, path, text, key, window, end_id), "packing")

    parts = written(
        held.groupBy("pid", "rest").agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.size("full_crcs")).cast("long").alias("full")
        ),
        "packing-counts",
    )
    histogram = np.zeros(window, dtype=np.int64)
    full_total = 0
    for x in parts.groupBy("rest").agg(F.sum("n").alias("n"), F.sum("full").alias("full")).collect():  # one row a length
        histogram[x.rest] = x.n
        full_total += x.full
    histogram[0] = 0
    made = plan(np.append(histogram, 0), window)
    first_residual = int(full_total + made["planned_sequences"])

    before = Window.partitionBy("rest").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    full_before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)  # one row a source partition
    base = parts.select("pid", "rest", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rest_base"))
    full_base = parts.groupBy("pid").agg(F.sum("full").alias("full")).select("pid", F.coalesce(F.sum("full").over(full_before), F.lit(0)).alias("full_base"))
    base = base.join(full_base, "pid")

    # for each length, the partition at whose ranks the residual begins: earlier partitions need no ids
    planned = spark.createDataFrame([(r, int(n)) for r, n in enumerate(made["planned"][:window])], "rest int, planned long")
    base = base.join(F.broadcast(planned), "rest")  # at most one row a length
    edge = written(base, "packing-ranks").select("pid", "rest", "rest_base", "full_base", "planned")
    first = edge.where("rest_base <= planned").groupBy("rest").agg(F.max(F.struct("pid", F.col("planned") - F.col("rest_base"))).alias("e"))
    first = first.select("rest", F.col("e.pid").alias("edge_pid"), F.col("e.col2").alias("edge_rank"))
    slim = held.join(F.broadcast(first), "rest", "left")  # at most one row a length
    residual = (F.col("pid") > F.col("edge_pid")) | ((F.col("pid") == F.col("edge_pid")) & (F.col("rest_rank") >= F.col("edge_rank")))
    slim = slim.withColumn("rest_ids", F.when(residual, F.col("rest_ids"))).drop("edge_pid", "edge_rank")
    ranked = slim.join(edge.drop("planned"), ["pid", "rest"])

    lookup = {k: v for k, v in made.items()}
    shared = spark.sparkContext.broadcast(lookup)  # at most three intervals a combination used of lengths

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        opens = np.searchsorted(m["length"], np.arange(window + 2))
        for b in batches:
            col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            num = lambda n: col[n].to_numpy(zero_copy_only=False)
            rest, rank = num("rest"), num("rest_rank") + num("rest_base")
            out: list[list] = [[] for _ in range(5)]
            ids, crcs = col["rest_ids"], col["full_crcs"]
            full = (num("full_rank") + num("full_base")).tolist()
            rest_crc, tokens = num("rest_crc").tolist(), num("doc_tokens").tolist()
            row: list[int] = []

            def add(i, start, length, crc, sequence, offset):
                row.append(i)
                for o, v in zip(out, (start, length, crc, sequence, offset)):
                    o.append(v)

            for i, (r, k) in enumerate(zip(rest.tolist(), rank.tolist())):
                begin = tokens[i] - r
                if begin:
                    for j, crc in enumerate(crcs[i].as_py()):
                        add(i, j * window, window, crc, full[i] + j, 0)
                if not r:
                    continue
                if k < m["planned"][r]:
                    at = opens[r] + int(np.searchsorted(m["rank"][opens[r] : opens[r + 1]], k, side="right")) - 1
                    add(i, begin, r, rest_crc[i], int(full_total + m["sequence"][at] + k - m["rank"][at]), int(m["offset"][at]))
                    continue
                place = int(m["residual"][r] + (k - m["planned"][r]) * r)
                raw, done = ids[i].as_py(), 0
                while done < r:
                    size = min(r - done, window - (place + done) % window)
                    add(i, begin + done, size, zlib.crc32(raw[4 * done : 4 * (done + size)]), first_residual + (place + done) // window, (place + done) % window)
                    done += size
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [col["doc_id"].take(take), *(pa.array(o, pa.int64()) for o in out), col["doc_tokens"].take(take)],
                names=["doc_id", "start", "length", "ids_crc32", "sequence_id", "offset", "doc_tokens"],
            )

    return ranked.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, sequence_id long, offset long, doc_tokens long").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: all documents in windows of 2048 ids."""
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary_path())
