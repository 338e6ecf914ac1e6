"""Approximate nearest neighbours by vantage-point trees per shard, for the largest inner product.

Vectors are lifted to one sphere, (x, sqrt(M^2 - |x|^2)) / M with the largest norm M, where a larger inner
product with a query (q, 0) / |q| is a smaller Euclidean distance; so the triangle inequality holds and
the search by distance is the search by inner product, whatever the norms.

A vantage-point tree over a bounded sample cuts the space into regions; every vector goes to one region, a
crowded region is salted into shards of bounded size, and each shard builds a tree of its own.  The
sample bounds a query's k-th distance, the shards of its home region bound it further, and then those
regions are searched that the triangle inequality can't exclude; only rows within the bound leave a shard.  A branch at lower bound l is skipped when factor * l exceeds the
k-th distance so far: factor 1 is exact, larger ones skip more.

Equal vectors are one vector with its smallest ids: k + 1 of them hold all that a result can show.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import table, written

#: Vectors of the sample that the regions are cut from, at most; vectors a region has on average; of a shard; of a leaf.
SAMPLE, REGION, SHARD, LEAF = 16_384, 2048, 4096, 64
#: Queries of a shard that one task searches at once.
QUERY_BLOCK = 2048
#: Ties of a block beyond which those that a nearer bound has ruled out are forgotten.
TIES = 1 << 20
#: How far the pruning bound is relaxed.  1 restores the exact search.
FACTOR = 1.0
K = 20
#: Distances near 0 are exact to about 1e-8 only; bounds give way by more than that.
SLACK = 1e-6


@dataclass
class Tree:
    """Nodes in breadth order: vantage point, children (-1: none), and for each child the nearest and
    farthest distance from the vantage point to what lies below it.  A leaf has its rows' range."""

    vantage: np.ndarray
    child: np.ndarray
    near: np.ndarray
    far: np.ndarray
    rows: np.ndarray
    order: np.ndarray


def build(points: np.ndarray, leaf: int) -> Tree:
    """A vantage-point tree of the rows: the vantage point of a node is its row farthest from their mean,
    and the median distance parts its rows in two."""
    vantage, child, near, far, rows = [], [], [], [], []
    order = np.arange(len(points))
    todo = [(0, len(points), -1, 0)]
    while todo:
        lo, hi, parent, side = todo.pop()
        me = len(vantage)
        if parent >= 0:
            child[parent][side] = me
        here = order[lo:hi]
        block = points[here]
        top = here[int(((block - block.mean(axis=0)) ** 2).sum(axis=1).argmax())] if len(here) else 0
        v = points[top] if len(points) else np.zeros(points.shape[1])
        vantage.append(v)
        child.append([-1, -1])
        near.append([0.0, 0.0])
        far.append([0.0, 0.0])
        rows.append((lo, hi))
        if hi - lo <= leaf:
            continue
        d = np.sqrt(((block - v) ** 2).sum(axis=1))
        by = np.argsort(d, kind="stable")
        order[lo:hi], d = here[by], d[by]
        mid = (hi - lo) // 2
        near[me], far[me] = [d[0], d[mid]], [d[mid - 1], d[-1]]
        todo += [(lo + mid, hi, me, 1), (lo, lo + mid, me, 0)]
    n = len(vantage)
    return Tree(np.array(vantage).reshape(n, -1), np.array(child), np.array(near), np.array(far), np.array(rows), order)


def leaves(tree: Tree) -> np.ndarray:
    return np.flatnonzero((tree.child < 0).all(axis=1))


def assign(tree: Tree, points: np.ndarray) -> np.ndarray:
    """The leaf whose side each point falls on all the way down."""
    at = np.zeros(len(points), dtype=np.int64)
    while True:
        inner = np.flatnonzero(tree.child[at, 0] >= 0)
        if not len(inner):
            return at
        node = at[inner]
        d = np.sqrt(((points[inner] - tree.vantage[node]) ** 2).sum(axis=1))
        edge = (tree.far[node, 0] + tree.near[node, 1]) / 2
        at[inner] = tree.child[node, (d > edge).astype(int)]


class Best:
    """The k nearest rows found so far of each query, and those that tie with the k-th within the slack."""

    def __init__(self, queries: int, k: int, bound: np.ndarray):
        self.distance = np.full((queries, k), np.inf)
        self.row = np.full((queries, k), -1, dtype=np.int64)
        self.bound = bound.copy()  # of the k-th distance
        self.tied: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # query, distance, row
        self.held, self.most = 0, TIES

    def offer(self, which: np.ndarray, distance: np.ndarray, rows: np.ndarray) -> None:
        d = np.concatenate([self.distance[which], distance], axis=1)
        r = np.concatenate([self.row[which], np.broadcast_to(rows, distance.shape)], axis=1)
        k = self.distance.shape[1]
        order = np.argpartition(d, k - 1, axis=1)
        pick, rest = order[:, :k], order[:, k:]
        self.distance[which], self.row[which] = np.take_along_axis(d, pick, 1), np.take_along_axis(r, pick, 1)
        self.bound[which] = np.minimum(self.bound[which], self.distance[which].max(axis=1))
        beyond = np.take_along_axis(d, rest, 1)
        q, i = np.nonzero((beyond <= self.bound[which][:, None] + 2 * SLACK) & (beyond < np.inf))
        if len(q):
            self.tied.append((which[q], beyond[q, i], r[q, rest[q, i]]))
            self.held += len(q)
            if self.held > self.most:
                self.tied = [self.ties()]
                self.held = len(self.tied[0][0])
                self.most = max(TIES, 2 * self.held)

    def ties(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, distance and row of those beyond the k that tie with the k-th, by query."""
        if not self.tied:
            return np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype=np.int64)
        q, d, r = (np.concatenate(x) for x in zip(*self.tied))
        on = np.flatnonzero(d <= self.bound[q] + 2 * SLACK)
        on = on[np.argsort(q[on], kind="stable")]
        return q[on], d[on], r[on]


def search(tree: Tree, points: np.ndarray, queries: np.ndarray, k: int, bound: np.ndarray, factor: float) -> Best:
    """The k nearest points of each query within its bound: all queries walk the tree together, each
    leaving the branches that its own bound excludes."""
    best = Best(len(queries), k, bound)
    norm = (points**2).sum(axis=1)
    todo = [(0, np.arange(len(queries)), np.zeros(len(queries)))]
    while todo:
        node, which, least = todo.pop()
        on = factor * least <= best.bound[which] + SLACK
        which, least = which[on], least[on]
        if not len(which):
            continue
        if tree.child[node, 0] < 0:
            rows = tree.order[tree.rows[node, 0] : tree.rows[node, 1]]
            if len(rows):
                q = queries[which]
                d = np.sqrt(np.maximum((q**2).sum(axis=1)[:, None] + norm[rows] - 2 * q @ points[rows].T, 0))
                best.offer(which, d, rows)
            continue
        d = np.sqrt(((queries[which] - tree.vantage[node]) ** 2).sum(axis=1))
        bounds = np.maximum(np.maximum(d[:, None] - tree.far[node], tree.near[node] - d[:, None]), least[:, None])
        first = int((bounds[:, 0] > bounds[:, 1]).mean() > 0.5)  # the side that most queries are nearer to comes first
        for side in (1 - first, first):
            todo.append((int(tree.child[node, side]), which, bounds[:, side]))
    return best


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector has components, all of them finite numbers, not all zero."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0))


def distinct_vectors(df: DataFrame, key: str, vector: str, keep: int) -> DataFrame:
    """v, ids: each different vector with its ``keep`` smallest ids.  Partial ranks come before the shuffle."""
    w = Window.partitionBy("h", "v").orderBy("id")
    v = F.transform(F.col(vector), lambda x: x.cast("double") + F.lit(0.0))
    rows = df.select(F.col(key).cast("long").alias("id"), v.alias("v")).where("id is not null").withColumn("h", F.xxhash64("v"))
    few = rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= keep)
    return few.groupBy("h", "v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select("h", "v", "ids")  # keep ids at most


def lift(x: np.ndarray, most: float) -> np.ndarray:
    x = x / most
    return np.concatenate([x, np.sqrt(np.maximum(1.0 - (x**2).sum(axis=1), 0.0))[:, None]], axis=1)


def aim(q: np.ndarray) -> np.ndarray:
    return np.concatenate([q / np.sqrt((q**2).sum(axis=1))[:, None], np.zeros((len(q), 1))], axis=1)


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def nearest(df: DataFrame, is_query, key: str = "vec_id", vector: str = "embedding", k: int = K, factor: float = FACTOR) -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates of largest inner product of each row that ``is_query`` picks.

    Candidates are all rows but the query's own.  Ties go to the smaller id; fewer candidates give fewer
    rows.  Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do
    null ids; of several lengths only vectors of the commonest (ties: the longest) take part.  Repeated
    rows of one id and vector are one.  Other columns are not read.
    """
    spark = df.sparkSession
    rows = usable(df.select(key, vector, is_query.alias("is_query")), vector)
    size = rows.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if size is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size(vector) == size.d).dropDuplicates([key, vector])
    vectors = written(distinct_vectors(rows, key, vector, k + 1), "vectors")
    total = vectors.count()
    most = vectors.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))).first()[0] * (1 + 1e-12)

    share = min(1.0, SAMPLE / max(total, 1))
    cut = min(int((2 * share - 1) * 2**63), 2**63 - 1)
    sample = vectors.where(F.col("h") <= cut).select("v").collect()[: 2 * SAMPLE]  # about SAMPLE: the smallest hashes
    points = lift(np.array([x.v for x in sample]).reshape(-1, size.d), most)
    top = build(points, max(8, int(np.ceil(REGION * share))))
    shared = spark.sparkContext.broadcast((top, most))
    known = spark.sparkContext.broadcast(points)  # the sample: SAMPLE rows

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, m = shared.value
        for b in batches:
            region = assign(tree, lift(matrix(b.column(0)), m))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(region, pa.int64())], names=["v", "ids", "h", "region"])

    placed = written(vectors.select("v", "ids", "h").mapInArrow(place, "v array<double>, ids array<long>, h long, region long"), "vectors-placed")
    crowd = placed.groupBy("region").agg(F.ceil(F.count(F.lit(1)) / F.lit(SHARD)).cast("int").alias("shards"))
    dealt = placed.join(F.broadcast(crowd), "region").withColumn("shard", F.pmod("h", F.col("shards")).cast("int"))  # a row a region
    dealt = written(dealt, "vectors-dealt")

    # what every region spans, for the bounds of the second phase
    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, m = shared.value
        ways = paths(tree)
        low: dict[int, np.ndarray] = {}
        high: dict[int, np.ndarray] = {}
        for b in batches:
            x, region = lift(matrix(b.column(0)), m), b.column(1).to_numpy()
            for r in np.unique(region):
                at = np.stack([np.sqrt(((x[region == r] - tree.vantage[n]) ** 2).sum(axis=1)) for n in ways[r]], axis=1) if ways[r] else np.zeros((1, 0))
                low[r] = np.minimum(low[r], at.min(axis=0)) if r in low else at.min(axis=0)
                high[r] = np.maximum(high[r], at.max(axis=0)) if r in high else at.max(axis=0)
        if low:
            regions = sorted(low)
            yield pa.RecordBatch.from_arrays(
                [pa.array(regions, pa.int64()), pa.array([low[r].tolist() for r in regions], pa.list_(pa.float64())), pa.array([high[r].tolist() for r in regions], pa.list_(pa.float64()))],
                names=["region", "low", "high"],
            )

    each = dealt.select("v", "region").mapInArrow(spans, "region long, low array<double>, high array<double>")
    each = each.select("region", F.posexplode(F.arrays_zip("low", "high")).alias("i", "e")).groupBy("region", "i").agg(F.min("e.low").alias("low"), F.max("e.high").alias("high"))
    span: dict[int, dict[int, tuple[float, float]]] = {}
    for x in each.collect():  # the depth of the tree, a region
        span.setdefault(x.region, {})[x.i] = (x.low, x.high)
    for r in crowd.select("region").collect():
        span.setdefault(r.region, {})
    reach = spark.sparkContext.broadcast(span)

    asked = rows.where("is_query").select(F.col(key).cast("long").alias("query_id"), F.transform(F.col(vector), lambda x: x.cast("double") + F.lit(0.0)).alias("v")).where("query_id is not null")
    queries = written(asked.withColumn("h", F.xxhash64("v")), "queries")
    aims = queries.groupBy("h", "v").agg(F.lit(1).alias("one")).select("h", "v")  # equal queries are searched once

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, _ = shared.value
        held = known.value
        norm = (held**2).sum(axis=1)
        for b in batches:
            q = aim(matrix(b.column(1)))
            bound = np.full(len(q), np.inf)
            for lo in range(0, len(q) if len(held) > k else 0, 256):  # the k-th of the sample bounds the k-th of all
                part = q[lo : lo + 256]
                d = (part**2).sum(axis=1)[:, None] + norm - 2 * part @ held.T
                bound[lo : lo + 256] = np.sqrt(np.maximum(np.partition(d, k, axis=1)[:, k], 0)) + SLACK
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(assign(tree, q), pa.int64()), pa.array(bound)], names=["h", "v", "region", "bound"])

    homed = written(aims.mapInArrow(home, "h long, v array<double>, region long, bound double"), "queries-home")
    phase1 = written(_searched(homed, dealt, crowd, k, factor, most), "nearest-home")

    kth = phase1.groupBy("h", "qv").agg(F.sort_array(F.flatten(F.collect_list("ds"))).alias("ds"))  # k a shard of the home region
    kth = kth.select("h", F.col("qv").alias("v"), F.when(F.size("ds") >= k + 1, F.element_at("ds", k + 1)).alias("kth"))
    bounds = homed.join(kth, ["h", "v"], "left").select("h", "v", F.col("region").alias("home"), F.least("bound", "kth").alias("bound"))

    def beyond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, _ = shared.value
        ways = paths(tree)
        for b in batches:
            q, own, bound = aim(matrix(b.column(1))), b.column(2).to_numpy(), b.column(3).to_numpy(zero_copy_only=False)
            seen: dict[int, np.ndarray] = {}
            for r, spans_ in reach.value.items():
                least = np.zeros(len(q))
                for i, n in enumerate(ways[r]):
                    if n not in seen:
                        seen[n] = np.sqrt(((q - tree.vantage[n]) ** 2).sum(axis=1))
                    if i in spans_:
                        least = np.maximum(least, np.maximum(seen[n] - spans_[i][1], spans_[i][0] - seen[n]))
                go = np.flatnonzero((factor * least <= bound + SLACK) & (own != r))
                if len(go):
                    take = pa.array(go)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(np.full(len(go), r)), b.column(3).take(take)], names=["h", "v", "region", "bound"])

    away = bounds.mapInArrow(beyond, "h long, v array<double>, region long, bound double")
    phase2 = _searched(away, dealt, crowd, k, factor, most)

    # the exact measure on the original vectors; equal vectors show their smallest ids
    hits = phase1.unionByName(phase2).select("h", "qv", F.explode(F.arrays_zip("ids", "scores")).alias("e")).select("h", "qv", F.col("e.scores").alias("score"), F.explode("e.ids").alias("vec_id"))
    by = Window.partitionBy("h", "qv").orderBy(F.desc("score"), "vec_id")
    kept = hits.withColumn("n", F.row_number().over(by)).where(F.col("n") <= k + 1).select("h", F.col("qv").alias("v"), "score", "vec_id")
    pairs = queries.join(kept, ["h", "v"]).where(F.col("query_id") != F.col("vec_id"))
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def paths(tree: Tree) -> dict[int, list[int]]:
    """The inner nodes above each leaf."""
    out, todo = {}, [(0, [])]
    while todo:
        node, way = todo.pop()
        if tree.child[node, 0] < 0:
            out[node] = way
        else:
            todo += [(int(c), [*way, node]) for c in tree.child[node]]
    return out


def _searched(queries: DataFrame, dealt: DataFrame, crowd: DataFrame, k: int, factor: float, most: float) -> DataFrame:
    """h, qv, region, ids, scores, ds: of each query in each shard of the region it visits, the nearest vectors.

    Tasks get a shard's vectors (at most about SHARD) and the queries that visit it, vectors first; the
    queries are searched in blocks of QUERY_BLOCK.
    """
    visits = queries.join(F.broadcast(crowd), "region").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    left = dealt.select("region", "shard", F.lit(0).alias("role"), "v", "ids", "h", F.lit(0.0).alias("bound"))
    right = visits.select("region", "shard", F.lit(1).alias("role"), "v", F.lit(None).cast("array<long>").alias("ids"), "h", "bound")
    rows = left.unionByName(right).repartition("region", "shard").sortWithinPartitions("region", "shard", "role")
    kinds = [pa.int64(), pa.list_(pa.float64()), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.float64()), pa.list_(pa.float64())]
    names = ["h", "qv", "region", "ids", "scores", "ds"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, vectors, ids, tree, points = None, [], [], None, None
        held: list[tuple] = []

        def answer() -> pa.RecordBatch | None:
            nonlocal tree, points
            if not held or not vectors:
                held.clear()
                return None
            if tree is None:
                points = np.array(vectors)
                tree = (build(lift(points, most), LEAF), lift(points, most))
            original = np.array([q for _, q, _ in held])
            best = search(tree[0], tree[1], aim(original), k + 1, np.array([b for _, _, b in held]), factor)
            out = []
            whose, tied_d, tied_r = best.ties()
            edge = np.searchsorted(whose, np.arange(len(held) + 1))
            for (h, q, bound), d, r, lo, hi in zip(held, best.distance, best.row, edge, edge[1:]):
                r, d = np.concatenate([r, tied_r[lo:hi]]), np.concatenate([d, tied_d[lo:hi]])
                on = (r >= 0) & (d <= bound + SLACK)
                if not on.any():
                    continue
                r, d = r[on], d[on]
                scores = np.cumsum(points[r] * np.array(q), axis=1)[:, -1]  # summed from the left
                if len(r) > k + 1:  # the exact score decides, then the smallest id
                    first = np.lexsort((np.array([ids[i][0] for i in r]), -scores))[: k + 1]
                    r, d, scores = r[first], d[first], scores[first]
                # the distances that bound the k-th: one for each id of a vector
                many = np.repeat(d, [len(ids[i]) for i in r])
                out.append((h, q, key[0], [ids[i] for i in r], scores.tolist(), np.sort(many)[: k + 1].tolist()))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names) if out else None

        for b in batches:
            region, shard, role, v, i, h, bound = (b.column(n).to_pylist() for n in range(7))
            for j in range(b.num_rows):
                if (region[j], shard[j]) != key:
                    if (out := answer()) is not None:
                        yield out
                    key, vectors, ids, tree = (region[j], shard[j]), [], [], None
                if role[j] == 0:
                    vectors.append(v[j])
                    ids.append(i[j])
                else:
                    held.append((h[j], v[j], bound[j]))
                    if len(held) >= QUERY_BLOCK and (out := answer()) is not None:
                        yield out
        if (out := answer()) is not None:
            yield out

    return rows.mapInArrow(run, "h long, qv array<double>, region long, ids array<array<long>>, scores array<double>, ds array<double>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: the 20 nearest of each vector whose id is divisible by 20, by inner product."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
