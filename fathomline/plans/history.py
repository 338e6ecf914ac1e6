"""History, index and adapter queries: orders as commits, their parts as paths; documents as files."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import mapped, rounded, upper_median
from ..functions.paths import extension
from ..operators import adapter, indexing
from ..operators import history as H
from .registry import query
from .texts import FILE, documents

#: Commits change the parts of an order; a part below 1000 exists, one divisible by 9 is a test.
CHANGES = "ch AS (SELECT l_orderkey AS sha, CAST(l_partkey AS VARCHAR) AS path, min(l_linenumber) AS pos, bool_or(l_partkey % 4 <> 0) AS existing, bool_or(l_partkey % 9 = 0) AS test FROM lineitem GROUP BY ALL)"


def changes(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    part = F.col("l_partkey")
    return li.groupBy(F.col("l_orderkey").alias("sha"), part.cast("string").alias("path")).agg(
        F.min("l_linenumber").alias("pos"), F.bool_or(part % 4 != 0).alias("existing"), F.bool_or(part % 9 == 0).alias("test")
    )


@query("co_change", f"WITH {CHANGES}, k AS (SELECT sha FROM ch GROUP BY sha HAVING count(*) BETWEEN 2 AND 30) SELECT a.path AS a, b.path AS b, count(*) AS n FROM ch a JOIN ch b ON a.sha = b.sha AND a.path < b.path WHERE a.sha IN (SELECT sha FROM k) GROUP BY ALL")
def co_change(spark, sf_dir):
    return H.co_change(changes(spark, sf_dir), 30)


@query("first_indexed_positive", f"WITH {CHANGES} SELECT sha, arg_min(path, struct_pack(pos, path)) AS positive FROM (SELECT * FROM ch WHERE path IN (SELECT CAST(p_partkey AS VARCHAR) FROM part WHERE p_size % 2 = 0)) GROUP BY sha")
def first_indexed_positive(spark, sf_dir):
    index = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_size % 2 = 0").select(F.col("p_partkey").cast("string").alias("path"))
    return H.first_positive(changes(spark, sf_dir), index)


ELIGIBLE = "el AS (SELECT sha, count(*) AS existing, CAST(sum(CASE WHEN test THEN 0 ELSE 1 END) AS BIGINT) AS gold FROM ch WHERE existing GROUP BY sha HAVING count(*) BETWEEN 1 AND 5 AND sum(CASE WHEN test THEN 0 ELSE 1 END) >= 1)"


@query("eligible_commits", f"WITH {CHANGES}, {ELIGIBLE} SELECT * FROM el")
def eligible_commits(spark, sf_dir):
    return H.eligible(changes(spark, sf_dir), 5)


def tasks(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("sha"), F.col("o_orderpriority").alias("repo"), F.col("o_orderdate").alias("date"))
    w = Window.partitionBy("repo").orderBy("date", "sha")
    return o.join(H.eligible(changes(spark, sf_dir), 5), "sha").withColumn("n", (F.row_number().over(w) - 1).cast("long"))


TASKS = f"{CHANGES}, {ELIGIBLE}, t AS (SELECT o_orderkey AS sha, o_orderpriority AS repo, gold, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) - 1 AS n FROM orders JOIN el ON sha = o_orderkey)"


@query("rolling_block", f"WITH {TASKS} SELECT sha, repo, n, CASE WHEN n >= 20 THEN CAST(floor((n - 20) / 100) AS BIGINT) END AS block FROM t")
def rolling_block(spark, sf_dir):
    return tasks(spark, sf_dir).select("sha", "repo", "n", H.blocks("n", 20, 100).alias("block"))


@query("block_training_set", f"WITH {TASKS}, b AS (SELECT repo, CAST(floor((n - 20) / 100) AS BIGINT) AS block, min(n) AS first FROM t WHERE n >= 20 GROUP BY ALL) SELECT b.repo, block, count(*) AS examples, min(t.n) AS oldest, max(t.n) AS newest FROM b JOIN t ON t.repo = b.repo AND t.n < b.first AND t.n >= b.first - 200 GROUP BY ALL")
def block_training_set(spark, sf_dir):
    """Of each block the last 200 tasks before it; ranges of task numbers, no pairs of tasks."""
    t = tasks(spark, sf_dir).select("repo", "n")
    blocks = t.withColumn("block", H.blocks("n", 20, 100)).where("block is not null").groupBy("repo", "block").agg(F.min("n").alias("first"))
    span = blocks.withColumn("n", F.explode(F.sequence(F.greatest(F.lit(0), F.col("first") - 200), F.col("first") - 1)))
    return span.join(t, ["repo", "n"]).groupBy("repo", "block").agg(F.count(F.lit(1)).alias("examples"), F.min("n").alias("oldest"), F.max("n").alias("newest"))


@query("upper_median", f"WITH {CHANGES}, c AS (SELECT sha, count(*) AS files FROM ch GROUP BY sha) SELECT o_orderpriority AS repo, list_sort(list(files))[len(list(files)) // 2 + 1] AS median FROM c JOIN orders ON sha = o_orderkey GROUP BY 1")
def upper_median_(spark, sf_dir):
    """Counts of files are few different values, so the sorted place is found among those."""
    c = changes(spark, sf_dir).groupBy("sha").agg(F.count(F.lit(1)).alias("files"))
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("sha"), F.col("o_orderpriority").alias("repo"))
    counted = c.join(o, "sha").groupBy("repo", "files").agg(F.count(F.lit(1)).alias("m"))
    w = Window.partitionBy("repo")
    place = counted.withColumn("upto", F.sum("m").over(w.orderBy("files"))).withColumn("n", F.sum("m").over(w))
    return place.where(F.col("upto") > F.floor(F.col("n") / 2)).groupBy("repo").agg(F.min("files").alias("median"))


@query("size_slices", f"WITH {CHANGES}, c AS (SELECT sha, count(*) AS files, count(*) FILTER (existing) AS found FROM ch GROUP BY sha) SELECT CASE WHEN files < 3 THEN 'small' WHEN files < 6 THEN 'medium' ELSE 'large' END AS size, count(*) AS n, round(avg(CASE WHEN found >= 3 THEN 1.0 ELSE 0.0 END), 3) AS hit3 FROM c GROUP BY 1")
def size_slices(spark, sf_dir):
    from ..functions.numeric import bucket

    c = changes(spark, sf_dir).groupBy("sha").agg(F.count(F.lit(1)).alias("files"), F.count_if("existing").alias("found"))
    return c.groupBy(bucket(F.col("files"), [(3, "small"), (6, "medium")], "large").alias("size")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.col("found") >= 3, 1.0).otherwise(0.0)), 3).alias("hit3")
    )


@query("jaccard_dirs", "WITH d AS (SELECT o_orderpriority AS repo, list_distinct(list(CAST(l_suppkey % 50 AS INTEGER))) AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL) SELECT a.repo AS a, b.repo AS b, round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 6) AS jaccard FROM d a JOIN d b ON a.repo < b.repo")
def jaccard_dirs(spark, sf_dir):
    """Folders of each repository (50 at most) compared; a repository is one of five."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("repo"))
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", (F.col("l_suppkey") % 50).cast("int").alias("d"))
    d = li.join(o, "l_orderkey").groupBy("repo").agg(F.collect_set("d").alias("s"))
    a, b = d.select(F.col("repo").alias("a"), F.col("s").alias("sa")), d.select(F.col("repo").alias("b"), F.col("s").alias("sb"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(F.size(F.array_intersect("sa", "sb")) / F.size(F.array_union("sa", "sb")), 6).alias("jaccard"))


@query("eras")
def eras(spark, sf_dir):
    c = changes(spark, sf_dir).groupBy("sha").agg(F.collect_set((F.substring("path", 1, 1))).alias("folders"), F.max(F.when(F.col("test"), "python").otherwise("go")).alias("language"))
    return H.eras(tasks(spark, sf_dir).select("sha", "repo", "n").join(c, "sha"), least=40)


@query(
    "ancestors",
    """WITH c AS (SELECT CAST(conv_id AS VARCHAR) AS repo, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS n FROM conversations)
       SELECT a.repo, concat(a.repo, '.', a.n) AS sha, concat(b.repo, '.', b.n) AS ancestor FROM c a JOIN c b ON a.repo = b.repo AND b.n < a.n""",
)
def ancestors(spark, sf_dir):
    """Replies of a conversation as commits, each after the one before it."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    w = Window.partitionBy("conv_id").orderBy("turn", "text")
    n = c.select(F.col("conv_id").alias("repo"), (F.row_number().over(w) - 1).alias("n"))
    commits = n.select(F.col("repo").cast("string").alias("repo"), "n", F.concat("repo", F.lit("."), "n").alias("sha"), F.when(F.col("n") > 0, F.array(F.concat("repo", F.lit("."), F.col("n") - 1))).otherwise(F.array().cast("array<string>")).alias("parents"))
    return H.ancestry(commits)


VERSIONS = "old AS (SELECT doc_id AS path, md5(text) AS cid FROM documents WHERE doc_id % 10 <> 3), new AS (SELECT doc_id AS path, CASE WHEN doc_id % 7 = 0 THEN md5(concat(text, '!')) ELSE md5(text) END AS cid FROM documents WHERE doc_id % 11 <> 5)"


def versions(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("path"), "text")
    md5 = lambda c: F.md5(c.cast("binary"))
    old = d.where("path % 10 <> 3").select("path", md5(F.col("text")).alias("cid"))
    new = d.where("path % 11 <> 5").select("path", F.when(F.col("path") % 7 == 0, md5(F.concat("text", F.lit("!")))).otherwise(md5(F.col("text"))).alias("cid"))
    return old, new


@query("refresh_keep_new_removed", f"WITH {VERSIONS} SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.cid IS NULL THEN 'add' WHEN n.cid IS NULL THEN 'remove' WHEN o.cid = n.cid THEN 'keep' ELSE 'replace' END AS action FROM old o FULL OUTER JOIN new n ON o.path = n.path")
def refresh_keep_new_removed(spark, sf_dir):
    return indexing.refresh_plan(*versions(spark, sf_dir))


@query("change_detected", f"WITH {VERSIONS} SELECT (SELECT count(*) FROM (SELECT * FROM old EXCEPT ALL SELECT * FROM new)) AS gone, (SELECT count(*) FROM (SELECT * FROM new EXCEPT ALL SELECT * FROM old)) AS come")
def change_detected(spark, sf_dir):
    old, new = versions(spark, sf_dir)
    side = lambda a, b, n: a.exceptAll(b).select(F.lit(n).alias("s"))
    both = side(old, new, 0).union(side(new, old, 1))
    return both.agg(F.count_if(F.col("s") == 0).alias("gone"), F.count_if(F.col("s") == 1).alias("come"))


EXT = f"x AS (SELECT regexp_extract(lower({FILE}), '\\.([^./]*)$', 1) AS extension FROM documents)"


@query("coverage_ext_top8", f"WITH {EXT} SELECT extension, count(*) AS n FROM x WHERE extension <> '' GROUP BY extension ORDER BY n DESC, extension LIMIT 8")
def coverage_ext_top8(spark, sf_dir):
    return indexing.top_extensions(documents(spark, sf_dir))


@query("lang_mix", f"WITH {EXT}, c AS (SELECT extension, count(*) AS n, sum(count(*)) OVER () AS total FROM x GROUP BY extension) SELECT extension, CAST(round(n * 10.0 / total) * 10 AS INTEGER) AS percent FROM c WHERE round(n * 10.0 / total) * 10 >= 10")
def lang_mix(spark, sf_dir):
    c = documents(spark, sf_dir).groupBy(extension(F.col("path")).alias("extension")).agg(F.count(F.lit(1)).alias("n"))
    total = c.agg(F.sum("n")).first()[0] or 1
    return c.select("extension", (F.round(F.col("n") * 10.0 / F.lit(float(total))) * 10).cast("int").alias("percent")).where("percent >= 10")


@query("index_counts", f"SELECT CASE WHEN {FILE} LIKE '%/vendor/%' THEN 'skipped' WHEN {FILE} LIKE '%.py' OR {FILE} LIKE '%.TS' THEN 'source' WHEN {FILE} LIKE '%.yaml' THEN 'config' ELSE 'none' END AS kind, count(*) AS n FROM documents GROUP BY 1")
def index_counts(spark, sf_dir):
    from ..functions.paths import is_skipped, kind

    p = F.col("path")
    return documents(spark, sf_dir).groupBy(F.when(is_skipped(p), "skipped").otherwise(F.coalesce(kind(p), F.lit("none"))).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "apply_adapter",
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), m AS (SELECT vec_id, list_transform(range(1, len(v) + 1), lambda j: v[j] + 0.5 * coalesce(v[j + 1], 0)) AS z FROM e)
       SELECT vec_id, list_transform(z, lambda x: round(x / greatest(sqrt(list_dot_product(z, z)), 1e-8), 6)) AS u FROM m""",
)
def apply_adapter(spark, sf_dir):
    """Each vector through a map that adds half of the next component."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").alias("v"))
    w = np.eye(64) + 0.5 * np.eye(64, k=-1)
    return e.select("vec_id", F.transform(mapped(w)(F.col("v")), lambda x: rounded(x, 6)).alias("u"))


@query("sample_negatives")
def sample_negatives(spark, sf_dir):
    """Five negatives for each of the vectors of a label, by one generator a label."""
    import pandas as pd

    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("label", "vec_id")

    def one(g: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(g.vec_id)
        drawn = adapter.sample_negatives(list(range(len(ids))), len(ids), 5, 7)
        return pd.DataFrame({"label": g.label.iloc[0], "vec_id": ids, "negatives": [[int(ids[i]) for i in d] for d in drawn]})

    return e.groupBy("label").applyInPandas(one, "label int, vec_id long, negatives array<long>")


@query("fit_adapter")
def fit_adapter(spark, sf_dir):
    """A map for each label: its vectors as files, each mixed with the label's first as queries."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("label").cast("string").alias("repo"), F.col("vec_id").alias("doc"), F.col("embedding").alias("v"))
    first = e.groupBy("repo").agg(F.min_by("v", "doc").alias("f"))
    q = e.join(first, "repo").select("repo", (-F.col("doc")).alias("n"), F.col("doc").alias("pos"), F.zip_with("v", "f", lambda a, b: a + b * 0.5).alias("q"))
    fitted = adapter.fit_per_repository(q, e.toDF(*e.columns), adapter.Params(negatives=16))
    return fitted.select("repo", "revision", "examples", F.size("weights").alias("size"))
