"""Report and replay queries: orders as reports, documents as candidates, conversations as transcripts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import ranking as R
from ..operators import reports as P
from .registry import query
from .texts import FILE, documents, turns


def orders(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


@query("fenced_reports", "WITH p AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN concat(E'text\\n```json\\n', props, E'\\n```\\nmore {') WHEN event_id % 3 = 1 THEN concat('see ', props, ' end') ELSE 'none' END AS body FROM events) SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE regexp_extract(body, '(\\{[^}]*\\})', 1) END AS json FROM p")
def fenced_reports(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    m = F.col("event_id") % 3
    body = F.when(m == 0, F.concat(F.lit("text\n```json\n"), "props", F.lit("\n```\nmore {"))).when(m == 1, F.concat(F.lit("see "), "props", F.lit(" end"))).otherwise("none")
    return e.select("event_id", P.fenced_json(body).alias("json"))


@query("report_validation", "SELECT l_linenumber AS line, count(*) AS n, CAST(sum(CASE WHEN l_discount * 12 BETWEEN 0 AND 1 AND l_quantity BETWEEN 0 AND 40 THEN 1 ELSE 0 END) AS BIGINT) AS valid FROM lineitem GROUP BY 1")
def report_validation(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    good = P.valid(F.col("l_discount") * 12, F.col("l_quantity"), 40)
    return li.groupBy(F.col("l_linenumber").alias("line")).agg(F.count(F.lit(1)).alias("n"), F.sum(good.cast("long")).alias("valid"))


@query("report_medians", "WITH r AS (SELECT o_orderstatus AS size, o_orderpriority AS lang, o_totalprice AS v FROM orders), p AS (SELECT *, row_number() OVER (PARTITION BY size, lang ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY size, lang) AS n FROM r) SELECT size, lang, v AS median, n FROM p WHERE i = n // 2")
def report_medians(spark, sf_dir):
    r = orders(spark, sf_dir).select(F.col("o_orderstatus").alias("size"), F.col("o_orderpriority").alias("lang"), F.col("o_totalprice").alias("v"))
    return P.grouped_upper_median(r, ["size", "lang"], "v")


@query("readable_tasks", "WITH c AS (SELECT l_orderkey AS task, l_partkey AS blob FROM lineitem), bad AS (SELECT DISTINCT task FROM c WHERE blob % 50 = 7) SELECT task, count(*) AS candidates FROM c WHERE task NOT IN (SELECT task FROM bad) GROUP BY task")
def readable_tasks(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("task"), F.col("l_partkey").alias("blob"))
    return P.readable(c, c.where("blob % 50 <> 7")).groupBy("task").agg(F.count(F.lit(1)).alias("candidates"))


@query("vector_cache", "SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'cache' WHEN vec_id % 3 = 1 THEN 'index' ELSE 'embed' END AS origin FROM embeddings")
def vector_cache(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id")
    some = lambda m, v: e.where(f"vec_id % 3 = {m}").withColumn("v", F.lit(v))
    out = P.with_vectors(e, some(0, "cache"), some(1, "index").unionByName(some(0, "index")), ["vec_id"])
    return out.select("vec_id", F.coalesce("v", F.lit("embed")).alias("origin"))


@query("first_touches", "WITH t AS (SELECT l_orderkey AS task, l_suppkey AS path, l_linenumber AS n, CASE WHEN l_returnflag = 'R' THEN 2 WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS s FROM lineitem) SELECT task, path, min(n) AS first, ['read', 'ran', 'edited'][max(s) + 1] AS action FROM t GROUP BY ALL")
def first_touches(spark, sf_dir):
    action = F.when(F.col("l_returnflag") == "R", "edited").when(F.col("l_returnflag") == "A", "ran").otherwise("read")
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("task"), F.col("l_suppkey").alias("path"), F.col("l_linenumber").alias("n"), action.alias("action"))
    return P.first_touches(t, "task")


@query("latest_answers", "WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events) SELECT user_id, event_id, CAST(place AS INTEGER) AS place FROM r WHERE place <= 200")
def latest_answers(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return P.latest(e, "user_id", [F.desc("ts"), F.desc("event_id")], 200).select("user_id", "event_id", "place")


@query("latest_prompt", "SELECT conv_id, arg_max(text, struct_pack(turn, text)) AS prompt FROM conversations WHERE role = 'user' GROUP BY conv_id")
def latest_prompt(spark, sf_dir):
    return turns(spark, sf_dir).where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", F.struct("turn", "text")).alias("prompt"))


@query("dominant_language", "WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS r FROM c) SELECT source, lang, n FROM r WHERE r = 1")
def dominant_language(spark, sf_dir):
    return P.dominant(documents(spark, sf_dir), "source", "lang")


@query("negative_pool", f"WITH f AS (SELECT source, {FILE} AS p, doc_id FROM documents) SELECT source, count(*) AS candidates, CAST(sum(CASE WHEN doc_id % 13 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS gold, CAST(sum(CASE WHEN doc_id % 13 = 0 THEN 0 ELSE 1 END) AS BIGINT) AS negatives FROM f GROUP BY source")
def negative_pool(spark, sf_dir):
    d = documents(spark, sf_dir).select("source", "path", "doc_id")
    left = d.join(d.where("doc_id % 13 = 0").select("path"), "path", "left_anti").groupBy("source").agg(F.count(F.lit(1)).alias("negatives"))
    total = d.groupBy("source").agg(F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("doc_id") % 13 == 0).alias("gold"))
    return total.join(left, "source", "left").select("source", "candidates", "gold", F.coalesce("negatives", F.lit(0)).alias("negatives"))


def _table():
    rows = []
    for kind in ("request", "issue", "error", "conversational"):
        for adapted in (True, False):
            for strict in (True, False):
                t = R.thresholds("base", kind, adapted, strict)
                rows.append((kind, adapted, strict, t.min_top if t else None, t.min_margin if t else None))
    return rows


_VALUES = ", ".join(f"('{k}', {str(a).lower()}, {str(s).lower()}, {'NULL' if t is None else t}, {'NULL' if m is None else m})" for k, a, s, t, m in _table())


@query(
    "calibrated_abstain",
    f"""WITH t(kind, adapted, strict, min_top, min_margin) AS (VALUES {_VALUES}),
        e AS (SELECT event_id, ['request', 'issue', 'error', 'conversational'][CAST(event_id % 4 AS INT) + 1] AS kind, event_id % 2 = 0 AS adapted, event_id % 3 = 0 AS strict, least(value / 100, 1) AS top, least(value / 1000, 1) AS margin FROM events)
        SELECT event_id, coalesce(top < min_top OR margin < min_margin, false) AS abstain FROM e JOIN t USING (kind, adapted, strict)""",
)
def calibrated_abstain(spark, sf_dir):
    """Thresholds by kind, adapter and strictness, joined to the answers: a row of nulls never abstains."""
    t = spark.createDataFrame(_table(), "kind string, adapted boolean, strict boolean, min_top double, min_margin double")
    i = F.col("event_id")
    kinds = F.array(*map(F.lit, ("request", "issue", "error", "conversational")))
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", F.element_at(kinds, (i % 4).cast("int") + 1).alias("kind"), (i % 2 == 0).alias("adapted"), (i % 3 == 0).alias("strict"),
        F.least(F.col("value") / 100, F.lit(1.0)).alias("top"), F.least(F.col("value") / 1000, F.lit(1.0)).alias("margin"),
    )
    joined = e.join(F.broadcast(t), ["kind", "adapted", "strict"])  # 16 rows
    return joined.select("event_id", R.abstains(F.col("top"), F.col("margin"), F.col("min_top"), F.col("min_margin")).alias("abstain"))


@query("hint_gate", "SELECT event_type AS kind, CAST(sum(CASE WHEN value < 1 OR value > 30 THEN 1 ELSE 0 END) AS BIGINT) AS asked, count(*) AS n FROM events GROUP BY 1")
def hint_gate(spark, sf_dir):
    """Searches that found nothing or too much (no or more than 30 results) ask for hints."""
    found = F.floor("value")
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.groupBy(F.col("event_type").alias("kind")).agg(F.sum(((found == 0) | (F.col("value") > 30)).cast("long")).alias("asked"), F.count(F.lit(1)).alias("n"))


@query("rank_within_repo", "SELECT n_regionkey AS repo, n_nationkey AS item, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey % 3, n_name) AS rank FROM nation")
def rank_within_repo(spark, sf_dir):
    """Files, then functions, then configurations, each part in its own order."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    w = Window.partitionBy("n_regionkey").orderBy(F.col("n_nationkey") % 3, "n_name")
    return n.select(F.col("n_regionkey").alias("repo"), F.col("n_nationkey").alias("item"), F.row_number().over(w).cast("long").alias("rank"))
