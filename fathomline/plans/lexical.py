"""Lexical ranking: benchmark passages as queries over documents."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import lexical as L
from ..sources.store import spread
from .registry import query
from .texts import TOKENS, documents

POSTED = f"""
    dt AS (SELECT doc_id, unnest({TOKENS.format('text')}) AS term FROM documents),
    p AS (SELECT doc_id, term, count(*) AS tf FROM dt GROUP BY doc_id, term),
    l AS (SELECT doc_id, len({TOKENS.format('text')}) AS len FROM documents),
    df AS (SELECT term, count(*) AS df FROM p GROUP BY term)"""
BM25 = f"""{POSTED},
    f AS (SELECT count(*) AS n, avg(len) AS avg_len FROM l),
    qt AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({TOKENS.format('text')}) AS term FROM benchmark) GROUP BY item_id, term),
    s AS (SELECT item_id, doc_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))) AS score
          FROM qt JOIN df USING (term) JOIN p USING (term) JOIN l USING (doc_id), f GROUP BY item_id, doc_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM s)"""
#: Gold: the documents that hold the passage.
GOLD = "g AS (SELECT item_id, min(rank) - 1 AS gold_rank FROM r JOIN benchmark b USING (item_id) JOIN documents d USING (doc_id) WHERE strpos(d.text, b.text) > 0 GROUP BY item_id), a AS (SELECT item_id, gold_rank FROM benchmark LEFT JOIN g USING (item_id))"


def benchmark(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


@query("term_counts", f"WITH {POSTED} SELECT doc_id, term, tf FROM p")
def term_counts(spark, sf_dir):
    return L.postings(documents(spark, sf_dir), "doc_id").select("doc_id", "term", "tf")


@query("idf", f"WITH {POSTED} SELECT term, round(ln(1 + ((SELECT count(*) FROM documents) - df + 0.5) / (df + 0.5)), 6) AS idf FROM df")
def idf(spark, sf_dir):
    d = documents(spark, sf_dir)
    n = d.count()
    return L.postings(d, "doc_id").groupBy("term").agg(F.count(F.lit(1)).alias("df")).select("term", F.round(L.idf(F.lit(float(n)), F.col("df")), 6).alias("idf"))


def ranked(spark, sf_dir):
    scored = L.bm25(benchmark(spark, sf_dir), documents(spark, sf_dir), "item_id", "doc_id")
    w = Window.partitionBy("item_id").orderBy(F.desc(F.round("score", 6)), "doc_id")
    return scored.withColumn("rank", F.row_number().over(w))


@query("bm25_top3", f"WITH {BM25} SELECT item_id, doc_id, CAST(rank AS INTEGER) AS rank, round(score, 4) AS score FROM r WHERE rank <= 3")
def bm25_top3(spark, sf_dir):
    return ranked(spark, sf_dir).where("rank <= 3").select("item_id", "doc_id", "rank", F.round("score", 4).alias("score"))


#: Passages up to which they are broadcast to the documents (their texts, a few hundred bytes each).
BROADCAST_PASSAGES = 2000


def gold(spark, sf_dir):
    """The passages are looked for in every document first, so that only documents that hold one meet ranks."""
    b = benchmark(spark, sf_dir)
    passages = b.select("item_id", F.col("text").alias("passage"))
    d = spread(documents(spark, sf_dir).select("doc_id", "text"))
    r = ranked(spark, sf_dir).select("item_id", "doc_id", "rank")
    if passages.count() <= BROADCAST_PASSAGES:
        holds = d.join(F.broadcast(passages), F.contains("text", "passage")).select("item_id", "doc_id")
        found = r.join(holds, ["item_id", "doc_id"])
    else:
        found = r.join(passages, "item_id").join(d, "doc_id").where(F.contains("text", "passage"))
    found = found.groupBy("item_id").agg((F.min("rank") - 1).cast("long").alias("gold_rank"))
    return b.select("item_id").join(found, "item_id", "left")


@query("gold_rank", f"WITH {BM25}, {GOLD} SELECT item_id, gold_rank FROM a")
def gold_rank(spark, sf_dir):
    return gold(spark, sf_dir)


@query(
    "hit_mrr",
    f"""WITH {BM25}, {GOLD} SELECT count(*) AS n, round(avg(CASE WHEN gold_rank < 1 THEN 1.0 ELSE 0.0 END), 3) AS hit1, round(avg(CASE WHEN gold_rank < 3 THEN 1.0 ELSE 0.0 END), 3) AS hit3,
        round(avg(CASE WHEN gold_rank < 10 THEN 1.0 ELSE 0.0 END), 3) AS hit10, round(avg(coalesce(1.0 / (gold_rank + 1), 0.0)), 3) AS mrr FROM a""",
)
def hit_mrr(spark, sf_dir):
    return gold(spark, sf_dir).agg(*L.hits())


@query(
    "bm25_per_source",
    f"""WITH c AS (SELECT source AS task, doc_id, text FROM documents), q AS (SELECT task, text AS query FROM (SELECT source AS task, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n = 1),
        dt AS (SELECT task, doc_id, unnest({TOKENS.format('text')}) AS term FROM c), p AS (SELECT task, doc_id, term, count(*) AS tf FROM dt GROUP BY ALL),
        l AS (SELECT task, doc_id, len({TOKENS.format('text')}) AS len FROM c), f AS (SELECT task, count(*) AS n, avg(len) AS avg_len FROM l GROUP BY task), df AS (SELECT task, term, count(*) AS df FROM p GROUP BY ALL),
        qt AS (SELECT task, term, count(*) AS qtf FROM (SELECT task, unnest({TOKENS.format('query')}) AS term FROM q) GROUP BY ALL),
        s AS (SELECT task, doc_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))) AS score FROM qt JOIN df USING (task, term) JOIN p USING (task, term) JOIN l USING (task, doc_id) JOIN f USING (task) GROUP BY ALL)
        SELECT task, concat('d', doc_id) AS path, round(coalesce(score, 0), 4) AS score FROM c LEFT JOIN s USING (task, doc_id)""",
)
def bm25_per_source(spark, sf_dir):
    d = documents(spark, sf_dir).select(F.col("source").alias("task"), F.concat(F.lit("d"), "doc_id").alias("path"), "doc_id", "text")
    q = d.groupBy("task").agg(F.min_by("text", "doc_id").alias("query"))
    scored = L.bm25_per_task(d.join(q, "task"))
    return scored.select("task", "path", F.round("score", 4).alias("score"))


@query(
    "grep_terms_rank",
    """WITH t AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(text, '[A-Za-z]{7,}')) AS term FROM benchmark),
            w AS (SELECT doc_id, length(text) AS size, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z_0-9]*')) AS term FROM documents),
            c AS (SELECT doc_id, size, term, count(*) AS c FROM w GROUP BY ALL),
            m AS (SELECT item_id, doc_id, size, count(*) AS terms, sum(c) AS total FROM t JOIN c USING (term) GROUP BY ALL),
            r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY terms DESC, total DESC, size, doc_id) AS rank FROM m)
       SELECT item_id, doc_id, terms, CAST(total AS BIGINT) AS total, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3""",
)
def grep_terms_rank(spark, sf_dir):
    terms = benchmark(spark, sf_dir).select("item_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{7,}"), F.lit(0))).alias("term")).distinct()
    return L.grep_ranked(terms, documents(spark, sf_dir), "item_id", "doc_id").where("rank <= 3").select("item_id", "doc_id", "terms", "total", "rank")
