"""BM25 over each task's own candidates, gold ranks and their scores, and the identifier-grep baseline."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from ..functions.numeric import idf
from ..functions.text import tokens
from ..sources.store import spread, written

#: Fixed values of the lexical ranker.
K1, B = 1.2, 0.75


def postings(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, term, tf and len (all tokens) of every document; one shuffle, on the document and term."""
    bag = docs.select(key, tokens(F.col(text)).alias("bag"))
    terms = bag.select(key, F.size("bag").alias("len"), F.explode("bag").alias("term"))
    return terms.groupBy(key, "term", "len").agg(F.count(F.lit(1)).alias("tf"))


#: Buckets of the filter that terms pass before they leave their document.
FILTER = 1 << 16


def kept_tokens(bag: Column, asked: DataFrame) -> Column:
    """The tokens of a bag that may be asked for: a bit a hash bucket of the asked terms, FILTER in all."""
    slot = F.xxhash64("term").bitwiseAND(F.lit(FILTER - 1)).cast("int")
    held = {r[0] for r in asked.select(slot).distinct().collect()}  # at most FILTER rows
    bits = F.split(F.lit("".join("1" if i in held else "0" for i in range(FILTER))), "")
    return F.filter(bag, lambda x: F.get(bits, F.xxhash64(x).bitwiseAND(F.lit(FILTER - 1)).cast("int")) == "1")


def counted_terms(bags: DataFrame, asked: DataFrame, by: list[str]) -> DataFrame:
    """by, len, term, tf of the asked terms; bags: by, len, kept.  Few rows leave a document, and its counts
    are whole before any shuffle."""
    return bags.select(*by, "len", F.explode("kept").alias("term")).groupBy(*by, "len", "term").agg(F.count(F.lit(1)).alias("tf"))


def saturated(avg_len: Column) -> Column:
    return F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / avg_len))


def bm25(queries: DataFrame, docs: DataFrame, query_key: str, doc_key: str) -> DataFrame:
    """query_key, doc_key, score of the documents that share a term with a query (the others score 0).

    Every document is a candidate of every query here, so the counts are those of all documents.  A term
    that a query repeats counts as often.  Documents are tokenised once; only terms that some query asks
    for are counted and joined."""
    asked = written(queries.select(query_key, F.explode(tokens(F.col("text"))).alias("term")).groupBy(query_key, "term").agg(F.count(F.lit(1)).alias("qtf")), "bm25-asked")
    bags = spread(docs.select(doc_key, "text")).select(doc_key, tokens(F.col("text")).alias("bag")).select(doc_key, F.size("bag").alias("len"), kept_tokens(F.col("bag"), asked).alias("kept"))
    bags = written(bags, "bm25-bags")
    facts = bags.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len")).first()
    posted = counted_terms(bags.where(F.size("kept") > 0), asked, [doc_key])
    frequency = posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    asked = written(asked.join(frequency, "term").withColumn("w", F.col("qtf") * idf(F.lit(float(facts.n)), F.col("df"))).select(query_key, "term", "w"), "bm25-weights")
    size = asked.agg(F.count_distinct(query_key).alias("q"), F.count_distinct("term").alias("t")).first()
    if size.q * size.t <= DENSE:
        return multiplied(bags, asked, query_key, doc_key, facts.avg_len or 1.0)
    scored = posted.join(asked, "term").withColumn("s", F.col("w") * saturated(F.lit(facts.avg_len or 1.0)))
    return scored.groupBy(query_key, doc_key).agg(F.sum("s").alias("score"))


#: Queries times their terms up to which scores are matrix products (8 bytes each); beyond, they are joins.
DENSE = 4_000_000


def multiplied(bags: DataFrame, asked: DataFrame, query_key: str, doc_key: str, avg_len: float) -> DataFrame:
    """query_key, doc_key, score: the saturated counts of a batch of documents times the weights of all
    queries (query_key, term, w; at most DENSE in all), so that nothing is shuffled."""
    rows = asked.collect()  # at most DENSE, most of them far apart
    ids, terms = sorted({r[0] for r in rows}), sorted({r.term for r in rows})
    number, place = {q: i for i, q in enumerate(ids)}, {t: i for i, t in enumerate(terms)}
    weights = np.zeros((len(terms), len(ids)))
    for r in rows:
        weights[place[r.term], number[r[0]]] = r.w
    kinds = dict(asked.dtypes) | dict(bags.dtypes)
    schema = f"{query_key} {kinds[query_key]}, {doc_key} {kinds[doc_key]}, score double"
    of = {c: bags.select(c).schema[0].dataType for c in (doc_key,)} | {query_key: asked.schema[query_key].dataType}
    kind = {c: to_arrow_type(t) for c, t in of.items()}
    shared = asked.sparkSession.sparkContext.broadcast((pa.array(ids, kind[query_key]), pa.array(terms, pa.string()), weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, known, w = shared.value
        step = max(1, DENSE // max(1, len(known)))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                kept = b.column(2)
                owner = np.repeat(np.arange(b.num_rows), pc.fill_null(pc.list_value_length(kept), 0).to_numpy(zero_copy_only=False))
                found = pc.index_in(kept.flatten(), value_set=known).to_numpy(zero_copy_only=False)
                real = ~np.isnan(found) if found.dtype.kind == "f" else np.ones(len(found), dtype=bool)
                tf = np.bincount(owner[real] * len(known) + found[real].astype(np.int64), minlength=b.num_rows * len(known)).reshape(b.num_rows, len(known)).astype(float)
                length = b.column(1).to_numpy(zero_copy_only=False).astype(float)[:, None]
                score = (tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avg_len))) @ w
                doc, query = np.nonzero(score)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(query)), b.column(0).take(pa.array(doc)), pa.array(score[doc, query])], names=[query_key, doc_key, "score"])

    return bags.where(F.size("kept") > 0).select(doc_key, "len", "kept").mapInArrow(run, schema)


def bm25_per_task(candidates: DataFrame) -> DataFrame:
    """candidates (task, path, query, text) with score: counts and lengths over each task's candidates only."""
    asked = candidates.groupBy("task").agg(F.first("query").alias("query")).select("task", F.explode(tokens(F.col("query"))).alias("term"))
    asked = written(asked.groupBy("task", "term").agg(F.count(F.lit(1)).alias("qtf")), "bm25-asked")
    bags = spread(candidates.select("task", "path", "text")).select("task", "path", tokens(F.col("text")).alias("bag"))
    bags = written(bags.select("task", "path", F.size("bag").alias("len"), kept_tokens(F.col("bag"), asked).alias("kept")), "bm25-bags")
    per = bags.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"))
    terms = counted_terms(bags, asked, ["task", "path"]).join(asked, ["task", "term"])
    frequency = terms.groupBy("task", "term").agg(F.count(F.lit(1)).alias("df"))
    hit = terms.join(frequency, ["task", "term"]).join(per, "task")
    scored = hit.groupBy("task", "path").agg(F.sum(F.col("qtf") * idf(F.col("n"), F.col("df")) * saturated(F.col("avg_len"))).alias("score"))
    return bags.select("task", "path").join(scored, ["task", "path"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def gold_rank(ranked: DataFrame, by: str, gold: Column, order: list) -> DataFrame:
    """The best position from 0 of a gold row of each query; null where none is."""
    w = Window.partitionBy(by).orderBy(*order)
    place = ranked.withColumn("place", F.row_number().over(w) - 1)
    return place.groupBy(by).agg(F.min(F.when(gold, F.col("place"))).alias("gold_rank"))


def hits(rank: Column | str = "gold_rank") -> list[Column]:
    """n, hit1, hit3, hit10 and mrr, to three decimals; a miss counts 0."""
    r = F.col(rank) if isinstance(rank, str) else rank
    share = lambda k: F.round(F.avg(F.when(r < k, 1.0).otherwise(0.0)), 3)
    return [
        F.count(F.lit(1)).alias("n"), share(1).alias("hit1"), share(3).alias("hit3"), share(10).alias("hit10"),
        F.round(F.avg(F.coalesce(1.0 / (r + 1), F.lit(0.0))), 3).alias("mrr"),
    ]


def grep_ranked(terms: DataFrame, docs: DataFrame, by: str, key: str) -> DataFrame:
    """terms (by, term) against the words of docs: distinct terms matched, then matches, then shorter text."""
    words = spread(docs.select(key, "text")).select(key, F.length("text").alias("size"), F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z_]\w*"), F.lit(0))).alias("term"))
    counted = words.groupBy(key, "size", "term").agg(F.count(F.lit(1)).alias("c"))
    matched = terms.join(counted, "term").groupBy(by, key, "size").agg(F.count(F.lit(1)).alias("terms"), F.sum("c").alias("total"))
    w = Window.partitionBy(by).orderBy(F.desc("terms"), F.desc("total"), "size", key)
    return matched.withColumn("rank", F.row_number().over(w))
