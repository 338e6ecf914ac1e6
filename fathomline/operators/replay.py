"""History replay: commits as tasks, ranked lexically, by an encoder and by an adapter that learns on the way.

A commit is a task: its message is the query, the source files of its parent are the candidates, those of
them that it changes are gold.  Frames by repository, so one run replays many:

    commits (repo, n from the newest, sha, date, subject, body, parent, paths)
    trees   (repo, rev, path, blob): source files of the parents
    graph   (repo, n parents first, sha, parents): all commits, for ancestry

    held = replay(spark, commits, trees, graph, texts, encoder)
    held.scores.show(); held.by_size.show(); held.by_era.show(); held.counts.show()
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf
from pyspark.sql.window import Window

from ..functions import text
from ..functions.code import file_doc_udf
from ..functions.numeric import bucket, idf, upper_median
from ..functions.paths import is_test, kind, language
from ..sources.store import written
from . import adapter as A
from . import encoders as E
from . import history as H
from . import lexical as L

#: Most changed files of a task, size labels.
MOST_GOLD = 6
SIZES = [(1000, "< 1k files"), (3000, "1k-3k files"), (10_000, "3k-10k files")]
LARGEST = "10k+ files"
METHODS = {"lexical": "lexical (BM25)", "model": "model", "adapter": "model + adapter"}


@dataclass(frozen=True)
class Options:
    commits: int = 300
    train: int = 200
    step: int = 100
    with_tests: bool = False
    adapter: bool = True
    most_gold: int = MOST_GOLD
    seed: int = 0
    params: A.Params = field(default_factory=A.Params)


@dataclass
class Replay:
    """tasks: repo, t (from the oldest), sha, files, lexical, model, adapter (gold ranks from 0; ``adapted``
    tells whether an adapter was fitted for the task).  Only tasks that are scored."""

    counts: DataFrame
    tasks: DataFrame
    scores: DataFrame
    matched: DataFrame
    by_size: DataFrame
    by_era: DataFrame


@pandas_udf(T.DoubleType())
def pair_dot(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([float(np.dot(np.asarray(x, dtype=np.float64), np.asarray(y, dtype=np.float64))) for x, y in zip(a, b)])


def walked(commits: DataFrame, o: Options) -> DataFrame:
    """The newest commits with a parent, as many as the replay may look at."""
    want = o.commits + (o.train if o.adapter else 0)
    w = Window.partitionBy("repo").orderBy("n")
    return commits.where("parent is not null").withColumn("place", F.row_number().over(w)).where(F.col("place") <= max(4 * want, 50)).drop("place")


def eligible(touching: DataFrame, trees: DataFrame, o: Options) -> tuple[DataFrame, DataFrame]:
    """(tasks, gold): the newest commits that change 1 to most_gold files of their parent's tree, one of
    them at least no test, and those files."""
    changed = touching.select("repo", "sha", "n", F.col("parent").alias("rev"), F.explode(F.array_distinct("paths")).alias("path"))
    existing = changed.join(trees, ["repo", "rev", "path"], "left_semi")
    test = F.lit(False) if o.with_tests else is_test(F.col("path"))
    per = existing.groupBy("repo", "sha", "n").agg(F.count(F.lit(1)).alias("existing"), F.count_if(~test).alias("gold"))
    good = per.where(F.col("existing").between(1, o.most_gold) & (F.col("gold") > 0))
    w = Window.partitionBy("repo").orderBy("n")
    picked = good.withColumn("place", F.row_number().over(w)).where(F.col("place") <= o.commits + (o.train if o.adapter else 0))
    return picked.select("repo", "sha", "n"), existing.where(~test).select("repo", "sha", "path")


def lexical_scores(candidates: DataFrame, docs: DataFrame, asked: DataFrame) -> DataFrame:
    """repo, t, path, score by BM25 with the counts of each task's own candidates.  Each version of a file
    is tokenised once, and only terms that a query asks for are joined."""
    bags = docs.select("repo", "path", "blob", text.tokens(F.col("doc")).alias("bag")).select("repo", "path", "blob", F.size("bag").alias("len"), "bag")
    terms = bags.select("repo", "path", "blob", F.explode("bag").alias("term")).groupBy("repo", "path", "blob", "term").agg(F.count(F.lit(1)).alias("tf"))
    sized = candidates.join(bags.drop("bag"), ["repo", "path", "blob"])
    per = sized.groupBy("repo", "t").agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"))
    query = asked.select("repo", "t", F.explode(text.tokens(F.col("query"))).alias("term")).groupBy("repo", "t", "term").agg(F.count(F.lit(1)).alias("qtf"))
    hit = query.join(terms, ["repo", "term"]).join(sized, ["repo", "t", "path", "blob"])
    df = hit.groupBy("repo", "t", "term").agg(F.count(F.lit(1)).alias("df"))
    s = F.col("qtf") * idf(F.col("n"), F.col("df")) * F.col("tf") * (L.K1 + 1) / (F.col("tf") + L.K1 * (1 - L.B + L.B * F.col("len") / F.col("avg_len")))
    return hit.join(df, ["repo", "t", "term"]).join(per, ["repo", "t"]).groupBy("repo", "t", "path").agg(F.sum(s).alias("score"))


def gold_ranks(scored: DataFrame, gold: DataFrame, name: str) -> DataFrame:
    """repo, t and the best place of a gold file among the candidates; ties by path."""
    w = Window.partitionBy("repo", "t").orderBy(F.desc("score"), "path")
    placed = scored.withColumn(name, F.row_number().over(w) - 1)
    return placed.join(gold, ["repo", "t", "path"], "left_semi").groupBy("repo", "t").agg(F.min(name).alias(name))


def blocks(tasks: DataFrame, graph: DataFrame, o: Options) -> DataFrame:
    """repo, block, t, scored: of each block the tasks that it scores, and those that it learns from.  These
    come before it and are ancestors of all its commits: the last ``train`` of them, A.LEAST at least.

    One group a repository: ancestry is a walk over its whole history, held as a bit a task."""

    def one(key, mine: pd.DataFrame, log: pd.DataFrame) -> pd.DataFrame:
        shas = list(mine.sort_values("t").sha)
        log = log.sort_values("n")
        reach = H.ancestors([(s, list(p)) for s, p in zip(log.sha, log.parents)], shas)
        n, rows = len(shas), []
        start = max(n - o.commits, min(A.LEAST, n))
        size = min(o.step, max(start, 10))
        for block, begin in enumerate(range(start, n, size)):
            now = range(begin, min(begin + size, n))
            known = set.intersection(*(reach[shas[b]] for b in now))
            train = [j for j in range(begin) if shas[j] in known][-o.train :]
            if len(train) >= A.LEAST:
                rows += [(key[0], block, j, False) for j in train] + [(key[0], block, b, True) for b in now]
        return pd.DataFrame(rows, columns=["repo", "block", "t", "scored"])

    return tasks.select("repo", "t", "sha").groupBy("repo").cogroup(graph.groupBy("repo")).applyInPandas(one, "repo string, block long, t long, scored boolean")


def examples(candidates: DataFrame, gold: DataFrame, o: Options) -> DataFrame:
    """repo, t, slot, path, blob: slot 0 is a task's first gold file by path, the others are sampled from
    its candidates that aren't gold.  One group a task."""

    def one(c: pd.DataFrame) -> pd.DataFrame:
        c = c.sort_values("path")
        t = int(c.t.iloc[0])
        own, others = c[c.gold], list(zip(c[~c.gold].path, c[~c.gold].blob))
        drawn = A.sample_from(others, o.params.negatives, o.seed ^ (t * 0x9E3779B9 & A.MASK))
        chosen = [(own.path.iloc[0], own.blob.iloc[0]), *drawn]
        return pd.DataFrame([(c.repo.iloc[0], t, i, *x) for i, x in enumerate(chosen)], columns=["repo", "t", "slot", "path", "blob"])

    marked = candidates.join(gold.withColumn("gold", F.lit(True)), ["repo", "t", "path"], "left").withColumn("gold", F.coalesce("gold", F.lit(False)))
    return marked.select("repo", "t", "path", "blob", "gold").groupBy("repo", "t").applyInPandas(one, "repo string, t long, slot long, path string, blob string")


def fitted(learned: DataFrame, params: A.Params) -> DataFrame:
    """repo, block, w; learned: repo, block, t, q, vs (the vectors of the task's slots).  One group a block,
    bounded by its training tasks."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("t")
        own = [np.stack([np.asarray(v, dtype=np.float32) for v in vs]) for vs in g.vs]
        first = np.cumsum([0, *(len(v) for v in own)])[:-1].tolist()
        w = A.fit(np.stack(g.q.values), np.concatenate(own), first, [list(range(f + 1, f + len(v))) for f, v in zip(first, own)], params)
        return pd.DataFrame({"repo": [g.repo.iloc[0]], "block": [int(g.block.iloc[0])], "w": [w.ravel().tolist()]})

    return learned.groupBy("repo", "block").applyInPandas(one, "repo string, block long, w array<float>")


@pandas_udf(T.ArrayType(T.FloatType()))
def mapped(q: pd.Series, w: pd.Series) -> pd.Series:
    return pd.Series([A.apply(np.asarray(x, dtype=np.float32), np.asarray(m, dtype=np.float32).reshape(len(x), len(x))).astype(np.float32) for x, m in zip(q, w)])


def sliced(tasks: DataFrame, label: Column, order: Column) -> DataFrame:
    """label, n and hit@3 of each method; the adapter's on the tasks that have one, null where none has."""
    hit = lambda c: F.when(F.col(c) < 3, 1.0).otherwise(0.0)
    cells = [F.round(F.avg(hit("lexical")), 3).alias("lexical"), F.round(F.avg(hit("model")), 3).alias("model"), F.round(F.avg(F.when(F.col("adapted"), hit("adapter"))), 3).alias("adapter")]
    out = tasks.groupBy("repo", label.alias("label")).agg(F.count(F.lit(1)).alias("n"), *cells, F.min(order).alias("place"))
    return out.orderBy("repo", "place").drop("place")


def method_scores(tasks: DataFrame, methods: list[str]) -> DataFrame:
    parts = [tasks.groupBy("repo").agg(*L.hits(m)).select("repo", F.lit(METHODS[m]).alias("method"), "n", "hit1", "hit3", "hit10", "mrr") for m in methods]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def replay(commits: DataFrame, trees_of: Callable[[DataFrame], DataFrame], texts_of: Callable[[DataFrame], DataFrame], graph: DataFrame, encoder: E.Encoder, options: Options = Options()) -> Replay:
    """Replays the newest eligible commits of each repository.

    ``trees_of`` gives the source files of (repo, rev), ``texts_of`` the texts of (repo, blob), as those of
    sources.git do.  Tasks with a candidate whose text can't be read are left out."""
    o = options
    touching = walked(commits, o).where(F.exists("paths", lambda p: kind(p) == "source"))
    touching = written(touching, "replay-commits")
    trees = written(trees_of(touching.select("repo", F.col("parent").alias("rev"))), "replay-trees")
    picked, gold = eligible(touching, trees, o)
    picked = written(picked, "replay-picked")
    want = o.commits + (o.train if o.adapter else 0)
    reach = picked.groupBy("repo").agg(F.count(F.lit(1)).alias("picked"), F.max("n").alias("last"))
    looked = touching.join(reach, "repo", "left").where((F.col("picked") < want) | F.col("picked").isNull() | (F.col("n") <= F.col("last")))
    scanned = looked.groupBy("repo").agg(F.count(F.lit(1)).alias("scanned"))

    facts = picked.join(touching.drop("n"), ["repo", "sha"]).select("repo", "n", "sha", "date", F.col("parent").alias("rev"), text.history_body(F.col("subject"), F.col("body")).alias("query"))
    sides = facts.join(trees, ["repo", "rev"]).select("repo", "n", "sha", "path", "blob")
    texts = written(texts_of(sides.select("repo", "blob")), "replay-texts")
    missing = sides.join(texts, ["repo", "blob"], "left_anti").select("repo", "sha").distinct()
    facts = facts.join(missing, ["repo", "sha"], "left_anti")
    facts = written(facts.withColumn("t", (F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("n"))) - 1).cast("long")), "replay-tasks")
    number = facts.select("repo", "sha", "t")
    candidates = written(sides.drop("n").join(number, ["repo", "sha"]).select("repo", "t", "path", "blob"), "replay-candidates")
    gold = gold.join(number, ["repo", "sha"]).select("repo", "t", "path").distinct()

    versions = candidates.select("repo", "path", "blob").distinct().join(texts, ["repo", "blob"])
    docs = versions.withColumn("doc", file_doc_udf("path", "text")).select("repo", "path", "blob", E.document_text(encoder, F.col("doc")).alias("doc"))
    docs = written(E.with_vectors(docs, "doc", encoder), "replay-docs")
    asked = facts.withColumn("q", E.vector_of(encoder)(E.query_text(encoder, F.col("query"), F.lit(""))))
    asked = written(asked.select("repo", "t", "query", "q"), "replay-queries")

    # the newest ``commits`` are scored
    sized = facts.join(facts.groupBy("repo").agg(F.count(F.lit(1)).alias("eligible")), "repo").where(F.col("t") >= F.col("eligible") - o.commits)
    scored = sized.join(candidates.groupBy("repo", "t").agg(F.count(F.lit(1)).alias("files")), ["repo", "t"]).select("repo", "t", "sha", "date", "eligible", "files")
    shown = candidates.join(scored.select("repo", "t"), ["repo", "t"], "left_semi")
    lexical = lexical_scores(shown, docs, asked)
    lexical = shown.join(lexical, ["repo", "t", "path"], "left").select("repo", "t", "path", F.coalesce("score", F.lit(0.0)).alias("score"))
    by_vector = lambda q: shown.join(q, ["repo", "t"]).join(docs.select("repo", "path", "blob", "v"), ["repo", "path", "blob"]).select("repo", "t", "path", pair_dot("q", "v").alias("score"))
    ranks = [gold_ranks(lexical, gold, "lexical"), gold_ranks(by_vector(asked.select("repo", "t", "q")), gold, "model")]
    none = scored.select("repo", "t").withColumns({"adapter": F.lit(None).cast("int"), "adapted": F.lit(False)})
    if o.adapter:
        dealt = written(blocks(facts, graph, o), "replay-blocks")
        learning = dealt.where("not scored").select("repo", "t").distinct()
        drawn = examples(candidates.join(learning, ["repo", "t"], "left_semi"), gold, o).join(docs.select("repo", "path", "blob", "v"), ["repo", "path", "blob"])
        slots = drawn.groupBy("repo", "t").agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "v"))), lambda x: x["v"]).alias("vs"))  # 1 + negatives of a task
        learned = dealt.where("not scored").join(slots, ["repo", "t"]).join(asked.select("repo", "t", "q"), ["repo", "t"])
        weights = written(fitted(learned.select("repo", "block", "t", "q", "vs"), o.params), "replay-weights")
        moved = dealt.where("scored").join(weights, ["repo", "block"]).join(asked.select("repo", "t", "q"), ["repo", "t"]).select("repo", "t", mapped("q", "w").alias("q"))
        moved = written(moved, "replay-mapped")
        own = gold_ranks(by_vector(moved), gold, "adapter")
        none = scored.select("repo", "t").join(own, ["repo", "t"], "left").join(moved.select("repo", "t", F.lit(True).alias("adapted")), ["repo", "t"], "left").withColumn("adapted", F.coalesce("adapted", F.lit(False)))
    tasks = scored
    for r in [*ranks, none]:
        tasks = tasks.join(r, ["repo", "t"], "left")
    tasks = written(tasks, "replay-ranks")

    # eras: folders and the commonest language of a task's candidates
    parts = F.split("path", "/")
    head = F.when(F.size(parts) >= 3, F.concat_ws("/", F.slice(parts, 1, 2))).otherwise(F.col("path"))
    folders = shown.groupBy("repo", "t").agg(F.collect_set(head).alias("folders"))
    spoken = shown.select("repo", "t", language(F.col("path")).alias("language")).where("language is not null").groupBy("repo", "t", "language").agg(F.count(F.lit(1)).alias("m"))
    spoken = spoken.groupBy("repo", "t").agg(F.min(F.struct(-F.col("m"), "language")).alias("x")).select("repo", "t", F.col("x.language").alias("language"))
    told = folders.join(spoken, ["repo", "t"], "left").select("repo", F.col("t").alias("n"), "folders", F.coalesce("language", F.lit("")).alias("language"))
    era = H.eras(told).join(told.select("repo", "n", "language"), ["repo", "n"]).join(tasks.select("repo", F.col("t").alias("n"), "date"), ["repo", "n"])
    day = lambda f: F.substring(f("date", "n"), 1, 10)
    named = era.groupBy("repo", "era").agg(F.concat(day(F.min_by), F.lit(" to "), day(F.max_by), F.lit(" ("), F.min_by("language", "n"), F.lit(")")).alias("label"), F.min("n").alias("from"))
    in_era = tasks.join(era.select("repo", F.col("n").alias("t"), "era"), ["repo", "t"]).join(named, ["repo", "era"])

    counted = tasks.groupBy("repo").agg(
        F.max("eligible").alias("eligible"), F.count(F.lit(1)).alias("evaluated"), F.count_if("adapted").alias("adapted"), upper_median(F.collect_list("files")).alias("files_median")
    )  # at most ``commits`` numbers
    counts = scanned.join(counted, "repo", "left").select("repo", "scanned", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("eligible", "evaluated", "adapted", "files_median")])
    return Replay(
        counts, tasks, method_scores(tasks, ["lexical", "model"]), method_scores(tasks.where("adapted"), list(METHODS)),
        sliced(tasks, bucket(F.col("files"), SIZES, LARGEST), F.col("files")), sliced(in_era, F.col("label"), F.col("from")),
    )
