"""The whole answer to a batch of queries in one call: from query texts to ranked, abstaining, budgeted
and rendered hints.

Frames: queries (q_id long, query, context); index (kind, path, name, line, v) with the kinds file,
config, function; texts (path, text) for exact evidence.  Queries are the small side; the index is read
in batches and never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions import text
from ..functions.numeric import dot
from ..functions.paths import basename, is_auxiliary, path_prior
from ..sources.store import written
from . import adapter as A
from . import encoders as E
from . import ranking as R

Texts = DataFrame | Callable[[DataFrame], DataFrame]

#: Candidates whose texts are searched for literals, words that ask for a configuration, and messages.
SEARCHED = 50
CONFIG_WORDS = "config configuration docker yaml toml manifest settings".split()
EMPTY_QUERY, NO_MATCH = "empty query: say what you are looking for", "no file matches the query"
KINDS = ("error", "conversational", "issue", "request")
HINT = "kind string, path string, name string, line int, similarity double, exact boolean"
ANSWER = f"q_id long, state string, reason string, fallback boolean, adapter boolean, revision string, hints array<struct<{HINT}>>, answer string"


@dataclass(frozen=True)
class Options:
    k: int = 3
    functions: bool = False
    adapt: bool = True
    strict: bool = False
    no_abstain: bool = False
    start_min_files: int | None = None
    unsupported_only: bool = False


def adapted(weights: np.ndarray):
    @pandas_udf(T.ArrayType(T.FloatType()))
    def run(vectors: pd.Series) -> pd.Series:
        return pd.Series([A.apply(np.asarray(v, dtype=np.float32), weights).astype(np.float32) for v in vectors])

    return run


def unanswered(queries: DataFrame, state: str, reason: str | None, fallback: bool) -> DataFrame:
    none = F.array().cast(f"array<struct<{HINT}>>")
    said = F.lit(R.rendered(state, reason=reason or ""))
    cells = {"state": F.lit(state), "reason": F.lit(reason).cast("string"), "fallback": F.lit(fallback), "adapter": F.lit(False), "revision": F.lit(None).cast("string"), "hints": none, "answer": said}
    return queries.select("q_id", *[c.alias(n) for n, c in cells.items()])


def exact_evidence(asked: DataFrame, files: DataFrame, candidates: DataFrame, texts: Texts) -> DataFrame:
    """q_id, path of exact evidence: literals of the query that name a file, or that the texts of its
    candidates hold."""
    literals = asked.select("q_id", F.explode(text.query_literals(F.col("query"))).alias("literal"))
    named = literals.join(files.select("path", basename(F.col("path")).alias("literal")), "literal").select("q_id", "path", F.lit("").alias("text"))
    read = candidates.join(literals.select("q_id").distinct(), "q_id", "left_semi").select("q_id", "path")
    texts = texts(read.select("path").distinct()) if callable(texts) else texts
    read = read.join(texts.select("path", "text"), "path").select("q_id", "path", "text")
    return R.exact_files(literals, named.unionByName(read))


def ask(
    queries: DataFrame, index: DataFrame, encoder: E.Encoder, texts: Texts | None = None, adapter: dict | None = None, options: Options = Options(), serving: bool = True
) -> DataFrame:
    """q_id, state, reason, fallback, adapter, revision, hints and answer of each query.

    ``texts`` is a frame, or gives one for the paths (a frame) that are to be read.  ``adapter`` has weights, base (fingerprint), dim and revision.  A query without any text is an error;
    an index that can't serve, or holds nothing, answers with its state.  A reason not to answer is
    overridden by exact evidence, and then only exact rows are shown; behind the start gate there is none.
    """
    o = options
    fallback = encoder.fingerprint.startswith("hash-")
    q = queries.select("q_id", F.coalesce("query", F.lit("")).alias("query"), F.coalesce("context", F.lit("")).alias("context"))
    blank = (text.strip(F.col("query")) == "") & (text.strip(F.col("context")) == "")
    empty = unanswered(q.where(blank), "error", EMPTY_QUERY, fallback)
    asked = q.where(~blank)
    if not serving:
        return empty.unionByName(unanswered(asked, "error", "the index can't serve", fallback))
    have = {r.kind: r for r in index.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(is_auxiliary(F.col("path")).cast("long")).alias("aux")).collect()}  # a row a kind
    if "file" not in have and "config" not in have:
        return empty.unionByName(unanswered(asked, "unsupported_scope" if o.unsupported_only else "empty_index", None, fallback))
    n_files = have["file"].n if "file" in have else 0
    mostly = n_files > 0 and have["file"].aux * 2 > n_files

    # vectors; the adapter maps the one for files and configurations only
    uses = o.adapt and adapter is not None and adapter["base"] == encoder.fingerprint and adapter["dim"] == encoder.dim
    asked = asked.withColumn("q", E.vector_of(encoder)(E.query_text(encoder, F.col("query"), F.col("context"))))
    if uses:
        asked = asked.withColumn("q", adapted(np.asarray(adapter["weights"], dtype=np.float32).reshape(encoder.dim, encoder.dim))("q"))
    # written: each query is encoded once, however many parts of the answer look at its vector
    asked = written(asked.withColumn("query_kind", text.query_kind(F.col("query"), F.col("context"))), "asked")

    # what the prior holds back and what it doesn't are ranked apart, so the best of either are at hand
    files = index.where("kind = 'file'")
    held_back = path_prior(F.col("path"), F.lit("x")) < 0
    most = max(SEARCHED, o.k, 2)
    pool = R.nearest_rows(asked, files.where(held_back), most, key="path").unionByName(R.nearest_rows(asked, files.where(~held_back), most, key="path")).drop("rank")
    pool = written(pool, "ask-pool")  # a hundred rows a query; the index is read once
    raw = R.top(pool, most)
    exact = None
    if texts is not None and o.start_min_files is None:
        exact = written(exact_evidence(asked, files, raw, texts), "ask-exact")
        far = exact.join(files.select("path", "v"), "path").join(asked.select("q_id", "q"), "q_id").select("q_id", "path", dot("q", "v").alias("similarity"))
        pool = pool.unionByName(far.join(pool.select("q_id", "path"), ["q_id", "path"], "left_anti"))

    # whether to answer
    decided = asked.select("q_id", "query", "query_kind").join(R.margins(raw), "q_id", "left")
    t, m = F.col("top_similarity"), F.col("margin")
    if o.start_min_files is not None and n_files < o.start_min_files:
        reason = F.lit(f"start: {n_files} files < {o.start_min_files}; start hints help in large repositories")
    elif o.no_abstain:
        reason = F.lit(None).cast("string")
    else:
        no_match = F.when(t < R.SHOWN_FLOOR, NO_MATCH)
        reason = no_match
        if encoder.model is not None:
            reason = F.lit(None).cast("string")
            for kind in KINDS:
                th = R.thresholds(encoder.model, kind, uses, o.strict)
                said = F.lit(None).cast("string")
                if th is not None and th.min_top >= 0:
                    low = F.when(t < th.min_top, F.format_string(f"{kind}: top similarity %.2f < {th.min_top:.2f}", t))
                    said = F.coalesce(low.when(m < th.min_margin, F.format_string(f"{kind}: margin %.3f < {th.min_margin:.3f}", m)), no_match)
                reason = F.when(F.col("query_kind") == kind, said).otherwise(reason)
    decided = decided.withColumn("reason", reason)
    wants = F.exists(F.array(*map(F.lit, CONFIG_WORDS)), lambda w: F.contains(F.lower("query"), w))
    decided = decided.select("q_id", "query", "reason", wants.alias("wants_config"))

    # the files in their final order
    ranked = pool.join(decided.select("q_id", "query", "reason"), "q_id")
    ranked = ranked.join(exact.withColumn("exact", F.lit(True)), ["q_id", "path"], "left") if exact is not None else ranked.withColumn("exact", F.lit(None).cast("boolean"))
    ranked = ranked.withColumn("exact", F.coalesce("exact", F.lit(False)))
    ranked = R.top(R.reranked(ranked, F.lit(mostly), F.col("exact")), o.k, score="order_by")
    ranked = R.above_floor(ranked.where(F.col("reason").isNull() | F.col("exact")))
    blank_name, blank_line = F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("line")
    parts = [ranked.select("q_id", F.lit("file").alias("kind"), "rank", "path", blank_name, blank_line, "similarity", "exact")]
    shown = F.col("similarity") >= R.SHOWN_FLOOR
    if "config" in have:
        best = R.nearest_rows(asked, index.where("kind = 'config'"), 1, key="path").where(shown)
        parts.append(best.select("q_id", F.lit("config").alias("kind"), "rank", "path", blank_name, blank_line, "similarity", F.lit(False).alias("exact")))
    if o.functions and "function" in have:
        own = asked.withColumn("q", E.vector_of(encoder)(E.query_text(encoder, F.col("query"), F.col("context"), text.FOR_FUNCTIONS)))
        named = index.where("kind = 'function'").withColumn("at", F.to_json(F.struct("path", F.lpad(F.col("line").cast("string"), 9, "0").alias("line"), "name")))
        best = R.nearest_rows(own, named, o.k, key="at").where(shown)
        back = F.from_json("at", "path string, line string, name string")
        parts.append(best.withColumn("x", back).select("q_id", F.lit("function").alias("kind"), "rank", "x.path", "x.name", F.col("x.line").cast("int").alias("line"), "similarity", F.lit(False).alias("exact")))
    hints = parts[0]
    for p in parts[1:]:
        hints = hints.unionByName(p)
    cell = F.struct("kind", "rank", "path", "name", "line", F.round("similarity", 4).alias("similarity"), "exact")
    grouped = hints.groupBy("q_id").agg(F.sort_array(F.collect_list(cell)).alias("hints"))  # a few hints a query
    revision = adapter["revision"] if uses else None

    def finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for q_id, reason, wants_config, found in zip(f.q_id, f.reason, f.wants_config, f.hints):
                found = [dict(h) for h in ([] if found is None else found)]
                of = lambda kind: [h for h in found if h["kind"] == kind]
                is_exact = any(h["exact"] for h in of("file"))
                if reason is not None and not is_exact:
                    rows.append((q_id, "abstain", reason, fallback, uses, revision, [], R.rendered("abstain", reason=reason)))
                    continue
                kept = R.budget_ask(of("file"), [] if is_exact else of("function"), [] if is_exact else of("config"), o.k, o.functions, bool(wants_config))
                flat = [{n: h[n] for n in ("kind", "path", "name", "line", "similarity", "exact")} for part in kept for h in part]
                rows.append((q_id, "ok", None, fallback, uses, revision, flat, R.rendered("ok", flat, uses)))
            yield pd.DataFrame(rows, columns=["q_id", "state", "reason", "fallback", "adapter", "revision", "hints", "answer"])

    answered = decided.join(grouped, "q_id", "left").select("q_id", "reason", "wants_config", "hints").mapInPandas(finish, ANSWER)
    return empty.unionByName(answered)
