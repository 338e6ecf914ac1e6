"""A repository's life in one object: index, adapter, answers, replay and their logs, kept under a home folder.

The home holds a folder a repository (sources.workspace) with versions of its index and adapter, its
usage as a daily log and the latest figures of each kind; the log of hooks is one for all.  The home and the
repositories must be readable by the executors too.
"""

from __future__ import annotations

import json
import os
import subprocess
import time
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.code import file_doc_udf, function_docs_udf
from ..functions.paths import kind
from ..operators import adapter as A
from ..operators import asking, history, indexing
from ..operators import encoders as E
from ..operators import ranking as R
from ..operators import replay as P
from ..sources import files, git, workspace
from ..sources.store import DailyLog, written

#: Fixed value: repositories of a folder that are indexed without being confirmed.
CONFIRM_ABOVE = 10
ROW = "kind string, path string, cid string, name string, line int, v array<float>"
#: What a file without functions leaves in their table, so that it isn't read again.
SEEN = "seen"


def latest_values(folder: str, name: str) -> dict | None:
    """The latest figures of a kind, or None where none were written or the file is broken."""
    try:
        with open(os.path.join(folder, f"{name}.json"), encoding="utf-8") as f:
            held = json.load(f)
    except (OSError, ValueError):
        return None
    return held if isinstance(held, dict) else None


def write_values(folder: str, name: str, values: dict) -> None:
    """Puts figures in place of the earlier ones, whole or not at all."""
    at = os.path.join(folder, f"{name}.json")
    with open(at + ".tmp", "w", encoding="utf-8") as f:
        json.dump(values, f)
    os.replace(at + ".tmp", at)


def new_commits(root: str, since: str | None) -> int | None:
    """Commits after one; None where it is unknown."""
    if not since:
        return None
    try:
        return int(git.git(root, "rev-list", "--count", f"{since}..HEAD"))
    except (subprocess.CalledProcessError, ValueError):
        return None


@dataclass
class Engine:
    spark: SparkSession
    home: str
    encoder: E.Encoder = field(default_factory=E.HashEncoder)
    params: A.Params = field(default_factory=A.Params)
    clock: object = time.time

    def __post_init__(self):
        self.home = os.path.abspath(self.home)
        self.spark.dataSource.register(git.GitSource)

    # what is kept of a repository

    def folder(self, root: str) -> str:
        return workspace.folder_of(self.home, root)

    def _index(self, root: str, name: str = "index") -> indexing.IndexStore:
        return indexing.IndexStore(self.spark, f"{self.folder(root)}/{name}", self.encoder.fingerprint)

    def adapters(self, root: str) -> A.AdapterStore:
        return A.AdapterStore(self.spark, f"{self.folder(root)}/adapter/{self.encoder.fingerprint}")

    def usage(self, root: str) -> DailyLog:
        return DailyLog(self.spark, f"{self.folder(root)}/usage", files.USAGE)

    def hook_log(self) -> DailyLog:
        return DailyLog(self.spark, f"{self.home}/hooks", files.HOOKS)

    def git_table(self, root: str, table: str, **options) -> DataFrame:
        read = self.spark.read.format("git").option("repositories", root).option("table", table)
        for k, v in options.items():
            read = read.option(k, str(v))
        return read.load()

    def files_of(self, root: str) -> DataFrame:
        """repo, path, cid, kind of what is to be indexed: a git working tree, or any other folder."""
        found = self.git_table(root, "files").withColumn("kind", kind(F.col("path"))).where("kind is not null")
        return found.select(F.lit(root).alias("repo"), "path", "cid", "kind")

    # index

    def _rows(self, fresh: DataFrame) -> DataFrame:
        """Index rows of files and configurations; files that can't be read leave none."""
        read = files.working_texts(fresh)
        doc = F.when(F.col("kind") == "source", file_doc_udf("path", "text")).otherwise(text.config_doc(F.col("path"), F.col("text")))
        name = F.when(F.col("kind") == "source", "file").otherwise("config")
        docs = read.select(name.alias("kind"), "path", "cid", F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("line"), E.document_text(self.encoder, doc).alias("doc"))
        return E.with_vectors(docs, "doc", self.encoder).select("kind", "path", "cid", "name", "line", "v")

    def _function_rows(self, fresh: DataFrame) -> DataFrame:
        """Rows of the functions of source files, and a mark for those without any."""
        read = files.working_texts(fresh).select("path", "cid", F.explode_outer(function_docs_udf("path", "text")).alias("f"))
        found = read.where("f is not null").select(F.lit("function").alias("kind"), "path", "cid", "f.name", "f.line", E.document_text(self.encoder, F.col("f.text")).alias("doc"))
        rows = E.with_vectors(found, "doc", self.encoder).select("kind", "path", "cid", "name", "line", "v")
        none = read.where("f is null").select(F.lit(SEEN).alias("kind"), "path", "cid", F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("array<float>").alias("v"))
        return rows.unionByName(none)

    def refresh(self, root: str, functions: bool = False) -> dict:
        """Brings the index up to the files: what is new or changed is read, what is gone goes.  The counts of
        each action and the time taken."""
        began = time.monotonic()
        root = os.path.abspath(root)
        folder = workspace.record(self.home, root)
        have = written(self.files_of(root), "files")
        store = self._index(root)
        held = store.open()
        before = held.select("path", "cid") if held is not None else self.spark.createDataFrame([], "path string, cid string")
        counts = {r.action: r.n for r in indexing.refresh_plan(before, have).groupBy("action").agg(F.count(F.lit(1)).alias("n")).collect()}  # four actions
        changed = any(counts.get(a) for a in ("add", "replace", "remove"))
        if held is None or changed:
            store.refresh(have, self._rows)
        if functions:
            own, sources = self._index(root, "functions"), have.where("kind = 'source'")
            listed = own.open()
            if listed is None or indexing.changed(listed.select("path", "cid").distinct(), sources.select("path", "cid")):
                own.refresh(sources, self._function_rows)
        took = int((time.monotonic() - began) * 1000)
        done = {"status": "ok", **{a: counts.get(a, 0) for a in ("keep", "add", "replace", "remove")}, "ms": took}
        if held is None or changed:
            write_values(folder, "index", {"ts": int(self.clock()), "ms": took, "files": done["keep"] + done["add"] + done["replace"]})
        return done

    def index(self, root: str, functions: bool = False) -> DataFrame:
        """The index that serves; without rows where none was built yet."""
        held = self._index(root).open()
        rows = held if held is not None else self.spark.createDataFrame([], ROW)
        listed = self._index(root, "functions").open() if functions else None
        return rows if listed is None else rows.unionByName(listed.where("kind = 'function'"))

    def status(self, root: str) -> dict:
        """State of index and adapter, counts by kind and the commonest extensions that are not indexed."""
        root = os.path.abspath(root)
        held = self._index(root).open()
        counts = {} if held is None else {r.kind: r.n for r in held.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a kind
        adapter = self.adapters(root).load()
        other = self.git_table(root, "files").where(kind(F.col("path")).isNull())
        left_out = {r.extension: r.n for r in indexing.top_extensions(other).collect()}  # eight at most
        listed = self._index(root, "functions").open()
        return {
            "root": root, "model": self.encoder.fingerprint, "index": "missing" if held is None else "ready", "files": counts.get("file", 0), "configs": counts.get("config", 0),
            "functions": 0 if listed is None else listed.where("kind = 'function'").count(), "not_indexed": left_out,
            "adapter": None if adapter is None else {k: adapter[k] for k in ("revision", "examples", "cutoff")},
        }

    # adapter

    def train(self, root: str, force: bool = True) -> dict:
        """Fits the adapter on the newest commits that change an indexed file.  Unless forced only where one is
        due; too few examples leave the one there is."""
        root = os.path.abspath(root)
        if not os.path.exists(os.path.join(root, ".git")):
            return {"status": "skipped", "reason": "no history"}
        store = self.adapters(root)
        held = store.load()
        if not force and not A.needs_fit("active" if held else "none", held is not None, new_commits(root, held["cutoff"]) if held else None):
            return {"status": "kept", "revision": held["revision"]}
        indexed = self.index(root).where("kind = 'file'")
        commits = written(self.git_table(root, "commits", limit=3 * A.COMMITS), "train-commits")
        changes = commits.select("sha", F.posexplode("paths").alias("pos", "path"))
        first = history.first_positive(changes, indexed)
        asked = commits.join(first, "sha").select("n", "positive", text.history_body(F.col("subject"), F.col("body")).alias("query"))
        asked = asked.orderBy("n").limit(A.COMMITS)  # the newest; a fixed number
        examples = asked.select(F.lit(root).alias("repo"), "n", F.col("positive").alias("pos"), E.vector_of(self.encoder)(E.query_text(self.encoder, F.col("query"), F.lit(""))).alias("q"))
        documents = indexed.select(F.lit(root).alias("repo"), F.col("path").alias("doc"), "v")
        fitted = A.fit_per_repository(examples, documents, self.params).first()
        if fitted is None:
            return {"status": "skipped", "reason": f"fewer than {A.LEAST} commits that change an indexed file"}
        weights = np.array(fitted.weights, dtype=np.float32).reshape(self.encoder.dim, self.encoder.dim)
        cutoff = git.git(root, "rev-parse", "HEAD").strip()
        return {"status": "fitted", "revision": store.save(weights, self.encoder.fingerprint, fitted.examples, cutoff), "examples": fitted.examples}

    def rollback(self, root: str) -> dict:
        """The adapter before the last one serves again; the only one goes, and an error where there is none."""
        store = self.adapters(os.path.abspath(root))
        numbers = store.held.numbers()
        if not numbers:
            raise ValueError("no adapter to go back from")
        if len(numbers) == 1:
            store.held.drop(numbers[0])
            return {"status": "removed"}
        return {"status": "restored", "revision": store.rollback()["revision"]}

    def init(self, root: str) -> dict:
        return {"index": self.refresh(root), "adapter": self.train(root, force=False)}

    # answers

    def ask(self, root: str, queries: DataFrame, options: asking.Options = asking.Options(), log: bool = True) -> DataFrame:
        """The answers of ``asking.ask`` to q_id, query, context, as a table; each is logged without its text."""
        began = time.monotonic()
        root = os.path.abspath(root)
        index = self.index(root, options.functions)

        def texts(paths: DataFrame) -> DataFrame:
            return files.working_texts(paths.select(F.lit(root).alias("repo"), "path", F.lit("").alias("cid"), F.lit("source").alias("kind")))

        answers = written(asking.ask(queries, index, self.encoder, texts, self.adapters(root).load(), options), "answers")
        if log:
            blank = F.lit("")
            sort = queries.select("q_id", text.query_kind(F.coalesce("query", blank), F.coalesce("context", blank)).alias("kind"))
            took = int((time.monotonic() - began) * 1000)
            paths = F.transform("hints", lambda h: h["path"])
            self.usage(root).append(
                answers.join(sort, "q_id").select(
                    F.lit(int(self.clock())).cast("long").alias("ts"), "kind", "state", F.lit(took).cast("long").alias("ms"), F.lit(self.encoder.fingerprint).alias("model"), "adapter",
                    F.size("hints").cast("long").alias("files"), paths.alias("hinted"),
                )
            )
        return answers

    def ask_one(self, root: str, query: str, context: str = "", options: asking.Options = asking.Options(), log: bool = True) -> dict:
        row = self.ask(root, self.spark.createDataFrame([(0, query, context)], "q_id long, query string, context string"), options, log).first()
        return row.asDict(recursive=True)

    def ask_below(self, top: str, query: str, context: str = "", options: asking.Options = asking.Options(), log: bool = True) -> dict:
        """One answer over all repositories at or below a folder that have an index for this encoder."""
        roots = [r for r, _ in workspace.indexed(self.home, top, fingerprint=self.encoder.fingerprint)]
        if not roots:
            return {"state": "empty_index", "reason": "no repository is indexed below this folder", "hints": [], "answer": R.rendered("empty_index")}
        asked = self.spark.createDataFrame([(0, query, context)], "q_id long, query string, context string")
        parts = None
        for root in roots:
            one = self.ask(root, asked, options, log).where("state = 'ok'").select(F.lit(root).alias("repo"), F.posexplode("hints").alias("place", "h"))
            parts = one if parts is None else parts.unionByName(one)
        flat = parts.select("repo", (F.col("place") + 1).alias("rank"), "h.*")
        best = [r.asDict() for r in R.workspace_fused(flat, options.k).collect()]  # at most k rows
        hints = [{**{n: h[n] for n in ("kind", "name", "line", "similarity", "exact")}, "path": os.path.join(os.path.relpath(h["repo"], os.path.abspath(top)), h["path"])} for h in best]
        state = "ok" if hints else "abstain"
        reason = None if hints else "no repository has a confident hint"
        return {"state": state, "reason": reason, "hints": hints, "answer": R.rendered(state, hints, reason=reason or "")}

    def init_below(self, top: str, confirmed: bool = False) -> dict:
        """Indexes the repositories below a folder; many of them only if confirmed."""
        roots = git.discover(top)
        if len(roots) > CONFIRM_ABOVE and not confirmed:
            raise ValueError(f"{len(roots)} repositories below {top}: confirm to index more than {CONFIRM_ABOVE}")
        return {r: self.init(r) for r in roots}

    # replay

    def bench(self, root: str, options: P.Options = P.Options()) -> P.Replay:
        """The replay of a repository's history; its headline figures are kept for the report."""
        root = os.path.abspath(root)
        commits = self.git_table(root, "commits", limit=3 * (options.commits + (options.train if options.adapter else 0)))
        held = P.replay(commits, git.trees_of, git.texts_of, self.git_table(root, "graph"), self.encoder, options)
        hits = {r.method: [r.hit1, r.hit3, r.hit10] for r in held.scores.collect()}  # a row a method
        own = {r.method: [r.hit1, r.hit3, r.hit10] for r in held.matched.collect()}
        counted = held.counts.first()
        if counted is not None and hits:
            model, lexical = P.METHODS["model"], P.METHODS["lexical"]
            figures = {"ts": int(self.clock()), "files": counted.files_median, "model": self.encoder.fingerprint, "lexical": hits[lexical], "model_hits": hits[model], "adapter_hits": own.get(P.METHODS["adapter"])}
            write_values(workspace.record(self.home, root), "bench", figures)
        return held

    def source_files(self, root: str) -> int:
        """Source files of the index: what the start gate of hooks looks at."""
        held = self._index(os.path.abspath(root)).open()
        return 0 if held is None else held.where("kind = 'file'").count()
