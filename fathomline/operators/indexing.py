"""Incremental refresh of an index, its versions on disk, and coverage counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import Versions, written

#: Files encoded between two checkpoints of a build.
CHECKPOINT = 1024


def refresh_plan(index: DataFrame, files: DataFrame) -> DataFrame:
    """path and action of every path on either side: keep (same version), replace, add, remove."""
    i, f = index.select("path", F.col("cid").alias("old")), files.select("path", F.col("cid").alias("new"))
    action = F.when(F.col("old").isNull(), "add").when(F.col("new").isNull(), "remove").when(F.col("old") == F.col("new"), "keep").otherwise("replace")
    return i.join(f, "path", "full_outer").select("path", action.alias("action"))


def refreshed(index: DataFrame, files: DataFrame, encode) -> DataFrame:
    """The index for these files: kept rows as they are, new versions through ``encode`` (files to rows)."""
    same = index.join(files.select("path", "cid"), ["path", "cid"], "left_semi")
    fresh = files.join(index.select("path", "cid"), ["path", "cid"], "left_anti")
    return same.unionByName(encode(fresh))


def changed(before: DataFrame, after: DataFrame) -> bool:
    """Whether two versions of (path, cid) differ."""
    return not (before.exceptAll(after).isEmpty() and after.exceptAll(before).isEmpty())


class IndexStore:
    """Versions of an index under a folder, by model fingerprint; the newest whole one serves.  What a
    first build has finished so far is kept apart and never serves."""

    def __init__(self, spark: SparkSession, root: str, fingerprint: str):
        self.whole = Versions(spark, f"{root.rstrip('/')}/{fingerprint}/whole")
        self.part = Versions(spark, f"{root.rstrip('/')}/{fingerprint}/part")

    def save(self, index: DataFrame, complete: bool = True) -> int:
        number = (self.whole if complete else self.part).write(index)
        if complete:
            for old in self.part.numbers():
                self.part.drop(old)
        return number

    def open(self) -> DataFrame | None:
        return self.whole.read()

    def refresh(self, files: DataFrame, encode, chunk: int = CHECKPOINT) -> DataFrame:
        """The index for these files (path, cid, ...), saved: rows whose path and cid it holds stay, others go
        through ``encode`` (files to rows) about ``chunk`` at a time.  A build that was broken off goes on
        from the chunks that it had finished."""
        spark = files.sparkSession
        held = self.open()
        rows = [] if held is None else [held.join(files.select("path", "cid"), ["path", "cid"], "left_semi")]
        done = [self.part.read(n) for n in self.part.numbers()]
        rows += [d.join(files.select("path", "cid"), ["path", "cid"], "left_semi") for d in done]
        todo = files
        for r in rows:
            todo = todo.join(r.select("path", "cid"), ["path", "cid"], "left_anti")
        todo = written(todo, "index-todo")
        parts = -(-todo.count() // chunk)
        for i in range(parts):
            number = self.part.write(encode(todo.where(F.pmod(F.xxhash64("path", "cid"), F.lit(parts)) == i)))
            rows.append(self.part.read(number))
        if not rows:
            rows = [encode(todo)]
        out = rows[0]
        for r in rows[1:]:
            out = out.unionByName(r)
        self.save(written(out, "index"))
        return self.open()


def top_extensions(paths: DataFrame, most: int = 8) -> DataFrame:
    """The commonest extensions: extension and n, by count, then name."""
    from ..functions.paths import extension

    counted = paths.select(extension(F.col("path")).alias("extension")).where("extension <> ''").groupBy("extension").agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), "extension").limit(most)
