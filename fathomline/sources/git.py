"""Git repositories as DataFrames: a batch data source that asks the git binary, a partition per repository.

    spark.dataSource.register(GitSource)
    spark.read.format("git").option("repositories", "a,b").option("table", "files").load()

Tables: files (working tree, or any folder without git), commits (no merges, newest first), graph (all commits with their parents,
parents first), trees (blobs of the revisions).  ``trees_of`` and ``texts_of`` give the trees and blob
texts that a frame asks for.
"""

from __future__ import annotations

import os
import re
import subprocess
import threading
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.paths import NEVER_INDEXED, kind

SCHEMAS = {
    "files": "repo string, path string, cid string",
    "commits": "repo string, n long, sha string, date string, subject string, body string, parent string, paths array<string>",
    "graph": "repo string, n long, sha string, parents array<string>",
    "trees": "repo string, rev string, path string, blob string",
}
#: Bytes read of a blob.
MOST_BYTES = 400_000
RECORD, FIELD = "\x1e", "\x1f"
LINK_MODE = "120000"
NEVER = re.compile(NEVER_INDEXED)


def git(root: str, *args: str) -> str:
    done = subprocess.run(["git", "-C", root, *args], capture_output=True, check=True)
    return done.stdout.decode("utf-8", "replace")


def version(path: str) -> str:
    """A version of a file outside the index: its time in nanoseconds and its size."""
    s = os.stat(path)
    return f"m{s.st_mtime_ns}-{s.st_size}"


def files(root: str) -> Iterator[tuple[str, str]]:
    """(path, version) of tracked and untracked files that exist and are neither ignored nor links."""
    top = os.path.realpath(root)
    modified = set(filter(None, git(root, "ls-files", "-m", "-z").split("\0")))
    seen: dict[str, str] = {}
    for line in filter(None, git(root, "ls-files", "-s", "-z").split("\0")):
        head, _, path = line.partition("\t")
        mode, blob, _ = head.split(" ")
        if mode != LINK_MODE:
            seen[path] = "" if path in modified else blob
    for path in filter(None, git(root, "ls-files", "-o", "--exclude-standard", "-z").split("\0")):
        seen.setdefault(path, "")
    for path, blob in seen.items():
        full = os.path.join(root, path)
        if os.path.isfile(full) and not os.path.islink(full) and os.path.realpath(full).startswith(top + os.sep):
            yield path, blob or version(full)


def plain_files(root: str) -> Iterator[tuple[str, str]]:
    """(path, version) of the files below a folder without git: folders that are never indexed are not entered,
    links not followed."""
    for at, folders, names in os.walk(root):
        inside = os.path.relpath(at, root)
        prefix = "" if inside == "." else inside.replace(os.sep, "/") + "/"
        folders[:] = sorted(f for f in folders if not NEVER.search(f"{prefix}{f}/") and not os.path.islink(os.path.join(at, f)))
        for name in sorted(names):
            full = os.path.join(at, name)
            if os.path.isfile(full) and not os.path.islink(full):
                yield prefix + name, version(full)


def commits(root: str, limit: int, rev: str = "HEAD") -> Iterator[tuple]:
    """Newest first, merges left out: (n, sha, date, subject, body, first parent or null, paths)."""
    fields = "%x1f".join(("%x1e%H", "%aI", "%s", "%b", "%P", ""))
    text = git(root, "log", rev, "--no-merges", f"-n{limit}", f"--format={fields}", "--name-only", "-z")
    for n, part in enumerate(filter(None, text.split(RECORD))):
        sha, date, subject, body, parents, names = part.split(FIELD)
        paths = [p for p in names.strip("\n\0").replace("\n", "\0").split("\0") if p]
        yield n, sha, date, subject, body.strip("\n"), parents.split(" ")[0] or None, paths


def tree(root: str, rev: str) -> Iterator[tuple[str, str]]:
    for line in filter(None, git(root, "ls-tree", "-r", "-z", rev).split("\0")):
        head, _, path = line.partition("\t")
        mode, kind, blob = head.split(" ")
        if kind == "blob" and mode != LINK_MODE:
            yield path, blob


def graph(root: str, rev: str = "HEAD") -> Iterator[tuple[int, str, list[str]]]:
    """(n, sha, parents) of the revision and all its ancestors, parents before children."""
    for n, line in enumerate(git(root, "rev-list", "--topo-order", "--reverse", "--parents", rev).splitlines()):
        sha, *parents = line.split(" ")
        yield n, sha, parents


def blobs(root: str, names: list[str], most: int = MOST_BYTES) -> Iterator[tuple[str, str]]:
    """(blob, text) by one batch process, cut at ``most`` bytes; missing ones are left out.  The answers are
    read one by one, so that no more than a blob is held."""
    with subprocess.Popen(["git", "-C", root, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as run:

        def ask() -> None:
            with run.stdin as f:
                f.writelines(f"{name}\n".encode() for name in names)

        asking = threading.Thread(target=ask, daemon=True)
        asking.start()
        for name in names:
            head = run.stdout.readline().split()
            if head[-1:] == [b"missing"]:
                continue
            size = int(head[2])
            kept, left = run.stdout.read(min(size, most)), max(0, size - most) + 1
            while left:
                left -= len(run.stdout.read(min(left, 1 << 20)))
            yield name, kept.decode("utf-8", "replace")
        asking.join()


def trees_of(revisions: DataFrame) -> DataFrame:
    """repo, rev, path, blob of the source files of each different (repo, rev), a task's revisions at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for repo, rev in zip(f.repo, f.rev):
                yield pd.DataFrame([(repo, rev, *r) for r in sorted(tree(repo, rev))], columns=["repo", "rev", "path", "blob"])

    return revisions.select("repo", "rev").distinct().mapInPandas(run, SCHEMAS["trees"]).where(kind(F.col("path")) == "source")


def texts_of(wanted: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """repo, blob, text of each different (repo, blob) that can be read: a batch process a repository and batch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for repo, names in f.groupby("repo").blob:
                held: list[tuple] = []
                for name, text in blobs(repo, list(names), most):
                    held.append((repo, name, text))
                    if len(held) == 200:
                        yield pd.DataFrame(held, columns=["repo", "blob", "text"])
                        held = []
                yield pd.DataFrame(held, columns=["repo", "blob", "text"])

    return wanted.select("repo", "blob").distinct().mapInPandas(run, "repo string, blob string, text string")


class Repository(InputPartition):
    def __init__(self, root: str):
        self.root = root


class GitReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [Repository(r.strip()) for r in self.options["repositories"].split(",") if r.strip()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        root, table = partition.root, self.options.get("table", "files")
        rev = self.options.get("rev", "HEAD")
        if table == "files":
            rows = files(root) if os.path.exists(os.path.join(root, ".git")) else plain_files(root)
        elif table == "commits":
            rows = commits(root, int(self.options.get("limit", "600")), rev)
        elif table == "graph":
            rows = graph(root, rev)
        else:
            rows = ((r, *entry) for r in rev.split(",") for entry in tree(root, r))
        for r in rows:
            yield (root, *r)


class GitSource(DataSource):
    """Options: repositories (paths, comma-separated), table, rev (for trees several, comma-separated), limit."""

    @classmethod
    def name(cls) -> str:
        return "git"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "files")]

    def reader(self, schema) -> DataSourceReader:
        return GitReader(dict(self.options))


def discover(top: str, depth: int = 4) -> list[str]:
    """Repositories under a folder: hidden and vendored folders are skipped, none is looked for inside another."""
    found, todo = [], [(top, 0)]
    while todo:
        at, level = todo.pop()
        if os.path.exists(os.path.join(at, ".git")):
            found.append(at)
        elif level < depth:
            for name in sorted(os.listdir(at)):
                full = os.path.join(at, name)
                if os.path.isdir(full) and not os.path.islink(full) and not name.startswith(".") and name not in ("node_modules", "vendor", "third_party"):
                    todo.append((full, level + 1))
    return sorted(found)
