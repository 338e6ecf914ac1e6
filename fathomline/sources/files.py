"""Folders outside git, logs as JSON lines, transcripts and task lists, all with fixed schemas."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import is_skipped, kind
from ..operators.usage import kept

USAGE = "ts long, kind string, state string, ms long, model string, adapter boolean, files long, hinted array<string>"
HOOKS = "ts long, agent string, moment string, root string, session string, ms long, outcome string, injected array<string>"
TASKS = "instance_id string, repo_dir string, base_commit string, problem_statement string, gold_files array<string>"
#: Bytes read of a source and of a configuration file.
SOURCE_BYTES, CONFIG_BYTES = 400_000, 200_000


def walk(spark: SparkSession, root: str) -> DataFrame:
    """path, cid and kind of the indexable files below a folder of any storage; versions are time and size.
    Spark's listing leaves out empty files (``git.plain_files`` gives them on a local disk)."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "modificationTime", "length")
    relative = F.regexp_replace("path", "^.*?" + root.rstrip("/").replace("file://", "") + "/", "")
    named = found.select(relative.alias("path"), F.concat(F.lit("m"), F.unix_micros("modificationTime"), F.lit("-"), "length").alias("cid"))
    return named.where(~is_skipped(F.col("path"))).withColumn("kind", kind(F.col("path"))).where("kind is not null")


def texts(spark: SparkSession, root: str, most: int = SOURCE_BYTES) -> DataFrame:
    """path and text of the files below a folder: bytes are cut first, then decoded, what is no UTF-8 replaced."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return found.select("path", F.decode(F.substring("content", 1, most), F.lit("UTF-8")).alias("text"))


def working_texts(wanted: DataFrame) -> DataFrame:
    """repo, path, cid, kind and text of files of working trees (repo, path, cid, kind), cut at the bytes of their kind;
    those that can't be read are left out.  A file at a time is held beside 200 finished rows."""
    columns = ["repo", "path", "cid", "kind", "text"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            held: list[tuple] = []
            for repo, path, cid, kind in zip(f.repo, f.path, f.cid, f.kind):
                try:
                    with open(os.path.join(repo, path), "rb") as file:
                        body = file.read(SOURCE_BYTES if kind == "source" else CONFIG_BYTES)
                except OSError:
                    continue
                held.append((repo, path, cid, kind, body.decode("utf-8", "replace")))
                if len(held) == 200:
                    yield pd.DataFrame(held, columns=columns)
                    held = []
            yield pd.DataFrame(held, columns=columns)

    return wanted.select("repo", "path", "cid", "kind").mapInPandas(run, "repo string, path string, cid string, kind string, text string")


def usage_log(spark: SparkSession, paths: str | list[str], now: int | None = None) -> DataFrame:
    """Answers logged as JSON lines, with the file as ``source``; broken lines are left out, old ones too if now is given."""
    df = spark.read.schema(USAGE).option("mode", "DROPMALFORMED").json(paths).withColumn("source", F.input_file_name())
    return df if now is None else kept(df, "ts", now)


def hook_log(spark: SparkSession, paths: str | list[str], since: int = 0) -> DataFrame:
    return spark.read.schema(HOOKS).option("mode", "DROPMALFORMED").json(paths).where(F.col("ts") >= since)


def tasks(spark: SparkSession, path: str) -> DataFrame:
    """A task list as JSON lines; a broken line is an error."""
    return spark.read.schema(TASKS).option("mode", "FAILFAST").json(path)


def prepared_tasks(rows: DataFrame) -> DataFrame:
    """A task list from its published columns: instance_id, repo (owner/name), base_commit,
    problem_statement and gold_context, JSON of an array of objects that each name a file."""
    gold = F.array_distinct(F.transform(F.from_json("gold_context", "array<struct<file:string>>"), lambda x: x["file"]))
    return rows.select("instance_id", F.replace("repo", F.lit("/"), F.lit("__")).alias("repo_dir"), "base_commit", "problem_statement", gold.alias("gold_files"))


def transcripts(root: str, depth: int, since: float = 0.0) -> list[str]:
    """The transcripts (.jsonl) below a folder, at most ``depth`` folders down and changed since a time, the
    largest first, so that none that takes long starts last."""
    found, todo = [], [(root, 0)]
    while todo:
        at, level = todo.pop()
        try:
            entries = list(os.scandir(at))
        except OSError:
            continue
        for e in entries:
            if e.is_dir():
                if level < depth:
                    todo.append((e.path, level + 1))
            elif e.name.endswith(".jsonl") and e.stat().st_mtime >= since:
                found.append((-e.stat().st_size, e.path))
    return [path for _, path in sorted(found)]


def transcript_lines(spark: SparkSession, paths: str | list[str], since: str | None = None) -> DataFrame:
    """session (the file), place (in the file) and line of transcripts; ``since`` leaves older files out
    before they are read.  Files of a task are not split, so places are in order."""
    reader = spark.read.format("text").option("wholetext", True)
    if since:
        reader = reader.option("modifiedAfter", since)
    whole = reader.load(paths).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.jsonl$", 1).alias("session"), F.split("value", "\r?\n").alias("lines"))
    return whole.select("session", F.posexplode("lines").alias("place", "line")).where("line <> ''")


CALL = r"(?:^|[;&|\s/])ask(?:\s|$)"


def transcript_items(lines: DataFrame, marker: str) -> DataFrame:
    """session, ts, event, reads, edits, shell of the lines that matter to the walk.

    Substring gates come before any parsing.  Lines hold a type and a message with text or an array of
    parts; parts of type tool_use name a tool and its input."""
    gated = lines.where(F.contains("line", F.lit('"type"')))
    v = gated.select("session", "line", F.try_parse_json("line").alias("v")).where("v is not null")
    get = lambda p, t="string": F.try_variant_get("v", p, t)
    base = v.select(
        "session", F.unix_timestamp(F.try_to_timestamp(get("$.timestamp"))).alias("ts"), get("$.type").alias("type"), get("$.isMeta", "boolean").alias("meta"),
        get("$.message.content").alias("plain"), get("$.message.content", "array<variant>").alias("parts"),
    )
    part = base.select("*", F.explode_outer("parts").alias("p"))
    pg = lambda p: F.try_variant_get("p", p, "string")
    command, path, tool = pg("$.input.command"), F.coalesce(pg("$.input.file_path"), pg("$.input.path")), pg("$.name")
    is_tool = pg("$.type") == "tool_use"
    called = is_tool & (F.contains(F.coalesce(command, F.lit("")), F.lit(marker)) | F.contains(F.coalesce(tool, F.lit("")), F.lit(marker)))
    spoke = (F.col("type") == "user") & ~F.coalesce("meta", F.lit(False)) & F.coalesce(pg("$.type") != "tool_result", F.lit(True))
    event = F.when(called, "call").when(is_tool, "tool").when(spoke, "user_turn")
    none = F.array().cast("array<string>")
    return part.select(
        "session", "ts", event.alias("event"),
        F.when(tool.isin("Read", "Grep") & path.isNotNull(), F.array(path)).otherwise(none).alias("reads"),
        F.when(tool.isin("Edit", "Write") & path.isNotNull(), F.array(path)).otherwise(none).alias("edits"),
        F.when(command.isNotNull(), F.array(command)).otherwise(none).alias("shell"),
    ).where("event is not null")


#: What patches and script cells look like in a transcript of the second kind.
PATCHED = r'\*\*\* (?:Update File|Add File|Delete File|Move to): ([^\n\\"]+)'
SCRIPTED = r'cmd"?\s*:\s*"((?:[^"\\]|\\.)*)"'
CALLS = ("custom_tool_call", "function_call", "local_shell_call")


def patch_paths(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PATCHED), F.lit(1)), F.btrim)


def unescaped(text: Column) -> Column:
    """A quoted script's text: \\n and \\t are white space, any other escaped character is itself."""
    marked = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\\\\", "\u0001"), r"\\n", "\n"), r"\\t", "\t")
    return F.replace(F.regexp_replace(marked, r"\\(.)", "$1"), F.lit("\u0001"), F.lit("\\"))


def argv_command(argv: Column) -> Column:
    """The script after -lc or -c of an argument list, else the list joined."""
    at = F.array_position(F.transform(argv, lambda x: x.isin("-lc", "-c")), True)
    return F.when((at > 0) & (at < F.size(argv)), F.try_element_at(argv, (at + 1).cast("int"))).otherwise(F.array_join(argv, " "))


def transcript_items_2(lines: DataFrame, marker: str, tool: str, hook: str) -> DataFrame:
    """session, place, ts, event, reads, edits, shell of transcripts whose lines hold a payload: a call of a
    tool with an argument list, a script cell or a patch, or a message.

    ``marker`` is a pattern of our shell command, ``tool`` part of our tool's name, ``hook`` what our hook
    says.  Substring gates come before any parsing."""
    has = lambda s: F.contains("line", F.lit(s))
    call = has('"response_item"') & (has('"custom_tool_call"') | has('"function_call"') | has('"local_shell_call"'))
    gated = lines.where(call | has('"role":"user"') | (has(hook) & has('"message"')))
    v = gated.withColumn("v", F.try_parse_json("line")).where("v is not null")
    get = lambda c, p, t="string": F.try_variant_get(c, p, t)
    v = v.withColumn("args", F.try_parse_json(get("v", "$.payload.arguments"))).withColumn("named", F.lower(F.coalesce(get("v", "$.payload.name"), F.lit(""))))
    none = F.array().cast("array<string>")
    source = get("v", "$.payload.input")
    cells = F.transform(F.regexp_extract_all(F.coalesce(source, F.lit("")), F.lit(SCRIPTED), F.lit(1)), unescaped)
    shell, edits = [F.when((F.col("named") != "apply_patch") & source.isNotNull(), cells).otherwise(none)], [patch_paths(source)]
    for c, at in (("args", "$"), ("v", "$.payload.action")):
        argv, plain, cmd = get(c, f"{at}.command", "array<string>"), get(c, f"{at}.command"), get(c, f"{at}.cmd")
        shell += [F.when(argv.isNotNull(), F.array(argv_command(argv))).when(plain.isNotNull(), F.array(plain)).otherwise(none), F.when(cmd.isNotNull(), F.array(cmd)).otherwise(none)]
        edits.append(patch_paths(F.coalesce(get(c, f"{at}.input"), get(c, f"{at}.patch"))))
    kind, role = get("v", "$.payload.type"), get("v", "$.payload.role")
    rows = v.select("session", "place", "line", F.unix_timestamp(F.try_to_timestamp(get("v", "$.timestamp"))).alias("ts"), "named", kind.alias("kind"), role.alias("role"), F.concat(*shell).alias("shell"), F.concat(*edits).alias("edits"))
    ours = F.contains("named", F.lit(tool)) | F.exists("shell", lambda c: c.rlike(marker))
    event = (
        F.when(F.col("kind").isin(*CALLS) & ours, "call").when(F.col("kind").isin(*CALLS), "tool")
        .when((F.col("kind") == "message") & has(hook) & F.col("role").isin("developer", "user"), "hook")
        .when((F.col("kind") == "message") & (F.col("role") == "user"), "user_turn")
    )
    return rows.select("session", "place", "ts", event.alias("event"), none.alias("reads"), "edits", "shell").where("event is not null")


def latest_prompt(turns: DataFrame) -> DataFrame:
    """session and its last user text; turns: session, n, role, text."""
    return turns.where("role = 'user'").groupBy("session").agg(F.max_by("text", "n").alias("prompt"))
