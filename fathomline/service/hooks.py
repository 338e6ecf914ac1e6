"""Moments at which an agent's host may show hints: a prompt, or a search that found nothing or too much.

A moment is JSON: session, cwd, and prompt, or command or pattern with the number of results (and prompt).
The answer is text to show, or nothing.  It comes within a time budget or not at all, and a path is shown
once a session."""

from __future__ import annotations

import json
import os
import subprocess

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.commands import search_pattern
from ..functions.text import search_intent
from ..operators.asking import Options
from ..sources import files, git, workspace
from ..streaming.rescan import within
from .engine import Engine

#: Time budget, results that are a lot, hints shown at once, longest path, a session's memory, and the gate.
BUDGET_S, MANY, MOST_SHOWN, MOST_PATH, TTL_S, MIN_FILES = 1.5, 30, 3, 200, 86_400, 3000
MOMENTS = ("start", "prompt", "search")


def shown_before(engine: Engine, session: str) -> set[str]:
    """Paths that a session was shown: its memory lasts a day from the last time something was shown."""
    now = int(engine.clock())
    runs = engine.hook_log().read().where((F.col("session") == session) & (F.size("injected") > 0))
    back = Window.partitionBy("session").orderBy(F.desc("ts"))  # the injections of one session
    gap = F.coalesce(F.lag("ts").over(back), F.lit(now)) - F.col("ts")
    kept = runs.withColumn("gap", gap).withColumn("widest", F.max("gap").over(back)).where(F.col("widest") <= TTL_S)
    return {r.path for r in kept.select(F.explode("injected").alias("path")).distinct().collect()}


def question(engine: Engine, moment: str, event: dict) -> tuple[str, str] | None:
    """(query, context) of a moment, or None where it asks nothing."""
    if moment == "prompt":
        prompt = event.get("prompt")
        return (prompt, "") if isinstance(prompt, str) and prompt.strip() else None
    found = event.get("results")
    if not isinstance(found, int) or 0 < found <= MANY:
        return None
    pattern = event.get("pattern") or search_pattern(event.get("command") or "")
    if not pattern:
        return None
    words = engine.spark.createDataFrame([(pattern,)], "p string").select(search_intent(F.col("p")).alias("w")).first().w
    return (words, event.get("prompt") or "") if words else None


def repository_of(cwd: str) -> str | None:
    try:
        return git.git(cwd, "rev-parse", "--show-toplevel").strip()
    except (subprocess.CalledProcessError, OSError):
        return None


def run(engine: Engine, agent: str, moment: str, payload: str, budget_s: float = BUDGET_S, min_files: int = MIN_FILES) -> str:
    """The text to show for a moment; empty where there is nothing to say or no time to say it.  Runs that
    got as far as asking are logged."""
    try:
        event = json.loads(payload)
        cwd, session = os.path.realpath(event["cwd"]), str(event["session"])
    except (ValueError, KeyError, TypeError):
        return ""
    if moment not in MOMENTS or not os.path.isdir(cwd):
        return ""
    root = repository_of(cwd)
    if root:
        roots = [root] if root in workspace.cached(engine.home) else []
    else:
        roots = [r for r, _ in workspace.indexed(engine.home, cwd, fingerprint=engine.encoder.fingerprint)]
    if not roots or sum(map(engine.source_files, roots)) < min_files:
        return ""
    if moment == "start":
        engine.index(roots[0]).count()  # the tables' files are at hand from here on
        return ""
    asked = question(engine, moment, event)
    if asked is None:
        return ""
    past: dict = {}

    def answer() -> list[str]:
        got = engine.ask_one(root, *asked, Options(k=MOST_SHOWN), log=False) if root else engine.ask_below(cwd, *asked, Options(k=MOST_SHOWN), log=False)
        before = shown_before(engine, session)
        paths = [h["path"] for h in got["hints"] if len(h["path"]) <= MOST_PATH and h["path"] not in before] if got["state"] == "ok" else []
        return list(dict.fromkeys(paths))[:MOST_SHOWN]

    shown = within(budget_s, answer, lambda outcome, ms: past.update(outcome=outcome, ms=int(ms)))
    row = (int(engine.clock()), agent, moment, root or cwd, session, past["ms"], past["outcome"], shown)
    engine.hook_log().append(engine.spark.createDataFrame([row], files.HOOKS))
    return "\n".join(["Files that may be worth opening next:", *(f"- {p}" for p in shown)]) if shown else ""
