"""Streaming twins: the transcript walk and the per-session memory of what was already shown.

Both keep state per session, and both have a batch form with the same rules (operators.transcripts).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.transcripts import Walk

#: Seconds that a session's memory lasts since its last change, and hints shown at once.
MEMORY_S, SHOWN = 86_400, 3


def walk_stream(items: DataFrame) -> DataFrame:
    """session, opened, calls of observations as they end; items: session, n, event.

    Inside a trigger a session's rows are taken by n; an ``eof`` event ends the walk and drops its state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        name, opened, calls = state.get if state.exists else ("seeking", -1, 0)
        walk = Walk(name, None if opened < 0 else opened, calls)
        rows: list[tuple] = []
        for n, e in sorted((int(n), e) for b in batches for n, e in zip(b["n"], b["event"])):
            if walk.state == "done":
                walk = Walk()
            rows += [(key[0], *r) for r in walk.feed(n, e)]
        if walk.state == "done":
            state.remove()
        else:
            state.update((walk.state, -1 if walk.opened is None else walk.opened, walk.calls))
        yield pd.DataFrame(rows, columns=["session", "opened", "calls"])

    return items.select("session", "n", "event").groupBy("session").applyInPandasWithState(
        step, "session string, opened long, calls long", "state string, opened long, calls long", "append", GroupStateTimeout.NoTimeout
    )


def fresh_hints_stream(hints: DataFrame) -> DataFrame:
    """session, n, path of hints not yet shown in their session, at most SHOWN of a moment.

    hints: session, n, ts, state, paths.  The memory of a session lasts MEMORY_S from its last change, by
    event time of the rows."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        shown, updated = (list(state.get[0]), state.get[1]) if state.exists else ([], None)
        rows: list[tuple] = []
        for n, ts, ok, paths in sorted((int(n), int(t), s, list(p)) for b in batches for n, t, s, p in zip(b["n"], b["ts"], b["state"], b["paths"])):
            if updated is not None and ts - updated > MEMORY_S:
                shown = []
            fresh = [p for p in dict.fromkeys(paths) if len(p) <= 200 and p not in shown][:SHOWN] if ok == "ok" else []
            if fresh:
                shown += fresh
                updated = ts
                rows += [(key[0], n, p) for p in fresh]
        state.update((shown, updated if updated is not None else 0))
        yield pd.DataFrame(rows, columns=["session", "n", "path"])

    return hints.select("session", "n", "ts", "state", "paths").groupBy("session").applyInPandasWithState(
        step, "session string, n long, path string", "shown array<string>, updated long", "append", GroupStateTimeout.NoTimeout
    )


def matched_stream(calls: DataFrame, answers: DataFrame, before_s: int = 5, after_s: int = 600) -> DataFrame:
    """Calls (repo, call_id, call_at) with the answers (repo, answer_id, answer_at) in their window, as an
    interval join; watermarks of the window's length bound the state.  Each call may still meet several
    answers: the one-to-one choice is made on the small result."""
    c = calls.withWatermark("call_at", f"{after_s} seconds")
    a = answers.withWatermark("answer_at", f"{after_s} seconds").withColumnRenamed("repo", "answer_repo")
    low, high = F.expr(f"call_at - interval {before_s} seconds"), F.expr(f"call_at + interval {after_s} seconds")
    return c.join(a, (F.col("repo") == F.col("answer_repo")) & (F.col("answer_at") >= low) & (F.col("answer_at") <= high)).drop("answer_repo")


def daily_counts_stream(events: DataFrame, late: str = "1 day") -> DataFrame:
    """day, kind, n over event time (ts); rows later than ``late`` are dropped with their state."""
    windowed = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "kind").agg(F.count(F.lit(1)).alias("n"))
    return windowed.select(F.col("w.start").alias("day"), "kind", "n")
