"""Streaming queries: conversations read as a stream of transcript events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import run, sessions
from .registry import query

TURNS = "conv_id long, turn long, role string, text string"


def turns(spark, sf_dir):
    """The table as a stream; a Parquet file is given by a pattern that only it meets."""
    return run.stream_of(spark, f"{sf_dir}/[c]onversations.parquet", TURNS)


@query("tracker_stream")
def tracker_stream(spark, sf_dir):
    kind = F.when(F.col("role") == "user", "user_turn").when(F.col("turn") % 3 == 0, "call").otherwise("tool")
    return run.drained(sessions.walk_stream(turns(spark, sf_dir).select(F.col("conv_id").cast("string").alias("session"), F.col("turn").alias("n"), kind.alias("event"))))


@query("session_dedupe_stream")
def session_dedupe_stream(spark, sf_dir):
    paths = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.concat(F.lit("f"), (F.col("turn") + i * 2) % 5))
    hints = turns(spark, sf_dir).select(
        F.col("conv_id").cast("string").alias("session"), F.col("turn").alias("n"), (F.col("turn") * 600).alias("ts"),
        F.when(F.col("turn") % 4 == 3, "abstain").otherwise("ok").alias("state"), paths.alias("paths"),
    )
    return run.drained(sessions.fresh_hints_stream(hints))
