"""Lifecycles as one table of legal transitions; anything else is rejected and leaves the state as it is."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Machine, then its transitions as "state event next".
TABLES = {
    "index": """
        uninitialized init indexing; uninitialized model_changed uninitialized; indexing index_done ready; indexing index_failed error;
        indexing files_changed indexing; indexing model_changed uninitialized; ready files_changed stale; ready model_changed uninitialized;
        stale files_changed stale; stale refresh refreshing; stale model_changed uninitialized; refreshing refresh_done ready;
        refreshing refresh_failed error; refreshing files_changed refreshing; refreshing model_changed uninitialized; error init indexing;
        error reset uninitialized; error model_changed uninitialized""",
    "adapter": """
        none fit fitting; none model_changed none; fitting fit_done active; fitting fit_failed none; fitting model_changed none;
        active fit refitting; active model_changed invalidated; active discard none; refitting fit_done active; refitting fit_failed active;
        refitting model_changed invalidated; invalidated fit fitting; invalidated model_changed invalidated; invalidated discard none""",
    "query": """
        received ranked ranked; received unavailable fail_open; ranked confident answer; ranked not_confident abstain; ranked unavailable fail_open""",
    "model": """
        missing fetch downloading; missing local_found verifying; downloading download_done verifying; downloading download_failed missing;
        verifying checksum_ok loaded; verifying checksum_mismatch corrupt; loaded files_changed verifying; loaded evict missing;
        corrupt fetch downloading; corrupt reset missing""",
    "session": """
        starting warm warming; starting shutdown shutting_down; warming warm_done serving; warming warm_failed degraded; warming shutdown shutting_down;
        serving failure degraded; serving shutdown shutting_down; degraded recovered serving; degraded warm warming; degraded shutdown shutting_down;
        shutting_down closed stopped""",
    "indexer": """
        idle acquired indexing; idle busy waiting; failed acquired indexing; failed busy waiting; waiting acquired indexing; waiting gave_up idle;
        indexing done idle; indexing failed failed""",
    "bench": """
        idle start collecting; collecting collected embedding; embedding embedded scoring; scoring scored done; collecting fail failed;
        embedding fail failed; scoring fail failed""",
    "report": """
        collecting collected previewing; collecting collect_failed failed; previewing accept confirmed; previewing decline cancelled;
        confirmed post posting; posting post_ok posted; posting post_failed failed""",
    "tracker": """
        seeking call following; seeking hook armed; seeking tool seeking; seeking user_turn seeking; seeking eof done; armed call following;
        armed hook armed; armed tool following; armed user_turn armed; armed eof done; following call following; following hook armed;
        following tool following; following user_turn seeking; following limit seeking; following eof done""",
    "connection": """
        idle connect connecting; idle disabled in_process; connecting connected handshaking; connecting refused spawning;
        connecting timed_out in_process; spawning spawned waiting; spawning spawn_failed in_process; waiting connected handshaking;
        waiting timed_out in_process; handshaking accepted ready; handshaking mismatch restarting; handshaking timed_out in_process;
        restarting stopped respawning; restarting timed_out in_process; respawning spawned rewaiting; respawning spawn_failed in_process;
        rewaiting connected rehandshaking; rewaiting timed_out in_process; rehandshaking accepted ready; rehandshaking mismatch in_process;
        rehandshaking timed_out in_process; ready broken in_process""",
    "resident": """
        starting bound listening; starting bind_failed failed; starting shutdown stopped; listening request listening;
        listening idle_timeout draining; listening shutdown draining; draining drained stopped""",
}
#: States in which an index serves answers and an adapter applies.
SERVING = {"index": ("ready", "stale", "refreshing"), "adapter": ("active", "refitting")}


class Illegal(ValueError):
    """An event that the state doesn't allow."""


def rows() -> list[tuple[str, str, str, str]]:
    return [(m, *t.split()) for m, text in TABLES.items() for t in text.split(";")]


_NEXT = {(m, s, e): n for m, s, e, n in rows()}


def step(machine: str, state: str, event: str) -> str:
    try:
        return _NEXT[machine, state, event]
    except KeyError:
        raise Illegal(f"{machine}: event {event} is not allowed in state {state}") from None


def transitions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), "machine string, state string, event string, next string")


def stepped(events: DataFrame, spark: SparkSession) -> DataFrame:
    """events (machine, state, event, ...) with the next state and whether the event was legal."""
    table = F.broadcast(transitions(spark))
    out = events.join(table, ["machine", "state", "event"], "left")
    return out.withColumn("legal", F.col("next").isNotNull()).withColumn("next", F.coalesce("next", "state"))


def replayed(events: DataFrame, start: str, machine: str, key: str, order: str, event: str) -> DataFrame:
    """The state after each event of a key's log, in order; rejected events keep the state."""
    schema = f"{key} {dict(events.dtypes)[key]}, {order} {dict(events.dtypes)[order]}, {event} string, state string, legal boolean"
    table = {(s, e): n for (m, s, e), n in _NEXT.items() if m == machine}

    def walk(log: pd.DataFrame) -> pd.DataFrame:
        log = log.sort_values(order, kind="stable")
        state, out = start, []
        for k, o, e in zip(log[key], log[order], log[event]):
            legal = (state, e) in table
            state = table.get((state, e), state)
            out.append((k, o, e, state, legal))
        return pd.DataFrame(out, columns=[key, order, event, "state", "legal"])

    return events.select(key, order, event).groupBy(key).applyInPandas(walk, schema)


