"""Usage analytics: percentiles by nearest rank, days, shares, buckets, retention and edits after hints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .reports import grouped_upper_median

DAY = 86_400
#: Days kept, answers needed before a share is quoted, seconds in which an edit proves a hint useful.
RETENTION_DAYS, QUOTABLE, USEFUL_S = 30, 5, 86_400


def nearest_rank(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """For each group the value at sorted place round((n - 1) * share), under the given names.

    Values are counted first, so a group of any size sorts only its different values."""
    counted = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*by)
    running = counted.withColumn("upto", F.sum("c").over(w.orderBy(value))).withColumn("n", F.sum("c").over(w))
    picks = [F.min(F.when(F.col("upto") > F.round((F.col("n") - 1) * p), F.col(value))).alias(name) for name, p in shares.items()]
    return running.groupBy(*by).agg(F.max("n").alias("n"), *picks)


def days_ago(seconds: Column, now: int) -> Column:
    """Whole days before now, counted back from now."""
    return F.floor((F.lit(now) - seconds) / DAY)


def per_day(df: DataFrame, seconds: str, now: int, days: int) -> DataFrame:
    """day (0: the oldest of the last ``days``) and n, zero-filled."""
    spark = df.sparkSession
    counted = df.select((F.lit(days - 1) - days_ago(F.col(seconds), now)).alias("day")).where(F.col("day").between(0, days - 1)).groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    return spark.range(days).select(F.col("id").alias("day")).join(counted, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def kept(df: DataFrame, seconds: str, now: int, days: int = RETENTION_DAYS) -> DataFrame:
    return df.where(F.col(seconds) >= F.lit(now - days * DAY))


def quoted_share(part: Column, whole: Column) -> Column:
    """part / whole, or null below QUOTABLE answers."""
    return F.when(whole >= QUOTABLE, part / whole)


def sparkline(values: Column) -> Column:
    """An array of counts as a line of eight block heights; a dot where there is none."""
    most = F.greatest(F.array_max(values), F.lit(1))
    bars = F.array(*[F.lit(c) for c in "▁▂▃▄▅▆▇█"])
    height = lambda v: F.greatest(F.lit(1), F.least(F.lit(8), F.ceil(v * 8 / most).cast("int")))
    return F.array_join(F.transform(values, lambda v: F.when(v == 0, "·").otherwise(F.element_at(bars, height(v)))), "")


def bar(share: Column, cells: int = 20) -> Column:
    """A share of 0 to 1 as a bar."""
    full = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * cells).cast("int")
    return F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), F.lit(cells) - full))


def hook_summary(runs: DataFrame, by: list[str]) -> DataFrame:
    """runs, injections, files, sessions, timeouts and p50 of hook runs in groups."""
    counted = runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(F.col("outcome") == "injected").alias("injections"), F.sum(F.size("injected")).cast("long").alias("files"),
        F.count_distinct("agent", "session").alias("sessions"), F.count_if(F.col("outcome") == "timeout").alias("timeouts"),
    )
    return counted.join(nearest_rank(runs, by, "ms", {"p50": 0.5}).drop("n"), by)


def hooks_by_repository(repositories: DataFrame, runs: DataFrame) -> DataFrame:
    """repositories (root, ...) with the summary of their hook runs; zeros where there were none."""
    counts = ["runs", "injections", "files", "sessions", "timeouts"]
    return repositories.join(hook_summary(runs, ["root"]), "root", "left").fillna(0, counts)


def merged_counts(counts: DataFrame, by: list[str] = ()) -> DataFrame:
    """Counts (root, measure, key, n) added up over repositories: plain counters have key null, and the
    measure ``session`` counts different keys."""
    one = counts.where("measure <> 'session'").groupBy(*by, "measure", "key").agg(F.sum("n").cast("long").alias("n"))
    seen = counts.where("measure = 'session'").groupBy(*by, "measure").agg(F.count_distinct("key").alias("n"))
    return one.unionByName(seen.withColumn("key", F.lit(None).cast("string")).select(one.columns))


def with_agent_counts(repositories: DataFrame, counts: DataFrame) -> DataFrame:
    """repositories (root, ...) with a row for each of their counts; those without any keep one of nulls."""
    return repositories.join(counts, "root", "left")


def busiest(repositories: DataFrame, most: int | None = None) -> DataFrame:
    """Repositories by queries, then name; a report shows ``most``."""
    out = repositories.orderBy(F.desc("queries"), "name")
    return out if most is None else out.limit(most)


def titles_summary(rows: DataFrame, hits: list[str], times: list[str]) -> DataFrame:
    """Of issues (title, body, gold paths, hit columns, times): how many and how many hits, for all and by
    whether the text names a gold file, and the upper median of each time."""
    words = F.concat(F.coalesce("title", F.lit("")), F.coalesce("body", F.lit("")))
    named = F.exists("gold", lambda g: F.contains(words, F.regexp_extract(g, r"([^/]*)$", 1)))
    marked = rows.withColumn("group", F.explode(F.array(F.lit("all"), F.when(named, "names a gold file").otherwise("names none"))))
    out = marked.groupBy("group").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(h).alias(h) for h in hits])
    for t in times:
        out = out.join(grouped_upper_median(marked, ["group"], t, t).drop("n"), "group", "left")
    return out


def useful(answers: DataFrame, edits: DataFrame, within: int = USEFUL_S) -> DataFrame:
    """answers (repo, id, ts, hinted) with useful: whether a hinted path was edited in the time after.

    edits: repo, ts, path: commits, and files changed but not committed with the time of looking, which
    count while the time after an answer isn't over.  An equi join on repository, path and day bucket, so
    no pair is made that isn't within two buckets of time."""
    a = answers.select("repo", "id", F.col("ts").alias("t"), F.explode("hinted").alias("path")).withColumn("slot", F.explode(F.array(F.floor(F.col("t") / within), F.floor(F.col("t") / within) + 1)))
    e = edits.withColumn("slot", F.floor(F.col("ts") / within)).select("repo", "path", "slot", "ts").distinct()
    hit = a.join(e, ["repo", "path", "slot"]).where((F.col("ts") >= F.col("t")) & (F.col("ts") <= F.col("t") + within)).select("repo", "id").distinct()
    return answers.join(hit.withColumn("useful", F.lit(True)), ["repo", "id"], "left").withColumn("useful", F.coalesce("useful", F.lit(False)))
