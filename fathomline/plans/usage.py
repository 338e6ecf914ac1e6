"""Usage, transcript, fusion, streaming and lifecycle queries: events as a usage log (user: repository,
type: kind, value: milliseconds), conversations as transcripts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import commands
from ..functions.numeric import bucket
from ..functions.paths import is_near
from ..operators import ranking as R
from ..operators import transcripts as T
from ..operators import usage as U
from . import lifecycles
from .registry import query
from .texts import FILE, documents, turns

EV = "ev AS (SELECT event_id, user_id % 20 AS repo, event_type AS kind, value AS ms, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events), now AS (SELECT max(s) + 1 AS t FROM ev)"


def events(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", (F.col("user_id") % 20).alias("repo"), F.col("event_type").alias("kind"), F.col("value").alias("ms"), F.unix_timestamp("ts").alias("s"))


def now_of(e):
    return int(e.agg(F.max("s")).first()[0] or 0) + 1


RANKS = "(SELECT {g}, ms, row_number() OVER (PARTITION BY {g} ORDER BY ms) - 1 AS i, count(*) OVER (PARTITION BY {g}) AS n FROM ev)"


@query("nearest_rank_percentiles", f"WITH {EV} SELECT kind, max(n) AS n, max(ms) FILTER (i = CAST(round((n - 1) * 0.5) AS BIGINT)) AS p50, max(ms) FILTER (i = CAST(round((n - 1) * 0.95) AS BIGINT)) AS p95 FROM {RANKS.format(g='kind')} GROUP BY kind")
def nearest_rank_percentiles(spark, sf_dir):
    return U.nearest_rank(events(spark, sf_dir), ["kind"], "ms", {"p50": 0.5, "p95": 0.95})


@query(
    "usage_summary",
    f"""WITH {EV}, p AS (SELECT repo, max(n) AS n, max(ms) FILTER (i = CAST(round((n - 1) * 0.5) AS BIGINT)) AS p50, max(ms) FILTER (i = CAST(round((n - 1) * 0.95) AS BIGINT)) AS p95 FROM {RANKS.format(g='repo')} GROUP BY repo),
        c AS (SELECT repo, count(DISTINCT kind) AS kinds, count(*) FILTER (kind = 'error') AS errors, arg_max(kind, struct_pack(s, event_id)) AS last_kind FROM ev GROUP BY repo)
        SELECT repo, n, p50, p95, kinds, errors, last_kind FROM p JOIN c USING (repo)""",
)
def usage_summary(spark, sf_dir):
    e = events(spark, sf_dir)
    p = U.nearest_rank(e, ["repo"], "ms", {"p50": 0.5, "p95": 0.95})
    c = e.groupBy("repo").agg(F.count_distinct("kind").alias("kinds"), F.count_if(F.col("kind") == "error").alias("errors"), F.max_by("kind", F.struct("s", "event_id")).alias("last_kind"))
    return p.join(c, "repo")


@query("per_day_counts", f"WITH {EV}, d AS (SELECT 29 - CAST(floor((t - s) / 86400) AS BIGINT) AS day FROM ev, now) SELECT r.day, count(d.day) AS n FROM (SELECT unnest(range(30)) AS day) r LEFT JOIN d USING (day) GROUP BY r.day")
def per_day_counts(spark, sf_dir):
    e = events(spark, sf_dir)
    return U.per_day(e, "s", now_of(e), 30)


@query(
    "daily_sparkline",
    f"""WITH {EV}, d AS (SELECT 29 - CAST(floor((t - s) / 86400) AS BIGINT) AS day FROM ev, now), c AS (SELECT r.day, count(d.day) AS n FROM (SELECT unnest(range(30)) AS day) r LEFT JOIN d USING (day) GROUP BY r.day)
        SELECT string_agg(CASE WHEN n = 0 THEN '·' ELSE substr('▁▂▃▄▅▆▇█', CAST((n * 8 + m - 1) // m AS INTEGER), 1) END, '' ORDER BY day) AS line FROM c, (SELECT greatest(max(n), 1) AS m FROM c)""",
)
def daily_sparkline(spark, sf_dir):
    e = events(spark, sf_dir)
    days = U.per_day(e, "s", now_of(e), 30)
    counts = days.agg(F.transform(F.array_sort(F.collect_list(F.struct("day", "n"))), lambda x: x["n"]).alias("c"))  # 30 days
    return counts.select(U.sparkline(F.col("c")).alias("line"))


@query("retention", f"WITH {EV} SELECT repo, count(*) AS kept FROM ev, now WHERE s >= t - 30 * 86400 GROUP BY repo")
def retention(spark, sf_dir):
    e = events(spark, sf_dir)
    return U.kept(e, "s", now_of(e)).groupBy("repo").agg(F.count(F.lit(1)).alias("kept"))


@query("state_share", f"WITH {EV} SELECT kind, round(count(*) / (SELECT count(*) FROM ev) * 20) / 20 AS share FROM ev GROUP BY kind")
def state_share(spark, sf_dir):
    e = events(spark, sf_dir)
    n = e.count() or 1
    return e.groupBy("kind").agg((F.round(F.count(F.lit(1)) / F.lit(n) * 20) / 20).alias("share"))


@query("report_rates", f"WITH {EV} SELECT repo, kind, count(*) AS n, CASE WHEN count(*) >= 5 THEN round(count(*) FILTER (ms > 50) / count(*), 4) END AS slow FROM ev GROUP BY ALL")
def report_rates(spark, sf_dir):
    n = F.count(F.lit(1))
    return events(spark, sf_dir).groupBy("repo", "kind").agg(n.alias("n"), F.round(U.quoted_share(F.count_if(F.col("ms") > 50), n), 4).alias("slow"))


@query("bucket_counts", f"WITH {EV} SELECT CASE WHEN ms < 5 THEN '<5' WHEN ms < 20 THEN '5-20' WHEN ms < 100 THEN '20-100' ELSE '100+' END AS bucket, count(*) AS n FROM ev GROUP BY 1")
def bucket_counts(spark, sf_dir):
    return events(spark, sf_dir).groupBy(bucket(F.col("ms"), [(5, "<5"), (20, "5-20"), (100, "20-100")], "100+").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("last_model", f"WITH {EV} SELECT repo, arg_max(kind, struct_pack(s, event_id)) AS model, max(s) AS at FROM ev GROUP BY repo")
def last_model(spark, sf_dir):
    return events(spark, sf_dir).groupBy("repo").agg(F.max_by("kind", F.struct("s", "event_id")).alias("model"), F.max("s").alias("at"))


@query("hook_summary", f"WITH {EV} SELECT kind, count(*) AS runs, count(DISTINCT repo) AS sessions, CAST(sum(CASE WHEN ms > 90 THEN 1 ELSE 0 END) AS BIGINT) AS timeouts FROM ev GROUP BY kind")
def hook_summary(spark, sf_dir):
    return events(spark, sf_dir).groupBy("kind").agg(F.count(F.lit(1)).alias("runs"), F.count_distinct("repo").alias("sessions"), F.sum(F.when(F.col("ms") > 90, 1).otherwise(0)).alias("timeouts"))


@query("hint_edits_24h", f"WITH {EV}, a AS (SELECT * FROM ev WHERE kind = 'view'), e AS (SELECT repo, s, event_id % 7 AS path FROM ev WHERE kind = 'purchase') SELECT event_id AS id, repo, EXISTS (SELECT 1 FROM e WHERE e.repo = a.repo AND e.path = a.event_id % 7 AND e.s BETWEEN a.s AND a.s + 86400) AS useful FROM a")
def hint_edits_24h(spark, sf_dir):
    e = events(spark, sf_dir)
    answers = e.where("kind = 'view'").select("repo", F.col("event_id").alias("id"), F.col("s").alias("ts"), F.array(F.col("event_id") % 7).alias("hinted"))
    edits = e.where("kind = 'purchase'").select("repo", F.col("s").alias("ts"), (F.col("event_id") % 7).alias("path"))
    return U.useful(answers, edits).select("id", "repo", "useful")


@query("daily_window", "SELECT date_trunc('day', ts) AS day, event_type AS kind, count(*) AS n FROM events GROUP BY ALL")
def daily_window(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.groupBy(F.window("ts", "1 day").start.alias("day"), F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def items(spark, sf_dir):
    """Turns as transcript events: the user's, tool calls of the assistant, and a call in every third turn."""
    kind = F.when(F.col("role") == "user", "user_turn").when(F.col("turn") % 3 == 0, "call").otherwise("tool")
    return turns(spark, sf_dir).select(F.col("conv_id").alias("session"), F.col("turn").alias("n"), kind.alias("event"))


FOLLOWED = """WITH i AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'u' WHEN turn % 3 = 0 THEN 'c' ELSE 't' END AS k FROM conversations),
            g AS (SELECT *, sum(CASE WHEN k = 't' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS part FROM i),
            f AS (SELECT conv_id, part, max(CASE WHEN k = 'c' THEN turn END) AS opened, least(10, count(*) FILTER (k = 't')) AS calls FROM g GROUP BY ALL)
       SELECT conv_id AS session, opened, calls FROM f WHERE opened IS NOT NULL"""


@query("tracker", FOLLOWED)
def tracker(spark, sf_dir):
    """By the state machine; the SQL counts boundaries, which is the same where calls come one after another."""
    return T.tracked(items(spark, sf_dir))


@query("follow_window_counts", FOLLOWED)
def follow_window_counts(spark, sf_dir):
    """The same windows by counting boundaries, where turns are in order and none repeats."""
    w = Window.partitionBy("session").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    parts = items(spark, sf_dir).withColumn("part", F.sum(F.when(F.col("event") == "tool", 0).otherwise(1)).over(w))
    f = parts.groupBy("session", "part").agg(F.max(F.when(F.col("event") == "call", F.col("n"))).alias("opened"), F.least(F.lit(10), F.count_if(F.col("event") == "tool")).cast("long").alias("calls"))
    return f.where("opened is not null").select("session", "opened", "calls")


@query("greedy_match")
def greedy_match(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("s", F.floor(F.col("s") / 100))  # closer in time, so that windows meet
    side = lambda k: e.where(F.col("kind") == k).select("repo", F.col("event_id").alias("id"), F.col("s").alias("ts"))
    return T.greedy_match(side("click"), side("view"))


@query(
    "interval_match_uncontended",
    f"WITH {EV}, x AS (SELECT event_id, repo, kind, s // 100 AS s FROM ev), c AS (SELECT * FROM x WHERE kind = 'click'), a AS (SELECT * FROM x WHERE kind = 'view'), m AS (SELECT c.event_id AS call_id, a.event_id AS answer_id, row_number() OVER (PARTITION BY c.event_id ORDER BY abs(a.s - c.s), a.s, a.event_id) AS r FROM c JOIN a ON a.repo = c.repo AND a.s BETWEEN c.s - 5 AND c.s + 600) SELECT call_id, answer_id FROM m WHERE r = 1",
)
def interval_match_uncontended(spark, sf_dir):
    """The nearest answer in the window of each call, by an equi join on repository and time slot."""
    e = events(spark, sf_dir).withColumn("s", F.floor(F.col("s") / 100))
    c = e.where("kind = 'click'").select("repo", F.col("event_id").alias("call_id"), F.col("s").alias("t"))
    slots = F.sequence(F.floor((F.col("t") - T.BEFORE_S) / T.AFTER_S), F.floor((F.col("t") + T.AFTER_S) / T.AFTER_S))
    a = e.where("kind = 'view'").select("repo", F.col("event_id").alias("answer_id"), "s", F.floor(F.col("s") / T.AFTER_S).alias("slot"))
    near = c.withColumn("slot", F.explode(slots)).join(a, ["repo", "slot"]).where((F.col("s") >= F.col("t") - T.BEFORE_S) & (F.col("s") <= F.col("t") + T.AFTER_S))
    best = near.groupBy("call_id").agg(F.min(F.struct(F.abs(F.col("s") - F.col("t")).alias("d"), "s", "answer_id")).alias("b"))
    return best.select("call_id", F.col("b.answer_id").alias("answer_id"))


@query(
    "near_pairs",
    f"WITH f AS (SELECT source, {FILE} AS p FROM documents), d AS (SELECT source, regexp_extract(p, '^(.*)/[^/]*$', 1) AS dir, count(*) AS n FROM f GROUP BY ALL) SELECT dir, CAST(n * (n - 1) / 2 AS BIGINT) AS pairs FROM d WHERE n > 1",
)
def near_pairs(spark, sf_dir):
    """How many pairs of files share a folder: counted, not made."""
    from ..functions.paths import folder

    d = documents(spark, sf_dir).groupBy(folder(F.col("path")).alias("dir")).agg(F.count(F.lit(1)).alias("n"))
    return d.where("n > 1").select("dir", (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("pairs"))


@query(
    "similarity_partition",
    f"WITH f AS (SELECT source, doc_id, {FILE} AS p FROM documents), n AS (SELECT *, lead(p) OVER (PARTITION BY source ORDER BY doc_id) AS q FROM f), c AS (SELECT CASE WHEN q IS NULL THEN 'none' WHEN p = q THEN 'exact' WHEN regexp_extract(p, '^(.*)/[^/]*$', 1) = regexp_extract(q, '^(.*)/[^/]*$', 1) THEN 'near' ELSE 'elsewhere' END AS similarity FROM n) SELECT similarity, count(*) AS n FROM c GROUP BY 1",
)
def similarity_partition(spark, sf_dir):
    """Each file as the hint and the next one of its source as what was touched."""
    w = Window.partitionBy("source").orderBy("doc_id")
    n = documents(spark, sf_dir).select("source", "doc_id", "path").withColumn("q", F.lead("path").over(w))
    p, q = F.col("path"), F.col("q")
    kind = F.when(q.isNull(), "none").when(p == q, "exact").when(is_near(p, q), "near").otherwise("elsewhere")
    return n.groupBy(kind.alias("similarity")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "command_touches",
    """SELECT conv_id, turn, t.path, t.action FROM conversations, LATERAL (VALUES ('src/s/a/b/', 'edited'), (concat('src/f', turn, '.py'), 'edited'), ('src/out.txt', 'edited'),
        (concat('src/tests/t', turn, '.py'), 'ran'), ('src/notes.md', 'read')) AS t(path, action)""",
)
def command_touches(spark, sf_dir):
    t = turns(spark, sf_dir).select("conv_id", "turn", F.concat(F.lit("cd src && sed -i s/a/b/ f"), "turn", F.lit(".py > out.txt; pytest tests/t"), "turn", F.lit(".py | cat notes.md")).alias("c"))
    return t.select("conv_id", "turn", F.explode(commands.command_touches(F.col("c"))).alias("x")).select("conv_id", "turn", "x.path", "x.action")


@query("search_patterns", "SELECT conv_id, turn, concat('def f', turn, '\\w+') AS pattern, concat('def f', turn) AS intent FROM conversations")
def search_patterns(spark, sf_dir):
    from ..functions.text import search_intent

    t = turns(spark, sf_dir).select("conv_id", "turn", F.concat(F.lit("rg -n --glob '*.py' \"def f"), "turn", F.lit("\\w+\" src | head")).alias("c"))
    return t.select("conv_id", "turn", commands.search_pattern_udf("c").alias("pattern")).withColumn("intent", search_intent(F.col("pattern")))


RRF = "a AS (SELECT o_orderkey AS item, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank, o_orderpriority AS q FROM orders), b AS (SELECT o_orderkey AS item, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey) AS rank, o_orderpriority AS q FROM orders)"


@query("rrf_two_rankers", f"WITH {RRF}, u AS (SELECT * FROM a UNION ALL SELECT * FROM b) SELECT q, item, round(sum(1.0 / (60 + rank)), 8) AS score FROM u GROUP BY ALL")
def rrf_two_rankers(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("item"), F.col("o_orderpriority").alias("q"), "o_totalprice", "o_orderdate")
    order = lambda c: o.select("q", "item", F.row_number().over(Window.partitionBy("q").orderBy(F.desc(c), "item")).alias("rank"))
    fused = order("o_totalprice").unionByName(order("o_orderdate")).withColumn("item", F.struct("q", "item"))
    return R.reciprocal_ranks(fused).select("item.q", F.col("item.item").alias("item"), F.round("score", 8).alias("score"))


SUPPLIED = "r AS (SELECT s_nationkey AS repo, s_suppkey AS path, s_acctbal / 10000 AS similarity, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS rank FROM supplier)"


def answers(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_nationkey").alias("repo"), F.col("s_suppkey").alias("path"), (F.col("s_acctbal") / 10000).alias("similarity"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("similarity"), "path")))


@query("workspace_fuse", f"WITH {SUPPLIED} SELECT repo, path, rank, round(1.0 / (60 + rank), 8) AS fused FROM r ORDER BY 1.0 / (60 + rank) DESC, similarity DESC, repo LIMIT 10")
def workspace_fuse(spark, sf_dir):
    return R.workspace_fused(answers(spark, sf_dir), 10).select("repo", "path", F.col("rank").cast("long").alias("rank"), F.round("fused", 8).alias("fused"))


@query("repo_summary", f"WITH {SUPPLIED}, m AS (SELECT repo, max(similarity) AS top, count(*) AS hints FROM r GROUP BY repo) SELECT n_name AS name, round(top, 6) AS top, coalesce(hints, 0) AS hints, row_number() OVER (ORDER BY top DESC NULLS LAST, n_name) AS place FROM nation LEFT JOIN m ON repo = n_nationkey")
def repo_summary(spark, sf_dir):
    """All repositories by their best hint, those without one last.  A row a repository (25)."""
    m = answers(spark, sf_dir).groupBy("repo").agg(F.max("similarity").alias("top"), F.count(F.lit(1)).alias("hints"))
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").join(m, F.col("n_nationkey") == F.col("repo"), "left")
    w = Window.orderBy(F.desc_nulls_last("top"), "n_name")
    return n.select(F.col("n_name").alias("name"), F.round("top", 6).alias("top"), F.coalesce("hints", F.lit(0)).alias("hints"), F.row_number().over(w).cast("long").alias("place"))


@query(
    "budget_ask",
    f"""WITH {SUPPLIED}, p AS (SELECT repo, rank, concat('src/module_', path, '.py') AS path FROM r)
        SELECT repo, 'file' AS part, path FROM p WHERE rank <= 2 UNION ALL SELECT repo, 'function', path FROM p WHERE rank = 1""",
)
def budget_ask(spark, sf_dir):
    """Hints of each repository through the budget: files, a function and a configuration."""
    import pandas as pd

    hints = answers(spark, sf_dir).where("rank <= 5").select("repo", "rank", F.concat(F.lit("src/module_"), "path", F.lit(".py")).alias("path"))

    def one(g: pd.DataFrame) -> pd.DataFrame:
        files = [{"path": p} for p in g.sort_values("rank").path]
        kept = R.budget_ask(files, [{"path": f["path"], "name": "run"} for f in files], [{"path": "setup.cfg"}], 3, True, False)
        rows = [(int(g.repo.iloc[0]), part, h["path"]) for part, hs in zip(("file", "function", "config"), kept) for h in hs]
        return pd.DataFrame(rows, columns=["repo", "part", "path"])

    return hints.groupBy("repo").applyInPandas(one, "repo int, part string, path string")


LOG = """CASE CAST(event_id % 5 AS INT) WHEN 0 THEN 'init' WHEN 1 THEN 'index_done' WHEN 2 THEN 'files_changed' WHEN 3 THEN 'refresh' ELSE 'refresh_done' END"""
STATE = """CASE CAST(user_id % 4 AS INT) WHEN 0 THEN 'uninitialized' WHEN 1 THEN 'indexing' WHEN 2 THEN 'ready' ELSE 'stale' END"""


@query(
    "transition_step",
    f"""WITH t(machine, state, event, next) AS (VALUES {', '.join(str(r) for r in lifecycles.rows())}), e AS (SELECT event_id, 'index' AS machine, {STATE} AS state, {LOG} AS event FROM events)
        SELECT event_id, state, event, coalesce(t.next, e.state) AS next, t.next IS NOT NULL AS legal FROM e LEFT JOIN t USING (machine, state, event)""",
)
def transition_step(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.lit("index").alias("machine"), F.expr(STATE).alias("state"), F.expr(LOG).alias("event"))
    return lifecycles.stepped(e, spark).select("event_id", "state", "event", "next", "legal")


@query("transition_replay")
def transition_replay(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("repo"), F.col("event_id").alias("n"), F.expr(LOG).alias("event"))
    return lifecycles.replayed(e, "uninitialized", "index", "repo", "n", "event")


HOOKED = """hk AS (SELECT event_id, concat('/r', user_id % 20) AS root, concat('a', user_id % 3) AS agent, CAST(user_id AS VARCHAR) AS session, CAST(value AS BIGINT) AS ms,
    CASE CAST(event_id % 4 AS INT) WHEN 0 THEN 'timeout' WHEN 1 THEN 'quiet' ELSE 'injected' END AS outcome, CAST(CASE WHEN event_id % 4 < 2 THEN 0 ELSE event_id % 4 END AS BIGINT) AS files FROM events)"""


def hook_runs(spark, sf_dir):
    """Events as hook runs: one in two injects two or three files."""
    e, m = spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("event_id") % 4
    outcome = F.when(m == 0, "timeout").when(m == 1, "quiet").otherwise("injected")
    paths = F.when(m >= 2, F.transform(F.sequence(F.lit(1), m.cast("int")), lambda i: F.concat(F.lit("f"), i))).otherwise(F.array().cast("array<string>"))
    return e.select(
        F.concat(F.lit("/r"), F.col("user_id") % 20).alias("root"), F.concat(F.lit("a"), F.col("user_id") % 3).alias("agent"), F.col("user_id").cast("string").alias("session"),
        F.col("value").cast("long").alias("ms"), outcome.alias("outcome"), paths.alias("injected"),
    )


@query(
    "hooks_by_repository",
    f"""WITH {HOOKED.replace('CAST(value AS BIGINT)', 'CAST(trunc(value) AS BIGINT)')}, s AS (SELECT root, count(*) AS runs, count(*) FILTER (outcome = 'injected') AS injections, CAST(sum(files) AS BIGINT) AS files, count(DISTINCT (agent, session)) AS sessions, count(*) FILTER (outcome = 'timeout') AS timeouts FROM hk GROUP BY root),
        k AS (SELECT root, ms, row_number() OVER (PARTITION BY root ORDER BY ms) - 1 AS i, count(*) OVER (PARTITION BY root) AS n FROM hk), p AS (SELECT root, max(ms) AS p50 FROM k WHERE i = CAST(round((n - 1) * 0.5) AS BIGINT) GROUP BY root)
        SELECT concat('/r', n_nationkey) AS root, n_name AS name, coalesce(runs, 0) AS runs, coalesce(injections, 0) AS injections, coalesce(files, 0) AS files, coalesce(sessions, 0) AS sessions, coalesce(timeouts, 0) AS timeouts, p50
        FROM nation LEFT JOIN s ON s.root = concat('/r', n_nationkey) LEFT JOIN p ON p.root = s.root""",
)
def hooks_by_repository(spark, sf_dir):
    """Nations as repositories: those from 20 on have no run."""
    repos = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("/r"), "n_nationkey").alias("root"), F.col("n_name").alias("name"))
    return U.hooks_by_repository(repos, hook_runs(spark, sf_dir))


@query(
    "agent_counts_merged",
    f"""WITH {HOOKED} SELECT 'similarity' AS measure, outcome AS key, count(*) AS n FROM hk GROUP BY outcome UNION ALL SELECT 'answered', NULL, CAST(sum(files) AS BIGINT) FROM hk
        UNION ALL SELECT 'session', NULL, count(DISTINCT concat(agent, ' ', session)) FROM hk""",
)
def agent_counts_merged(spark, sf_dir):
    """Counts by repository, then added up: sessions that work in several repositories count once."""
    runs = hook_runs(spark, sf_dir)
    null, one = F.lit(None).cast("string"), F.count(F.lit(1))
    parts = runs.groupBy("root", F.lit("similarity").alias("measure"), F.col("outcome").alias("key")).agg(one.alias("n"))
    parts = parts.unionByName(runs.groupBy("root").agg(F.sum(F.size("injected")).cast("long").alias("n")).withColumns({"measure": F.lit("answered"), "key": null}))
    seen = runs.select("root", F.concat_ws(" ", "agent", "session").alias("key")).distinct().withColumns({"measure": F.lit("session"), "n": F.lit(1).cast("long")})
    return U.merged_counts(parts.unionByName(seen)).select("measure", "key", "n")


@query(
    "issue_titles",
    """WITH i AS (SELECT doc_id, text, concat('src/', split_part(text, ' ', CAST(1 + doc_id % 2 AS INTEGER)), CASE WHEN doc_id % 3 = 0 THEN '' ELSE '.py' END) AS gold, doc_id % 5 < 3 AS ours, doc_id % 7 < 3 AS theirs, n_chars AS ms FROM documents),
            m AS (SELECT *, contains(text, regexp_extract(gold, '([^/]*)$', 1)) AS named FROM i),
            g AS (SELECT 'all' AS "group", * FROM m UNION ALL SELECT CASE WHEN named THEN 'names a gold file' ELSE 'names none' END, * FROM m),
            r AS (SELECT "group", ms, row_number() OVER (PARTITION BY "group" ORDER BY ms) - 1 AS i, count(*) OVER (PARTITION BY "group") AS c FROM g), k AS (SELECT "group", max(ms) AS ms FROM r WHERE i = c // 2 GROUP BY "group")
       SELECT "group", count(*) AS n, count(*) FILTER (ours) AS ours, count(*) FILTER (theirs) AS theirs, max(k.ms) AS ms FROM g JOIN k USING ("group") GROUP BY ALL""",
)
def issue_titles(spark, sf_dir):
    """Documents as issues, a word of each as its gold file."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    word = F.split_part("text", F.lit(" "), (F.col("doc_id") % 2 + 1).cast("int"))
    gold = F.concat(F.lit("src/"), word, F.when(F.col("doc_id") % 3 == 0, "").otherwise(".py"))
    rows = d.select(F.lit("").alias("title"), F.col("text").alias("body"), F.array(gold).alias("gold"), (F.col("doc_id") % 5 < 3).alias("ours"), (F.col("doc_id") % 7 < 3).alias("theirs"), F.col("n_chars").alias("ms"))
    return U.titles_summary(rows, ["ours", "theirs"], ["ms"])


TOUCHED = f"""f AS (SELECT source, doc_id, {FILE} AS p FROM documents), n AS (SELECT *, lead(p, 1) OVER w AS a, lead(p, 3) OVER w AS b FROM f WINDOW w AS (PARTITION BY source ORDER BY doc_id)),
    d AS (SELECT *, list_filter(CASE WHEN doc_id % 6 = 0 THEN [p, a] WHEN doc_id % 6 = 1 THEN [a, p] ELSE [a, b] END, lambda x: x IS NOT NULL) AS t, regexp_extract(p, '^(.*)/[^/]*$', 1) AS dir FROM n)"""


@query(
    "agent_similarity",
    f"""WITH {TOUCHED}, s AS (SELECT *, CASE WHEN len(t) = 0 THEN 'none' WHEN list_contains(t, p) THEN 'exact' WHEN len(list_filter(t, lambda x: regexp_extract(x, '^(.*)/[^/]*$', 1) = dir)) > 0 THEN 'near' ELSE 'elsewhere' END AS k FROM d)
        SELECT source, count(*) AS answered, count(*) FILTER (k = 'exact') AS exact, count(*) FILTER (k = 'near') AS near, count(*) FILTER (k = 'elsewhere') AS elsewhere, count(*) FILTER (k = 'none') AS none,
            count(*) FILTER (k = 'exact' AND doc_id % 2 = 0) AS by_edited, 0::BIGINT AS by_ran, count(*) FILTER (k = 'exact' AND doc_id % 2 = 1) AS by_read, count(*) FILTER (coalesce(t[1] = p, false)) AS first_pick
        FROM s GROUP BY source""",
)
def agent_similarity(spark, sf_dir):
    """Files as hints; what was touched after each are later files of its source, at times the file itself."""
    w = Window.partitionBy("source").orderBy("doc_id")
    n = documents(spark, sf_dir).select("source", "doc_id", "path").withColumns({"a": F.lead("path", 1).over(w), "b": F.lead("path", 3).over(w)})
    m = F.col("doc_id") % 6
    paths = F.when(m == 0, F.array("path", "a")).when(m == 1, F.array("a", "path")).otherwise(F.array("a", "b"))
    action = F.when(F.col("doc_id") % 2 == 0, "edited").otherwise("read")
    touched = F.transform(F.filter(paths, lambda x: x.isNotNull()), lambda x: F.struct(x.alias("path"), action.alias("action")))
    return T.agent_counts(n.select("source", F.array("path").alias("hinted"), touched.alias("touched")), ["source"])
