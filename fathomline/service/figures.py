"""What the logs tell: usage by repository, a card without names, and an anonymous report with its checks."""

from __future__ import annotations

import json
import os
import platform
import subprocess
from functools import reduce
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import bucket
from ..functions.paths import language
from ..functions.text import model_name
from ..operators import reports, transcripts
from ..operators import usage as U
from ..sources import files, git, workspace
from .engine import Engine, latest_values

#: Buckets of the report, its schema's number, the most bench rows, and the longest time in it.
FILES = [(1000, "<1k"), (3000, "1k-3k"), (10_000, "3k-10k")]
COUNTS = [(1, "0"), (10, "1-9"), (50, "10-49"), (200, "50-199")]
INDEX_MS = [(10_000, "<10s"), (60_000, "10-60s"), (300_000, "1-5min")]
THREADS = [(5, "1-4"), (9, "5-8"), (17, "9-16")]
SCHEMA, MOST_BENCH, MOST_MS, SHARE_STEP = 1, 10, 600_000, 0.05
USAGE_COLUMNS = [c.split()[0] for c in files.USAGE.split(", ")]


def label(value: float, edges: list[tuple[int, str]], last: str) -> str:
    return next((name for edge, name in edges if value < edge), last)


def usage_of(engine: Engine, roots: list[str], days: int = U.RETENTION_DAYS) -> DataFrame:
    """root and the logged answers of repositories in the last days."""
    since = int(engine.clock()) - days * U.DAY
    parts = [engine.usage(r).read(since=since).select(F.lit(r).alias("root"), *USAGE_COLUMNS) for r in roots]
    return reduce(DataFrame.unionByName, parts) if parts else engine.spark.createDataFrame([], f"root string, {files.USAGE}")


def edits_of(engine: Engine, roots: list[str]) -> DataFrame:
    """repo, ts, path of the newest commits, and of files changed but not committed, at the present time."""
    held = []
    for r in roots:
        if not os.path.exists(os.path.join(r, ".git")):
            continue
        commits = engine.git_table(r, "commits", limit=600)
        held.append(commits.select("repo", F.unix_timestamp(F.to_timestamp("date")).alias("ts"), F.explode("paths").alias("path")))
        try:
            dirty = [p for p in git.git(r, "diff", "--name-only", "-z", "HEAD").split("\0") if p]
        except subprocess.CalledProcessError:  # no commit yet
            dirty = []
        held.append(engine.spark.createDataFrame([(r, int(engine.clock()), p) for p in dirty], "repo string, ts long, path string"))
    return reduce(DataFrame.unionByName, held) if held else engine.spark.createDataFrame([], "repo string, ts long, path string")


def with_useful(engine: Engine, usage: DataFrame, roots: list[str]) -> DataFrame:
    """Answers that held hints, with whether one of these files was edited in the time after."""
    answers = usage.where(F.size("hinted") > 0).select(F.col("root").alias("repo"), "ts", "hinted")
    answers = answers.withColumn("id", F.xxhash64("ts", "hinted")).dropDuplicates(["repo", "id"])
    return U.useful(answers, edits_of(engine, roots))


def by_repository(usage: DataFrame) -> DataFrame:
    """root, name, queries, abstained, p50, the busiest first."""
    counted = usage.groupBy("root").agg(F.count(F.lit(1)).alias("queries"), F.count_if(F.col("state") == "abstain").alias("abstained"))
    named = counted.join(U.nearest_rank(usage, ["root"], "ms", {"p50": 0.5}).drop("n"), "root").withColumn("name", F.regexp_extract("root", r"([^/]*)/?$", 1))
    return U.busiest(named)


def totals(engine: Engine, roots: list[str], days: int = U.RETENTION_DAYS) -> dict:
    """The figures of a card: counts, shares (None below the number that is quoted), times and a line of days."""
    now, usage = int(engine.clock()), usage_of(engine, roots, days)
    n = F.count(F.lit(1))
    row = usage.agg(
        n.alias("queries"), F.count_if(F.col("state") == "ok").alias("answered"), F.count_if(F.col("state") == "abstain").alias("abstained"),
        F.sum(F.size("hinted")).cast("long").alias("hints"), U.quoted_share(F.count_if("adapter"), n).alias("adapter_share"), U.quoted_share(F.count_if(F.col("model").startswith("hash-")), n).alias("fallback_share"),
    ).first()
    times = U.nearest_rank(usage, [], "ms", {"p50": 0.5, "p95": 0.95}).first()
    edited = with_useful(engine, usage, roots).agg(U.quoted_share(F.count_if("useful"), n).alias("s")).first().s
    line = U.per_day(usage, "ts", now, days).agg(F.transform(F.sort_array(F.collect_list(F.struct("day", "n"))), lambda x: x["n"]).alias("v"))  # a number a day
    runs = engine.hook_log().read(since=now - days * U.DAY).where(F.col("root").isin(roots))
    hooks = U.hook_summary(runs.withColumn("all", F.lit(0)), ["all"]).first()
    counts = {"runs": 0, "injections": 0, "files": 0, "sessions": 0, "timeouts": 0, "p50": None}
    return {
        **row.asDict(), "hints": row.hints or 0, "p50": times.p50 if times else None, "p95": times.p95 if times else None, "useful_share": edited,
        "days": line.select(U.sparkline(F.col("v")).alias("s")).first().s, "repositories": len(roots), "hooks": {k: hooks[k] for k in counts} if hooks else counts,
    }


def percent(share: float | None) -> str:
    return "too few to tell" if share is None else f"{100 * share:.0f}%"


def card_lines(t: dict) -> list[str]:
    """A card to show others: no names, paths or queries."""
    abstained = t["abstained"] / t["queries"] if t["queries"] >= U.QUOTABLE else None
    return [
        f"{t['queries']} queries in {t['repositories']} repositories, {t['hints']} hints",
        f"days      {t['days']}",
        f"no answer {percent(abstained)}",
        f"edited    {percent(t['useful_share'])} of answers led to an edit within a day",
        f"latency   p50 {t['p50'] if t['p50'] is not None else '-'} ms, p95 {t['p95'] if t['p95'] is not None else '-'} ms",
        f"hooks     {t['hooks']['runs']} runs, {t['hooks']['injections']} with hints, {t['hooks']['timeouts']} too late",
    ]


def card_svg(t: dict, width: int = 640, row: int = 26) -> str:
    """The card as an image: one text element a line on a plain ground."""
    rows = card_lines(t)
    height = row * (len(rows) + 1)
    cells = "".join(f'<text x="20" y="{row * (i + 1)}" xml:space="preserve">{escape(line)}</text>' for i, line in enumerate(rows))
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" font-family="monospace" font-size="14"><rect width="100%" height="100%" fill="#fff"/>{cells}</svg>'


def stats_text(engine: Engine, roots: list[str], days: int = U.RETENTION_DAYS, every: bool = False, agents: DataFrame | None = None) -> str:
    """Figures for one's own eyes; ``every`` adds a line a repository, ``agents`` counts of what agents did."""
    out = card_lines(totals(engine, roots, days))
    if every:
        out += ["", reports.usage_table([r.asDict() for r in by_repository(usage_of(engine, roots, days)).collect()])]  # a row a repository
    for r in agents.collect() if agents is not None else ():  # a row
        out.append(f"agents    {r.answered} answers: {r.exact} used as hinted, {r.near} nearby, {r.elsewhere} elsewhere, {r.none} nothing")
    for r in roots if not every else ():
        bench = latest_values(engine.folder(r), "bench")
        if bench:
            out.append(f"replay    hit@3 lexical {bench['lexical'][1]:.2f}, model {bench['model_hits'][1]:.2f}")
    return "\n".join(out)


def agents_of(observed: DataFrame) -> DataFrame:
    """One row of counts of what was touched after answers (hinted, touched)."""
    return transcripts.agent_counts(observed.withColumn("all", F.lit(0)), ["all"])


def stepped(part: Column, whole: Column) -> Column:
    """A share in steps, or null below the number that is quoted."""
    return F.round(F.round(U.quoted_share(part, whole) / SHARE_STEP) * SHARE_STEP, 2)


def stepped_number(part: int, whole: int) -> float:
    return round(round(part / whole / SHARE_STEP) * SHARE_STEP, 2)


def coarse_ms(ms: Column) -> Column:
    """A time in steps of 1, 5, 10 or 100 as it grows, at most the longest that a report takes."""
    step = F.when(ms < 10, 1).when(ms < 100, 5).when(ms < 1000, 10).otherwise(100)
    return F.least((F.round(ms / step) * step).cast("long"), F.lit(MOST_MS))


def report_of(engine: Engine, roots: list[str], days: int = U.RETENTION_DAYS) -> dict:
    """An anonymous report: buckets, shares in steps and known names only; no path, text or repository."""
    usage, n = usage_of(engine, roots, days), F.count(F.lit(1))
    counts = {c: {r[c]: r.n for r in usage.groupBy(c).agg(n.alias("n")).collect()} for c in ("state", "kind")}  # a row a state or kind
    states, kinds = ({k: stepped_number(m, sum(c.values())) for k, m in sorted(c.items()) if sum(c.values()) >= U.QUOTABLE} for c in counts.values())
    row = usage.agg(
        n.alias("queries"), stepped(F.count_if("adapter"), n).alias("adapter"), stepped(F.count_if(F.col("state") == "abstain"), n).alias("abstain"),
        stepped(F.count_if(F.col("model").startswith("hash-")), n).alias("fallback"),
    ).first()
    times = U.nearest_rank(usage, [], "ms", {"p50": 0.5, "p95": 0.95}).select(coarse_ms(F.col("p50")).alias("p50"), coarse_ms(F.col("p95")).alias("p95")).first()
    edited = with_useful(engine, usage, roots).agg(stepped(F.count_if("useful"), n).alias("s")).first().s
    parts = [engine.index(r).where("kind = 'file'").select(F.lit(r).alias("root"), "path") for r in roots]
    spoken, sizes = {}, {}
    if parts:
        have = reduce(DataFrame.unionByName, parts)
        per = have.groupBy("root").agg(n.alias("n")).groupBy(bucket(F.col("n"), FILES, "10k+").alias("size")).agg(n.alias("m"))
        sizes = {r["size"]: r.m for r in per.orderBy("size").collect()}  # four sizes
        tongues = {r.l: r.m for r in have.groupBy(F.coalesce(language(F.col("path")), F.lit("other")).alias("l")).agg(n.alias("m")).collect()}  # a row a language
        tenths = {l: round(10 * m / sum(tongues.values())) * 10 for l, m in tongues.items()}
        spoken = {l: s for l, s in sorted(tenths.items(), key=lambda x: (-x[1], x[0])) if s}
    bench, slowest = [], 0
    for r in roots:
        b, built = latest_values(engine.folder(r), "bench"), latest_values(engine.folder(r), "index")
        slowest = max(slowest, built["ms"] if built else 0)
        if b:
            two = lambda h: None if h is None else [round(x, 2) for x in h]
            bench.append({"files": label(b["files"], FILES, "10k+"), "model": known_model(engine, b["model"]), **{k: two(b[k]) for k in ("lexical", "model_hits", "adapter_hits")}})
    bench.sort(key=lambda b: json.dumps(b, sort_keys=True))
    bench = bench[:MOST_BENCH]
    system = platform.system().lower()
    return {
        "schema": SCHEMA,
        "setup": {"os": system if system in ("linux", "darwin", "windows") else "other", "threads": label(os.cpu_count() or 1, THREADS, "17+"), "model": known_model(engine, engine.encoder.fingerprint)},
        "repositories": {"count": label(len(roots), COUNTS, "200+"), "sizes": sizes, "languages": spoken},
        "usage": {"queries": label(row.queries, COUNTS, "200+"), "adapter_rate": row.adapter, "kinds": kinds},
        "quality": {"abstain_rate": row.abstain, "hint_usefulness": edited},
        "reliability": {"fallback_rate": row.fallback, "states": states},
        "performance": {"query_ms_p50": times.p50 if times else None, "query_ms_p95": times.p95 if times else None, "index_time": label(slowest, INDEX_MS, "5min+")},
        "bench": bench,
    }


def known_model(engine: Engine, fingerprint: str) -> str:
    """The name that a report may carry: the lexical fallback, or a model's name without its hash."""
    return "lexical" if fingerprint.startswith("hash-") else engine.spark.range(1).select(model_name(F.lit(fingerprint)).alias("m")).first().m


def problems(report: dict) -> list[str]:
    """What is wrong with a report; nothing if it can be taken."""
    wanted = ("schema", "setup", "repositories", "usage", "quality", "reliability", "performance", "bench")
    if not isinstance(report, dict) or any(k not in report for k in wanted):
        return ["a section is missing"]
    if extra := sorted(set(report) - {*wanted, "truncated"}):
        return [f"unknown section {extra[0]}"]
    if report["schema"] != SCHEMA:
        return [f"unsupported schema {report['schema']}"]
    unit = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool) and 0 <= x <= 1
    try:
        rates = [report["quality"]["abstain_rate"], report["quality"]["hint_usefulness"], report["reliability"]["fallback_rate"], report["usage"]["adapter_rate"]]
        shares = [*report["reliability"]["states"].values(), *report["usage"]["kinds"].values(), *(r for r in rates if r is not None)]
        hits = [x for b in report["bench"] for h in (b["lexical"], b["model_hits"], b.get("adapter_hits") or []) for x in h]
        times = [report["performance"][k] or 0 for k in ("query_ms_p50", "query_ms_p95")]
        good = (
            all(map(unit, shares + hits)) and len(report["bench"]) <= MOST_BENCH and all(0 <= t <= MOST_MS for t in times)
            and all(isinstance(p, int) and 0 <= p <= 100 and p % 10 == 0 for p in report["repositories"]["languages"].values())
        )
    except (KeyError, TypeError, AttributeError):
        return ["a section has another form"]
    return [] if good else ["a value is out of range"]


def posted(body: str, spark: SparkSession) -> dict | None:
    """The report in a file or a post: plain JSON, or the JSON block of a text."""
    found = spark.createDataFrame([(body,)], "body string").select(reports.fenced_json(F.col("body")).alias("j")).first().j
    try:
        return json.loads(found) if found else None
    except ValueError:
        return None


def summary_markdown(spark: SparkSession, path: str) -> str:
    """Reports in JSON lines as a table: how many by size of use, and medians of rates and times by model."""
    rows = spark.read.schema(
        "setup struct<model: string>, usage struct<queries: string, adapter_rate: double>, quality struct<abstain_rate: double, hint_usefulness: double>, performance struct<query_ms_p50: long>"
    ).option("mode", "DROPMALFORMED").json(path)
    flat = rows.select(F.col("setup.model").alias("model"), F.col("usage.queries").alias("queries"), F.col("quality.abstain_rate").alias("abstain"), F.col("quality.hint_usefulness").alias("useful"), F.col("performance.query_ms_p50").alias("p50"))
    out = flat.groupBy("model").agg(F.count(F.lit(1)).alias("n"))
    for value in ("abstain", "useful", "p50"):
        out = out.join(reports.grouped_upper_median(flat.where(F.col(value).isNotNull()), ["model"], value, value).drop("n"), "model", "left")
    cell = lambda v: "-" if v is None else f"{v:g}"
    lines = ["| model | reports | no answer | edited | p50 ms |", "|-|-|-|-|-|"]
    lines += [f"| {r.model} | {r.n} | {cell(r.abstain)} | {cell(r.useful)} | {cell(r.p50)} |" for r in out.orderBy(F.desc("n"), "model").collect()]  # a row a model
    return "\n".join(lines)


def known_roots(engine: Engine) -> list[str]:
    return sorted(workspace.cached(engine.home))
