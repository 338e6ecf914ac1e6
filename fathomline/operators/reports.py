"""Reports: validation, shares, medians across reports, and pieces of replay that are plain relations."""

from __future__ import annotations

import copy
import json
from collections.abc import Callable
from urllib.parse import quote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text


def fenced_json(body: Column) -> Column:
    """The JSON object of a post: inside a fence if there is one, else the text from its first brace to its last."""
    fenced = F.regexp_extract(body, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    bare = F.regexp_extract(body, r"(?s)(\{.*\})", 1)
    return F.when(fenced != "", fenced).when(bare != "", bare)


def valid(share: Column, count: Column, most: int = 1_000_000) -> Column:
    """Whether a share lies in 0 to 1 and a count in 0 to most; nulls are no values."""
    return F.coalesce(share.between(0, 1) & count.between(0, most), F.lit(False))


def grouped_upper_median(df: DataFrame, by: list[str], value: str, name: str = "median") -> DataFrame:
    """Element n div 2 of each group's sorted values, found among the different values and their counts."""
    counted = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("m"))
    w = Window.partitionBy(*by)
    place = counted.withColumn("upto", F.sum("m").over(w.orderBy(value))).withColumn("n", F.sum("m").over(w))
    return place.where(F.col("upto") > F.floor(F.col("n") / 2)).groupBy(*by).agg(F.min(value).alias(name), F.max("n").alias("n"))


def readable(candidates: DataFrame, blobs: DataFrame) -> DataFrame:
    """Candidates (task, blob, ...) of the tasks of which every blob was read."""
    missing = candidates.join(blobs.select("blob").distinct(), "blob", "left_anti").select("task").distinct()
    return candidates.join(missing, "task", "left_anti")


def with_vectors(docs: DataFrame, cache: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """docs with v: the cached vector, else the index's, else null (still to be embedded)."""
    out = docs.join(cache.select(*keys, F.col("v").alias("cached")), keys, "left").join(index.select(*keys, F.col("v").alias("indexed")), keys, "left")
    return out.withColumn("v", F.coalesce("cached", "indexed")).drop("cached", "indexed")


def first_touches(touches: DataFrame, by: str) -> DataFrame:
    """by, path, first place and strongest action (read < ran < edited) of each path."""
    strength = F.when(F.col("action") == "edited", 2).when(F.col("action") == "ran", 1).otherwise(0)
    names = F.array(F.lit("read"), F.lit("ran"), F.lit("edited"))
    out = touches.groupBy(by, "path").agg(F.min("n").alias("first"), F.max(strength).alias("__strength"))
    return out.select(by, "path", "first", F.element_at(names, F.col("__strength") + 1).alias("action"))


def latest(df: DataFrame, by: str, order: list[Column], most: int) -> DataFrame:
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def dominant(df: DataFrame, by: str, value: str) -> DataFrame:
    """The commonest value of each group; of equally common ones the first by name."""
    counted = df.groupBy(by, value).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(by).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("value"))).alias("x")).select(by, F.col("x.value").alias(value), (-F.col("x.m")).alias("n"))


def fitted_query(count: Callable[[str], int], query: str, context: str, window: int, build: Callable[[str, str], str]) -> tuple[str, int]:
    """(text, characters of context dropped): the oldest context goes until the tokens fit the window; at
    least 200 characters of it stay."""
    out, dropped = build(query, context), 0
    tokens = count(out) if context else 0
    while context and tokens > window and len(context) - dropped > 200:
        left = len(context) - dropped
        cut = max(200, int(left * (1 - window / tokens)) + 50)
        dropped = min(len(context) - 200, dropped + cut)
        out = build(query, context[dropped:])
        tokens = count(out)
    return out, dropped


def query_builder(instruction: str = text.FOR_FILES) -> Callable[[str, str], str]:
    """query_text for one query at a time, for fitted_query."""

    def build(query: str, context: str) -> str:
        q, c = query.strip(), context.strip()
        if not c:
            return instruction + q[: text.LIMIT_1]
        room = max(text.LEAST_CONTEXT, text.LIMIT_1 - min(len(q), text.LIMIT_1 // 2))
        return f"{instruction}{q[: text.LIMIT_1 - min(room, len(c))]}\nRecent context:\n{c[-room:]}"

    return build


#: Fixed value: the longest address that a form is filled in by.
MOST_ADDRESS = 8000


def report_json(report: dict) -> str:
    return json.dumps(report, ensure_ascii=False, indent=2)


def _line(cells: dict) -> str:
    return ", ".join(f"{k} {v}" for k, v in sorted(cells.items())) or "none"


def _hits(h: list[float] | None) -> str:
    return " / ".join(f"{x:.2f}" for x in h) if h else "none"


def report_markdown(report: dict) -> str:
    """A report of sections (name to cells) and bench rows for people, and the JSON that is sent below it."""
    out = ["## Usage report", ""]
    for section, cells in report.items():
        if isinstance(cells, dict):
            plain = {k: v for k, v in cells.items() if not isinstance(v, dict)}
            out.append(f"- {section}: {_line(plain)}")
            out += [f"  - {name}: {_line(inner)}" for name, inner in cells.items() if isinstance(inner, dict)]
    for b in report.get("bench", ()):
        out.append(f"- bench ({b['files']} files, {b['model']}): hit@1/3/10 lexical {_hits(b['lexical'])}, model {_hits(b['model_hits'])}, adapter {_hits(b.get('adapter_hits'))}")
    if report.get("truncated"):
        out.append("- some detail was left out to fit the address")
    return "\n".join([*out, "", "```json", report_json(report), "```", ""])


def report_address(report: dict, base: str, most: int = MOST_ADDRESS) -> tuple[str, dict]:
    """(address, the report it carries): bench rows go from the last on, then the languages, until it fits."""

    def made(r: dict) -> str:
        return f"{base}{quote(json.dumps(r, ensure_ascii=False, separators=(',', ':')), safe='-_.~')}"

    r = copy.deepcopy(report)
    while len(made(r)) > most and r.get("bench"):
        r["bench"].pop()
        r["truncated"] = True
    if len(made(r)) > most and r.get("repositories", {}).get("languages"):
        r["repositories"]["languages"] = {}
        r["truncated"] = True
    return made(r), r


def bench_text(counts: dict, scores: list[dict], matched: list[dict], slices: dict[str, list[dict]]) -> str:
    """A replay as text: what was looked at, hit@1/3/10 and MRR by method, and hit@3 by slice."""
    cell = lambda v: f"{v:6.3f}" if v is not None else "     -"
    out = [f"{counts['scanned']} commits scanned, {counts['eligible']} eligible, {counts['evaluated']} scored, {counts['adapted']} with an adapter; median {counts['files_median']} files"]
    for title, rows in (("all", scores), ("with an adapter", matched)):
        if rows:
            out += ["", f"{title:<20}     n   hit1   hit3  hit10    mrr"]
            out += [f"{r['method']:<20}{r['n']:6} " + " ".join(cell(r[k]) for k in ("hit1", "hit3", "hit10", "mrr")) for r in rows]
    for title, rows in slices.items():
        if rows:
            out += ["", f"{title:<34}     n lexic.  model  adapt."]
            out += [f"{r['label']:<34}{r['n']:6} " + " ".join(cell(r[k]) for k in ("lexical", "model", "adapter")) for r in rows]
    return "\n".join(out)


def usage_table(repositories: list[dict]) -> str:
    """Repositories as lines of a table: name, queries, share without an answer, latency at the median."""
    out = [f"{'repository':<30}queries abstain    p50"]
    for r in repositories:
        share = f"{100 * r['abstained'] / r['queries']:6.0f}%" if r["queries"] >= 5 else "      -"
        out.append(f"{r['name'][:29]:<30}{r['queries']:7} {share} {r['p50'] if r['p50'] is not None else '-':>6}")
    return "\n".join(out)
