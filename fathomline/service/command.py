"""The command line: python -m fathomline COMMAND.  Every command runs on the Spark session it is given, or
on the one that the surroundings configure."""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Callable
from typing import TextIO

from pyspark.sql import SparkSession

from ..operators import replay, reports
from ..operators.asking import EMPTY_QUERY, Options
from . import figures, hooks, server
from .engine import Engine

HOME = os.path.join("~", ".fathomline")
REPORT_ADDRESS = "https://example.org/new?body="


def count_of_hints(text: str) -> int:
    if text not in ("1", "2", "3"):
        raise argparse.ArgumentTypeError("1 to 3 hints")
    return int(text)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="fathomline", description="Which files to open next, from a repository's own index and history.")
    top.add_argument("--root", default=".", help="repository, or a folder of repositories")
    top.add_argument("--home", default=HOME, help="where indexes, adapters and logs are kept")
    sub = top.add_subparsers(dest="command", required=True)
    c = sub.add_parser("init", help="index and fit the adapter")
    c.add_argument("-y", "--yes", action="store_true", help="index many repositories without asking")
    for name, told in (("status", "index, coverage and adapter"), ("train", "fit the adapter now"), ("rollback", "the adapter before"), ("serve", "tools over standard input and output")):
        sub.add_parser(name, help=told)
    c = sub.add_parser("ask", help="files to open next")
    c.add_argument("query")
    c.add_argument("--context-file", help="recent context; - reads standard input")
    c.add_argument("--functions", action="store_true")
    c.add_argument("-k", type=count_of_hints, default=3)
    c.add_argument("--no-adapter", action="store_true")
    c.add_argument("--strict", action="store_true")
    c.add_argument("--no-abstain", action="store_true")
    c.add_argument("--start", action="store_true")
    c.add_argument("--start-min-files", type=int, default=server.START_FILES)
    c.add_argument("--no-log", action="store_true")
    c.add_argument("--json", action="store_true")
    c = sub.add_parser("bench", help="replay the repository's history")
    for name, given in (("--commits", 300), ("--train", 200), ("--step", 100)):
        c.add_argument(name, type=int, default=given)
    c.add_argument("--with-tests", action="store_true")
    c.add_argument("--no-adapter", action="store_true")
    c = sub.add_parser("stats", help="use, times and edits after hints")
    c.add_argument("--all", action="store_true")
    c.add_argument("--days", type=int, default=30)
    c.add_argument("--share", action="store_true", help="a card without names, paths or queries")
    c.add_argument("--svg", help="write the card as an image")
    c = sub.add_parser("report", help="an anonymous report")
    c.add_argument("--address", default=REPORT_ADDRESS, help="form that takes the report")
    c.add_argument("--validate", help="check a report or a post that holds one")
    c.add_argument("--summarize", help="a table of reports in JSON lines")
    c = sub.add_parser("hook", help="a moment as JSON on standard input")
    c.add_argument("agent")
    c.add_argument("moment", choices=hooks.MOMENTS)
    c.add_argument("--budget-ms", type=int, default=int(hooks.BUDGET_S * 1000))
    c.add_argument("--min-files", type=int, default=hooks.MIN_FILES)
    return top


def pretty(value: dict) -> str:
    return json.dumps(value, ensure_ascii=False, indent=2)


def ask(engine: Engine, root: str, a: argparse.Namespace, given: TextIO) -> str:
    context = ""
    if a.context_file == "-":
        context = given.read()
    elif a.context_file:
        with open(a.context_file, encoding="utf-8", errors="replace") as f:
            context = f.read()
    if not a.query.strip() and not context.strip():
        raise ValueError(EMPTY_QUERY)
    o = Options(k=a.k, functions=a.functions, adapt=not a.no_adapter, strict=a.strict, no_abstain=a.no_abstain, start_min_files=a.start_min_files if a.start else None)
    if hooks.repository_of(root) or engine.source_files(root):
        engine.refresh(root, functions=a.functions)
        answer = engine.ask_one(root, a.query, context, o, not a.no_log)
    else:
        answer = engine.ask_below(root, a.query, context, o, not a.no_log)
    return pretty({k: answer.get(k) for k in ("state", "reason", "hints")}) if a.json else answer["answer"]


def bench(engine: Engine, root: str, a: argparse.Namespace) -> str:
    r = engine.bench(root, replay.Options(commits=a.commits, train=a.train, step=a.step, with_tests=a.with_tests, adapter=not a.no_adapter))
    rows = lambda df: [x.asDict() for x in df.collect()]  # noqa: E731  a row a method or slice
    counted = r.counts.first()
    if counted is None:
        raise ValueError("no commit that can be replayed")
    return reports.bench_text(counted.asDict(), rows(r.scores), rows(r.matched), {"size": rows(r.by_size), "era": rows(r.by_era)})


def stats(engine: Engine, root: str, a: argparse.Namespace) -> str:
    roots = figures.known_roots(engine) if a.all else [root]
    if not (a.share or a.svg):
        return figures.stats_text(engine, roots, a.days, a.all)
    t = figures.totals(engine, roots, a.days)
    if a.svg:
        with open(a.svg, "w", encoding="utf-8") as f:
            f.write(figures.card_svg(t))
    return "\n".join(figures.card_lines(t))


def report(engine: Engine, a: argparse.Namespace) -> str:
    if a.summarize:
        return figures.summary_markdown(engine.spark, a.summarize)
    if a.validate:
        with open(a.validate, encoding="utf-8") as f:
            held = figures.posted(f.read(), engine.spark)
        wrong = figures.problems(held) if held is not None else ["no report found"]
        if wrong:
            raise ValueError("; ".join(wrong))
        return "valid"
    made = figures.report_of(engine, figures.known_roots(engine))
    address, carried = reports.report_address(made, a.address)
    return f"{reports.report_markdown(carried)}\n{address}"


def main(argv: list[str] | None = None, spark: SparkSession | None = None, given: TextIO | None = None, out: TextIO | None = None) -> int:
    """Runs a command; 0, or 1 with the reason on standard error.  The report is shown, never sent."""
    given, out = given or sys.stdin, out or sys.stdout
    a = parser().parse_args(argv)
    engine = Engine(spark or SparkSession.builder.appName("fathomline").getOrCreate(), os.path.expanduser(a.home))
    root = os.path.realpath(a.root)
    if a.command not in ("stats", "report", "hook"):
        root = hooks.repository_of(root) or root
    if a.command == "serve":
        server.serve(server.RepositoryService(engine, root), given, out)
        return 0
    several = not hooks.repository_of(root)
    run: dict[str, Callable[[], str]] = {
        "init": lambda: pretty(engine.init_below(root, a.yes) if several and not engine.source_files(root) else engine.init(root)),
        "status": lambda: pretty(engine.status(root)),
        "train": lambda: pretty(engine.train(root)),
        "rollback": lambda: pretty(engine.rollback(root)),
        "ask": lambda: ask(engine, root, a, given),
        "bench": lambda: bench(engine, root, a),
        "stats": lambda: stats(engine, root, a),
        "report": lambda: report(engine, a),
        "hook": lambda: hooks.run(engine, a.agent, a.moment, given.read(), a.budget_ms / 1000, a.min_files),
    }
    try:
        said = run[a.command]()
    except (ValueError, OSError) as e:
        print(str(e), file=sys.stderr)
        return 1
    if said:
        print(said, file=out)
    return 0
