"""Folders of repositories, rescans, time budgets, task lists and reports as text."""

import json
import os
import time
from urllib.parse import unquote

import pytest

from fathomline.operators import indexing, reports, transcripts
from fathomline.sources import files, workspace
from fathomline.streaming import rescan


def test_indexed_repositories(spark, tmp_path):
    home, roots = str(tmp_path / "home"), [str(tmp_path / "w" / n) for n in ("one", "two", "elsewhere/three")]
    assert workspace.cached(home) == [] and workspace.folder_of(home, roots[0]) != workspace.folder_of(home, roots[1])
    for r in roots:
        os.makedirs(r)
        at = workspace.record(home, r)
        indexing.IndexStore(spark, f"{at}/index", "tiny-1" if r != roots[1] else "other-1").save(spark.createDataFrame([("a", "1")], "path string, cid string"))
    stray = tmp_path / "home" / "stray-0"
    stray.mkdir()
    (stray / workspace.RECORD).write_text(json.dumps({"root": roots[0]}))
    assert sorted(workspace.cached(home)) == sorted(roots)
    assert [r for r, _ in workspace.indexed(home, str(tmp_path / "w"), fingerprint="tiny-1")] == sorted([roots[0], roots[2]], key=lambda r: workspace.folder_of(home, r))
    assert [r for r, _ in workspace.indexed(home, str(tmp_path / "w"), model="other")] == [roots[1]] and workspace.indexed(home, str(tmp_path / "w/one"), model="other") == []
    assert not workspace.indexed(home, str(tmp_path / "w/on"), fingerprint="tiny-1")  # a folder, not the start of a name
    _, at = workspace.indexed(home, roots[0], model="tiny")[0]
    assert os.path.basename(at) == "tiny-1"


def test_rescans(spark):
    scans = iter([[("a", "1")], [("a", "1")], [("a", "2")], None, [("a", "2")], [("a", "2")]])
    applied = []

    def scan():
        rows = next(scans)
        if rows is None:
            raise OSError("gone")
        return spark.createDataFrame(rows, "path string, cid string")

    r = rescan.Rescanner(scan, lambda df: applied.append(df.first().cid))
    waits = []
    assert r.run(3, waits.append) == 2 and applied == ["1", "2"] and len(waits) == 2 and min(waits) >= 2.0
    assert r.step()[0] is False and r.degraded and r.error == "gone"
    assert r.step()[0] is True and not r.degraded  # after a failure what is there is applied again
    assert r.step()[0] is False and applied == ["1", "2", "2"]
    assert rescan.pause(0.01) == 2.0 and rescan.pause(3.0) == 30.0


def test_time_budget():
    said = []
    log = lambda outcome, ms: said.append(outcome)
    assert rescan.within(5, lambda: ["x"], log) == ["x"] and rescan.within(5, list, log) == []
    assert rescan.within(0.05, lambda: time.sleep(0.4) or ["late"], log) == [] and said == ["injected", "quiet", "timeout"]


def test_task_list(spark):
    rows = spark.createDataFrame([("i1", "own/er", "c", "p", json.dumps([{"file": "a"}, {"file": "b", "line": 3}, {"file": "a"}]))], "instance_id string, repo string, base_commit string, problem_statement string, gold_context string")
    r = files.prepared_tasks(rows).first()
    assert r.repo_dir == "own__er" and r.gold_files == ["a", "b"]


def test_reports_as_text():
    bench = [{"files": "1k", "model": "m", "lexical": [0.1, 0.2, 0.3], "model_hits": [0.4, 0.5, 0.6], "adapter_hits": None} for _ in range(3)]
    report = {"repositories": {"count": "1-5", "languages": {"go": 0.5, "rust": 0.5}}, "usage": {"queries": "10-20"}, "bench": bench, "truncated": False}
    text = reports.report_markdown(report)
    assert "- usage: queries 10-20" in text and "  - languages: go 0.5, rust 0.5" in text and text.count("- bench (1k files, m): hit@1/3/10 lexical 0.10 / 0.20 / 0.30") == 3
    assert json.loads(text.split("```json\n")[1].split("\n```")[0]) == report
    whole, same = reports.report_address(report, "https://e.org/new?report=")
    assert same == report and json.loads(unquote(whole.split("report=")[1])) == report
    for most in range(200, len(whole), 40):
        address, carried = reports.report_address(report, "https://e.org/new?report=", most)
        assert carried["truncated"] and json.loads(unquote(address.split("report=")[1])) == carried
        assert len(address) <= most or (carried["bench"] == [] and carried["repositories"]["languages"] == {})
    assert report["bench"] == bench
    score = {"method": "model", "n": 45, "hit1": 0.5, "hit3": 0.75, "hit10": 1.0, "mrr": 0.6}
    slices = {"size": [{"label": "< 1k files", "n": 45, "lexical": 0.9, "model": 0.8, "adapter": None}]}
    lines = reports.bench_text({"scanned": 48, "eligible": 45, "evaluated": 45, "adapted": 25, "files_median": 14}, [score], [], slices).splitlines()
    assert lines[0].startswith("48 commits scanned, 45 eligible") and lines[3].split() == ["model", "45", "0.500", "0.750", "1.000", "0.600"] and lines[-1].split()[-1] == "-"
    table = reports.usage_table([{"name": "r", "queries": 10, "abstained": 3, "p50": 12}, {"name": "s", "queries": 2, "abstained": 1, "p50": None}]).splitlines()
    assert table[1].split() == ["r", "10", "30%", "12"] and table[2].split() == ["s", "2", "-", "-"]


@pytest.mark.parametrize(
    "hinted,touched,want",
    [
        (["src/a.py"], [], ("none", None, False)),
        (["src/a.py", "b.py"], [("src/a.py", "read"), ("b.py", "edited")], ("exact", "edited", True)),
        (["src/a.py"], [("src/c.py", "edited")], ("near", None, False)),
        (["src/a.py"], [("lib/test_a.py", "ran")], ("near", None, False)),
        (["src/a.py"], [("docs/x.md", "edited")], ("elsewhere", None, False)),
        ([], [("x", "read")], ("elsewhere", None, False)),
    ],
)
def test_similarity(spark, hinted, touched, want):
    frame = spark.createDataFrame([(hinted, touched)], "hinted array<string>, touched array<struct<path:string,action:string>>")
    r = transcripts.similarity(frame).first()
    assert (r.similarity, r.exact_by, r.first_pick) == want
