"""Ranking, budgets, adapter, history, lifecycles, transcripts, usage, index store, git and streams."""

import random
import subprocess

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fathomline.operators import adapter, history, indexing, ranking, transcripts, usage
from fathomline.plans import lifecycles
from fathomline.sources import files, git, store
from fathomline.streaming import run, sessions

HINT = st.builds(lambda n: {"path": "p" * n}, st.integers(1, 400))


@given(st.lists(HINT, max_size=5), st.lists(HINT, max_size=3), st.lists(HINT, max_size=2), st.integers(-1, 5), st.booleans(), st.booleans())
@settings(max_examples=60, deadline=None)
def test_budgets(fs, fn, cf, k, with_functions, wants_config):
    a = ranking.budget(list(fs), list(fn), list(cf))
    assert sum(map(len, a)) <= 3 and (not a[0] or ranking.cost([*a[0], *a[1], *a[2]]) <= ranking.TOKEN_BUDGET)
    b = ranking.budget_ask(list(fs), list(fn), list(cf), k, with_functions, wants_config)
    assert sum(map(len, b)) <= min(max(k, 1), 3)
    assert len(b[0]) >= min(1, len(fs)) or b[2]


def test_thresholds():
    assert ranking.thresholds("base", "issue", False, False) is None
    assert ranking.thresholds("base", "request", True, False) == ranking.Thresholds(0.274, 0.0015)
    assert ranking.thresholds("small", "request", True, False) == ranking.Thresholds(0.2, 0.0)
    assert ranking.thresholds("small", "issue", False, False).min_top < 0
    assert ranking.thresholds("none", "request", False, False) is None


def test_top_floor_and_exact(spark):
    rows = spark.createDataFrame([(1, "a", 0.001), (1, "b", 0.001), (2, "a", 0.5), (2, "c", 0.5), (2, "b", 0.4)], "q_id int, path string, similarity double")
    top = ranking.top(rows, 2).withColumn("exact", F.lit(False))
    assert sorted((r.q_id, r.path) for r in top.collect()) == [(1, "a"), (1, "b"), (2, "a"), (2, "c")]
    assert sorted((r.q_id, r.path) for r in ranking.above_floor(top).collect()) == [(1, "a"), (2, "a"), (2, "c")]
    literals = spark.createDataFrame([(1, "parse"), (1, "x.py"), (1, "zz")], "q_id int, literal string")
    texts = spark.createDataFrame([(1, "a/x.py", ""), (1, "b.py", "def parse"), (1, "c.py", "parse it")], "q_id int, path string, text string")
    assert [r.path for r in ranking.exact_files(literals, texts).collect()] == ["a/x.py"]


def test_fusion(spark):
    orders = spark.createDataFrame([("a", 1), ("b", 2), ("b", 1), ("a", 3)], "item string, rank int")
    got = {r.item: r.score for r in ranking.reciprocal_ranks(orders).collect()}
    assert got["a"] == pytest.approx(1 / 61 + 1 / 63) and got["b"] > got["a"]
    answers = spark.createDataFrame([("r", 1, 0.2), ("s", 1, 0.9), ("s", 2, 0.8)], "repo string, rank int, similarity double")
    assert [r.repo for r in ranking.workspace_fused(answers, 2).collect()] == ["s", "r"]
    assert ranking.rendered("abstain", reason="margin") == "no confident hint (margin); use normal search."


def test_adapter_learns():
    rng = np.random.default_rng(0)
    docs = rng.normal(size=(40, 16)).astype(np.float32)
    docs /= np.linalg.norm(docs, axis=1, keepdims=True)
    turn = np.linalg.qr(rng.normal(size=(16, 16)))[0].astype(np.float32)
    q = (docs @ (0.6 * turn + 0.4 * np.eye(16, dtype=np.float32))).astype(np.float32)
    negatives = adapter.sample_negatives(list(range(40)), 40, 16, 7)
    w = adapter.fit(q, docs, list(range(40)), negatives, adapter.Params(steps=80, lr=5e-3))
    hit = lambda v: np.mean(np.argmax(v @ docs.T, axis=1) == np.arange(40))
    assert hit(q @ w) >= hit(q) and len(adapter.revision(w)) == 12
    assert np.allclose(adapter.apply(q[0], np.eye(16)), q[0] / np.linalg.norm(q[0]), atol=1e-6)
    assert (adapter.fit(q[:0], docs, [], []) == np.eye(16)).all()


def test_negatives():
    drawn = adapter.sample_negatives([0, 3, 3], 5, 10, 1)
    assert all(sorted(d) == [x for x in range(5) if x != p] for p, d in zip([0, 3, 3], drawn))
    assert adapter.sample_negatives([2], 50, 4, 9) == adapter.sample_negatives([2], 50, 4, 9)
    assert drawn[1] != drawn[2]


def test_history(spark):
    ch = spark.createDataFrame([("s1", "a", 1), ("s1", "b", 2), ("s2", "a", 1), ("s2", "b", 2), ("s2", "c", 3)], "sha string, path string, pos int")
    assert {(r.a, r.b): r.n for r in history.co_change(ch, 10).collect()} == {("a", "b"): 2, ("a", "c"): 1, ("b", "c"): 1}
    assert {(r.a, r.b): r.n for r in history.co_change(ch, 2).collect()} == {("a", "b"): 1}
    index = spark.createDataFrame([("b",), ("c",)], "path string")
    assert {r.sha: r.positive for r in history.first_positive(ch, index).collect()} == {"s1": "b", "s2": "b"}
    parents = [("1", []), ("2", ["1"]), ("3", ["1"]), ("4", ["2", "3"])]
    assert history.ancestors(parents, ["1", "3", "4"]) == {"1": set(), "3": {"1"}, "4": {"1", "3"}}
    tasks = [({"a"}, "py")] * 3 + [({"b"}, "py")] * 3 + [({"b"}, "go")]
    assert history.eras_of(tasks, least=3) == [0, 0, 0, 1, 1, 1, 1]
    assert history.eras_of(tasks, least=1)[-1] == 2


def test_lifecycles(spark):
    table = {(m, s, e): n for m, s, e, n in lifecycles.rows()}
    assert len(table) == len(lifecycles.rows())
    sizes = {"index": 18, "adapter": 14, "query": 5, "model": 10, "session": 11, "indexer": 8, "bench": 7, "report": 7, "tracker": 16, "connection": 22, "resident": 7}
    assert {m: sum(k[0] == m for k in table) for m in sizes} == sizes
    for m in sizes:
        states = {k[1] for k in table if k[0] == m} | {n for k, n in table.items() if k[0] == m}
        events = {k[2] for k in table if k[0] == m}
        for s in states:
            for e in events:
                if (m, s, e) in table:
                    assert lifecycles.step(m, s, e) == table[m, s, e]
                else:
                    with pytest.raises(lifecycles.Illegal):
                        lifecycles.step(m, s, e)
    log = spark.createDataFrame([("r", 1, "init"), ("r", 2, "refresh"), ("r", 3, "index_done")], "repo string, n int, event string")
    got = sorted((r.n, r.state, r.legal) for r in lifecycles.replayed(log, "uninitialized", "index", "repo", "n", "event").collect())
    assert got == [(1, "indexing", True), (2, "indexing", False), (3, "ready", True)]


def test_walk():
    w = transcripts.Walk()
    assert w.feed(0, "tool") == [] and w.feed(1, "call") == []
    out = [x for n in range(2, 14) for x in w.feed(n, "tool")]
    assert out == [(1, 10)] and w.state == "seeking"
    assert w.feed(20, "hook") == [] and w.feed(21, "user_turn") == [] and w.feed(22, "call") == [(20, 0)]
    assert w.feed(23, "tool") == [] and w.feed(24, "user_turn") == [(22, 1)]


def test_greedy_is_the_plain_form():
    rng = random.Random(3)
    for _ in range(200):
        calls = sorted(((i, rng.randrange(3000)) for i in range(rng.randrange(12))), key=lambda x: (x[1], x[0]))
        answers = sorted(((i, rng.randrange(3000)) for i in range(rng.randrange(12))), key=lambda x: (x[1], x[0]))
        assert transcripts.greedy_sorted(calls, answers) == transcripts.greedy_pairs(calls, answers)


def test_usage(spark):
    df = spark.createDataFrame([("a", float(x)) for x in range(1, 5)] + [("b", 7.0)], "k string, v double")
    got = {r.k: (r.n, r.p50, r.p95) for r in usage.nearest_rank(df, ["k"], "v", {"p50": 0.5, "p95": 0.95}).collect()}
    assert got == {"a": (4, 3.0, 4.0), "b": (1, 7.0, 7.0)}
    answers = spark.createDataFrame([("r", 1, 100, ["x"]), ("r", 2, 100, ["y"])], "repo string, id int, ts long, hinted array<string>")
    edits = spark.createDataFrame([("r", 86_500, "x"), ("r", 86_501, "y"), ("s", 120, "y")], "repo string, ts long, path string")
    assert {r.id: r.useful for r in usage.useful(answers, edits).collect()} == {1: True, 2: False}
    assert spark.range(1).select(usage.sparkline(F.array(F.lit(0), F.lit(4), F.lit(8)))).first()[0] == "·▄█"


def test_index_store(spark, tmp_path):
    store = indexing.IndexStore(spark, str(tmp_path / "index"), "hash-64")
    assert store.open() is None
    first = spark.createDataFrame([("a", "1", [1.0])], "path string, cid string, v array<double>")
    store.save(first)
    store.save(first.limit(0).union(first), complete=False)
    assert store.open().collect() == first.collect()
    now = spark.createDataFrame([("a", "2"), ("b", "1")], "path string, cid string")
    plan = {r.path: r.action for r in indexing.refresh_plan(first, now).collect()}
    assert plan == {"a": "replace", "b": "add"} and indexing.changed(first.select("path", "cid"), now)
    fresh = indexing.refreshed(first, now, lambda f: f.withColumn("v", F.array(F.lit(2.0))))
    assert sorted(r.path for r in fresh.collect()) == ["a", "b"]
    other = indexing.IndexStore(spark, str(tmp_path / "index"), "other")
    assert other.open() is None


def test_index_build_goes_on_where_it_was(spark, tmp_path):
    asked = []

    def encode(f):
        asked.append(f.count())
        if len(asked) == 3:
            raise RuntimeError("broken off")
        return f.withColumn("v", F.array(F.lit(1.0)))

    files = spark.range(40).select(F.concat(F.lit("f"), "id").alias("path"), F.lit("1").alias("cid"))
    store = indexing.IndexStore(spark, str(tmp_path / "index"), "m")
    with pytest.raises(RuntimeError):
        store.refresh(files, encode, chunk=10)
    assert store.open() is None
    finished = sum(asked[:2])
    del asked[:]
    asked += [0] * 9
    got = store.refresh(files, encode, chunk=10)
    assert got.count() == 40 and sum(asked) == 40 - finished and not store.part.numbers()
    later = files.where("path <> 'f0'").withColumn("cid", F.when(F.col("path") == "f1", "2").otherwise(F.col("cid")))
    del asked[9:]
    asked += [0]
    assert sorted((r.path, r.cid) for r in store.refresh(later, encode).collect()) == sorted((r.path, r.cid) for r in later.collect()) and asked[-1] == 1
    assert store.refresh(files.limit(0), encode).count() == 0


def test_adapter_store(spark, tmp_path):
    store = adapter.AdapterStore(spark, str(tmp_path / "a"))
    assert store.load() is None
    with pytest.raises(ValueError):
        store.rollback()
    one, two = np.eye(3, dtype=np.float32) * np.float32(1.0001), np.eye(3, dtype=np.float32) * 2
    r1, r2 = store.save(one, "m", 20, "c1"), store.save(two, "m", 30)
    held = store.load()
    assert held["revision"] == r2 != r1 and held["base"] == "m" and held["dim"] == 3 and (held["weights"] == two).all()
    back = store.rollback()
    assert back["revision"] == r1 and np.abs(back["weights"] - one).max() < 1e-3 and back["cutoff"] == "c1"
    with pytest.raises(ValueError):
        store.rollback()


def test_daily_log(spark, tmp_path):
    log = store.DailyLog(spark, str(tmp_path / "log"), files.HOOKS)
    assert log.read().count() == 0 and log.prune(10**9) == []
    day = 86_400
    row = lambda ts, s: (ts, "a", "prompt", "/r", s, 5, "injected", ["x"])
    log.append(spark.createDataFrame([row(100 * day + 5, "old"), row(131 * day, "new")], files.HOOKS))
    log.append(spark.createDataFrame([row(101 * day + 50, "edge")], files.HOOKS))
    now = 131 * day + 60
    assert {r.session for r in log.read(now=now).collect()} == {"new"} and {r.session for r in log.read(since=101 * day).collect()} == {"edge", "new"}
    assert log.prune(now) == [100] and {r.session for r in log.read().collect()} == {"edge", "new"}
    held = store.Versions(spark, str(tmp_path / "latest"))
    for n in (1, 2, 3):
        held.write(spark.range(n), keep=1)
    assert held.numbers() == [2, 3] and held.read().count() == 3 and held.read(2).count() == 2 and held.read(9) is None


@pytest.fixture
def repository(tmp_path):
    root = tmp_path / "repo"
    root.mkdir()
    sh = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@e", *a], check=True, capture_output=True)
    sh("init", "-q")
    (root / "a.py").write_text("def a(): pass\n")
    (root / ".gitignore").write_text("skip.py\n")
    sh("add", "."), sh("commit", "-qm", "First\n\nbody line")
    (root / "b.py").write_text("x\n"), (root / "a.py").write_text("def b(): pass\n")
    sh("add", "."), sh("commit", "-qm", "Second")
    (root / "skip.py").write_text("y"), (root / "new.py").write_text("z"), (root / "b.py").write_text("changed")
    return root


def test_git_source(spark, repository):
    spark.dataSource.register(git.GitSource)
    read = lambda t, **o: spark.read.format("git").options(repositories=str(repository), table=t, **o).load()
    cids = {r.path: r.cid for r in read("files").collect()}
    assert set(cids) == {"a.py", "b.py", "new.py", ".gitignore"} and cids["b.py"].startswith("m") and len(cids["a.py"]) == 40
    log = read("commits").orderBy("n").collect()
    assert [(r.subject, r.body, sorted(r.paths), r.parent is None) for r in log] == [("Second", "", ["a.py", "b.py"], False), ("First", "body line", [".gitignore", "a.py"], True)]
    tree = {r.path: r.blob for r in read("trees").collect()}
    assert dict(git.blobs(str(repository), [tree["a.py"], "0" * 40])) == {tree["a.py"]: "def b(): pass\n"}
    assert git.discover(str(repository.parent)) == [str(repository)]


def test_files_and_logs(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s/a.py").write_bytes(b"ok \xff"), (tmp_path / "s/yarn.lock").write_text("x"), (tmp_path / "s/c.toml").write_text("k=1")
    assert {r.path: r.kind for r in files.walk(spark, str(tmp_path / "s")).collect()} == {"a.py": "source", "c.toml": "config"}
    (tmp_path / "u.jsonl").write_text('{"ts": 100, "kind": "ask", "ms": 5}\nbroken\n{"ts": 5000000, "kind": "ask", "ms": 7}\n')
    assert files.usage_log(spark, str(tmp_path / "u.jsonl")).count() == 2
    assert files.usage_log(spark, str(tmp_path / "u.jsonl"), now=5_000_100).count() == 1
    lines = [
        '{"type": "user", "timestamp": "2026-01-02T03:04:05Z", "message": {"content": "find it"}}',
        '{"type": "assistant", "timestamp": "2026-01-02T03:04:06Z", "message": {"content": [{"type": "tool_use", "name": "Bash", "input": {"command": "hint ask x"}}]}}',
        '{"type": "assistant", "timestamp": "2026-01-02T03:04:07Z", "message": {"content": [{"type": "tool_use", "name": "Read", "input": {"file_path": "/r/a.py"}}]}}',
        "not json",
    ]
    (tmp_path / "t.jsonl").write_text("\n".join(lines))
    items = files.transcript_items(files.transcript_lines(spark, str(tmp_path / "t.jsonl")), "hint ask").orderBy("ts").collect()
    assert [(r.event, r.reads, r.shell) for r in items] == [("user_turn", [], []), ("call", [], ["hint ask x"]), ("tool", ["/r/a.py"], [])]


def test_streams(spark, tmp_path):
    rows = [("s", 1, "call"), ("s", 2, "tool"), ("s", 3, "eof"), ("t", 1, "tool")]
    spark.createDataFrame(rows, "session string, n long, event string").write.parquet(str(tmp_path / "items"))
    out = run.drained(sessions.walk_stream(run.stream_of(spark, str(tmp_path / "items"), "session string, n long, event string")))
    assert [tuple(r) for r in out.collect()] == [("s", 1, 1)]
    hints = [("s", 1, 0, "ok", ["a", "b"]), ("s", 2, 50, "ok", ["b", "c"]), ("s", 3, 100, "abstain", ["d"]), ("s", 4, 90_000, "ok", ["a"])]
    schema = "session string, n long, ts long, state string, paths array<string>"
    spark.createDataFrame(hints, schema).write.parquet(str(tmp_path / "hints"))
    out = run.drained(sessions.fresh_hints_stream(run.stream_of(spark, str(tmp_path / "hints"), schema)))
    assert sorted((r.n, r.path) for r in out.collect()) == [(1, "a"), (1, "b"), (2, "c"), (4, "a")]
    events = spark.createDataFrame([("2026-01-01 01:00:00", "v"), ("2026-01-03 05:00:00", "v")], "t string, kind string").select(F.to_timestamp("t").alias("ts"), "kind")
    events.write.parquet(str(tmp_path / "events"))
    out = run.drained(sessions.daily_counts_stream(run.stream_of(spark, str(tmp_path / "events"), "ts timestamp, kind string")))
    assert out.count() <= 2


def test_reports(spark):
    from fathomline.operators import reports

    posts = spark.createDataFrame([('x\n```json\n{"a": 1}\n```\n{',), ('so {"b": {"c": 2}} it is',), ("none",)], "t string")
    assert [r[0] for r in posts.select(reports.fenced_json(F.col("t"))).collect()] == ['{"a": 1}', '{"b": {"c": 2}}', None]
    v = spark.createDataFrame([("a", x) for x in (4, 1, 3, 2)], "k string, v int")
    assert [tuple(r) for r in reports.grouped_upper_median(v, ["k"], "v").collect()] == [("a", 3, 4)]
    t = spark.createDataFrame([(1, "p", 3, "read"), (1, "p", 5, "edited"), (1, "q", 4, "ran")], "s int, path string, n int, action string")
    assert sorted((r.path, r.first, r.action) for r in reports.first_touches(t, "s").collect()) == [("p", 3, "edited"), ("q", 4, "ran")]


def test_fitted_query():
    from fathomline.operators import reports

    build = reports.query_builder("")
    whole, dropped = reports.fitted_query(len, "q", "", 10, build)
    assert (whole, dropped) == ("q", 0)
    fitted, dropped = reports.fitted_query(len, "q", "o" * 3000 + "n" * 300, 500, build)
    assert dropped > 2500 and fitted.endswith("n" * 200) and len(fitted) <= 500
