"""Queries that SQL can't express, against plain Python over the same rows; sources of the second kind."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.functions import code
from fathomline.operators import adapter, history, transcripts, usage
from fathomline.plans import lifecycles, registry
from fathomline.plans import history as history_plans
from fathomline.plans import usage as usage_plans
from fathomline.sources import files
from fathomline.streaming import run, sessions

from .compare import SF

Q = registry.queries()


def test_greedy_match_query(spark):
    e = usage_plans.events(spark, SF).withColumn("s", F.floor(F.col("s") / 100)).collect()
    want = set()
    for repo in {r.repo for r in e}:
        side = lambda k: sorted(((r.event_id, r.s) for r in e if r.repo == repo and r.kind == k), key=lambda x: (x[1], x[0]))
        free = side("view")
        for c, t in side("click"):
            near = [(abs(s - t), s, a) for a, s in free if t - 5 <= s <= t + 600]
            if near:
                _, s, a = min(near)
                free.remove((a, s))
                want.add((repo, c, a))
    assert {tuple(r) for r in Q["greedy_match"](spark, SF).collect()} == want and want


def test_eras_query(spark):
    c = history_plans.changes(spark, SF).groupBy("sha").agg(F.collect_set(F.substring("path", 1, 1)).alias("f"), F.max(F.when(F.col("test"), "python").otherwise("go")).alias("l"))
    rows = sorted((r.repo, r.n, set(r.f), r.l) for r in history_plans.tasks(spark, SF).join(c, "sha").select("repo", "n", "f", "l").collect())
    want = {}
    for repo in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == repo]
        starts, now = [0], mine[0]
        for i, r in enumerate(mine):
            if len(r[2] & now[2]) / len(r[2] | now[2]) < 0.4 or r[3] != now[3]:
                starts, now = [*starts, i], r
        ends = [*starts[1:], len(mine)]
        kept = [0] + [s for s, e in zip(starts, ends) if s and e - s >= 40]
        want |= {(repo, r[1]): max(k for k, s in enumerate(kept) if s <= i) for i, r in enumerate(mine)}
    assert {(r.repo, r.n): r.era for r in Q["eras"](spark, SF).collect()} == want


def test_transition_replay_query(spark):
    e = spark.read.parquet(f"{SF}/events.parquet").select("user_id", "event_id", F.expr(usage_plans.LOG).alias("e")).orderBy("event_id").collect()
    table = {(s, ev): n for m, s, ev, n in lifecycles.rows() if m == "index"}
    state, want = {}, set()
    for r in e:
        now = state.get(r.user_id, "uninitialized")
        state[r.user_id] = table.get((now, r.e), now)
        want.add((r.user_id, r.event_id, r.e, state[r.user_id], (now, r.e) in table))
    assert {tuple(r) for r in Q["transition_replay"](spark, SF).collect()} == want


def test_session_dedupe_query(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn").orderBy("conv_id", "turn").collect()
    want, shown, last = set(), {}, {}
    for r in turns:
        s, ts = str(r.conv_id), r.turn * 600
        if s in last and ts - last[s] > 86_400:
            shown[s] = []
        fresh = []
        for i in range(4):
            p = f"f{(r.turn + i * 2) % 5}"
            if r.turn % 4 != 3 and p not in shown.setdefault(s, []) and p not in fresh and len(fresh) < 3:
                fresh.append(p)
        if fresh:
            shown[s] += fresh
            last[s] = ts
        want |= {(s, r.turn, p) for p in fresh}
    assert {tuple(r) for r in Q["session_dedupe_stream"](spark, SF).collect()} == want


def test_tracker_stream_query(spark):
    """As the batch form, but for observations that are still open at the end."""
    items = sorted((str(r.session), r.n, r.event) for r in usage_plans.items(spark, SF).collect())
    want = set()
    for s in {i[0] for i in items}:
        walk = transcripts.Walk()
        want |= {(s, *r) for _, n, e in (i for i in items if i[0] == s) for r in walk.feed(n, e)}
    assert {tuple(r) for r in Q["tracker_stream"](spark, SF).collect()} == want


def test_sampled_negatives_query(spark):
    rows = Q["sample_negatives"](spark, SF).collect()
    for label in {r.label for r in rows}:
        ids = sorted(r.vec_id for r in rows if r.label == label)
        state, want = 7, {}
        for p in range(len(ids)):
            others = [x for x in range(len(ids)) if x != p]
            for i in range(min(5, len(others))):
                state = (state + 0x9E3779B97F4A7C15) % 2**64
                z = state
                z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 % 2**64
                z = (z ^ z >> 27) * 0x94D049BB133111EB % 2**64
                j = i + (z ^ z >> 31) % (len(others) - i)
                others[i], others[j] = others[j], others[i]
            want[ids[p]] = [ids[x] for x in others[:5]]
        assert {r.vec_id: r.negatives for r in rows if r.label == label} == want


def test_hash_encode_query(spark):
    rows = {r.doc_id: r.v for r in Q["hash_encode"](spark, SF).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(20).collect()}
    for i, t in texts.items():
        v = np.zeros(256)
        for w in code.word_pieces(t or ""):
            if len(w.encode()) >= 2 and w not in code.STOPWORDS:
                h = 0xCBF29CE484222325
                for b in code.stem(w).encode():
                    h = (h ^ b) * 0x100000001B3 % 2**64
                v[h % 256] += -1 if h >> 63 else 1
        assert np.allclose(rows[i], v / max(np.linalg.norm(v), 1e-30), atol=1e-6)


def test_fit_follows_the_gradient():
    """Against differences of the objective, and Adam written out, in double precision."""
    rng = np.random.default_rng(0)
    docs, q = rng.normal(size=(9, 4)), rng.normal(size=(5, 4))
    docs /= np.linalg.norm(docs, axis=1, keepdims=True)
    positives = [0, 1, 2, 3, 4]
    negatives = adapter.sample_negatives(positives, 9, 3, 1)
    p = adapter.Params(steps=4, lr=0.05, reg=0.1, tau=0.3)

    def objective(w):
        total = 0.0
        for x, pos, neg in zip(q, positives, negatives):
            u = x @ w / np.linalg.norm(x @ w)
            logits = docs[[pos, *neg]] @ u / p.tau
            total += np.log(np.exp(logits).sum()) - logits[0]
        return total / len(q) + p.reg * ((w - np.eye(4)) ** 2).sum()

    w, m, v = np.eye(4), np.zeros((4, 4)), np.zeros((4, 4))
    for t in range(1, p.steps + 1):
        g = np.zeros((4, 4))
        for i in range(4):
            for j in range(4):
                d = np.zeros((4, 4))
                d[i, j] = 1e-5
                g[i, j] = (objective(w + d) - objective(w - d)) / 2e-5
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - p.lr * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    assert np.allclose(adapter.fit(q.astype(np.float32), docs.astype(np.float32), positives, negatives, p), w, atol=2e-3)


def test_newest_examples_are_learned_from(spark):
    rng = np.random.default_rng(1)
    docs = spark.createDataFrame([("r", i, rng.normal(size=4).tolist()) for i in range(6)], "repo string, doc long, v array<double>")
    rows = [("r", n, n % 6, rng.normal(size=4).tolist()) for n in range(300)]
    frame = lambda rs: spark.createDataFrame(rs, "repo string, n long, pos long, q array<double>")
    whole, newest = (adapter.fit_per_repository(frame(rs), docs, adapter.Params(steps=3, negatives=3)).first() for rs in (rows, rows[:200]))
    assert whole.examples == 200 and whole.revision == newest.revision


def test_second_transcripts(spark, tmp_path):
    line = lambda **p: json.dumps({"type": "response_item", "timestamp": "2026-01-02T03:04:05Z", "payload": p})
    cell = 'await tools.exec_command({cmd: "cat \\"a b.py\\"\\nls -l"}); *** Update File: src/x.py\n'
    rows = [
        line(type="message", role="user", content="find it").replace('"role": "user"', '"role":"user"'),
        line(type="function_call", name="shell", arguments=json.dumps({"command": ["bash", "-lc", "hint ask where"]})),
        line(type="custom_tool_call", name="exec", input=cell),
        line(type="custom_tool_call", name="apply_patch", input="*** Begin Patch\n*** Add File: new.py\n*** Move to: moved.py\n"),
        line(type="local_shell_call", action={"command": ["sed", "-n", "1p", "y.py"]}),
        line(type="function_call", name="mcp__file_hints", arguments="{}"),
        line(type="message", role="developer", content="OUR HOOK suggests").replace('"type": "message"', '"type":"message"'),
        "not json but \"response_item\" \"function_call\"",
        json.dumps({"type": "other"}),
    ]
    (tmp_path / "s1.jsonl").write_text("\n".join(rows))
    lines = files.transcript_lines(spark, str(tmp_path / "s1.jsonl"))
    got = [(r.event, r.shell, r.edits, r.ts) for r in files.transcript_items_2(lines, r"(^|\s)hint ask(\s|$)", "file_hints", "OUR HOOK").orderBy("place").collect()]
    assert [g[0] for g in got] == ["user_turn", "call", "tool", "tool", "tool", "call", "hook"]
    assert got[2][1:3] == (['cat "a b.py"\nls -l'], ["src/x.py"]) and got[3][1:3] == ([], ["new.py", "moved.py"]) and got[4][1] == ["sed -n 1p y.py"]
    assert got[1][3] == 1767323045


def test_finding_transcripts(tmp_path):
    (tmp_path / "a/b/c").mkdir(parents=True)
    for name, size in (("s.jsonl", 5), ("a/t.jsonl", 50), ("a/b/c/deep.jsonl", 500), ("a/n.txt", 9)):
        (tmp_path / name).write_text("x" * size)
    names = lambda *a: [p.rsplit("/", 1)[1] for p in files.transcripts(str(tmp_path), *a)]
    assert names(2) == ["t.jsonl", "s.jsonl"] and names(3) == ["deep.jsonl", "t.jsonl", "s.jsonl"] and names(3, 4e9) == [] and files.transcripts(str(tmp_path / "none"), 1) == []


def test_bars_and_merges(spark):
    assert spark.range(1).select(usage.bar(F.lit(0.26), 10)).first()[0] == "███░░░░░░░"
    counts = spark.createDataFrame([("a", "calls", None, 3), ("b", "calls", None, 4), ("a", "session", "x 1", 1), ("b", "session", "x 1", 1)], "root string, measure string, key string, n long")
    assert {(r.measure, r.n) for r in usage.merged_counts(counts).collect()} == {("calls", 7), ("session", 1)}
    repos = spark.createDataFrame([("a", "m", 5), ("c", "b", 5), ("d", "z", 9)], "root string, name string, queries long")
    assert [(r.name, r.n) for r in usage.with_agent_counts(usage.busiest(repos, 2), counts.where("measure = 'calls'")).orderBy("name").collect()] == [("b", None), ("z", None)]


def test_bm25_by_products_and_by_joins(spark, monkeypatch):
    from fathomline.operators import lexical

    d = spark.createDataFrame([(1, "the cat sat on the mat"), (2, "a dog"), (3, None), (4, ""), (5, "cat and dog and cat"), (5, "cat and dog and cat")], "doc_id long, text string")
    q = spark.createDataFrame([(10, "cat cat dog"), (11, "unknown"), (12, "the")], "item_id long, text string")
    rows = lambda: sorted((r.item_id, r.doc_id, round(r.score, 9)) for r in lexical.bm25(q, d, "item_id", "doc_id").collect())
    products = rows()
    assert {(i, j) for i, j, _ in products} == {(10, 1), (10, 2), (10, 5), (12, 1)}
    once = d.where("doc_id <> 5")
    monkeypatch.setattr(lexical, "DENSE", 0)
    by_join = sorted((r.item_id, r.doc_id, round(r.score, 9)) for r in lexical.bm25(q, once, "item_id", "doc_id").collect())
    monkeypatch.undo()
    assert by_join == sorted((r.item_id, r.doc_id, round(r.score, 9)) for r in lexical.bm25(q, once, "item_id", "doc_id").collect()) and by_join
