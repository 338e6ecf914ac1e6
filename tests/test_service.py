"""The engine of a repository, its figures, hooks, tool server and command line, on repositories made here."""

import io
import json
import os
import subprocess

import pytest

from fathomline.operators import encoders
from fathomline.operators.asking import Options
from fathomline.service import command, figures, hooks, server
from fathomline.service.engine import Engine, latest_values

BODIES = {
    "src/auth.py": '"""Login and token verification."""\ndef login(user):\n    pass\ndef verify_token(t):\n    pass\n',
    "src/upload.go": "// Package upload tries again when a transfer runs out of time.\npackage upload\nfunc Retry() {}\n",
    "web/picker.ts": "/** Listbox to pick a model from. */\nexport function renderPicker() {}\n",
    "Dockerfile": "FROM rust\nRUN cargo build\n",
    "notes.md": "prose\n",
}
WORDS = {"src/auth.py": "login token", "src/upload.go": "upload transfer retry", "web/picker.ts": "picker listbox"}
NOW = 1_800_000_000


def sh(root, *args):
    subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@e", *args], check=True, capture_output=True)


def made(root, commits=24):
    for path, body in BODIES.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(body)
    sh(root, "init", "-q", "-b", "main"), sh(root, "add", "-A"), sh(root, "commit", "-qm", "layout")
    for i in range(commits):
        path = list(WORDS)[i % 3]
        with open(root / path, "a") as f:
            f.write(f"{'#' if path.endswith('.py') else '//'} {WORDS[path]} {i}\n")
        sh(root, "commit", "-qam", f"mend {WORDS[path]} {i}")
    return str(root)


@pytest.fixture(scope="module")
def place(tmp_path_factory):
    top = tmp_path_factory.mktemp("service")
    for name in ("one", "two"):
        (top / "w" / name).mkdir(parents=True)
    return top, made(top / "w" / "one"), made(top / "w" / "two", 2)


@pytest.fixture(scope="module")
def engine(spark, place):
    e = Engine(spark, str(place[0] / "home"), encoders.HashEncoder(256), clock=lambda: NOW)
    e.init(place[1]), e.init(place[2])
    return e


def test_refresh_reads_what_changed(spark, place, tmp_path):
    e = Engine(spark, str(tmp_path / "home"), encoders.HashEncoder(64))
    root = tmp_path / "r"
    root.mkdir()
    made(root, 0)
    assert e.status(str(root))["index"] == "missing"
    first = e.refresh(str(root))
    assert (first["add"], first["keep"]) == (4, 0) and e.refresh(str(root))["keep"] == 4
    (root / "src/auth.py").write_text("def sign_in():\n    pass\n"), (root / "web/picker.ts").unlink(), (root / "new.py").write_text("x = 1\n")
    again = e.refresh(str(root), functions=True)
    assert (again["keep"], again["add"], again["replace"], again["remove"]) == (2, 1, 1, 1)
    now = e.status(str(root))
    assert (now["index"], now["files"], now["configs"], now["functions"]) == ("ready", 3, 1, 2) and now["not_indexed"] == {"md": 1}
    held = e._index(str(root), "functions").whole.numbers()
    e.refresh(str(root), functions=True)
    assert e._index(str(root), "functions").whole.numbers() == held  # files without functions aren't read again
    assert latest_values(e.folder(str(root)), "index")["files"] == 4
    # no git: any folder; and a file that is no UTF-8
    plain = tmp_path / "plain"
    plain.mkdir()
    (plain / "a.py").write_bytes(b"def a\xff():\n    pass\n"), (plain / "empty.py").write_text("")
    assert e.refresh(str(plain))["add"] == 2 and e.status(str(plain))["files"] == 2 and e.train(str(plain))["status"] == "skipped"


def test_adapter(engine, place):
    one, two = place[1], place[2]
    assert engine.status(one)["adapter"]["examples"] >= 20 and engine.status(two)["adapter"] is None
    assert engine.train(one, force=False)["status"] == "kept" and engine.train(two)["status"] == "skipped"
    first = engine.status(one)["adapter"]["revision"]
    sh(one, "commit", "-q", "--allow-empty", "-m", "more")
    engine.train(one)
    assert engine.rollback(one) == {"status": "restored", "revision": first}
    assert engine.rollback(one) == {"status": "removed"} and engine.status(one)["adapter"] is None
    with pytest.raises(ValueError):
        engine.rollback(one)
    assert engine.train(one, force=False)["status"] == "fitted"


def test_answers_and_logs(engine, place):
    top, one, two = place
    before = engine.usage(one).read(now=NOW).count()
    got = engine.ask_one(one, "login token verification", options=Options(adapt=False))
    assert got["state"] == "ok" and got["hints"][0]["path"] == "src/auth.py"
    exact = engine.ask_one(one, "who calls verify_token here", log=False)
    assert [(h["path"], h["exact"]) for h in exact["hints"]][:1] == [("src/auth.py", True)]
    rows = engine.usage(one).read(now=NOW).collect()
    assert len(rows) == before + 1 and rows[-1].hinted[0] == "src/auth.py" and rows[-1].model == "hash-256"
    both = engine.ask_below(str(top / "w"), "login token verification", options=Options(adapt=False))
    assert both["state"] == "ok" and [h["path"] for h in both["hints"][:2]] in ([f"{a}/src/auth.py" for a in p] for p in (("one", "two"), ("two", "one")))
    assert engine.ask_below(str(top / "none"), "login")["state"] == "empty_index"
    assert engine.ask_one(str(top / "none"), "login", log=False)["state"] == "empty_index"
    engine.refresh(one, functions=True)
    named = engine.ask_one(one, "verify token", options=Options(functions=True, adapt=False), log=False)["hints"]
    assert ("verify_token", 4) in [(h["name"], h["line"]) for h in named]
    with pytest.raises(ValueError):
        many = top / "many"
        for i in range(11):
            (many / f"r{i}" / ".git").mkdir(parents=True)
        engine.init_below(str(many))


def test_hooks(engine, place):
    one = place[1]
    fire = lambda moment, session="s1", agent="x", budget=60, least=0, **event: hooks.run(engine, agent, moment, json.dumps({"session": session, "cwd": one, **event}), budget, least)
    shown = fire("prompt", prompt="login token verification")
    assert "- src/auth.py" in shown and "- src/auth.py" not in fire("prompt", prompt="login token verification")  # once a session
    assert "- src/auth.py" in fire("search", "s2", command="rg 'verify.*token' src", results=0, prompt="login")
    assert fire("search", "s3", command="rg token", results=5) == "" and fire("search", "s3", command="ls", results=0) == ""
    assert fire("prompt", "s3", prompt=" ") == "" and fire("start", "s3") == "" and fire("prompt", "s3", prompt="login", least=3000) == ""
    assert hooks.run(engine, "x", "prompt", "not json") == "" and hooks.run(engine, "x", "prompt", json.dumps({"session": "s", "cwd": "/", "prompt": "login"})) == ""
    assert fire("prompt", "s4", prompt="login token", budget=0.001) == ""  # too late: silence, but logged
    runs = {(r.session, r.outcome) for r in engine.hook_log().read().collect()}
    assert {("s1", "injected"), ("s2", "injected"), ("s4", "timeout")} <= runs and not any(s == "s3" for s, _ in runs)
    # a session's memory lasts a day from its last showing
    assert hooks.shown_before(engine, "s1") >= {"src/auth.py"}
    later = Engine(engine.spark, engine.home, engine.encoder, clock=lambda: NOW + hooks.TTL_S + 1)
    assert hooks.shown_before(later, "s1") == set()


def test_tool_server(engine, place):
    said = io.StringIO()
    ask = lambda i, method, **params: json.dumps({"jsonrpc": "2.0", "id": i, "method": method, "params": params})
    call = lambda i, name, **given: ask(i, "tools/call", name=name, arguments=given)
    lines = [
        ask(1, "initialize"), json.dumps({"jsonrpc": "2.0", "method": "notifications/initialized"}), ask(2, "tools/list"), call(3, "where_next", query="login token verification"),
        call(4, "refresh_index"), call(5, "status"), call(6, "where_next"), call(7, "other"), ask(8, "other"), "{", "", call(9, "where_next", query=" "), call(10, "where_next", query="login", start=True), "[]",
    ]
    server.serve(server.RepositoryService(engine, place[1]), lines, said)
    got = [json.loads(x) for x in said.getvalue().splitlines()]
    by = {g["id"]: g for g in got if g["id"] is not None}
    body = lambda i: json.loads(by[i]["result"]["content"][0]["text"])
    assert len(got) == 12 and [t["name"] for t in by[2]["result"]["tools"]] == ["where_next", "refresh_index", "status"]
    assert body(3)["state"] == "ok" and len(body(3)["hints"]) <= 3 and body(4)["status"] == "ok" and body(5)["index"] == "ready"
    assert by[6]["error"]["code"] == server.BAD_PARAMS and by[7]["error"]["code"] == server.BAD_PARAMS and by[8]["error"]["code"] == server.NO_METHOD
    assert body(9)["state"] == "error" and by[9]["result"]["isError"] and body(10)["state"] == "abstain"
    assert {g["error"]["code"] for g in got if g["id"] is None} == {server.NOT_JSON, server.BAD_REQUEST}

    class Broken:
        def status(self):
            raise RuntimeError("gone\nmore")

    assert json.loads(server.answered(Broken(), call(1, "status"))["result"]["content"][0]["text"])["reason"] == "gone"


def test_figures(spark, engine, place, tmp_path):
    one, two = place[1], place[2]
    empty = Engine(spark, str(tmp_path / "home"), encoders.HashEncoder(64), clock=lambda: NOW)
    assert figures.totals(empty, [])["queries"] == 0 and not figures.problems(figures.report_of(empty, []))
    rows = [(NOW - 3600 * i, "request", "abstain" if i % 4 == 0 else "ok", 10 * i, "hash-256", i % 2 == 0, 1, [] if i % 4 == 0 else ["src/auth.py"]) for i in range(1, 13)]
    e = Engine(spark, str(tmp_path / "other"), encoders.HashEncoder(256), clock=lambda: NOW)
    e.refresh(one), e.usage(one).append(spark.createDataFrame(rows, figures.files.USAGE))
    with open(os.path.join(one, "src/auth.py"), "a") as f:
        f.write("# changed\n")
    t = figures.totals(e, [one])
    assert (t["queries"], t["abstained"], t["answered"], t["hints"]) == (12, 3, 9, 9) and t["useful_share"] == 1.0 and t["p50"] == 70 and len(t["days"]) == 30
    sh(one, "checkout", "-q", "src/auth.py")
    assert figures.totals(e, [one])["useful_share"] == 0.0  # commits of today's date lie before these answers
    card, image = "\n".join(figures.card_lines(t)), figures.card_svg(t)
    assert "one" not in card.replace("none", "") and "auth" not in card + image and image.startswith("<svg") and image.endswith("</svg>")
    r = figures.report_of(e, [one])
    assert figures.problems(r) == [] and r["usage"]["queries"] == "10-49" and r["quality"]["abstain_rate"] == 0.25 and r["reliability"]["states"] == {"abstain": 0.25, "ok": 0.75}
    assert r["repositories"]["languages"] == {"go": 30, "python": 30, "typescript": 30} and r["setup"]["model"] == "lexical" and one not in json.dumps(r)
    assert figures.problems({**r, "schema": 9}) == ["unsupported schema 9"] and figures.problems({**r, "quality": {"abstain_rate": 1.5, "hint_usefulness": None}}) == ["a value is out of range"]
    assert figures.problems({**r, "more": 1}) and figures.problems({"schema": 1}) and figures.problems({**r, "usage": 3})
    assert figures.posted(f"see\n```json\n{json.dumps(r)}\n```\n", spark) == r and figures.posted("none", spark) is None
    (tmp_path / "r.jsonl").write_text("\n".join([json.dumps(r)] * 3 + ["{broken"]))
    assert "| lexical | 3 | 0.25 |" in figures.summary_markdown(spark, str(tmp_path / "r.jsonl"))


def test_command_line(spark, place, tmp_path, capsys):
    def run(*args, given=""):
        out = io.StringIO()
        code = command.main(["--home", str(tmp_path / "home"), "--root", place[1], *args], spark, io.StringIO(given), out)
        return code, out.getvalue()

    assert json.loads(run("init")[1])["adapter"]["status"] == "fitted" and json.loads(run("status")[1])["index"] == "ready"
    code, said = run("ask", "login token verification", "--no-adapter", "--context-file", "-", given="earlier talk of tokens")
    assert code == 0 and "src/auth.py" in said
    assert json.loads(run("ask", "login token", "-k", "1", "--json")[1])["state"] in ("ok", "abstain")
    assert run("ask", " ")[0] == 1 and "empty query" in capsys.readouterr().err
    assert json.loads(run("rollback")[1])["status"] == "removed" and run("rollback")[0] == 1
    code, said = run("bench", "--commits", "12", "--no-adapter")
    assert code == 0 and "commits scanned" in said and "model" in said
    assert "queries" in run("stats")[1] and "one" in run("stats", "--all")[1]
    assert "<svg" not in run("stats", "--svg", str(tmp_path / "card.svg"))[1] and (tmp_path / "card.svg").read_text().startswith("<svg")
    code, said = run("report")
    assert code == 0 and "```json" in said and said.strip().splitlines()[-1].startswith("https://")
    (tmp_path / "post.md").write_text(said)
    assert run("report", "--validate", str(tmp_path / "post.md"))[1].strip() == "valid"
    (tmp_path / "bad.md").write_text("nothing")
    assert run("report", "--validate", str(tmp_path / "bad.md"))[0] == 1
    event = json.dumps({"session": "c", "cwd": place[1], "prompt": "login token verification"})
    assert "src/auth.py" in run("hook", "x", "prompt", "--budget-ms", "60000", "--min-files", "0", given=event)[1]
    assert '"tools"' in run("serve", given=json.dumps({"jsonrpc": "2.0", "id": 1, "method": "tools/list"}) + "\n")[1]
    with pytest.raises(SystemExit):
        run("ask", "x", "-k", "4")
