"""Replay from a repository to scores, on a history whose numbers are known."""

import subprocess

import pytest

from fathomline.operators import encoders, replay
from fathomline.sources import git

TOPICS = [
    ("pkg/auth.py", "def login(user):\n    return user\n", "login session password"),
    ("pkg/upload.py", "def send(part):\n    return part\n", "upload part retry"),
    ("web/picker.ts", "export function pick() {}\n", "picker listbox choice"),
    ("web/theme.js", "export function shade() {}\n", "theme colour shade"),
    ("core/ledger.rs", "pub fn post() {}\n", "ledger posting balance"),
    ("core/Index.java", "class Index {}\n", "index term lookup"),
    ("core/heap.c", "int heap(void) { return 0; }\n", "heap memory release"),
]


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    """45 commits that change one topic file each; four that are no tasks: only a test, seven files, only
    prose, only a new file."""
    root = tmp_path_factory.mktemp("history") / "repo"
    root.mkdir()
    sh = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@e", *a], check=True, capture_output=True)

    def add(path, body, mode="a"):
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        with open(root / path, mode) as f:
            f.write(body)

    def commit(message):
        sh("add", "-A"), sh("commit", "-qm", message)

    sh("init", "-q", "-b", "main")
    for path, body, _ in TOPICS:
        add(path, body)
    add("pkg/tests/test_auth.py", "def test_login():\n    pass\n")
    add("README.md", "demo\n")
    for i in range(6):
        add(f"extra/e{i}.py", "x = 1\n")
    commit("layout")
    for i in range(45):
        path, _, words = TOPICS[i % len(TOPICS)]
        add(path, f"{'#' if path.endswith('.py') else '//'} {words} {i}\n")
        commit(f"mend {words} ({i})\n\nmore on {words}")
        if i == 10:
            add("pkg/tests/test_auth.py", "# more\n"), commit("tests only")
        elif i == 20:
            for k in range(6):
                add(f"extra/e{k}.py", "y = 2\n")
            add("pkg/auth.py", "# z\n"), commit("seven at once")
        elif i == 30:
            add("README.md", "more\n"), commit("prose only")
        elif i == 40:
            add("pkg/fresh.py", "def fresh():\n    pass\n"), commit("a new file")
    return str(root)


def run(spark, root, **kw):
    spark.dataSource.register(git.GitSource)
    read = lambda t: spark.read.format("git").options(repositories=root, table=t, limit="4000").load()
    return replay.replay(read("commits"), git.trees_of, git.texts_of, read("graph"), encoders.HashEncoder(128), replay.Options(**kw))


def test_replay(spark, repository):
    held = run(spark, repository)
    c = held.counts.first()
    assert (c.scanned, c.eligible, c.evaluated, c.adapted, c.files_median) == (48, 45, 45, 25, 14)
    all_ = {r.method: r for r in held.scores.collect()}
    matched = {r.method: r for r in held.matched.collect()}
    assert set(matched) == {"lexical (BM25)", "model", "model + adapter"} and {r.n for r in matched.values()} == {25} and {r.n for r in all_.values()} == {45}
    assert matched["lexical (BM25)"].hit1 > 0.9 and matched["model + adapter"].hit3 > 0.9
    assert [(r.label, r.n) for r in held.by_size.collect()] == [("< 1k files", 45)]
    assert sum(r.n for r in held.by_era.collect()) == 45
    # the tasks that an adapter scores are the last 25, as it needs 20 before it
    assert {r.t for r in held.tasks.where("adapted").collect()} == set(range(20, 45))
    # each rank is that of a plain sort
    assert held.tasks.where("lexical is null or model is null").count() == 0


def test_replay_options(spark, repository):
    with_tests = run(spark, repository, with_tests=True, adapter=False)
    assert with_tests.counts.first().eligible == 46 and with_tests.counts.first().adapted == 0 and with_tests.matched.count() == 0
    small = run(spark, repository, commits=10, train=20, step=5).counts.first()
    assert (small.eligible, small.evaluated, small.adapted) == (30, 10, 10)


def test_blocks_learn_from_common_ancestors_only(spark):
    """A branch that isn't merged before a block ends is not learned from."""
    tasks = spark.createDataFrame([("r", i, f"c{i}") for i in range(50)], "repo string, t long, sha string")
    parents = {f"c{i}": [f"c{i - 1}"] if i else [] for i in range(50)}
    parents["c10"], parents["c11"], parents["c40"] = ["c5"], ["c9"], ["c39", "c10"]  # c10 is a side branch until c40
    log = spark.createDataFrame([("r", i, f"c{i}", parents[f"c{i}"]) for i in range(50)], "repo string, n long, sha string, parents array<string>")
    got = replay.blocks(tasks, log, replay.Options(commits=300, train=200, step=5)).collect()
    for block in {r.block for r in got}:
        train = {r.t for r in got if r.block == block and not r.scored}
        now = {r.t for r in got if r.block == block and r.scored}
        assert max(train) < min(now) and (10 in train) == (min(now) >= 40)
    assert {r.t for r in got if r.scored} == set(range(25, 50))  # 19 of the first 20 tasks are known at first


def test_the_source_tables(spark, repository):
    spark.dataSource.register(git.GitSource)
    log = spark.read.format("git").options(repositories=repository, table="graph").load().orderBy("n").collect()
    assert len(log) == 50 and log[0].parents == [] and all(r.parents == [log[i].sha] for i, r in enumerate(log[1:]))
    wanted = spark.createDataFrame([(repository, log[0].sha), (repository, log[0].sha), (repository, log[-1].sha)], "repo string, rev string")
    trees = git.trees_of(wanted).collect()
    assert len(trees) == 14 + 15 and not any(r.path == "README.md" for r in trees)
    texts = git.texts_of(spark.createDataFrame([(repository, trees[0].blob), (repository, "0" * 40)], "repo string, blob string"), most=5).collect()
    assert [(r.blob, len(r.text)) for r in texts] == [(trees[0].blob, 5)]
