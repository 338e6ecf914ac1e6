"""The whole answer on a repository of five files, and encoders."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.functions import code
from fathomline.operators import asking, encoders, ranking

FILES = {
    "src/auth.py": '"""Login and token verification."""\ndef login(user):\n    pass\ndef verify_token(t):\n    pass\n',
    "src/upload.go": "// Package upload tries again when a transfer runs out of time.\npackage upload\nfunc Retry() {}\n",
    "src/picker.ts": "/** Listbox to pick a model from. */\nexport function renderPicker() {}\n",
    "tests/test_auth.py": '"""Login and token verification checks."""\ndef test_login():\n    assert True\n',
    "Dockerfile": "FROM rust\nRUN cargo build\n",
}
ENCODER = encoders.HashEncoder(512)


@pytest.fixture(scope="module")
def index(spark):
    rows = []
    for path, body in FILES.items():
        if path == "Dockerfile":
            rows.append(("config", path, None, None, f"file: {path}\n{body}"))
            continue
        rows.append(("file", path, None, None, code.file_doc(path, body)))
        rows += [("function", path, name, line, doc) for name, line, doc in code.function_docs(path, body)]
    docs = spark.createDataFrame(rows, "kind string, path string, name string, line int, doc string")
    return encoders.with_vectors(docs, "doc", ENCODER).cache()


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(FILES.items()), "path string, text string")


def answers(spark, index, asked, texts=None, encoder=ENCODER, **kw):
    q = spark.createDataFrame([(i, *(a if isinstance(a, tuple) else (a, None))) for i, a in enumerate(asked)], "q_id long, query string, context string")
    adapter, serving = kw.pop("adapter", None), kw.pop("serving", True)
    got = asking.ask(q, index, encoder, texts, adapter, asking.Options(**kw), serving).collect()
    return [r for _, r in sorted((r.q_id, r) for r in got)]


def test_answers(spark, index, texts):
    plain, blank, nothing, functions, config = (
        answers(spark, index, ["where is the login token verified", " ", "zzz qqq"], texts)
        + answers(spark, index, ["verify token"], texts, functions=True)
        + answers(spark, index, ["docker build of the rust image"], texts)
    )
    assert plain.state == "ok" and plain.hints[0].path == "src/auth.py" and plain.fallback and not plain.adapter
    assert plain.answer.splitlines()[1].startswith(f"{plain.hints[0].similarity:.2f}  src/auth.py")
    assert blank.state == "error" and blank.reason == asking.EMPTY_QUERY and not blank.hints
    assert nothing.state == "abstain" and nothing.reason == asking.NO_MATCH and "use normal search" in nothing.answer
    assert [(h.kind, h.name, h.line) for h in functions.hints if h.kind == "function"] == [("function", "verify_token", 4)]
    assert [h.path for h in config.hints if h.kind == "config"] == ["Dockerfile"]
    assert len(plain.hints) <= 3 and sum(h.kind == "file" for h in answers(spark, index, ["login"], texts, k=1)[0].hints) == 1


def test_tests_come_later_unless_asked_for(spark, index):
    source, test = answers(spark, index, ["login token verification checks", "test of login token verification checks"])
    assert source.hints[0].path == "src/auth.py" and test.hints[0].path == "tests/test_auth.py"


def test_exact_evidence_overrides(spark, index, texts):
    strict = encoders.HashEncoder(512, model="base")
    weak, found, by_name = answers(spark, index, ["what shall we do", "who calls verify_token here", "open upload.go:3 please"], texts, strict)
    assert weak.state == "abstain" and weak.reason.startswith("request: top similarity")
    assert found.state == "ok" and [(h.path, h.exact) for h in found.hints] == [("src/auth.py", True)]
    assert [(h.path, h.exact) for h in by_name.hints] == [("src/upload.go", True)]
    gated = answers(spark, index, ["who calls verify_token here"], texts, strict, start_min_files=3000)[0]
    assert gated.state == "abstain" and gated.reason.startswith("start: 4 files < 3000")
    assert answers(spark, index, ["what shall we do"], texts, strict, no_abstain=True)[0].state == "ok"
    # a listed null never abstains; kinds that aren't listed use the default
    kinds = ranking.calibration_of(json.dumps({"request": None, "default": {f: {"min_top": 0.9, "min_margin": 0.0} for f in ("adapter", "plain", "strict_adapter", "strict_plain")}}))
    own = encoders.HashEncoder(512, model=kinds)
    assert [r.state for r in answers(spark, index, ["login of a user", ("login", "earlier talk")], None, own)] == ["ok", "abstain"]


def test_states_and_adapter(spark, index):
    assert answers(spark, index, ["login"], serving=False)[0].state == "error"
    none = index.limit(0)
    assert answers(spark, none, ["login"])[0].state == "empty_index" and answers(spark, none, ["login"], unsupported_only=True)[0].state == "unsupported_scope"
    turn = np.roll(np.eye(512, dtype=np.float32), 1, axis=1)
    held = {"weights": turn, "base": ENCODER.fingerprint, "dim": 512, "revision": "r1"}
    used = answers(spark, index, ["login token"], adapter=held)[0]
    other = answers(spark, index, ["login token"], adapter=held | {"base": "hash-1"})[0]
    assert used.adapter and used.revision == "r1" and not other.adapter
    assert not answers(spark, index, ["login token"], adapter=held, adapt=False)[0].adapter
    assert asking.ask(index.sparkSession.createDataFrame([], "q_id long, query string, context string"), index, ENCODER).count() == 0


def test_nearest_rows_keep_ties(spark):
    rows = spark.createDataFrame([(f"p{i:03}", [1.0, 0.0]) for i in range(300)] + [("q", [2.0, 0.0])], "path string, v array<double>").repartition(7)
    q = spark.createDataFrame([(1, [1.0, 0.0])], "q_id long, q array<double>")
    assert [r.path for r in ranking.nearest_rows(q, rows, 3, key="path").orderBy("rank").collect()] == ["q", "p000", "p001"]


def test_hash_encoder_is_the_plain_form():
    def plain(text, dim):
        v = np.zeros(dim, dtype=np.float32)
        for w in code.word_pieces(text):
            if len(w.encode()) >= 2 and w not in code.STOPWORDS:
                h = code.fnv1a(code.stem(w))
                v[h % dim] += -1 if h >> 63 else 1
        n = np.sqrt((v * v).sum())
        return v / n if n > 0 else v

    texts = ["", "the and", "parseHTTPRequest retries parsing", "Größe straßeNeu x1Y ΑβΓ", "snake_case_word 12ab CamelCase " * 50, "a b c"]
    assert np.allclose(code.hash_encode_batch(texts, 64), [plain(t, 64) for t in texts], atol=1e-6)
    assert code.word_pieces("parseHTTPRequest x1Y snake_case") == ["parse", "httprequest", "x1", "y", "snake", "case"]
    assert code.word_pieces("größeNeu ΑβΓ") == ["größe", "neu", "αβ", "γ"]


def test_model_encoder_batches(tmp_path, spark):
    lengths = [5, 9000, 3, 700, 700] + [600] * 40
    dealt = list(encoders.batches(lengths))
    assert sorted(i for b in dealt for i in b) == list(range(len(lengths)))
    assert all(len(b) <= 16 and (len(b) == 1 or len(b) * max(lengths[i] for i in b) <= 8192) for b in dealt)
    stub = encoders.ModelEncoder("stub-1", 4, lambda ids, mask: np.stack([[(i * m).sum(), m.sum(), 1, 0, 9] for i, m in zip(ids, mask)]), lambda t: [len(w) for w in t.split()], query_prefix="task: ")
    got = stub.encode(["a bb", "", "cccc"])
    assert np.allclose(np.linalg.norm(got, axis=1), 1) and np.allclose(got[0], np.array([3, 2, 1, 0]) / np.sqrt(14))
    made = spark.createDataFrame([("find it", "")], "q string, c string").select(encoders.query_text(stub, F.col("q"), F.col("c"))).first()[0]
    assert made == "task: find it"
    (tmp_path / "m.bin").write_bytes(b"x")
    import hashlib

    (tmp_path / "manifest.json").write_text(json.dumps({"name": "tiny", "files": {"m.bin": hashlib.sha256(b"x").hexdigest()}}))
    assert encoders.verified_fingerprint(str(tmp_path)).startswith("tiny-")
    (tmp_path / "m.bin").write_bytes(b"y")
    with pytest.raises(ValueError):
        encoders.verified_fingerprint(str(tmp_path))
