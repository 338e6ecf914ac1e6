"""Inline cases of paths, texts, code and commands."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.functions import code, commands, numeric, paths, text
from fathomline.plans import registry


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_language_kind_and_tests(spark):
    cases = {
        "a/b.py": ("python", "source", False), "x.TSX": ("typescript", "source", False), "vendor/a.go": ("go", None, False), "a.min.js": ("javascript", None, False),
        "Makefile": (None, "config", False), "deploy.YAML": (None, "config", False), "requirements-dev.txt": (None, "config", False), "yarn.lock": (None, None, False),
        "a/tests/x.rs": ("rust", "source", True), "pkg/a_test.go": ("go", "source", True), "web/a.spec.ts": ("typescript", "source", True), "README": (None, None, False),
    }
    df = spark.createDataFrame([(p,) for p in cases], "path string")
    got = df.select("path", paths.language(F.col("path")), paths.kind(F.col("path")), paths.is_test(F.col("path"))).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == cases


def test_path_prior(spark):
    rows = [("tests/a.py", "find the parser", -0.12), ("tests/a.py", "fix the tests", 0.0), ("src/test_a.py", "x", -0.12), ("src/a.py", "x", 0.0), ("spec/a.rb", "", 0.0), ("a/b_spec.rb", "q", -0.12)]
    df = spark.createDataFrame(rows, "p string, q string, e double")
    assert all(r.e == r.got for r in df.withColumn("got", paths.path_prior(F.col("p"), F.col("q"))).collect())


def test_near(spark):
    rows = [("a/x.py", "a/y.py", True), ("x.py", "y.py", False), ("src/a.py", "tests/test_a.py", True), ("src/a.ts", "lib/a.test.ts", True), ("src/a.py", "lib/a.py", False), ("m/Foo.java", "t/FooTest.java", True)]
    df = spark.createDataFrame(rows, "a string, b string, e boolean")
    assert all(r.e == r.got for r in df.withColumn("got", paths.is_near(F.col("a"), F.col("b"))).collect())


def test_tokens_and_stems(spark):
    words = ["sessions", "retries", "timed", "is", "running", "boxes", "ies"]
    df = spark.createDataFrame([(w,) for w in words], "w string").withColumn("s", text.stem(F.col("w")))
    assert {r.w: r.s for r in df.collect()} == {w: code.stem(w) for w in words}
    assert code.stem("retries") == "retr" and code.stem("sessions") == "session"


def test_token_pattern(spark):
    assert one(spark, text.tokens(F.lit("getHTTPUrl2")))[0] == ["get", "http", "url", "2"]


def test_query_texts(spark):
    got = one(spark, text.query_text(F.lit("  fix it "), F.lit("")), text.query_text(F.lit("q" * 3000), F.lit("c" * 900)))
    assert got[0] == text.FOR_FILES + "fix it"
    body = got[1].removeprefix(text.FOR_FILES)
    assert body.startswith("q" * 1500 + "\nRecent context:\n") and body.endswith("c" * 900)
    earlier, last = text.split_context(F.lit("opened a.py\nLast tool output:\nError: x"))
    assert tuple(one(spark, earlier, last)) == ("opened a.py", "Error: x")
    v2 = one(spark, text.query_text_2(F.lit("do"), F.lit("seen\nLast output:\nboom")))[0]
    assert v2 == text.FOR_FILES + "do\nLast tool output:\nboom\nEarlier context:\nseen"


def test_errors_and_kinds(spark):
    bad = ["Traceback (most recent call last)", "x\nValueError: no", "thread 'main' panicked at src/x", "it fails\nand is broken", "exit code 3", "main.c:3:1: error: no"]
    good = ["add a field", "the error", "it fails and is broken", ""]
    df = spark.createDataFrame([(t,) for t in bad + good], "t string").withColumn("e", text.has_error(F.col("t")))
    got = {r.t: r.e for r in df.collect()}
    assert all(got[t] for t in bad) and not any(got[t] for t in good)
    rows = [("add a field", "", "request"), ("x" * 200, "", "issue"), ("a\nb", "", "issue"), ("and now?", "before", "conversational"), ("panic: x", "", "error")]
    df = spark.createDataFrame(rows, "q string, c string, e string")
    assert all(r.e == r.k for r in df.withColumn("k", text.query_kind(F.col("q"), F.col("c"))).collect())


def test_literals(spark):
    t = 'see "an exact phrase" in parse_config and HttpClient at lib/io.py:12\nTypeError: unexpected end of input.'
    assert one(spark, text.query_literals(F.lit(t)))[0] == ["an exact phrase", "parse_config", "HttpClient", "lib/io.py", "TypeError", "unexpected end of input"]


def test_literals_beside_other_letters_as_in_sql(spark, tmp_path):
    """SQL's words are ASCII: a name may begin or end beside a letter of another script; null texts count as empty."""
    texts = ["Gr\u00f6\u00dfSSen und ma\u00dfSTz_", "\u00e9parse_it\u00e9", "\u00fclib/a.py:1\u0663", "\u0301HttpServer\u0301", "say '\u00a0an odd phrase\u3000'", "\u2003FooError: many words of one line\u00a0.", None]
    folder = str(tmp_path / "conversations.parquet")
    spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "conv_id long, turn int, text string").write.parquet(folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/*.parquet'")
    want = sorted(con.execute(registry.oracle_sql()["query_literals"]).fetchall())
    got = sorted(tuple(r) for r in registry.queries()["query_literals"](spark, str(tmp_path)).collect())
    assert got == want and want[0][2].startswith("SSen|")
    assert one(spark, text.query_literals(F.lit("ma\u00dfSSen")))[0] == []  # elsewhere letters of any script make words


def test_history_body(spark):
    got = one(spark, text.history_body(F.lit(" Fix x "), F.lit("\n\n why \nmore")), text.history_body(F.lit("s"), F.lit("b" * 200)), text.history_body(F.lit("s"), F.lit(None).cast("string")))
    assert tuple(got) == ("Fix x\nwhy", "s", "s")


def test_symbols_and_skeleton():
    src = "# A parser of small things\nimport os\n\nclass A:\n    def f(self):\n        pass\n    def g(self):\n        pass\n\ndef main():\n    pass\n"
    assert code.symbols("a.py", src) == [("A", 4, 9), ("f", 5, 6), ("g", 7, 9), ("main", 10, 12)]
    assert code.first_comment(src) == "A parser of small things"
    assert code.skeleton("a.py", src) == "a.py\nA parser of small things\nA f g main"
    assert code.function_docs("a.py", src)[3] == ("main", 10, "function: a.py::main\nA parser of small things")
    assert code.first_comment("x = 1\n# A comment after code") is None
    assert code.symbols("a.rs", "pub fn run() {}\nstruct S;\n") == [("run", 1, 1), ("S", 2, 3)]
    assert code.file_doc("a.vue", "<template>\n <p>hi</p>\n</template>\n<script>let a</script>") == "file: a.vue\n<p>hi</p> <script>let a</script>"


def test_word_pieces_and_encoder():
    assert code.word_pieces("handleLogin v2Go ÄÖx") == ["handle", "login", "v2", "go", "äöx"]
    v = code.hash_encode("sessions of the parser", 64)
    assert np.isclose((v**2).sum(), 1) and (code.hash_encode("", 8) == 0).all()
    assert code.fnv1a("a") == 0xAF63DC4C8601EC8C


@pytest.mark.parametrize(
    "command,expected",
    [
        ("cat a.py", [("a.py", "read")]),
        ("cd src && sed -i s/a/b/ x.py", [("src/s/a/b/", "edited"), ("src/x.py", "edited")]),
        ("uv run pytest tests/t.py::test_x -q", [("tests/t.py", "ran")]),
        ("echo hi > out.txt", [("hi", "read"), ("out.txt", "edited")]),
        ("FOO=1 timeout 30 ./run.sh a:12", [("run.sh", "ran"), ("a", "read")]),
        ("rg 'x*' https://e.org", []),
    ],
)
def test_shell_touches(command, expected):
    assert commands.shell_touches(command) == expected


def test_touched_and_relative():
    assert commands.relative_to("/private/tmp/r", "/tmp/r/a/../b.py") == "b.py"
    assert commands.relative_to("/r", "/s/x") is None
    calls = [{"reads": ["/r/a.py"]}, {"shell": ["cat b.py c.py"]}, {"edits": ["/r/a.py"]}]
    assert commands.touched(calls, "/r", ["b.py"], {"a.py"}) == [("a.py", "edited"), ("b.py", "read")]


@pytest.mark.parametrize(
    "command,pattern",
    [("rg -n --glob '*.py' \"def run\" src", "def run"), ("git grep -e foo", "foo"), ("find . -name '*.rs'", "*.rs"), ("ls", None), ("cat x | grep -i bar", "bar")],
)
def test_search_pattern(command, pattern):
    assert commands.search_pattern(command) == pattern


def test_numbers(spark):
    r = one(
        spark, numeric.upper_median(F.array(F.lit(4), F.lit(1), F.lit(3), F.lit(2))), numeric.upper_median(F.array().cast("array<int>")),
        numeric.normalized(F.array(F.lit(3.0), F.lit(4.0))), numeric.mapped(np.array([[0.0, 2.0], [1.0, 0.0]]))(F.array(F.lit(1.0), F.lit(0.0))),
    )
    assert (r[0], r[1], r[2], r[3]) == (3, 0, [0.6, 0.8], [0.0, 1.0])


def test_mapped_and_rounded_keep_signs_and_nulls(spark):
    """A negative share that rounds to zero stays negative, as in SQL; a null vector stays null."""
    df = spark.createDataFrame([([1.0, -1e-8],), (None,), ([-1e-8, 1.0],)], "v array<double>")
    got = [r[0] for r in df.select(F.transform(numeric.mapped(np.eye(2))("v"), lambda x: numeric.rounded(x, 6))).collect()]
    assert [repr(x) for x in got] == ["[1.0, -0.0]", "None", "[-0.0, 1.0]"]
    values = [0.49999999999999994, 0.5, -0.5, -0.4, 0.0, -2.5, 1e15 + 1, float("-inf")]
    got = one(spark, *[numeric.rounded(F.lit(x), 0) for x in values], numeric.rounded(F.lit(float("nan")), 6), numeric.rounded(F.lit(-1.2345675), 6))
    assert [repr(x) for x in got] == ["0.0", "1.0", "-1.0", "-0.0", "0.0", "-3.0", "1000000000000001.0", "-inf", "nan", repr(-(1234567.5 // 1 + 1) / 1e6)]
