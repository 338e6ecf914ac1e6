"""The operators over small tables: nulls, empty and long texts, ties, repeats, empty tables, extra columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.llm import bpe, components, fingerprints, html, jaccard, language, lines, nearest, oracles, packing, queries, sharding, warc
from fathomline.llm.shared import fresh_path, written

from ..compare import SF, check

RNG = random.Random(11)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k int, v string"


def sentence(n):
    return " ".join("".join(RNG.choice("abcdefghij") for _ in range(RNG.randrange(2, 7))) for _ in range(n))


BASE = sentence(60)
TEXTS = [
    None, "", " \n\t", "One", "a b c", BASE, BASE, BASE.replace(BASE.split()[30], "changed", 1), sentence(40) + "\n" + BASE + "\n\n" + sentence(7), sentence(4000),
    "<|endoftext|> x", "é ü 漢字 🙂", sentence(10) + "\n" + BASE.upper(), "123 456 !",
]
ROWS = [(i * 3, t, "en" if i % 2 else None, "s", 0, 1, "x") for i, t in enumerate(TEXTS)] + [(None, BASE, None, None, None, None, None), (6, TEXTS[2], None, "s", 0, 1, "x")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_bpe(docs, none):
    path = bpe.vocabulary_path()
    out = bpe.bpe_decode(bpe.bpe_encode(docs, path), path)
    assert out.columns == [*docs.columns, "ids", "decoded"]
    got = out.collect()
    assert len(got) == len(ROWS) and all(r.decoded == (r.text or "") for r in got)
    assert bpe.bpe_encode(none, path).count() == 0
    odd = docs.sparkSession.createDataFrame([(1, None), (2, [5, None, 10**7])], "a int, ids array<int>")
    assert [r.decoded for r in bpe.bpe_decode(odd, path).orderBy("a").collect()] == ["", "&"]


def test_packing(docs, none):
    path = bpe.vocabulary_path()
    got = packing.pack_documents(docs, path).collect()
    ids, counts = bpe.model(path).encode([t or "" for _, t, *_ in ROWS])
    ends = np.cumsum(counts)
    whole = collections.Counter((r[0], tuple(np.append(ids[e - n : e], 1).tolist())) for r, n, e in zip(ROWS, counts, ends))
    pieces = collections.defaultdict(list)
    for p in got:
        pieces[p.sequence_id].append((p.offset, p.length))
    for parts in pieces.values():
        parts.sort()
        assert [o for o, _ in parts] == list(np.cumsum([0] + [n for _, n in parts])[:-1]) and sum(n for _, n in parts) <= 2048
    assert sum(sum(n for _, n in parts) < 2048 for parts in pieces.values()) <= 1
    assert sum(p.length for p in got) == sum(len(i) * c for (_, i), c in whole.items())
    single = {d: i for d, i in whole if sum(c for (e, _), c in whole.items() if e == d) == 1}
    for d, i in single.items():
        at = 0
        for p in sorted((p for p in got if p.doc_id == d), key=lambda p: p.start):
            assert p.start == at and p.ids_crc32 == zlib.crc32(np.array(i[at : at + p.length], "<u4").tobytes()) and p.doc_tokens == len(i)
            at += p.length
        assert at == len(i)
    assert packing.pack_documents(none, path).count() == 0


def test_sharding(docs, none):
    got = sharding.shard_documents(docs).collect()
    assert len(got) == len(ROWS)
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in ROWS)
    assert sharding.shard_documents(none).count() == 0


def test_a_hot_group_is_split(spark):
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same text in a third of the rows").otherwise(F.concat(F.lit("text "), F.col("id"))).alias("text"))
    by = sharding.shard_documents(hot).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    assert len(by) == 8 and max(r.b for r in by) <= 1.01 * min(r.b for r in by)


def brute_components(rows):
    sets = collections.defaultdict(set)
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        s = frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset({tuple(w)} if w else ())
        sets[i].add(s)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    flat = [(i, s) for i, ss in sets.items() for s in ss if s]
    for i, a in flat:
        for j, b in flat:
            if 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_jaccard(spark, docs, none):
    last = jaccard.LAST_ID
    want = brute_components([(last if i is None else i, t) for i, t, *_ in ROWS])
    got = jaccard.jaccard_components(docs).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert r.component_id == (want[last if r.doc_id is None else r.doc_id] if want[last if r.doc_id is None else r.doc_id] != last else None)
    assert jaccard.jaccard_components(none).count() == 0
    # a large group of near copies, and unrelated documents that share a passage
    words, passage = sentence(50).split(), sentence(60)
    near = [" ".join(w if j != k % 50 else f"w{k}" for j, w in enumerate(words)) for k in range(120)]
    more = near + [sentence(200) + " " + passage for _ in range(60)]
    frame = spark.createDataFrame(list(enumerate(more)), "doc_id long, text string").repartition(5)
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_components(frame).collect()} == brute_components(list(enumerate(more)))


def test_jaccard_gives_a_row_a_document(spark):
    a = sentence(60)
    near = [a.replace(w, f"new{i}", 1) for i, w in enumerate(a.split()[10:40:6])]
    rows = [(1, a), (2, near[0]), (2, near[0]), (3, near[1]), (3, near[1]), (3, near[1]), (4, sentence(60))]
    rows += [(None, near[2])] * 5 + [(None, near[3]), (5, None), (5, "")]
    got = collections.Counter((r.doc_id, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())
    assert got == {(1, 1): 1, (2, 1): 2, (3, 1): 3, (4, 4): 1, (None, 1): 6, (5, 5): 2}


def test_jaccard_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
    # variants of one text around the threshold, the first of them not the closest to the others
    words = sentence(80).split()
    rows = [(i, " ".join(w if RNG.random() > 0.03 else f"x{RNG.randrange(99)}" for w in words)) for i in range(90)] + [(200, " ".join(words))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_components(frame).collect()} == brute_components(rows)


def test_components(spark):
    for links in ([], [(1, 1), (None, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 50)], [(RNG.randrange(60), RNG.randrange(60)) for _ in range(45)]):
        root = {}
        for a, b in links:
            if a is not None and b is not None and a != b:
                ra, rb = root.setdefault(a, {a}), root.setdefault(b, {b})
                if ra is not rb:
                    ra |= rb
                    for x in rb:
                        root[x] = ra
        got = components.connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()
        assert {r.node: r.component for r in got} == {n: min(s) for n, s in root.items() if n != min(s)}


def test_forest(spark):
    parent = {i: RNG.randrange(i) for i in range(1, 80)} | {i: i - 1 for i in range(100, 140) if i > 100}

    def root(i):
        return root(parent[i]) if i in parent else i

    got = components.forest_roots(spark.createDataFrame(list(parent.items()), "b long, a long"), "b", "a").collect()
    assert {r.node: r.component for r in got} == {i: root(i) for i in parent}
    assert components.forest_roots(spark.createDataFrame([], "b long, a long"), "b", "a").count() == 0


def text_hash(t):
    """As xxhash64 of Spark, signed: what orders the texts of one key."""
    import xxhash

    h = xxhash.xxh64_intdigest(t.encode(), seed=42)
    return h - 2**64 if h >= 2**63 else h


def brute_lines(rows):
    seen, gone = [], collections.defaultdict(set)
    order = sorted({(lines.FIRST_KEY if i is None else i, t) for i, t, *_ in rows if t is not None}, key=lambda x: (x[0], text_hash(x[1])))
    for i, t in order:
        now = []
        for n, line in enumerate(t.split("\n")):
            norm = line.strip(" \t\r\v\f").lower()
            if not norm:
                continue
            s = {w for w in norm.split(" ") if w}
            if any(9 * len(s & o) >= 4 * (len(s) + len(o)) for o in [*seen, *now]):
                gone[i, t].add(n)
            now.append(s)
        seen += now
    return gone


def test_rarity_and_line_sets_are_small(spark, monkeypatch):
    """Counts reach the driver as columns, and a plan bears the classes in short."""
    counts = spark.createDataFrame([(0, 1), (5, 3), (lines.BUCKETS - 1, 10**9)], "b long, c long")
    with monkeypatch.context() as m:
        m.setattr(type(counts), "collect", lambda self: pytest.fail("collected as rows"))
        classes = lines.rarity(counts)
    assert (len(classes), classes[0], classes[5], classes[-1], sum(classes)) == (lines.BUCKETS, 16, 32, 478, 526)
    sets = lines.line_sets(spark.createDataFrame([(1, 7, "b  a b"), (2, 7, "x")], "lid long, k long, norm string"), [400] * lines.BUCKETS)
    assert sets.columns == ["lid", "k", "n", "b1", "b2", "prefix"]
    assert len(sets._jdf.queryExecution().executedPlan().toString()) < 12 * lines.BUCKETS
    got = {r.lid: r for r in sets.collect()}
    assert got[1].n == 2 and got[2].n == 1 and all(x >> lines.HASH_BITS == 400 for x in got[1].prefix)


def test_line_work_per_word(spark):
    """A word costs one lambda for its token and one for the parity, keys of leaders none; blanks at the ends only go
    where there are any; the parity's distance is at most the symmetric difference, on either side of the middle."""
    rng = random.Random(6)
    texts = [" ".join(f"w{int(rng.random() ** 3 * 400)}" for _ in range(rng.randrange(1, 90))) for _ in range(120)]
    reps = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "lid long, k long, norm string")
    counts = {r.b: r.c for r in lines.word_counts(reps).collect() if r.c}
    plain = reps.select(F.explode(F.split("norm", " ")).alias("w")).groupBy(lines.bucket(F.col("w")).alias("b")).count().collect()
    assert counts == {r.b: r["count"] for r in plain}
    classes = lines.rarity(lines.word_counts(reps))
    sets = lines.line_sets(reps, classes)
    shown = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert shown(sets).count("lambdafunction(") == 1 + 2 * 2 and "lambdafunction(" not in shown(lines.leaders(reps.select("lid", "k", F.lit(1).alias("n"), F.lit(0).alias("b1"), F.lit(0).alias("b2"), F.array(F.lit(1)).alias("prefix"))))
    got = sorted(sets.collect())
    words = [set(t.split()) for t in texts]
    assert [r.n for r in got] == [len(w) for w in words] and any(r.b1 for r in got) and any(r.b2 for r in got)
    ones = lambda x: bin(x & (2**64 - 1)).count("1")
    for a, v in zip(got, words, strict=True):
        for b, w in zip(got, words, strict=True):
            assert ones(a.b1 ^ b.b1) + ones(a.b2 ^ b.b2) <= len(v ^ w)
    ends = ["a b", " a b", "a\tb\t", "\r\u000b\u000cA b \r", " \t", "", "\u00a0a\u00a0", "\u3000\u00c9 "]
    found = lines.lines_of(spark.createDataFrame([(1, "\n".join(ends))], "doc_id long, text string"), "doc_id", "text").collect()
    assert [(r.line_no, r.norm) for r in sorted(found, key=lambda r: r.line_no)] == [(i, x.strip(" \t\r\v\f").lower()) for i, x in enumerate(ends) if x.strip(" \t\r\v\f")]


def test_lines(docs, none):
    gone = brute_lines(ROWS)
    out = lines.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_removed"]
    got = collections.Counter((r.doc_id, r.text, r.n_removed) for r in out.collect())
    want = collections.Counter()
    for i, t, *_ in ROWS:
        g = gone[lines.FIRST_KEY if i is None else i, t]
        want[i, None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in g), len(g)] += 1
    assert got == want and lines.dedup_lines(none).count() == 0


def test_line_variants(spark):
    words = sentence(25).split()
    texts = ["\n".join(" ".join(w if RNG.random() > 0.06 else f"x{RNG.randrange(9)}" for w in words) for _ in range(3)) + "\n" + sentence(12) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)]
    gone = brute_lines(rows)
    got = {r.doc_id: r.n_removed for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: len(gone[i, t]) for i, t in rows}


def test_lines_beyond_the_broadcast_and_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(lines, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(lines, "BROADCAST_NUMBERS", 0)
    words = sentence(25).split()
    rows = [(i // 2, "\n".join(" ".join(w if RNG.random() > 0.05 else f"x{RNG.randrange(9)}" for w in words) for _ in range(2)) + "\n" + sentence(12), 7, 8) for i in range(30)]
    rows += [(None, rows[0][1], 1, 2)] * 6
    gone = brute_lines(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string, __k int, __gone int")
    out = lines.dedup_lines(frame)
    assert out.columns == [*frame.columns, "n_lines", "n_removed"]
    got = collections.Counter((r.doc_id, r.n_removed, r["__k"], r["__gone"]) for r in out.collect())
    assert got == collections.Counter((i, len(gone[lines.FIRST_KEY if i is None else i, t]), a, b) for i, t, a, b in rows)


def test_language(spark, docs, none):
    model = language.train(docs)
    out = language.identify(docs, model)
    assert out.columns == [*docs.columns, "lang_pred", "score"]
    for r in out.collect():
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) and 0 <= r.score <= 1
    empty = language.train(none)
    assert {r.lang_pred for r in language.identify(docs, empty).collect()} == {"und"}
    assert language.identify(none, model).count() == 0


def test_language_accuracy(spark):
    out = language.query(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    r = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("a"), F.count(F.lit(1)).alias("n")).first()
    assert r.n > 20 and r.a >= 0.95


def test_fingerprints(spark, docs, none):
    got = fingerprints.fingerprint_with_edits(docs).collect()
    order = sorted(((lines.FIRST_KEY if i is None else i, t or "") for i, t, *_ in ROWS), key=lambda x: (-x[0], x[1]))
    want = collections.Counter()
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        e = fingerprints.edited(t, after)
        want[None if i == lines.FIRST_KEY else i, len(t), hashlib.sha256(e.encode()).hexdigest(), fingerprints.fingerprint(t), fingerprints.fingerprint(e)] += 1
    assert collections.Counter(tuple(r)[:5] for r in got) == want
    assert fingerprints.fingerprint_with_edits(none).count() == 0
    alone = fingerprints.fingerprint_with_edits(docs.where("doc_id = 9")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0


PAGES = [(1, "http://a.org/1", "<p>same</p>" + "x" * 100), (2, None, "<p>same</p>" + "x" * 100), (None, "http://a.org/3", "<p>same</p>" + "x" * 100), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (1, "http://a.org/1", "<p>same</p>" + "x" * 100)]


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    manifest = warc.write_warc(pages, fresh_path(spark, "warc"))
    index = warc.index_warc(manifest.select("file"))
    got = warc.read_records(written(index, "index")).collect()
    assert len(got) == len(PAGES)
    kinds = collections.Counter((r.record_id, r.record_type, r.refers_to) for r in got)
    assert kinds["<urn:x-page:1>", "response", None] == 2 and kinds["<urn:x-page:2>", "revisit", "<urn:x-page:1>"] == 1 and kinds["<urn:x-page:none>", "revisit", "<urn:x-page:1>"] == 1
    assert kinds["<urn:x-page:6>", "response", None] == kinds["<urn:x-page:7>", "response", None] == 1
    assert {bytes(r.payload) for r in got if r.record_id == "<urn:x-page:4>"} == {b""}
    assert warc.write_warc(pages.limit(0), fresh_path(spark, "warc")).count() == 0


def test_revisits_are_followed(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    index = written(warc.index_warc(warc.write_warc(pages, fresh_path(spark, "warc")).select("file")), "index")
    whole = warc.resolved(warc.read_records(index)).collect()
    assert len(whole) == len(PAGES) and all(r.found == r.digest and r.size == r.payload_bytes for r in whole)
    lost = warc.resolved(warc.read_records(index.where("record_id <> '<urn:x-page:1>'"))).collect()
    assert {r.record_id for r in lost if r.found is None} == {"<urn:x-page:2>", "<urn:x-page:3>", "<urn:x-page:none>"} & {r.record_id for r in lost if r.record_type == "revisit"}
    assert any(r.record_type == "revisit" for r in lost)


def test_templates(spark):
    page = lambda i: f"<div><span>Subscribe to the letter {i}</span></div><div class='content'><p>{sentence(12)}</p></div>"
    rows = [(i, f"http://h.org/{i}", page(i)) for i in range(12)] + [(50, "http://other.org/", page(1)), (51, None, None), (52, "http://h.org/x", "")]
    got = {r.page_id: r for r in html.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows)
    assert not any("Subscribe" in got[i].text for i in range(12)) and all(len(got[i].text.split()) == 12 for i in range(12))
    assert "Subscribe" in got[50].text and got[51].text == got[52].text == "" and got[51].n_chars == 0
    copies = spark.createDataFrame([(i, "http://h.org/c", rows[0][2]) for i in range(9)], "page_id long, url string, html string")
    assert all("Subscribe" in r.text for r in html.extract_text(copies).collect())  # copies of one page are one page
    assert html.extract_text(copies.limit(0)).count() == 0


def texts_of(spark, rows):
    return {r.page_id: r.text for r in html.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_templates_inside_an_article(spark):
    own = [sentence(12) for _ in range(12)]
    block = "<div class='x7'><b>Read our other stories</b> every day in the evening paper</div>"
    page = lambda i: f"<article><h1>{own[i][:20]}</h1><p>{own[i]} <em>not</em> now</p>{block}<table><tr><td>{i}</td><td>yes</td></tr></table></article>"
    for tag in ("article", "main"):
        got = texts_of(spark, [(i, f"http://h.org/{i}", page(i).replace("article>", f"{tag}>")) for i in range(12)])
        assert got == {i: f"{own[i][:20].strip()} {own[i]} not now {i} yes" for i in range(12)}


def test_templates_of_a_large_host(spark, monkeypatch):
    own = [sentence(12) for _ in range(240)]
    promo = lambda i: f"<div>Try our {'abcdef'[i % 6]}{'abcdef'[i % 6]} paper for a month at no charge</div>"
    rows = [(i, f"http://h.org/{i}", f"<div>{promo(i)}<p>{own[i]}</p></div>") for i in range(240)]
    rows += [(1000 + i, "http://h.org/0", rows[0][2]) for i in range(40)]
    want = {i: own[i] if i < 1000 else own[0] for i, *_ in rows}
    assert texts_of(spark, rows) == want  # each promo on a sixth of the pages
    monkeypatch.setattr(html, "BROADCAST_HASHES", 0)
    monkeypatch.setattr(html, "COPIES", 10)
    assert texts_of(spark, rows) == want


def test_a_long_text_is_template(spark):
    terms, own = sentence(1000), [sentence(12) for _ in range(12)]
    assert len(terms) > 2000
    assert texts_of(spark, [(i, f"http://h.org/{i}", f"<div><p>{own[i]}</p><div>{terms}</div></div>") for i in range(12)]) == dict(enumerate(own))
    dated = [(i, f"http://h.org/{i}", f"<div><p>{terms} {i}</p></div>") for i in range(12)]  # one page but for digits
    assert texts_of(spark, dated) == {i: f"{terms} {i}" for i in range(12)}


def test_nearest(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 6)).round(2)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(300 + i, x[0].tolist()) for i in range(60)]
    rows += [(900, None), (901, []), (902, [0.0] * 6), (903, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (904, [float("nan")] * 6), (905, [1.0, 2.0]), (None, x[1].tolist()), (3, x[3].tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1))
    good = {i: np.array(v) for i, v in rows if i is not None and i < 900}
    got = collections.defaultdict(list)
    for r in nearest.nearest(frame, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == {i for i in good if i % 20 == 0}
    for q, found in got.items():
        want = sorted(((-float(good[q] @ v), i) for i, v in good.items() if i != q))[:20]
        assert [i for i, _ in found] == [i for _, i in want] and np.allclose([s for _, s in found], [-s for s, _ in want])
    assert nearest.nearest(frame.limit(0), F.lit(True)).count() == 0
    few = nearest.nearest(frame.where("vec_id < 3"), F.lit(True)).collect()
    assert len(few) == 6


def test_many_vectors_tie(spark):
    rng = np.random.default_rng(5)
    x = np.unique(rng.integers(-2, 3, size=(700, 6)), axis=0).astype(float)
    x = x[np.abs(x).sum(axis=1) > 0]
    x[:40] = np.eye(6)[np.arange(40) % 6] * np.sign(rng.normal(size=40))[:, None] * rng.integers(1, 4, size=40)[:, None]
    good = dict(enumerate(x[rng.permutation(len(x))]))
    rows = [(int(i), v.tolist()) for i, v in good.items()]
    got = collections.defaultdict(list)
    for r in nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.lit(True)).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert got == {q: [i for _, i in sorted((-float(good[q] @ v), i) for i, v in good.items() if i != q)[:20]] for q in good}


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_same_rows_as_sql(spark, name):
    check(spark, name, queries.QUERIES[name], oracles.ORACLES[name])


def test_unlabelled_documents_stay(spark, docs):
    pipeline = pytest.importorskip("corpus_pipeline")
    lettered = collections.Counter((i, t) for i, t, *_ in ROWS if any(c.isalpha() for c in t or ""))
    for label in (F.lit(None).cast("string"), F.when(F.col("doc_id") == 0, "und"), F.lit("und")):
        out = pipeline.identify_language(spark, docs.withColumn("lang", label), SF)
        assert out.columns == docs.columns and collections.Counter((r.doc_id, r.text) for r in out.collect()) == lettered
    assert {r.lang for r in pipeline.identify_language(spark, docs.withColumn("lang", F.lit(None).cast("string")), SF).collect()} == {None}


def test_near_duplicates_without_or_with_repeated_ids(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    a, b, c, d, e = (sentence(60) for _ in range(5))
    near = lambda t: t.replace(t.split()[30], "changed", 1)
    rows = [(None, a), (None, a), (None, near(a)), (None, b), (7, c), (7, d), (7, c), (8, near(c)), (1, e), (9, near(e)), (9, sentence(50)), (3, near(b))]
    frame = spark.createDataFrame([(i, t, None, "s", 0, 1, "x") for i, t in rows], SCHEMA).repartition(3)
    out = pipeline.drop_near_duplicates(spark, frame, SF)
    got = collections.Counter((r.doc_id, r.text) for r in out.collect())
    assert out.columns == frame.columns and sum(got[None, t] for t in (a, near(a))) == 1
    assert {k: n for k, n in got.items() if k not in ((None, a), (None, near(a)))} == {(7, c): 1, (7, d): 1, (1, e): 1, rows[10]: 1, rows[11]: 1}


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    d = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(pipeline.STAGES)
    named = written(stages["language"](spark, d, SF), "t")
    assert named.columns == d.columns and named.count() == d.where("text rlike '\\\\p{L}'").count()
    clean = written(stages["lines"](spark, named, SF), "t")
    assert clean.columns == d.columns and brute_lines([(r.doc_id, r.text) for r in clean.collect()]).keys() <= {(r.doc_id, r.text) for r in clean.collect()}
    twice = clean.unionByName(clean.where("doc_id % 2 = 0").withColumn("doc_id", F.col("doc_id") + 10_000))
    kept = written(stages["near_duplicates"](spark, twice, SF), "t")
    want = brute_components([(r.doc_id, r.text) for r in twice.collect()])
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, c in want.items() if i == c)
    packed = stages["packing"](spark, kept, SF)
    assert packed.select("doc_id").distinct().count() == kept.count()
    assert pipeline.run(spark, SF).count() > 0
