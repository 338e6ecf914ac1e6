"""The parts that run inside tasks, against plain or published forms."""

import hashlib
import io
import random
import zlib

import numpy as np
import pytest

from fathomline.llm import bpe, fingerprints, html, jaccard, language, nearest, packing, sharding, warc

RNG = random.Random(5)


def word(n=6):
    return "".join(RNG.choice("abcdefgh") for _ in range(RNG.randrange(1, n)))


def test_bpe_is_the_librarys():
    from tokenizers import Tokenizer

    path = bpe.vocabulary_path()
    theirs, ours = Tokenizer.from_file(path), bpe.ByteBPE(path)
    fixed = ["", " ", "don't we'll I've 's 's's ''", "a<|endoftext|>b<|endoftext|>", "\n\n a\t b  c", "aaaa" * 60, "漢字 🙂 é ½²", "x\x00y\x1cz\x85", "'", "12ab 3"]
    texts = fixed + ["".join(RNG.choice("ab stmdrevl''  \n\t1é漢!<|>") for _ in range(RNG.randrange(60))) for _ in range(500)]
    ids, counts = ours.encode(texts)
    ends = np.cumsum(np.append(0, counts))
    want = theirs.encode_batch(texts, add_special_tokens=False)
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [w.ids for w in want]
    assert ours.decode(ids, counts) == [theirs.decode(w.ids, skip_special_tokens=False) for w in want]
    assert ours.decode(np.array([10**6, -1]), np.array([2])) != [None]


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    window = 64
    histogram = np.zeros(window + 1, dtype=np.int64)
    histogram[1:window] = rng.integers(0, [1, 30, 3, 200][seed] + 1, window - 1)
    p = packing.plan(histogram, window)
    used = {}
    for r in range(1, window):
        on = p["length"] == r
        ranks, seqs, offs = p["rank"][on], p["sequence"][on], p["offset"][on]
        ends = np.append(ranks[1:], p["planned"][r]) if len(ranks) else []
        for k, e, s, o in zip(ranks, ends, seqs, offs):
            for i in range(int(e - k)):
                used.setdefault(int(s) + i, []).append((int(o), r))
    for pieces in used.values():
        pieces.sort()
        assert [o for o, _ in pieces] == list(np.cumsum([0] + [r for _, r in pieces])[:-1]) and sum(r for _, r in pieces) == window
    assert (p["planned"] <= histogram).all()
    assert p["residual_tokens"] == ((histogram - p["planned"]) * np.arange(window + 1)).sum()
    if seed == 3:
        assert p["residual_tokens"] < 0.35 * (histogram * np.arange(window + 1)).sum()


def plain_nnls(a, b):
    """Lawson and Hanson's active set method, one column at a time."""
    x, passive = np.zeros(a.shape[1]), np.zeros(a.shape[1], dtype=bool)
    for _ in range(10 * a.shape[1]):
        w = a.T @ (b - a @ x)
        w[passive] = -1
        if w.max() < 1e-8:
            break
        passive[w.argmax()] = True
        while True:
            s = np.zeros_like(x)
            s[passive] = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            if s[passive].min() > 0:
                break
            low = passive & (s <= 0)
            x += (x[low] / (x[low] - s[low])).min() * (s - x)
            passive &= x > 1e-12
        x = s
    return x


@pytest.mark.parametrize("seed", range(6))
def test_least_squares_are_the_plain_ones(seed):
    rng = np.random.default_rng(seed)
    window = 48
    histogram = np.zeros(window + 1)
    histogram[1:window] = rng.integers(0, 60, window - 1) * (rng.random(window - 1) < 0.7)
    columns = packing.combinations(np.flatnonzero(histogram), window)
    a = np.stack([np.bincount(c, minlength=window + 1) for c in columns], axis=1).astype(float)[1:]
    active, x = packing.solve(columns, histogram)
    ours, best = (np.linalg.norm(a[:, active] @ x - histogram[1:]), np.linalg.norm(a @ plain_nnls(a, histogram[1:]) - histogram[1:]))
    assert (x > 0).all() and len(set(active.tolist())) == len(active) and ours <= best + 0.02 * np.linalg.norm(histogram)


def test_most_windows_come_from_the_least_squares():
    rng = np.random.default_rng(9)
    histogram = np.append(np.bincount(np.minimum(rng.gamma(2.0, 300.0, 40_000).astype(int) + 1, 2047), minlength=2048), 0)
    p = packing.plan(histogram, 2048)
    assert p["solved_sequences"] >= 0.9 * p["planned_sequences"]
    nothing = packing.plan(np.zeros(2049, dtype=np.int64), 2048)
    assert nothing["planned_sequences"] == 0 and nothing["residual_tokens"] == 0


def test_bins():
    rng = np.random.default_rng(1)
    v = rng.integers(1, 100, (400, 3)).astype(float)
    s = sharding.even_out(v[:, 0], sharding.place(v, 8), 8)
    held = np.array([v[s == k].sum(axis=0) for k in range(8)])
    assert (held.max(axis=0) / held.min(axis=0) < [1.001, 1.15, 1.15]).all()
    assert sharding.place(np.zeros((0, 3)), 8).tolist() == []
    assert set(sharding.place(np.ones((3, 3)), 8)) <= set(range(8))


def test_shingles_are_those_of_words():
    import re

    def plain(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    texts = ["", "  \n", "One", "a b c d", "A b C d e", "a b c d e f a b c d e f", "é É x y z w", "x\x00 y"] + [" ".join(word(3) for _ in range(RNG.randrange(40))) for _ in range(200)]
    sets, hashes = [plain(t) for t in texts], [jaccard.shingles(t) for t in texts]
    for a, ha in zip(sets, hashes):
        assert len(a) == len(ha)
    for i in range(len(texts) - 1):
        assert len(sets[i] & sets[i + 1]) == len(np.intersect1d(hashes[i], hashes[i + 1]))
    assert jaccard.signature(hashes[4]) == jaccard.signature(jaccard.shingles("a B c D e"))


def test_trie_decides_as_intersections_do():
    rng = np.random.default_rng(2)
    for _ in range(60):
        probe = np.unique(rng.integers(0, 400, rng.integers(1, 300))).astype(np.uint64)
        sets = []
        for _ in range(30):
            s = set(probe.tolist())
            for x in rng.integers(0, 400, rng.integers(0, 60)):
                s ^= {int(x)}
            sets.append(np.array(sorted(s or {1}), dtype=np.uint64))
        want = [100 * len(np.intersect1d(probe, s)) >= 75 * len(np.union1d(probe, s)) for s in sets]
        assert jaccard.trie_overlaps(probe, sets) == want


def test_prefix_bound():
    for n in range(1, 200):
        assert jaccard.prefix_length(n) == n - -(-3 * n // 4) + 1
        for m in range(n, min(200, 4 * n // 3 + 1)):
            least = jaccard.least_overlap(n, m)
            assert 100 * least >= 75 * (n + m - least) and 100 * (least - 1) < 75 * (n + m - least + 1)


def test_fingerprints():
    text = " ".join(word() for _ in range(3000))
    a, b = fingerprints.fingerprint(text), fingerprints.fingerprint(text[:4000] + "XYZ" + text[4000:])
    other = fingerprints.fingerprint(" ".join(word() for _ in range(3000)))
    near, far, same, empty = fingerprints.likeness([a, a, a, "3::"], [b, other, a, "3::"])
    assert near > 0.9 > 0.45 > far and same == 1.0 and empty == 1.0
    assert fingerprints.fingerprint("") == "3::" and fingerprints.edited("abcde", "xyz") == "abcxy"

    def lcs(x, y):
        row = [0] * (len(y) + 1)
        for c in x:
            prev = 0
            for j, d in enumerate(y):
                prev, row[j + 1] = row[j + 1], prev + 1 if c == d else max(row[j + 1], row[j])
        return row[-1]

    xs = ["".join(RNG.choice("ABC") for _ in range(RNG.randrange(65))).encode() for _ in range(200)]
    ys = ["".join(RNG.choice("ABC") for _ in range(RNG.randrange(65))).encode() for _ in range(200)]
    assert fingerprints.common_subsequence(xs, ys).tolist() == [lcs(x, y) for x, y in zip(xs, ys)]
    assert fingerprints.fingerprint("ab" * 50_000).count(":") == 2


def test_fingerprint_is_the_plain_form():
    """Chunk by chunk: the window's hash, its cuts, and a character a chunk."""

    def plain(text):
        data = text.encode()
        if not data:
            return "3::"

        def window(i):
            h = 0
            for k in range(min(7, i + 1)):
                h += (data[i - k] + 1) * pow(fingerprints.ROLLING, k, 2**32)
            h %= 2**32
            h ^= h >> 15
            h = h * 0x2C1B3C6D % 2**32
            return h ^ h >> 12

        roll = [window(i) for i in range(len(data))]

        def signed(block):
            out, begin, cuts = "", 0, [i + 1 for i, r in enumerate(roll) if r % block == block - 1][: fingerprints.LONGEST - 1]
            for stop in [*cuts, len(data)]:
                if begin < stop:
                    h = sum((b + 1) * pow(fingerprints.CHUNK, k, 2**64) for k, b in enumerate(data[begin:stop])) % 2**64
                    h ^= h >> 31
                    out += chr(fingerprints.ALPHABET[h * 0xBF58476D1CE4E5B9 % 2**64 >> 58])
                begin = stop
            return out

        block = 3
        while block * 64 < len(data):
            block *= 2
        while block > 3 and sum(r % block == block - 1 for r in roll) < 32:
            block //= 2
        # the wider signature cuts at a part of the narrower one's cuts
        assert all(r % block == block - 1 for r in roll if r % (2 * block) == 2 * block - 1)
        return f"{block}:{signed(block)}:{signed(2 * block)}"

    for t in ["", "a", "é" * 40, "the quick brown fox", *("".join(RNG.choice("abcde \n") for _ in range(RNG.randrange(3000))) for _ in range(30)), "x" * 500]:
        assert fingerprints.fingerprint(t) == plain(t)


def test_kernel_ridge_is_the_plain_form():
    """With every text a landmark: the square root of the kernel matrix as features, and the weighted ridge
    as ordinary least squares with a row of penalty for each feature."""
    texts = ["the cat sat", "the dog ran on", "a cat and a dog", "der Hund lief", "die Katze sass", "le chat noir", "un chien et un chat"]
    names = ["en", "en", "en", "de", "de", "fr", "fr"]
    rows = np.stack([language.presence(t) for t in texts])
    grams = [set(np.flatnonzero(r).tolist()) for r in rows]
    kernel = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in grams] for a in grams])
    value, vector = np.linalg.eigh(kernel)
    feature = vector @ np.diag(np.sqrt(value)) @ vector.T
    weight = np.array([1 / names.count(n) for n in names])
    weight /= weight.sum()
    target = np.array([[float(n == m) for m in ("de", "en", "fr")] for n in names])
    middle, centre = weight @ target, weight @ feature
    a = np.vstack([np.sqrt(weight)[:, None] * (feature - centre), np.sqrt(language.RIDGE / len(rows)) * np.eye(len(rows))])
    beta = np.linalg.lstsq(a, np.vstack([np.sqrt(weight)[:, None] * (target - middle), np.zeros((len(rows), 3))]), rcond=None)[0]
    model = language.fit(rows, names)
    assert model.languages == ["de", "en", "fr"]
    assert np.allclose(model.scores(rows), (feature - centre) @ beta + middle, atol=1e-3)
    assert model.predict(texts)[0] == names


def test_bins_are_the_plain_form():
    """Largest first, each to the shard that can take it with the highest dot product of item and residual."""
    rng = np.random.default_rng(4)
    for n, shards in ((120, 5), (3, 4), (40, 1)):
        v = rng.integers(1, 50, (n, 3)).astype(float)
        total = [sum(x[d] for x in v.tolist()) for d in range(3)]
        item = [[x[d] / total[d] for d in range(3)] for x in v.tolist()]
        left = [[1 / shards] * 3 for _ in range(shards)]
        want = [0] * n
        for i in sorted(range(n), key=lambda i: (-max(item[i]), i)):
            able = [k for k in range(shards) if all(left[k][d] >= item[i][d] - 1e-12 for d in range(3))]
            if able:
                best = max(able, key=lambda k: (round(sum(left[k][d] * item[i][d] for d in range(3)), 12), -k))
            else:
                best = max(range(shards), key=lambda k: (round(min(left[k][d] - item[i][d] for d in range(3)), 12), -k))
            want[i] = best
            left[best] = [left[best][d] - item[i][d] for d in range(3)]
        assert sharding.place(v, shards).tolist() == want


def test_kernel_is_the_count_of_common_grams():
    rows = np.stack([language.presence(t) for t in ("the cat", "the dog", "der Hund")])
    c = language.Classifier(["x"], (rows[1:2].astype(np.float32) / np.sqrt(rows[1].sum())), np.ones((1, 1), np.float32), np.zeros(1, np.float32))
    want = (rows & rows[1]).sum(axis=1) / np.sqrt(rows.sum(axis=1) * rows[1].sum())
    assert np.allclose(c.kernel(rows)[:, 0], want, atol=1e-5)
    assert language.fit(rows[:0], []).predict(["abc", None]) [0] == ["und", "und"]
    model = language.fit(rows, ["en", "en", "de"])
    names, scores = model.predict(["the cat", "der Hund", "", None, "123 !", "x" * 100_000])
    assert names[:5] == ["en", "de", "und", "und", "und"] and (scores >= 0).all() and (scores <= 1).all()


def test_trees_are_exact_at_factor_one():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 12)) * rng.uniform(0.2, 3, (900, 1))
    q = rng.normal(size=(40, 12))
    most = np.sqrt((x**2).sum(axis=1)).max()
    points = nearest.lift(x, most)
    tree = nearest.build(points, 16)
    best = nearest.search(tree, points, nearest.aim(q), 7, np.full(40, np.inf), 1.0)
    want = np.argsort(-(q @ x.T), axis=1)[:, :7]
    assert [set(r) for r in best.row] == [set(w) for w in want]
    loose = nearest.search(tree, points, nearest.aim(q), 7, np.full(40, np.inf), 3.0)
    common = np.mean([len(set(a) & set(b)) for a, b in zip(loose.row, want)]) / 7
    assert 0.5 < common < 1.0 and (np.mean([len(set(a) & set(b)) for a, b in zip(nearest.search(tree, points, nearest.aim(q), 7, np.full(40, np.inf), 1.2).row, want)]) / 7 >= 0.9)
    where = nearest.assign(tree, points)
    assert set(where) <= set(nearest.leaves(tree))


@pytest.mark.parametrize(
    "source,text",
    [
        ("", ""),
        ("plain &eacute;&nbsp;&#x41; text", "plain é A text"),
        ("<nav>menu</nav><article><h1>T</h1><p>one<p>two <b>b</b>old</article><footer>f</footer>", "T one two bold"),
        ("<body><header>H</header><div class='content'><p>A<div id=comments>no</div></div><aside>s</aside><form>f<input></form>", "A"),
        ("<p>it's <a title=it's>l</a> 1 < 2 <!-- c --> ok", "it's l 1 < 2 ok"),
        ("<ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table>", "a b 1 2 3"),
        ("<article><p>one<div class='cookie-notice'>c</div><section class=comments><article>no</article></section></article>", "one"),
        ("<script>var t='</p>'</script>x<style>p{}</style>y<textarea>z</textarea>", "xy"),
        ("<article><p>cut off &amp; th", "cut off & th"),
        ("<article><p>cut <a href='x", "cut"),
        ("<p hidden>h</p><p style='display: none'>n</p><p>s</p>", "s"),
    ],
)
def test_main_text(source, text):
    page = html.parse(source)
    assert html.main_text(page, html.keep_main(page), set()) == text


@pytest.mark.parametrize(
    "inside,text",
    [
        ('<h2 class="header">Title</h2><p>x</p>', "Title x"),
        ('<div class="related-work">We follow Smith.</div><div class="related-posts">More</div>', "We follow Smith."),
        ("<label>Sample</label> <math>a+b</math><form><label>Name</label><input></form>", "Sample a+b"),
        ('<div class="header"><h1>T</h1></div><div class="share-buttons">share</div><section class="reader-comments">c</section>', "T"),
        ('<p class="notice">We use cookies</p><p id="comment-list">c</p><p class="search-results">Found</p><div class="ad">buy</div>', "Found"),
    ],
)
def test_what_an_article_keeps(inside, text):
    for tag in ("article", "main"):
        page = html.parse(f"<body><div class='header'>site</div><{tag}>{inside}</{tag}></body>")
        assert html.main_text(page, html.keep_main(page), set()) == text


def test_broken_markup_takes_time_in_proportion():
    import time

    for part in ("<b><i></u>", "<b><hr>", "<b><td>", "<i><li>", "<div><p><b>", "</p>", "<table><td><b>"):
        took = []
        for n in (4000, 16_000):
            began = time.perf_counter()
            page = html.parse(part * n)
            took.append(time.perf_counter() - began)
            assert page.end[0] == len(page.name) and all(i < e <= page.end[p] for i, (e, p) in enumerate(zip(page.end, page.parent)) if i)
        assert took[1] < 12 * took[0] + 0.2, part  # four times the input; a square would be sixteen times


def test_archives(tmp_path):
    made = [warc.record(i, "http://e.org/ü x\r\n", hashlib.sha256(p).hexdigest(), p, None if i != 2 else 0, "2026-01-01T00:00:00Z") for i, p in enumerate([b"", b"<p>\xc3\xa9</p>", b"x" * 200, b"y" * 300_000])]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(made))
    with open(tmp_path / "a.warc.gz", "rb") as f:
        found = list(warc.members(f))
    assert [(o, n) for o, n, _ in found] == [(sum(map(len, made[:i])), len(m)) for i, m in enumerate(made)]
    assert [warc.payload_of(m) for m in made] == [b"", b"<p>\xc3\xa9</p>", b"", b"y" * 300_000]
    far = warc.record(9, "data:," + "\u6f22" * 80_000, hashlib.sha256(b"z").hexdigest(), b"z", None, "2026-01-01T00:00:00Z")
    ((_, _, head),) = warc.members(io.BytesIO(far))
    assert warc.headers(head[: head.index(warc.END)])["warc-record-id"] == "<urn:x-page:9>" and len(head) > 1 << 19
    plain = b"".join(zlib.decompress(m, 31) for m in made)
    (tmp_path / "a.warc").write_bytes(plain)
    with open(tmp_path / "a.warc", "rb") as f:
        spans = [(o, n) for o, n, _ in warc.plain_records(f, len(plain))]
    assert [warc.payload_of(plain[o : o + n]) for o, n in spans] == [warc.payload_of(m) for m in made]
    with open(tmp_path / "cut.warc.gz", "wb") as f:
        f.write(made[3][:-5])
    with open(tmp_path / "cut.warc.gz", "rb") as f, pytest.raises(ValueError):
        list(warc.members(f))
    assert list(warc.joined_ranges([(0, 10), (20, 5), (10_000, 5)], gap=50)) == [(0, 2, 0, 25), (2, 3, 10_000, 10_005)]
