"""Main text of HTML pages by site template removal.

Each page is parsed into a flat tree of elements.  Every element, inside the part that a page marks as
its article too, is hashed with its whole subtree (names, roles and text, digits aside); Spark counts per host on how many
different pages each hash stands, and subtrees that recur on many pages of a host are deleted as that
site's template.  Only the marked part itself and what holds it are spared.  What no site's main text holds (scripts, forms, menus, notices and the like) goes by
element, role or name, whatever its count, so that the first pages of a host come out clean too.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Container, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import small_batches, table, written

#: A subtree is template if it stands on at least LEAST_PAGES different pages of a host and on at least SHARE of them.
LEAST_PAGES, SHARE = 3, 0.2
#: Different pages that suffice for a whole text, however many pages the host has.
ENOUGH = 30
#: Texts with fewer bytes of letters (table cells, list items, "Yes.") recur by chance.  Inside a marked part
#: they are template only on SHORT_SHARE of the host's pages.
WHOLE, SHORT_SHARE = 20, 0.5
#: What the low two bits of a hash say: a whole text; a short one or a phrase amid a sentence; a short one in a marked part.
IS_WHOLE, IS_SHORT, IS_SHORT_INSIDE = 0, 1, 2
#: Template hashes up to which they are broadcast (8 bytes each); beyond, each page gets its own by a join, in
#: which pages that have more than COPIES copies are dealt to SALTS tasks.
BROADCAST_HASHES, COPIES, SALTS = 1_000_000, 1000, 32

#: Names of elements in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset(
    "script style textarea title xmp iframe noembed noframes head noscript template svg canvas object video audio map nav footer aside form "
    "button select option optgroup datalist input dialog menu menuitem".split()
)
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr "
    "html li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
TABLE = frozenset("table tbody td tfoot th thead tr".split())
#: A start tag of the key closes an open element of the value, up to the nearest scope.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"},
}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select", "datalist"}}
ENDS_P = BLOCK - {"br", "html", "body", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "option", "frameset"}
#: Words of class and id names, and roles, that mark what is not the main text.
BAD_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist tooltip status".split())
BAD_WORD = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promoted promotion nav navbar navigation menu submenu breadcrumb breadcrumbs "
    "header masthead topbar footer sidebar aside widget cookie cookies consent gdpr notice notices disclaimer alert popup modal overlay newsletter subscribe subscription "
    "signup login comment comments comentarios commentaires kommentare disqus respond reply replies share sharing social related recommended pagination pager form search toolbar skip copyright".split()
)
#: Words that may stand beside them in one name ("share-buttons", "related-posts") inside a marked part; with
#: any other the name speaks of the article ("related-work").  Its own headers and headings are its text.
BESIDE = frozenset(
    "area article articles bar block blog bottom box btn button buttons bottom container content entry floating global group holder icon icons inline inner item items js left line link links list main message "
    "module news outer page pages panel post posts reader readers region right section site slot space stack sticky stories story text thread title tools top unit user users wrap wrapper zone".split()
)
OWN = frozenset("header masthead".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Names of which the words above are no sign.
GOOD_WORD = frozenset("article content main post entry story body text".split())

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|[^>])*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAMED = re.compile(r"\b(?:class|id|role|hidden|aria-hidden|style|itemprop)\b", re.I)
WORDS = re.compile(r"[a-z]+")
DIGITS = re.compile(r"\d+")
LETTERS = re.compile(r"[^\W\d_]+")


class Page:
    """Elements in page order: name, mark, parent, end (one after the last descendant), dropped, main; and
    the texts as (element, text, starts a block)."""

    __slots__ = ("name", "mark", "parent", "end", "dropped", "main", "pieces")

    def __init__(self) -> None:
        self.name, self.mark, self.parent, self.end = ["#root"], [""], [-1], [0]
        self.dropped, self.main = [False], [False]
        self.pieces: list[tuple[int, str, bool]] = []


def boilerplate(name: str, attributes: str, depth_in_main: bool) -> tuple[bool, str]:
    """Whether an element is none of the main text by its name and attributes, and its mark."""
    if name in DROPPED:
        return True, ""
    if not attributes or not NAMED.search(attributes):
        return name == "header" and not depth_in_main, ""
    found = {k.lower(): html.unescape(a or b or c or "") for k, a, b, c in ATTRIBUTE.findall(attributes)}
    role = found.get("role", "").lower().strip()
    mark = f"{found.get('class', '')} {found.get('id', '')} {role}".lower()
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
        return True, mark
    if role in BAD_ROLE:
        return True, mark
    if name in ("html", "body", "main", "article"):
        return False, mark
    if depth_in_main:
        named = (set(WORDS.findall(token)) for token in mark.split())
        return name not in HEADINGS and any(words & BAD_WORD - OWN and words <= BAD_WORD | BESIDE for words in named), mark
    words = set(WORDS.findall(mark))
    if name == "header":
        return True, mark
    return bool(words & BAD_WORD) and not (words & GOOD_WORD and not words & {"ad", "ads", "comment", "comments", "nav", "menu", "sidebar", "footer", "related", "share"}), mark


def parse(source: str) -> Page:
    page = Page()
    open_: list[int] = [0]
    count: Counter[str] = Counter()  # of open elements, so that no tag looks for what isn't open
    at, block, n = 0, True, len(source)

    def close_to(depth: int) -> None:
        while len(open_) > depth:
            i = open_.pop()
            page.end[i] = len(page.name)
            count[page.name[i]] -= 1

    def add_text(raw: str) -> None:
        nonlocal block
        if raw:
            page.pieces.append((open_[-1], html.unescape(raw), block))
            block = False

    while at < n:
        lt = source.find("<", at)
        if lt < 0:
            add_text(source[at:])
            break
        m = TOKEN.match(source, lt)
        if m is None:  # a bare "<" is text
            nxt = source.find("<", lt + 1)
            stop = n if nxt < 0 else nxt
            add_text(source[at:stop])
            at = stop
            continue
        add_text(source[at:lt])
        at = m.end()
        if m.group(2) is None:
            if source.startswith("<![CDATA[", lt):
                continue
            continue
        if not source.endswith(">", lt, at):  # the page ends inside a tag
            break
        name = m.group(2).lower()
        if name in BLOCK:
            block = True
        if m.group(1):
            if name in VOID and name != "br" or not count[name]:
                continue
            for depth in range(len(open_) - 1, 0, -1):
                held = page.name[open_[depth]]
                if held == name:
                    close_to(depth)
                    break
                if held in ("article", "main", "body", "table") and name in ("p", "b", "i", "em", "strong", "span", "a", "li", "font", "u", "small"):
                    break  # stray end tags don't close what holds them
            continue
        if name in ENDS_P and count["p"]:
            for depth in range(len(open_) - 1, 0, -1):
                held = page.name[open_[depth]]
                if held == "p":
                    close_to(depth)
                    break
                if held in BLOCK:
                    break
        if name in CLOSES and any(count[c] for c in CLOSES[name]):
            stop = SCOPES.get(name, {"table"})
            for depth in range(len(open_) - 1, 0, -1):
                if not any(count[c] for c in CLOSES[name]):
                    break
                held = page.name[open_[depth]]
                if held in CLOSES[name]:
                    close_to(depth)
                    if name in SCOPES:
                        break
                elif held in stop:
                    break
        parent = open_[-1]
        bad, mark = boilerplate(name, m.group(3), page.main[parent])
        me = len(page.name)
        page.name.append(name)
        page.mark.append(mark)
        page.parent.append(parent)
        page.end.append(me + 1)
        page.dropped.append(bad or page.dropped[parent])
        page.main.append(page.main[parent] or name in ("article", "main"))
        if name in VOID or m.group(3).endswith("/") and name in ("br", "hr", "path"):
            continue
        open_.append(me)
        count[name] += 1
        if name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(source, at)
            stop = close.start() if close else n
            if name in ("textarea", "title"):
                add_text(source[at:stop])
            at = stop
        elif name == "plaintext":
            add_text(source[at:])
            at = n
    close_to(0)
    return page


def keep_main(page: Page) -> int | None:
    """The element that is the page's main part, where it marks one: main's or the page's only article."""
    articles = [i for i, n in enumerate(page.name) if n == "article" and not page.dropped[i] and page.name[page.parent[i]] != "article"]
    outer = [i for i in articles if not any(page.name[p] == "article" for p in ancestors(page, i))]
    if len(outer) == 1:
        return outer[0]
    mains = [i for i, n in enumerate(page.name) if (n == "main" or "main" in page.mark[i].split()[-1:]) and not page.dropped[i]]
    return mains[0] if mains else None


def ancestors(page: Page, i: int) -> Iterator[int]:
    i = page.parent[i]
    while i >= 0:
        yield i
        i = page.parent[i]


def letters_of(text: str) -> int:
    """Bytes of letters, counted up to WHOLE."""
    n = 0
    for m in LETTERS.finditer(text):
        n += len(m.group().encode("utf-8", "replace"))
        if n >= WHOLE:
            break
    return n


def phrases(page: Page) -> set[int]:
    """Inline elements with words beside them in the same block: parts of a sentence."""
    out: set[int] = set()
    run: list[tuple[int, str]] = []

    def close() -> None:
        worded = {e for e, t in run if LETTERS.search(t)} if len(run) > 1 else ()
        low, high = min(worded, default=0), max(worded, default=0)
        for i in worded if low < high else ():
            while i > 0 and page.name[i] not in BLOCK:
                if not i <= low <= high < page.end[i]:
                    out.add(i)
                i = page.parent[i]
        run.clear()

    for e, t, starts in page.pieces:
        if starts:
            close()
        if not page.dropped[e]:
            run.append((e, t))
    close()
    return out


def subtree_hashes(page: Page, inside: int | None, host: str = "") -> dict[int, int]:
    """For each element that could be template (not the marked main part or around it) a 64-bit hash of
    its subtree: host, names, marks and texts, with digits and white space levelled.  The low two bits tell how
    often it must recur.  In a marked part phrases amid a sentence, short tables and cells and texts without
    a letter are content."""
    n = len(page.name)
    text: dict[int, list[str]] = {}
    for e, t, _ in page.pieces:
        text.setdefault(e, []).append(t)
    size, letters, digest, out = [0] * n, [0] * n, [b""] * n, {}
    amid = phrases(page)
    seed = hashlib.blake2b(host.encode("utf-8", "replace") + b"\0", digest_size=8)
    children: list[list[bytes]] = [[] for _ in range(n)]
    kept = set()
    if inside is not None:
        kept = {inside, *ancestors(page, inside)}
    for i in range(n - 1, 0, -1):
        own = DIGITS.sub("0", " ".join(" ".join(text[i]).split())) if i in text else ""
        size[i] += len(own)
        if own and letters[i] < WHOLE:
            letters[i] += letters_of(own)
        state = seed.copy()
        state.update(f"{page.name[i]}\0{page.mark[i]}\0{own}\0".encode("utf-8", "replace"))
        for d in reversed(children[i]):
            state.update(d)
        digest[i] = state.digest()
        size[page.parent[i]] += size[i]
        letters[page.parent[i]] += letters[i]
        children[page.parent[i]].append(digest[i])
        within = inside is not None and inside <= i < page.end[inside]
        if i in kept or not size[i] or page.name[i] in ("html", "body"):
            continue
        if letters[i] >= WHOLE and i not in amid:
            kind = IS_WHOLE
        elif not within:
            kind = IS_SHORT
        elif i not in amid and letters[i] and page.name[i] not in TABLE:
            kind = IS_SHORT_INSIDE
        else:
            continue
        out[i] = int.from_bytes(digest[i], "little", signed=True) & ~3 | kind
    return out


def main_text(page: Page, inside: int | None, template: Container[int], host: str = "") -> str:
    """The texts that stay, blocks joined by one space: white space levelled inside, blocks trimmed."""
    hashes = subtree_hashes(page, inside, host) if template else {}
    gone = [False] * len(page.name)
    for i in range(1, len(page.name)):
        gone[i] = gone[page.parent[i]] or hashes.get(i) in template if hashes else False
    blocks: list[str] = []
    held: list[str] = []
    last = -1
    for e, t, starts in page.pieces:
        if starts or last < 0:
            if held:
                blocks.append("".join(held))
            held = []
        last = e
        if page.dropped[e] or gone[e] or (inside is not None and not inside <= e < page.end[inside]):
            continue
        held.append(t)
    if held:
        blocks.append("".join(held))
    clean = (" ".join(b.split()) for b in blocks)
    return " ".join(b for b in clean if b)


def host_of():
    return F.lower(F.coalesce(F.regexp_extract(F.col("url"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit("")))


class Held:
    """Hashes in sorted order, 8 bytes each, asked like a set."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)

    def __len__(self) -> int:
        return len(self.hashes)

    def __contains__(self, x: int | None) -> bool:
        if x is None:
            return False
        i = int(np.searchsorted(self.hashes, x))
        return i < len(self.hashes) and int(self.hashes[i]) == x


def subtrees(pages: DataFrame) -> DataFrame:
    """host, copy (a hash of host and html), page_mark and hashes (those of its subtrees) of each page.  Columns read: url, html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks, hashes = [], []
            for host, source in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                page = parse(source or "")
                inside = keep_main(page)
                body = DIGITS.sub("0", main_text(page, inside, ()))
                marks.append(int.from_bytes(hashlib.blake2b(body.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True))
                hashes.append(sorted(set(subtree_hashes(page, inside, host).values())))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(marks, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))], names=["host", "copy", "page_mark", "hashes"])

    source = pages.select(host_of().alias("host"), copy_of().alias("copy"), "html")
    return written(source.mapInArrow(run, "host string, copy long, page_mark long, hashes array<long>"), "html-subtrees")


def copy_of():
    return F.xxhash64(host_of(), "html")


def templates(found: DataFrame) -> DataFrame:
    """host and hash of the subtrees that recur: on LEAST_PAGES different pages, and on SHARE of the host's or, if
    whole texts, on ENOUGH.  A hash belongs to one host.

    Pages of the same text but for digits count once, so that copies of a page don't make its text a template.
    """
    # narrow pairs, counted with partial sums: a host with a third of the pages is no single task
    pages_of = found.select("host", "page_mark").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    pairs = found.select("host", "page_mark", F.explode("hashes").alias("hash")).distinct()
    counted = pairs.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_PAGES)
    kind = F.col("hash").bitwiseAND(3)
    share = F.when(kind == IS_SHORT_INSIDE, SHORT_SHARE).otherwise(SHARE)
    enough = (kind == IS_WHOLE) & (F.col("n") >= ENOUGH)
    return counted.join(pages_of, "host").where(enough | (F.col("n") >= share * F.col("pages"))).select("host", "hash")


def own_templates(pages: DataFrame, found: DataFrame, hashes: DataFrame) -> DataFrame:
    """pages (with copy) and template: those of the hashes that stand on the page itself."""
    copies = found.groupBy("copy").agg(F.count(F.lit(1)).alias("n"))
    many = written(copies.where(F.col("n") > COPIES).select("copy", F.lit(SALTS).alias("salts")), "html-copied")  # one in COPIES rows at most
    one = found.select("copy", "hashes").dropDuplicates(["copy"])
    lists = one.select("copy", F.explode("hashes").alias("hash")).join(hashes, "hash").groupBy("copy").agg(F.collect_list("hash").alias("template"))
    lists = lists.join(many, "copy", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    dealt = pages.join(F.broadcast(many), "copy", "left").withColumn("salt", F.floor(F.rand(7) * F.coalesce("salts", F.lit(1))).cast("int"))
    return dealt.join(lists, ["copy", "salt"], "left")


def extract_text(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """pages' key and url with text (empty if none) and n_chars, its code points.

    Null html counts as empty, a null url as host "".  Repeated rows each give a row; pages of equal html
    on one host give equal text.  An empty table gives no rows.  Other columns are not read.
    """
    spark = pages.sparkSession
    small_batches(spark)
    pages = pages.select(F.col(key), "url", "html")
    found = subtrees(pages)
    hashes = written(templates(found).select(F.xxhash64("host").alias("site"), "hash"), "html-templates")
    hosted = pages.withColumn("host", host_of())
    held = None
    if hashes.count() <= BROADCAST_HASHES:
        site, mark = (c.to_numpy() for c in hashes.toArrow().columns)
        held = spark.sparkContext.broadcast((Held(np.unique(site)), Held(mark)))
        joined = hosted.withColumn("template", F.lit(None).cast("array<long>"))
    else:
        joined = own_templates(hosted.withColumn("copy", copy_of()), found, hashes.select("hash"))
    joined = joined.select(key, "url", "html", "template", "host", F.xxhash64("host").alias("site"))
    schema = pages.select(key, "url", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for source, template, host, site in zip(*(b.column(i).to_pylist() for i in (2, 3, 4, 5))):
                page = parse(source or "")
                gone = set(template or ())
                if held is not None and site in held.value[0]:
                    gone = held.value[1]
                texts.append(main_text(page, keep_main(page), gone, host).encode("utf-8", "replace").decode())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[key, "url", "text", "n_chars"]
            )

    return joined.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: the main text of every page."""
    return extract_text(table(spark, sf_dir, "pages"))
