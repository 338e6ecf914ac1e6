"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

Texts are cut into words by character classes on one flat array of code points.  The words that are
new to a worker have their symbols laid end to end in one flat array; in each round every pair of
neighbouring symbols looks up its rank by binary search over the sorted pair keys, and each word
merges all occurrences of its lowest-ranked pair.  A word leaves the array when no pair has a rank.
Words already seen keep their ids in a bounded table, found by two hashes of 64 bits each.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import small_batches, table

#: The white space characters that the pre-tokenizer's \s stands for.
SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
OTHER, LETTER, NUMBER, SPACE, CUT = range(5)
NO_RANK = np.int32(2**31 - 1)
#: Words kept per worker before the table starts anew, and characters taken at once.
WORDS_KEPT = 250_000
CHARS_AT_ONCE = 1_000_000

_classes: np.ndarray | None = None
_models: dict[str, "ByteBPE"] = {}


def char_classes() -> np.ndarray:
    global _classes
    if _classes is None:
        major = np.frombuffer("".join(unicodedata.category(chr(c))[0] for c in range(0x110000)).encode(), dtype=np.uint8)
        _classes = np.where(major == ord("L"), LETTER, np.where(major == ord("N"), NUMBER, OTHER)).astype(np.uint8)
        _classes[SPACES] = SPACE
    return _classes


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte: itself if visible, else the next free one from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of the spans [start, start + length), one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


#: Odd multipliers of the two polynomial hashes of a word.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and its inverse modulo 2 ** 64, for i below n at least."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = max(n, CHARS_AT_ONCE + CHARS_AT_ONCE // 4)
        both = []
        for b in (base, pow(base, -1, 2**64)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        _powers[base] = (both[0], both[1])
    return _powers[base]


def word_hashes(code: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit hashes of each span of code points, from prefix sums of a polynomial modulo 2 ** 64."""
    out = []
    for base in BASES:
        up, down = powers(base, len(code) + 1)
        total = np.zeros(len(code) + 1, dtype=np.uint64)
        np.cumsum((code.astype(np.uint64) + np.uint64(base >> 40)) * up[: len(code)], out=total[1:])
        value = (total[ends] - total[begins]) * down[begins]
        value ^= value >> np.uint64(29)
        value *= np.uint64(0xBF58476D1CE4E5B9)
        out.append(value ^ (value >> np.uint64(32)))
    return out


class ByteBPE:
    """A vocabulary file of the tokenizers library: byte-level BPE with the usual English contractions."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_re = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        as_bytes = {i: bytes(alphabet[c] for c in s) for s, i in vocab.items() if s not in self.specials}
        as_bytes |= {i: s.encode() for s, i in self.specials.items()}
        size = max(as_bytes) + 1
        self.token_bytes = np.frombuffer(b"".join(as_bytes.get(i, b"") for i in range(size)), dtype=np.uint8)
        self.token_len = np.array([len(as_bytes.get(i, b"")) for i in range(size)], dtype=np.int64)
        self.token_at = np.cumsum(self.token_len) - self.token_len
        self.byte_id = np.array([vocab[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])], dtype=np.uint32)
        key = np.array([vocab[a] << 16 | vocab[b] for a, b in merges], dtype=np.uint32)
        order = np.argsort(key, kind="stable")
        self.pair_keys = key[order]
        self.pair_rank = np.arange(len(key), dtype=np.int32)[order]
        self.merged = np.array([vocab[a + b] for a, b in merges], dtype=np.uint32)
        self._forget()

    def _forget(self) -> None:
        self.hash = np.zeros(0, dtype=np.uint64)
        self.check = np.zeros(0, dtype=np.uint64)
        self.row = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.int32)
        self.at = np.zeros(0, dtype=np.int64)
        self.len = np.zeros(0, dtype=np.int64)

    # words

    def cut(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray, dict[int, int]]:
        """All texts in one string with its code points, where its words begin and end, how many words
        each text has, and the ids of the words that are special tokens."""
        pieces, owner, special = [], [], {}
        for i, text in enumerate(texts):
            parts = [text]
            if self.special_re is not None and any(s in text for s in self.specials):
                parts = [p for p in self.special_re.split(text) if p]
            for p in parts:
                if p in self.specials:
                    special[len(pieces)] = self.specials[p]
                pieces.append(p)
                owner.append(i)
        if not pieces:
            none = np.zeros(0, dtype=np.int64)
            return "", none.astype(np.uint32), none, none, np.zeros(len(texts), dtype=np.int64), {}
        flat = "\0".join(pieces) + "\0"
        code = np.frombuffer(flat.encode("utf-32-le"), dtype=np.uint32)
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        stop = np.cumsum(lengths + 1) - 1
        kind = char_classes()[code]
        kind[stop] = CUT

        start = np.ones(len(kind), dtype=bool)
        np.not_equal(kind[1:], kind[:-1], out=start[1:])
        start[1:] |= kind[:-1] == CUT
        # white space before a word gives up its last character; a plain space joins the word
        last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] < SPACE))
        start[last] = True
        start[last[code[last] == 0x20] + 1] = False
        # contractions, where an apostrophe stands alone between words
        quote = np.flatnonzero((code == 0x27) & start)
        if len(quote):
            padded = np.concatenate([code, np.zeros(2, dtype=np.uint32)])
            one, two = padded[quote + 1], padded[quote + 2]
            size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, 0)
            for pair in ("re", "ve", "ll"):
                size[(one == ord(pair[0])) & (two == ord(pair[1]))] = 2
            quote, size = quote[size > 0], size[size > 0]
            start[quote + 1] = False
            start[quote + 1 + size] = True
        for p in special:
            begin = int(stop[p] - lengths[p])
            start[begin:stop[p]] = False
            start[begin] = True
        begins = np.flatnonzero(start)
        ends = np.append(begins[1:], len(kind))
        real = kind[begins] != CUT
        begins, ends = begins[real], ends[real]
        tokens = {int(np.searchsorted(begins, stop[p] - lengths[p])): token for p, token in special.items()}
        piece = np.searchsorted(stop, begins, side="right")
        counts = np.bincount(np.asarray(owner, dtype=np.int64)[piece], minlength=len(texts))
        return flat, code, begins, ends, counts, tokens

    # merges

    def _ranks(self, symbol: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The ranks of the pairs that begin at these places."""
        out = np.full(len(at), NO_RANK, dtype=np.int32)
        after = np.minimum(at + 1, len(symbol) - 1)
        key = symbol[at] << np.uint32(16) | symbol[after]
        found = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        hit = (self.pair_keys[found] == key) & (word[after] == word[at]) & (after > at)
        out[hit] = self.pair_rank[found[hit]]
        return out

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words end to end, and how many each has."""
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        symbol = self.byte_id[np.frombuffer(b"".join(words), dtype=np.uint8)]
        word = np.repeat(np.arange(len(words)), size)
        done_symbol, done_word = [], []
        rank = self._ranks(symbol, word, np.arange(len(symbol)))
        while len(symbol):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, first)
            best = np.repeat(best, np.diff(np.append(first, len(word))))
            over = best == NO_RANK
            if over.any():
                done_symbol.append(symbol[over])
                done_word.append(word[over])
                on = ~over
                symbol, word, rank, best = symbol[on], word[on], rank[on], best[on]
                if not len(symbol):
                    break
            chosen = rank == best
            # of pairs that overlap, as in "aaa", every second one counts from the left
            opens = chosen.copy()
            opens[1:] &= ~chosen[:-1]
            if opens.sum() != chosen.sum():
                place = np.arange(len(chosen))
                chosen &= (place - np.maximum.accumulate(np.where(opens, place, 0))) % 2 == 0
            at = np.flatnonzero(chosen)
            symbol[at] = self.merged[rank[at]]
            keep = np.ones(len(symbol), dtype=bool)
            keep[at + 1] = False
            symbol, word, rank = symbol[keep], word[keep], rank[keep]
            at -= np.arange(len(at))  # where the merged symbols are now
            changed = np.concatenate([at, at[at > 0] - 1])
            rank[changed] = self._ranks(symbol, word, changed)
        if not done_symbol:
            return np.zeros(0, dtype=np.int32), np.zeros(len(words), dtype=np.int64)
        symbol, word = np.concatenate(done_symbol), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return symbol[order].astype(np.int32), np.bincount(word, minlength=len(words))

    def _index(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The place in the word table of each word of the texts, and how many words each text has."""
        flat, code, begins, ends, per_text, tokens = self.cut(texts)
        if not len(begins):
            return begins, per_text
        first, second = word_hashes(code, begins, ends)
        for i, token in tokens.items():
            first[i], second[i] = token, 0
        unique, where, inverse = np.unique(first, return_index=True, return_inverse=True)
        if (second[where][inverse] != second).any():
            raise ValueError("two words share a 64-bit hash")
        spot = np.minimum(np.searchsorted(self.hash, unique), max(len(self.hash) - 1, 0))
        known = (self.hash[spot] == unique) if len(self.hash) else np.zeros(len(unique), dtype=bool)
        if (self.check[spot[known]] != second[where[known]]).any():
            raise ValueError("two words share a 64-bit hash")
        new = np.flatnonzero(~known)
        if len(new):
            lo, hi = begins[where[new]].tolist(), ends[where[new]].tolist()
            words = [flat[a:b].encode() for a, b in zip(lo, hi)]
            special = {k: tokens[i] for k, i in enumerate(where[new].tolist()) if i in tokens} if tokens else {}
            for k in special:
                words[k] = b""
            ids, size = self.merge(words)
            for k, token in sorted(special.items()):
                ids = np.insert(ids, size[:k].sum(), token)
                size[k] = 1
            row = len(self.len) + np.arange(len(new))
            self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(size) - size])
            self.len = np.concatenate([self.len, size])
            self.ids = np.concatenate([self.ids, ids])
            hashes = np.concatenate([self.hash, unique[new]])
            order = np.argsort(hashes, kind="stable")
            self.hash = hashes[order]
            self.check = np.concatenate([self.check, second[where[new]]])[order]
            self.row = np.concatenate([self.row, row])[order]
            spot = np.searchsorted(self.hash, unique)
        return self.row[spot][inverse], per_text

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and how many each text has."""
        if len(self.len) > WORDS_KEPT:
            self._forget()
        try:
            index, per_text = self._index(texts)
        except ValueError:  # words are told apart by 128 bits of hash; where 64 clash, texts go one by one
            self._forget()
            if len(texts) == 1:
                raise
            parts = [self.encode([t]) for t in texts]
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        size = self.len[index]
        out = self.ids[ragged(self.at[index], size)]
        ends = np.cumsum(np.append(0, size))[np.cumsum(np.append(0, per_text))]
        return out, np.diff(ends)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of consecutive runs of ids; bytes that are no UTF-8 become U+FFFD, unknown ids nothing."""
        ids = np.where((ids >= 0) & (ids < len(self.token_len)), ids, 0).astype(np.int64)
        size = self.token_len[ids]
        raw = self.token_bytes[ragged(self.token_at[ids], size)].tobytes()
        ends = np.cumsum(np.append(0, size))[np.cumsum(np.append(0, counts))].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]


def model(path: str) -> ByteBPE:
    """The vocabulary of a file, read once by each worker."""
    if path not in _models:
        _models[path] = ByteBPE(path)
    return _models[path]


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def slices(texts: list[str], limit: int = CHARS_AT_ONCE) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``limit`` characters; a longer text is a run of its own."""
    begin = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > limit:
            yield begin, i
            begin, held = i, 0
        held += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def bpe_encode(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """df with the column ``out`` (array of int): the ids of each whole text, as the vocabulary's own library gives them.

    Null texts count as empty and have no ids.  Other columns pass through; a column already named
    ``out`` is replaced.  An empty table stays empty.
    """
    small_batches(df.sparkSession)
    df = df.drop(out) if out in df.columns else df
    schema = df.select("*", F.lit(None).cast("array<int>").alias(out)).schema
    names = [*df.columns, out]
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for b in batches:
            texts = [t or "" for t in b.column(at).to_pylist()]
            for lo, hi in slices(texts):
                ids, counts = bpe.encode(texts[lo:hi])
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(np.append(0, counts)), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*b.slice(lo, hi - lo).columns, lists], names=names)

    return df.mapInArrow(run, schema)


def bpe_decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the column ``out`` (string): the text of each row's ids, special tokens included.

    Null ids give the empty text, as no ids do; null or unknown ids inside a list give nothing.
    """
    small_batches(df.sparkSession)
    df = df.drop(out) if out in df.columns else df
    schema = df.select("*", F.lit(None).cast("string").alias(out)).schema
    names = [*df.columns, out]
    at = names.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                lists = part.column(at)
                counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
                keep = (flat >= 0) & (flat < len(bpe.token_len))
                if not keep.all():
                    row = np.repeat(np.arange(len(counts)), counts)
                    counts, flat = np.bincount(row[keep], minlength=len(counts)), flat[keep]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(bpe.decode(flat, counts), pa.string())], names=names)

    return df.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: digests of the ids and of the decoded text of every document."""
    path = vocabulary_path()
    coded = bpe_encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path).drop("text")
    return bpe_decode(coded, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
