"""Language identification by string kernels.

The kernel is a blended spectrum of n-gram presence: each text is the set of its character n-grams
(1 to 4 letters and word edges, lower-cased, hashed to ``DIM`` slots), and the kernel of two texts is
the number of common slots over the geometric mean of their set sizes.  A bounded set of labelled texts
gives the Nyström landmarks and the rows that the one-versus-rest kernel ridge regression is fitted
on.  Scoring a batch is two matrix products: presence rows by landmarks gives the kernel, and the
kernel by the dual weights gives a score per language.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import small_batches, table

#: Slots of the hashed n-gram sets and the n-gram lengths.
DIM, ORDERS = 1 << 14, (1, 2, 3, 4)
#: Landmarks and training rows per language at most: the bound of the labelled sample.
LANDMARKS, ROWS = 32, 300
#: Parts of a language whose smallest hashes are found apart.
PARTS = 16
RIDGE = 1e-2
UNKNOWN = "und"

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point: a mixed 32-bit code of the letter, 0 for what is no letter or mark."""
    global _letters
    if _letters is None:
        major = np.frombuffer("".join(unicodedata.category(chr(c))[0] for c in range(0x110000)).encode(), dtype=np.uint8)
        code = np.arange(0x110000, dtype=np.uint32) * np.uint32(0x9E3779B1) | np.uint32(1)
        _letters = np.where((major == ord("L")) | (major == ord("M")), code, 0).astype(np.uint32)
    return _letters


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text)) if len(text) < 64 else bool(re.search(r"[^\W\d_]", text)) and any(map(str.isalpha, text))


def presence(text: str) -> np.ndarray:
    """The slots of a whole text's n-grams as booleans; runs of other characters are one word edge."""
    out = np.zeros(DIM, dtype=bool)
    code = letters()[np.frombuffer((" " + text.lower() + " ").encode("utf-32-le"), dtype=np.uint32)]
    keep = code != 0
    keep[0] = True
    keep[1:] |= code[:-1] != 0
    code = code[keep]
    gram = np.zeros(len(code), dtype=np.uint32)
    shift = np.uint32(32 - DIM.bit_length() + 1)
    for n in ORDERS:
        # the gram that ends at each place, one letter longer in each round
        gram = gram[:-1] * np.uint32(0x85EBCA6B) + code[n - 1 :] + np.uint32(n) if n > 1 else code + np.uint32(1)
        if not len(gram):
            break
        mixed = gram * np.uint32(0xC2B2AE35)
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x27D4EB2F)
        out[mixed >> shift] = True
    return out


@dataclass
class Classifier:
    """Languages, landmarks (unit rows), and the weights that turn a row of the kernel into scores."""

    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def kernel(self, rows: np.ndarray) -> np.ndarray:
        size = np.sqrt(np.maximum(rows.sum(axis=1, dtype=np.float32), 1))
        return (rows.astype(np.float32) @ self.landmarks.T) / size[:, None]

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return self.kernel(rows) @ self.weights + self.bias

    def predict(self, texts: list[str | None], at_once: int = 256) -> tuple[list[str], np.ndarray]:
        """A language and a score from 0 to 1 for each text: the ridge regression's estimate, clipped, of the winner."""
        languages, best = [], np.zeros(len(texts))
        for lo in range(0, len(texts), at_once):
            part = texts[lo : lo + at_once]
            known = [i for i, t in enumerate(part) if t and has_letter(t)] if self.languages else []
            named = [UNKNOWN] * len(part)
            if known:
                s = self.scores(np.stack([presence(part[i]) for i in known]))
                win = s.argmax(axis=1)
                best[lo + np.array(known)] = np.clip(s[np.arange(len(known)), win], 0, 1)
                for i, w in zip(known, win):
                    named[i] = self.languages[w]
            languages += named
        return languages, best


def fit(rows: np.ndarray, labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Classifier:
    """Nyström features on ``landmarks`` rows per language (the first ones), then ridge regression per language."""
    names = sorted(set(labels))
    label = np.array([names.index(x) for x in labels], dtype=int)
    if not names:
        none = np.zeros((0, 0), dtype=np.float32)
        return Classifier([], np.zeros((0, DIM), dtype=np.float32), none, np.zeros(0, dtype=np.float32))
    unit = rows.astype(np.float32) / np.sqrt(np.maximum(rows.sum(axis=1, dtype=np.float32), 1))[:, None]
    chosen = np.concatenate([np.flatnonzero(label == k)[:landmarks] for k in range(len(names))])
    marks = unit[chosen]
    value, vector = np.linalg.eigh((marks @ marks.T).astype(float))
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])  # kernel rows to Nyström features
    feature = (unit @ marks.T).astype(float) @ root
    target = (label[:, None] == np.arange(len(names))).astype(float)
    # every language weighs the same
    weight = 1.0 / np.bincount(label, minlength=len(names))[label]
    weight /= weight.sum()
    centre, middle = weight @ feature, weight @ target
    f, t = feature - centre, target - middle
    beta = np.linalg.solve((f * weight[:, None]).T @ f + ridge / len(rows) * np.eye(f.shape[1]), (f * weight[:, None]).T @ t)
    return Classifier(names, marks, (root @ beta).astype(np.float32), (middle - centre @ beta).astype(np.float32))


def held_out(key: str):
    """crc32 of the key as text, mod 5, is 0 (null keys count as the empty text)."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", rows: int = ROWS) -> Classifier:
    """Fits on at most ``rows`` texts per language, those of the smallest hash of the text, out of the
    documents that are not held out.  Only their hashed n-gram sets (DIM bits each) reach the driver."""
    labelled = docs.where(~held_out(key) & F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.length(F.trim(F.col(text))) > 0))
    labelled = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(text), F.lit("sample")).alias("h"))
    # narrow first: the hash that admits enough texts of a language, then the texts themselves; the smallest
    # of each of PARTS parts of a language, then of these, so that no task gathers a language
    spaced = labelled.select("lang", "h").distinct().withColumn("part", F.pmod("h", F.lit(PARTS)))
    for by in (["lang", "part"], ["lang"]):
        spaced = spaced.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("h"))).where(F.col("n") <= rows).drop("n")
    picked = spaced.groupBy("lang").agg(F.max("h").alias("most")).collect()
    if not picked:
        return fit(np.zeros((0, DIM), dtype=bool), [])
    limit = F.create_map(*[F.lit(v) for x in picked for v in (x.lang, x.most)])  # one entry a language
    sample = labelled.where(F.col("h") <= limit[F.col("lang")]).dropDuplicates(["lang", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = [np.packbits(presence(t)).tobytes() if has_letter(t) else None for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(bits, pa.binary())], names=["lang", "h", "bits"])

    got = [x for x in sample.mapInArrow(run, "lang string, h long, bits binary").collect() if x.bits is not None]  # rows * DIM bits a language
    got.sort(key=lambda x: (x.lang, x.h))
    bits = np.array([np.unpackbits(np.frombuffer(x.bits, dtype=np.uint8)) for x in got], dtype=np.uint8).reshape(len(got), DIM)
    return fit(bits.astype(bool), [x.lang for x in got])


def identify(docs: DataFrame, classifier: Classifier, text: str = "text", predicted: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the language and the score of every whole text.

    ``und`` with score 0 for null texts, texts without a letter, and whenever nothing was learned.  Other
    columns pass through; columns already named like the results are replaced.  Equal texts get equal
    results; an empty table stays empty.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop(*[c for c in (predicted, score) if c in docs.columns])
    schema = docs.select("*", F.lit("").alias(predicted), F.lit(0.0).alias(score)).schema
    names = schema.names
    at = names.index(text)
    held = docs.sparkSession.sparkContext.broadcast(classifier)  # landmarks * DIM floats a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for b in batches:
            languages, scores = model.predict(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(languages, pa.string()), pa.array(scores, pa.float64())], names=names)

    return docs.mapInArrow(run, schema)


def with_letters(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows whose text holds a letter."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([bool(t) and has_letter(t) for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: the predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs)
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0
