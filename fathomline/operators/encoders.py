"""Encoders: what turns texts into vectors of length 1, as a protocol, and how frames are run through it.

An encoder is any object with the fields of ``Encoder``; it is pickled to the workers.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions import text
from ..functions.code import hash_encode_batch

#: Rows and tokens of a batch of a model.
BATCH_ROWS, BATCH_TOKENS = 16, 8192


class Encoder(Protocol):
    """fingerprint: vectors of different ones never meet.  model: the calibration (a name or kinds), None
    if there is none.  query_format: 1 or 2.  query_prefix: goes in place of the instruction, if given."""

    fingerprint: str
    dim: int
    model: str | dict | None
    query_format: int
    query_prefix: str | None
    document_prefix: str

    def encode(self, texts: list[str]) -> np.ndarray: ...


@dataclass(frozen=True)
class HashEncoder:
    """The hashed bag of words, for want of a model.  Instructions would add the same noise to every
    query, so its prefix is empty."""

    dim: int = 1024
    model: str | dict | None = None
    query_format: int = 1
    query_prefix: str | None = ""
    document_prefix: str = ""

    @property
    def fingerprint(self) -> str:
        return f"hash-{self.dim}"

    def encode(self, texts: list[str]) -> np.ndarray:
        return hash_encode_batch(texts, self.dim)


def batches(lengths: list[int], rows: int = BATCH_ROWS, tokens: int = BATCH_TOKENS) -> Iterator[list[int]]:
    """Places of texts dealt to batches, the longest first: at most ``rows`` texts, and at most ``tokens``
    tokens once all are as long as the longest; a text that is longer goes alone."""
    held: list[int] = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        if held and (len(held) == rows or (len(held) + 1) * lengths[held[0]] > tokens):
            yield held
            held = []
        held.append(i)
    if held:
        yield held


@dataclass
class ModelEncoder:
    """A neural model behind ``run`` (padded ids and mask to vectors) and ``tokenize`` (text to ids)."""

    fingerprint: str
    dim: int
    run: Callable[[np.ndarray, np.ndarray], np.ndarray]
    tokenize: Callable[[str], list[int]]
    model: str | dict | None = None
    query_format: int = 1
    query_prefix: str | None = None
    document_prefix: str = ""

    def encode(self, texts: list[str]) -> np.ndarray:
        ids = [self.tokenize(t) for t in texts]
        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        for places in batches([len(i) for i in ids]):
            width = max(1, max(len(ids[p]) for p in places))
            padded, mask = np.zeros((len(places), width), dtype=np.int64), np.zeros((len(places), width), dtype=np.int64)
            for row, p in enumerate(places):
                padded[row, : len(ids[p])], mask[row, : len(ids[p])] = ids[p], 1
            vectors = np.asarray(self.run(padded, mask), dtype=np.float32)[:, : self.dim]
            out[places] = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
        return out


def verified_fingerprint(folder: str) -> str:
    """The fingerprint of a model folder: its manifest.json (file to SHA-256) must agree with the files."""
    with open(os.path.join(folder, "manifest.json"), encoding="utf-8") as f:
        manifest = json.load(f)
    for name, want in sorted(manifest["files"].items()):
        with open(os.path.join(folder, name), "rb") as f:
            if hashlib.file_digest(f, "sha256").hexdigest() != want:
                raise ValueError(f"{name} doesn't agree with the manifest")
    return f"{manifest['name']}-{hashlib.sha256(json.dumps(manifest['files'], sort_keys=True).encode()).hexdigest()[:12]}"


def query_text(encoder: Encoder, query: Column, context: Column, instruction: str = text.FOR_FILES) -> Column:
    """What the encoder is given for a query: its format's text, with its own prefix for the instruction."""
    if encoder.query_prefix is not None:
        instruction = encoder.query_prefix
    return (text.query_text_2 if encoder.query_format == 2 else text.query_text)(query, context, instruction)


def document_text(encoder: Encoder, doc: Column) -> Column:
    return F.concat(F.lit(encoder.document_prefix), doc)


def vector_of(encoder: Encoder):
    """The column function of an encoder, in Arrow batches; null texts count as empty."""

    @pandas_udf(T.ArrayType(T.FloatType()))
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(encoder.encode([t or "" for t in texts])))

    return run


def with_vectors(df: DataFrame, column: str, encoder: Encoder, out: str = "v") -> DataFrame:
    """df with the vector of each text; each different text is encoded once, whatever rows share it."""
    key = F.xxhash64(F.coalesce(column, F.lit("")))
    once = df.select(F.coalesce(column, F.lit("")).alias("text")).distinct().select(F.xxhash64("text").alias("__key"), vector_of(encoder)("text").alias(out))
    return df.withColumn("__key", key).join(once, "__key").drop("__key")
