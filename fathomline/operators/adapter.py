"""The query-side linear map that a repository learns from its history: negatives, fit, use, revision."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.store import Versions

MASK = (1 << 64) - 1
#: Commits used, least number of examples, new commits before a refit.
COMMITS, LEAST, REFIT_EVERY = 200, 20, 50


@dataclass(frozen=True)
class Params:
    steps: int = 80
    lr: float = 1e-3
    reg: float = 0.1
    tau: float = 0.05
    negatives: int = 64


def split_mix(seed: int):
    """The SplitMix64 generator (published constants)."""
    state = seed & MASK
    while True:
        state = state + 0x9E3779B97F4A7C15 & MASK
        z = state
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & MASK
        z = (z ^ z >> 27) * 0x94D049BB133111EB & MASK
        yield z ^ z >> 31


def sample_negatives(positives: list[int], documents: int, k: int, seed: int) -> list[list[int]]:
    """For each positive up to k other documents by a partial shuffle; one generator runs through all."""
    draws, out = split_mix(seed), []
    for p in positives:
        size = documents - (0 <= p < documents)
        moved: dict[int, int] = {}  # the shuffle, only where it differs from ascending order
        at = lambda i: moved.get(i, i)
        chosen = []
        for i in range(min(k, size)):
            j = i + next(draws) % (size - i)
            chosen.append(at(j))
            moved[j] = at(i)
        out.append([x + (x >= p) if 0 <= p < documents else x for x in chosen])
    return out


def fit(queries: np.ndarray, documents: np.ndarray, positives: list[int], negatives: list[list[int]], params: Params = Params()) -> np.ndarray:
    """The d x d map: softmax cross-entropy of the positive among its negatives at temperature tau, plus
    reg * |W - I|^2, by Adam from the identity; float32 throughout."""
    n, d = queries.shape if len(queries) else (0, documents.shape[1])
    eye = np.eye(d, dtype=np.float32)
    if not n:
        return eye
    width = 1 + max(map(len, negatives), default=0)
    ids = np.array([[p, *neg, *[p] * (width - 1 - len(neg))] for p, neg in zip(positives, negatives)])
    real = np.array([[True] * (1 + len(neg)) + [False] * (width - 1 - len(neg)) for neg in negatives])
    candidates = documents.astype(np.float32)[ids]
    q, w = queries.astype(np.float32), eye.copy()
    first, second = np.zeros_like(w), np.zeros_like(w)
    tau = np.float32(params.tau)
    for t in range(1, params.steps + 1):
        z = q @ w
        length = np.linalg.norm(z, axis=1, keepdims=True)
        u = z / length
        logits = np.where(real, np.einsum("nkd,nd->nk", candidates, u) / tau, np.float32(-1e9))
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[:, 0] -= 1
        du = np.einsum("nk,nkd->nd", p / np.float32(n), candidates) / tau
        dz = (du - u * (u * du).sum(axis=1, keepdims=True)) / length
        g = q.T @ dz + np.float32(2 * params.reg) * (w - eye)
        first = np.float32(0.9) * first + np.float32(0.1) * g
        second = np.float32(0.999) * second + np.float32(0.001) * g * g
        w = w - np.float32(params.lr) * (first / np.float32(1 - 0.9**t)) / (np.sqrt(second / np.float32(1 - 0.999**t)) + np.float32(1e-8))
    return w.astype(np.float32)


def apply(vector: np.ndarray, weights: np.ndarray) -> np.ndarray:
    out = vector @ weights
    return out / max(float(np.linalg.norm(out)), 1e-8)


def revision(weights: np.ndarray) -> str:
    """The first 12 hex digits of the SHA-1 of the weights as little-endian float16."""
    return hashlib.sha1(weights.astype("<f2").tobytes()).hexdigest()[:12]


def sample_from(pool: list, k: int, seed: int) -> list:
    """Up to k of a pool without repetition, by the same shuffle with its own seed."""
    return [pool[i] for i in sample_negatives([-1], len(pool), k, seed)[0]]


def fit_per_repository(examples: DataFrame, documents: DataFrame, params: Params = Params(), seed: int = 0) -> DataFrame:
    """repo, revision, examples, weights.  examples: repo, n (0: the newest), pos (document number), q, and
    documents: repo, doc, v.  The newest COMMITS examples count.

    One group a repository; its examples are bounded by COMMITS and its documents by its files."""
    newest = Window.partitionBy("repo").orderBy("n")
    examples = examples.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= COMMITS).drop("place")

    def one(key, e: pd.DataFrame, docs: pd.DataFrame) -> pd.DataFrame:
        docs, e = docs.sort_values("doc"), e.sort_values("n")
        if len(docs) < 2 or len(e) < LEAST:
            return pd.DataFrame(columns=["repo", "revision", "examples", "weights"], dtype=object)
        number = {d: i for i, d in enumerate(docs.doc)}
        positives = [number[p] for p in e.pos]
        negatives = sample_negatives(positives, len(docs), params.negatives, seed)
        w = fit(np.stack(e.q.values), np.stack(docs.v.values), positives, negatives, params)
        return pd.DataFrame({"repo": [key[0]], "revision": [revision(w)], "examples": [len(e)], "weights": [w.ravel().tolist()]})

    return examples.groupBy("repo").cogroup(documents.groupBy("repo")).applyInPandas(one, "repo string, revision string, examples long, weights array<float>")


def needs_fit(state: str, same_model: bool, new_commits: int | None) -> bool:
    """Whether a fit is due: none yet, another model, an unknown cut-off, or enough new commits."""
    return state in ("none", "invalidated") or not same_model or new_commits is None or new_commits >= REFIT_EVERY


class AdapterStore:
    """The adapter of a repository and model under a folder, with the one before it for a way back."""

    SCHEMA = "revision string, base string, dim long, examples long, cutoff string, weights array<float>"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.held = spark, Versions(spark, root)

    def save(self, weights: np.ndarray, base: str, examples: int, cutoff: str | None = None) -> str:
        """Stores weights as float16 gives them; the revision."""
        rounded = weights.astype("<f2").astype(np.float32)
        row = (revision(weights), base, len(weights), examples, cutoff, rounded.ravel().tolist())
        self.held.write(self.spark.createDataFrame([row], self.SCHEMA).coalesce(1), keep=1)
        return row[0]

    def load(self) -> dict | None:
        """What ``ask`` takes as adapter, or None where there is none or its size isn't dim * dim."""
        table = self.held.read()
        row = None if table is None else table.first()
        if row is None or len(row.weights) != row.dim**2:
            return None
        return row.asDict() | {"weights": np.array(row.weights, dtype=np.float32).reshape(row.dim, row.dim)}

    def rollback(self) -> dict:
        """The adapter before the last one serves again; an error where there is none."""
        numbers = self.held.numbers()
        if len(numbers) < 2:
            raise ValueError("no earlier adapter to go back to")
        self.held.drop(numbers[-1])
        return self.load()
