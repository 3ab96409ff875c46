"""Hashed word n-grams, and linear models on them.

A feature function turns a text into indices and a factor: a feature's value is
how often its index is there, times the factor. `shares` has hashes of words, of
pairs of neighbouring words and of runs of one to three word forms, by their
share of the text; a form keeps what kinds of characters a word has (`Aa`, `9`,
`a%`), and a word that repeats the one before it has a form of its own. Scores are
sparse dot products, computed as sums of weights looked up by index.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from runsift.llm.common import Memo, map_arrow

WIDTH = 1 << 18
SCALE = 20.0
WORDS_KEPT = 150_000
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_SHIFT = np.uint64(64 - 18)
_KINDS = ((re.compile(r"[^\W\d_]+"), lambda m: "Aa" if m[0][:1].isupper() and m[0][1:].islower() else "A" if m[0].isupper() else "a"), (re.compile(r"\d+"), lambda m: "9"), (re.compile(r"([^\w\s])\1+"), lambda m: m[1] * 2))


def form(word: str) -> str:
    for pattern, kind in _KINDS:
        word = pattern.sub(kind, word)
    return word[:8]


def _pair(word: str) -> int:
    """48 bits of the word and 16 of its form."""
    return (xxhash.xxh3_64_intdigest(word) & ~0xFFFF) | (xxhash.xxh3_64_intdigest(form(word)) & 0xFFFF)


_WORD = Memo(_pair, WORDS_KEPT, stays=True)


Features = Callable[[str | None], tuple[np.ndarray, float]]


def shares(text: str | None) -> tuple[np.ndarray, float]:
    words = text.split() if text else []
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), 0.0
    both = np.fromiter(map(_WORD.__getitem__, words), np.uint64, n)
    word = both >> np.uint64(16)
    kind = (both & np.uint64(0xFFFF)) + np.uint64(1)
    kind[1:][word[1:] == word[:-1]] = np.uint64(0)
    f1 = (kind + np.uint64(3)) * _M3
    f2 = (f1[1:] * _M2) ^ (f1[:-1] * _M1)
    found = [word * _M1, (word[1:] * _M2) ^ (word[:-1] * _M1), f1 * _M2, f2 * _M3, (f2[1:] * _M1) ^ (f1[:-2] * _M3)]
    return (np.concatenate(found) >> _SHIFT).astype(np.int64), SCALE / n


def bare(word: str) -> str:
    return word.strip(_MARKS).lower()


_MARKS = ".,;:!?\"'()[]{}<>*#$%&|-_=+~`\u201c\u201d\u2018\u2019\u00ab\u00bb\u00bf\u00a1"


def training_rows(rows: DataFrame, target: str, features: Features) -> pd.DataFrame:
    """Features of a bounded sample of rows (id, text, target), on the driver: id, target, index and value arrays as bytes."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        index, value = [], []
        for text in batch.column(1).to_pylist():
            found, factor = features(text)
            at, count = np.unique(found, return_counts=True)
            index.append(at.astype("<i4").tobytes())
            value.append((count * factor).astype("<f4").tobytes())
        return pa.record_batch([batch.column(0), batch.column(2), pa.array(index, pa.binary()), pa.array(value, pa.binary())], ["id", "target", "index", "value"])

    found = map_arrow(rows.select(F.col("id").cast("long"), "text", F.col(target).cast("double")), of, "id long, target double, index binary, value binary")
    return found.toPandas().sort_values("id", ignore_index=True)


def ftrl(rows: pd.DataFrame, epochs: int = 4, alpha: float = 0.1, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5, seed: int = 7) -> tuple[np.ndarray, float]:
    """Logistic regression by follow-the-regularised-leader updates, one row at a time: weights and intercept.

    Targets are probabilities. The intercept has no penalty. Rows are taken in a
    fixed shuffled order, so the result is the same each time.
    """
    z, n = np.zeros(WIDTH + 1), np.zeros(WIDTH + 1)
    penalty = np.full(WIDTH + 1, l1)
    penalty[WIDTH] = 0
    index = [np.append(np.frombuffer(x, "<i4"), WIDTH) for x in rows["index"]]
    value = [np.append(np.frombuffer(x, "<f4"), 1.0).astype(np.float64) for x in rows["value"]]
    target = rows["target"].to_numpy()
    order = np.arange(len(rows))
    rng = np.random.default_rng(seed)

    def weights(at) -> np.ndarray:
        out = -(z[at] - np.sign(z[at]) * penalty[at]) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(z[at]) <= penalty[at], 0.0, out)

    for _ in range(epochs):
        rng.shuffle(order)
        for k in order:
            at, x = index[k], value[k]
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - target[k]) * x
            s = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - s * w
            n[at] += g * g
    out = weights(slice(None))
    return out[:WIDTH].astype(np.float32), float(out[WIDTH])


def scores(docs: DataFrame, weights: np.ndarray, intercept: float, features: Features) -> DataFrame:
    """docs (its own columns kept, text last) with text replaced by score."""
    held = docs.sparkSession.sparkContext.broadcast(weights)  # 1 MB
    fields = [f for f in docs.schema.fields if f.name != "text"]

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        w, out = held.value, np.full(batch.num_rows, intercept)
        for i, text in enumerate(batch.column(len(fields)).to_pylist()):
            found, factor = features(text)
            out[i] += float(w[found].sum(dtype=np.float64)) * factor
        p = 1 / (1 + np.exp(-np.clip(out, -35, 35)))
        return pa.record_batch([*(batch.column(k) for k in range(len(fields))), pa.array(p)], [*(f.name for f in fields), "score"])

    schema = docs.drop("text").withColumn("score", F.lit(0.0)).schema
    return map_arrow(docs.select(*[f.name for f in fields], "text"), score, schema)
