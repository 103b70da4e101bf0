"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

A token is a run of word characters or of other visible characters. Hashed features are single tokens, pairs of
neighbours, and triples of token shapes (case, digits, the symbols themselves, and whether a token repeats the one
before). A text is the vector of its feature counts, scaled to length one; a score is a sparse dot product.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, map_text

TOKEN = re.compile(r"\w+|[^\w\s]+")
PAIR, TRIPLE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
REMEMBER, CHUNK = 150_000, 100_000


@dataclass(frozen=True)
class Settings:
    """Bounds and rates of the training: `sample` labelled rows at most, `epochs` over them, 2**`bits` weights."""

    bits: int = 18
    sample: int = 8_000
    epochs: int = 6
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.01
    l2: float = 0.1
    threshold: float = 0.3


def _shape(token: str) -> str:
    if not (token[0].isalnum() or token[0] == "_"):
        return token[:3]
    if token.isdigit():
        return "0"
    return "A" if token.isupper() and len(token) > 1 else "Aa" if token[0].isupper() else "a"


class Hasher(dict):
    """Token to the pair (hash of the token, hash of its shape); forgets everything beyond a bound."""

    def __missing__(self, token: str) -> tuple[int, int]:
        if len(self) > REMEMBER:
            self.clear()
        value = xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass"), 1), xxhash.xxh64_intdigest(_shape(token).encode("utf-8", "surrogatepass"), 2)
        if len(token) <= 64:
            self[token] = value
        return value


HASHED = Hasher()


def features(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted feature numbers of a text and their counts scaled to length one; a text without tokens has none."""
    shift = np.uint64(64 - bits)
    found = TOKEN.finditer(text)
    index, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
    # the two tokens before a triple, and the one that tells whether the first of them is a repeat
    tail = np.zeros((0, 2), np.uint64)
    while tokens := [m[0] for m in islice(found, CHUNK)]:
        both = np.concatenate((tail, np.array([HASHED[t] for t in tokens], dtype=np.uint64)))
        words, shapes = both[:, 0], both[:, 1].copy()
        shapes[1:][words[1:] == words[:-1]] ^= TRIPLE
        new = len(tail)
        single = words[new:]
        pairs = (words[:-1] * PAIR + words[1:])[max(0, new - 1) :]
        triples = ((shapes[:-2] * PAIR + shapes[1:-1]) * TRIPLE + shapes[2:])[max(0, new - 2) :]
        mixed = np.concatenate((single, pairs, triples)) * PAIR
        k, n = np.unique((mixed >> shift).astype(np.int64), return_counts=True)
        if len(index):
            merged, at = np.unique(np.concatenate((index, k)), return_inverse=True)
            k, n = merged, np.bincount(at, weights=np.concatenate((count, n))).astype(np.int64)
        index, count = k, n
        tail = both[-3:]
    return index, count / max(np.sqrt((count.astype(float) ** 2).sum()), 1.0)


def follow(rows: list[tuple[int, np.ndarray, np.ndarray]], s: Settings) -> tuple[np.ndarray, float]:
    """Weights and bias after FTRL-proximal passes over (label, features, values) in the given order.

    The bias stays at the log odds of the labels, so a text of which nothing is known has the score of their share.
    """
    size = 1 << s.bits
    z, n = np.zeros(size), np.zeros(size)
    good = sum(label for label, _, _ in rows)
    bias = float(np.log((good + 1) / (len(rows) - good + 1)))

    def weights(k) -> np.ndarray:
        own, keep = z[k], s.l1
        return np.where(np.abs(own) <= keep, 0.0, -(own - np.sign(own) * keep) / ((s.beta + np.sqrt(n[k])) / s.alpha + s.l2))

    for _ in range(s.epochs):
        for label, index, value in rows:
            k, x = index.astype(np.int64), value.astype(float)
            w = weights(k)
            g = (1.0 / (1.0 + np.exp(-np.clip(w @ x + bias, -35, 35))) - label) * x
            z[k] += g - (np.sqrt(n[k] + g * g) - np.sqrt(n[k])) / s.alpha * w
            n[k] += g * g
    return weights(slice(None)).astype(np.float32), bias


def held_out(id: str = "doc_id"):
    """Whether a row is kept from training: crc32 of its id as text leaves 0 on division by 5 (null id: held out)."""
    return F.coalesce(F.crc32(F.col(id).cast("string")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", settings: Settings = Settings()) -> tuple[np.ndarray, float]:
    """Weights and bias learned from at most `settings.sample` labelled rows that are not held out; `labels` has the
    columns doc_id and quality (0 or 1).

    The rows are those whose ids hash lowest, so a repeated run takes the same. Rows with a null id, null label or
    null text take no part; with none left all weights are 0. Only ids (for the choice) and the finished weights,
    both of bounded size, leave the executors.
    """
    s = settings
    marked = labels.where(F.col("quality").isNotNull()).select(F.col("doc_id").alias("__id"), F.col("quality").cast("int").alias("__label")).where(~held_out("__id"))
    own = docs.select(F.col(id).alias("__id"), F.col(text).alias("__text"))
    ids = own.where("__text is not null").select("__id").join(marked, "__id").orderBy(F.xxhash64("__id"), "__id", "__label").limit(s.sample)
    chosen = own.where("__text is not null").join(F.broadcast(ids), "__id").withColumn("__tie", F.xxhash64("__text"))

    def work(texts: list[str]) -> list[pa.Array]:
        made = [features(t, s.bits) for t in texts]
        return [pa.array([m[0].astype(np.int32) for m in made], pa.list_(pa.int32())), pa.array([m[1].astype(np.float32) for m in made], pa.list_(pa.float32()))]

    rows = map_text(chosen, "__text", ["__id", "__label", "__tie"], work, [("index", "array<int>"), ("value", "array<float>")])
    rows = rows.select(F.xxhash64("__id").alias("h"), "*")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for label, index, value in zip(column(batch, "__label").to_pylist(), column(batch, "index"), column(batch, "value"), strict=True):
                held.append((label, index.values.to_numpy().copy(), value.values.to_numpy().copy()))
        weights, bias = follow(held, s)
        used = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(weights[used], bias).astype(float))], ["k", "w"])

    learned = rows.repartition(1).sortWithinPartitions("h", "__id", "__label", "__tie").mapInArrow(train, "k long, w double").collect()
    weights, bias = np.zeros(1 << s.bits, np.float32), 0.0
    for k, w in learned:
        if k < 0:
            bias = w
        else:
            weights[k] = w
    return weights, bias


def score(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text", keep: list[str] | None = None, settings: Settings = Settings(), names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """`keep` columns (default doc_id) with score (0 to 1) and predicted (1 if score >= threshold), under `names`.

    Whole texts are scored; a null or empty text has the score of the bias alone. Every row keeps its row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    bits = settings.bits

    def work(texts: list[str]) -> list[pa.Array]:
        weights, bias = shared.value
        out = []
        for t in texts:
            index, value = features(t, bits)
            out.append(1.0 / (1.0 + float(np.exp(-np.clip(bias + weights[index] @ value, -35, 35)))))
        return [pa.array(out, pa.float64())]

    found = map_text(docs, text, keep or ["doc_id"], work, [(names[0], "double")])
    return found.withColumn(names[1], (F.col(names[0]) >= settings.threshold).cast("int"))


def op9_quality(spark, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from labels that are not held out."""
    from .common import table

    docs = table(spark, sf_dir, "documents")
    found = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted")
