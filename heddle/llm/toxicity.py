"""Toxicity scores: FTRL-proximal logistic regression (McMahan et al., 2013) over hashed word features.

Features of a text, each present or not: words, their first five letters, word pairs, and pairs with one or two words skipped, hashed to
2**20 places. Learning rates are kept per coordinate and an L1 penalty leaves most weights at zero, so the model is a short list.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .caches import Hashes, use
from .common import ship

PLACES = 1 << 20
_WORD = re.compile(r"\w+")
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93], dtype=np.uint64)


_words, _stems = Hashes(), Hashes()


def _forget() -> None:
    _words.clear()
    _stems.clear()


def _mixed(x: np.ndarray) -> np.ndarray:
    return ((x ^ (x >> np.uint64(29))) * _MIX[0]) >> np.uint64(44)  # the top 20 bits


def features(text: str | None) -> np.ndarray:
    """Places of a text's features, repeats included."""
    use("toxicity", _forget)
    words = _WORD.findall((text or "").lower())
    n = len(words)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    stem = np.fromiter(map(_stems.__getitem__, [w[:5] for w in words]), np.uint64, n)
    sets = [h * _MIX[1], stem * _MIX[2]]
    sets += [h[:-gap] * _MIX[2 + gap] + h[gap:] * _MIX[1] for gap in (1, 2, 3) if n > gap]
    return _mixed(np.concatenate(sets)).astype(np.int32)


class Ftrl:
    """Per-coordinate FTRL-proximal; place PLACES is the intercept, which is not penalised."""

    def __init__(self, alpha: float = 0.3, beta: float = 1.0, l1: float = 6.0, l2: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(PLACES + 1), np.zeros(PLACES + 1)

    def weights(self, idx) -> np.ndarray:
        z = self.z[idx]
        l1 = np.where(np.asarray(idx) == PLACES, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(self.n[idx])) / self.alpha + self.l2))

    def learn(self, idx: np.ndarray, label: int) -> None:
        w = self.weights(idx)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[idx]
        self.z[idx] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[idx] = n + g * g


def _train(rows: Iterator[tuple[str | None, int]], epochs: int) -> tuple[np.ndarray, np.ndarray]:
    model = Ftrl()
    data = [(np.append(np.unique(features(text)), np.int32(PLACES)), label) for text, label in rows]
    for _ in range(epochs):
        for idx, label in data:
            model.learn(idx, label)
    w = model.weights(np.arange(PLACES + 1))
    used = np.flatnonzero(w)
    return used.astype(np.int64), w[used]


def held_out(id_col: str = "doc_id"):
    """Whether a row's labels are kept from training: crc32 of the id as text leaves 1 modulo 3. False for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 5000, most_chars: int = 64_000_000, epochs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(places, weights), the non-zero ones, at most 2**20 + 1.

    Trains on at most `per_class` labelled ids of each class that are not held out, those of least hash, and of these on as many whole
    texts in that order as have `most_chars` characters together: features take about four bytes a character. Rows without a label or
    id are ignored; an id labelled both ways counts as toxic, one of several texts gives that of least hash. Without labelled rows there
    are no weights and every score is 0.5.
    """
    spark = docs.sparkSession
    ship(spark)
    known = labels.select(F.col("doc_id").alias("_key"), F.col("toxic").cast("int").alias("_y")).where("_key is not null and _y is not null").where(~held_out("_key")).groupBy("_key").agg(F.max("_y").alias("_y"))
    order = F.xxhash64("_key")
    present = docs.select(F.col(id_col).cast("long").alias("_key")).where("_key is not null").distinct()
    known = known.join(present, "_key", "left_semi")  # so that in a later stage the sample comes from what is there
    picked = [known.where(F.col("_y") == y).orderBy(order, "_key").limit(per_class) for y in (0, 1)]
    ids = picked[0].union(picked[1])  # at most 2 * per_class rows, whatever the input
    texts = docs.select(F.col(id_col).cast("long").alias("_key"), F.col(text_col).alias("_text"))
    sample = texts.join(F.broadcast(ids), "_key").groupBy("_key", "_y").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text"))
    so_far = F.sum(F.coalesce(F.length("_text"), F.lit(0))).over(Window.orderBy(order, "_key"))  # over at most 2 * per_class rows
    sample = sample.withColumn("_chars", so_far).where(F.col("_chars") <= most_chars).select("_key", "_text", "_y")

    def train(batches):
        rows = ((t, y) for b in batches for t, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist()))
        used, w = _train(rows, epochs)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(w)], names=["place", "weight"])

    got = sample.mapInArrow(train, "place bigint, weight double").toPandas()
    return got["place"].to_numpy(), got["weight"].to_numpy()


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with a score column, 0 to 1; null texts score as empty ones. Every row and column is kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the weights that are not zero

    def one(text: str | None, w: np.ndarray) -> float:
        idx = features(text)
        idx = np.unique(idx[w[idx] != 0])
        return float(1 / (1 + np.exp(-np.clip(w[PLACES] + w[idx].sum(dtype=np.float64), -35, 35))))

    @F.pandas_udf("double")
    def scores(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = np.zeros(PLACES + 1, dtype=np.float32)
        w[shared.value[0]] = shared.value[1]
        for texts in parts:
            yield pd.Series([one(x, w) for x in texts], dtype="float64")

    return docs.withColumn(name, scores(F.col(text_col)))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row; see fit and score for nulls, ties and empty tables."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels, **options))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
