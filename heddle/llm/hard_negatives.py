"""Hard negatives for anchors by one-bit codes of rotated vectors (Gao and Long, 2024), exact in the end.

A vector is turned by random signs and a Hadamard transform; its code has the signs of what comes out, and with it stand the length of
the vector along its code (the alignment) and the length of what remains. An anchor's coordinates are quantised to eight bits, so that
its product with a code is eight popcounts; with the alignment this gives an estimate of its product with the vector, and what remains
bounds the error by Cauchy and Schwarz. The interval is certain: a row is scored in integers unless its interval rules it out.

Anchors and rows meet in blocks: either side is dealt by hash, a block pair is one group of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, stage
from .vector_dedup import hadamard

#: Anchors in a block at most, on average; rows in a block, on average, at least and at most.
ANCHORS, LEAST_ROWS, MOST_ROWS = 2048, 1024, 32768
_SEED, _BITS = 2024, 8
_INDEX = "row bigint, id bigint, label string, is_anchor boolean, dim int, ints binary, code binary, along double, rest double, norm double"


def rotated(x: np.ndarray) -> np.ndarray:
    """Rows turned at random, padded to a power of two of 64 or more columns; lengths stay."""
    d = 1 << max(6, (x.shape[1] - 1).bit_length())
    y = np.pad(x, ((0, 0), (0, d - x.shape[1])))
    rng = np.random.default_rng(_SEED + x.shape[1])
    for _ in range(3):
        y = hadamard(y * rng.choice([-1.0, 1.0], d)) / np.sqrt(d)
    return y


def coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes as 64-bit words, lengths along the code and off it, and lengths of the rows of x."""
    y = rotated(x)
    norm2 = (y * y).sum(1)
    along = np.abs(y).sum(1) / np.sqrt(y.shape[1])
    return np.packbits(y > 0, axis=1, bitorder="little").view(np.uint64), along, np.sqrt(np.maximum(norm2 - along**2, 0)), np.sqrt(norm2)


class Anchor:
    """An anchor's rotated vector, quantised, and its intervals with coded rows."""

    def __init__(self, y: np.ndarray):
        self.dim, self.norm2 = len(y), float(y @ y)
        self.low = float(y.min())
        self.step = (float(y.max()) - self.low) / ((1 << _BITS) - 1) or 1.0
        u = np.clip(np.rint((y - self.low) / self.step), 0, (1 << _BITS) - 1).astype(np.int64)
        told = self.low + self.step * u
        self.sum, self.off = float(told.sum()), float(np.abs(y - told).sum()) / np.sqrt(self.dim)
        self.planes = [np.packbits((u >> b & 1).astype(bool), bitorder="little").view(np.uint64) for b in range(_BITS)]

    def bounds(self, code: np.ndarray, ones: np.ndarray, along: np.ndarray, rest: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Between what the products with the rows lie."""
        total = sum(np.bitwise_count(code & plane).sum(1, dtype=np.int64) << b for b, plane in enumerate(self.planes))
        on_code = (2 * (self.step * total + self.low * ones) - self.sum) / np.sqrt(self.dim)
        least = np.maximum(np.abs(on_code) - self.off, 0)
        error = along * self.off + rest * np.sqrt(np.maximum(self.norm2 - least**2, 0))
        error += 1e-9 * norm * np.sqrt(self.norm2) + 1e-6  # rounding of doubles
        return along * on_code - error, along * on_code + error


class _Rows:
    """One block's rows of one length."""

    def __init__(self, pdf: pd.DataFrame):
        n = len(pdf)
        self.row, self.id, self.label = pdf["row"].to_numpy(), pdf["id"].to_numpy(), pdf["label"].to_numpy()
        self.ints = np.frombuffer(b"".join(pdf["ints"]), "<i8").reshape(n, -1)
        self.code = np.frombuffer(b"".join(pdf["code"]), np.uint64).reshape(n, -1)
        self.ones = np.bitwise_count(self.code).sum(1, dtype=np.int64)
        self.along, self.rest, self.norm = (pdf[c].to_numpy() for c in ("along", "rest", "norm"))
        self.short = self.ints.astype(np.float64) if n and np.abs(self.ints).max() < 2**53 else None

    def scores(self, some: np.ndarray, q: np.ndarray, norm: float) -> np.ndarray:
        """Integer products; in doubles where no part of the sum can reach 2**53, so that all of it is exact."""
        if self.short is not None and norm * self.norm.max() < 2**52:
            return np.rint(self.short[some] @ q.astype(np.float64)).astype(np.int64)
        return self.ints[some] @ q


def _best(ids: np.ndarray, rows: np.ndarray, scores: np.ndarray, n: int) -> np.ndarray:
    return np.lexsort((rows, ids, -scores))[:n]


def _positives(rows: _Rows, anchors: _Rows, n: int) -> Iterator[tuple]:
    """(anchor row, row, id, score): the best n rows of each anchor's label in this block, itself left out."""
    y = rotated(anchors.ints.astype(np.float64))
    order = pd.Series(range(len(rows.row))).groupby(rows.label).indices
    for k in range(len(anchors.row)):
        some = order.get(anchors.label[k], np.zeros(0, int))
        some = some[rows.row[some] != anchors.row[k]]
        if len(some) > n:
            low, high = Anchor(y[k]).bounds(rows.code[some], rows.ones[some], rows.along[some], rows.rest[some], rows.norm[some])
            some = some[high >= np.partition(low, -n)[-n]]
        s = rows.scores(some, anchors.ints[k], anchors.norm[k])
        for i in _best(rows.id[some], rows.row[some], s, n):
            yield anchors.row[k], rows.row[some[i]], rows.id[some[i]], s[i]


def _negatives(rows: _Rows, anchors: _Rows, wanted: list[list[int]], n: int, low_percent: int, high_percent: int) -> Iterator[tuple]:
    """(anchor row, positive score, row, id, score): for each positive score of an anchor the best n rows of other labels in its band."""
    y = rotated(anchors.ints.astype(np.float64))
    for k in range(len(anchors.row)):
        other = np.flatnonzero(rows.label != anchors.label[k])
        if not len(other):
            continue
        low, high = Anchor(y[k]).bounds(rows.code[other], rows.ones[other], rows.along[other], rows.rest[other], rows.norm[other])
        for positive in sorted({int(p) for p in wanted[k]}):
            least, most = -(-low_percent * positive // 100), high_percent * positive // 100
            keep = (high >= least) & (low <= most)
            inside = low[(low >= least) & (high <= most)]
            if len(inside) >= n:  # so many are certain: what lies below the n-th of them is out
                keep &= high >= np.partition(inside, -n)[-n]
            some = other[keep]
            s = rows.scores(some, anchors.ints[k], anchors.norm[k])
            some, s = some[(s >= least) & (s <= most)], s[(s >= least) & (s <= most)]
            for i in _best(rows.id[some], rows.row[some], s, n):
                yield anchors.row[k], positive, rows.row[some[i]], rows.id[some[i]], s[i]


def vector_index(vectors: DataFrame, is_anchor: Column, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """The rows that take part, each with a number of its own, floor(scale * x) for x, its code, alignment and residual."""
    ship(vectors.sparkSession)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"), F.transform(F.col(vector_col).cast("array<double>"), lambda x: x * scale).alias("x"))
    rows = rows.where("id is not null and label is not null and x is not null").where(~F.exists("x", bad) & (F.size("x") > 0))

    def encode(batches):
        for b in batches:
            at = np.diff(b.column(4).offsets.to_numpy())
            flat, ends = b.column(4).flatten().to_numpy(zero_copy_only=False), np.cumsum(at)
            for dim in np.unique(at):
                pick = np.flatnonzero(at == dim)
                x = np.floor(flat[(ends[pick] - dim)[:, None] + np.arange(dim)])
                with np.errstate(over="ignore"):
                    fits = (x * x).sum(1) < 2.0**62
                pick, x = pick[fits], x[fits]
                if not len(pick):
                    continue
                code, along, rest, norm = coded(x)
                cols = [b.column(c).take(pa.array(pick)) for c in range(4)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.full(len(pick), dim, np.int32)), pa.array([r.tobytes() for r in x.astype("<i8")], pa.binary()), pa.array([r.tobytes() for r in code], pa.binary()), pa.array(along), pa.array(rest), pa.array(norm)], names=[c.split()[0] for c in _INDEX.split(", ")])

    return stage(rows.mapInArrow(encode, _INDEX), "vector-index")


def hard_negatives(vectors: DataFrame, is_anchor: Column, scale: float = 256.0, positives: int = 5, negatives: int = 10, low_percent: int = 30, high_percent: int = 90, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Scores are products of floor(scale * x), exact. An anchor's positives are its first `positives` other rows of its label; for each, its
    negatives are the first `negatives` rows of other labels with low_percent * positive <= 100 * score <= high_percent * positive. Higher
    scores come first, ties by smaller id. Rows with a null id, label, vector or component, one that is not finite, or no components take
    no part, nor do those whose scaled vector is longer than 2**31, since scores must fit 64 bits; vectors of different lengths never
    meet. Rows that repeat an id are rows of their own. Other columns are ignored; without anchors the result is empty.
    """
    index = vector_index(vectors, is_anchor, scale, id_col, vector_col, label_col)
    n, n_anchors = index.agg(F.count(F.lit(1)), F.count_if("is_anchor")).first()
    row_blocks = max(1, -(-n // min(MOST_ROWS, max(LEAST_ROWS, n // 64))))
    anchor_blocks = max(1, -(-n_anchors // ANCHORS))
    block = lambda name, of: F.pmod(F.xxhash64("row", F.lit(name)), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    own = ["row", "id", "label", "dim", "ints", "code", "along", "rest", "norm"]
    rows = index.select("dim", block("row", row_blocks).alias("i"), every(anchor_blocks).alias("j"), *own[:3], *own[4:])
    asked = index.where("is_anchor")

    def meet(asked: DataFrame, found, schema: str) -> DataFrame:
        """What `found` yields of each block pair; a block's rows stand in order of their number."""
        extra = [c for c in asked.columns if c == "wanted"]
        sent = asked.select("dim", every(row_blocks).alias("i"), block("anchor", anchor_blocks).alias("j"), *own[:3], *own[4:], *extra)
        names = [c.split()[0] for c in schema.split(", ")]

        def pair(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            out = [] if left.empty or right.empty else list(found(_Rows(left), _Rows(right), right))
            return pd.DataFrame(out, columns=names)

        return rows.groupBy("dim", "i", "j").cogroup(sent.groupBy("dim", "i", "j")).applyInPandas(pair, schema)

    first = meet(asked, lambda r, a, _: _positives(r, a, positives), "anchor bigint, row bigint, id bigint, score bigint")
    ranked = first.withColumn("k", F.row_number().over(Window.partitionBy("anchor").orderBy(F.col("score").desc(), "id", "row"))).where(F.col("k") <= positives)
    chosen = stage(ranked.select("anchor", "k", "id", "score"), "positives")
    wanted = chosen.groupBy("anchor").agg(F.collect_set("score").alias("wanted"))  # at most `positives` each
    asked = stage(asked.join(wanted, F.col("row") == F.col("anchor")).drop("anchor"), "anchors")
    second = meet(asked, lambda r, a, pdf: _negatives(r, a, list(pdf["wanted"]), negatives, low_percent, high_percent), "anchor bigint, positive bigint, row bigint, id bigint, score bigint")
    best = second.withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "positive").orderBy(F.col("score").desc(), "id", "row"))).where(F.col("rank") <= negatives)
    ids = index.where("is_anchor").select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    pairs = chosen.select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive")).join(ids, "anchor")
    out = pairs.join(best, ["anchor", "positive"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("positive").alias("positive_score"), F.col("score").alias("negative_score"))
