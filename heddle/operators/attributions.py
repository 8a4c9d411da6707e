"""What each feature adds to a forest's score of a row: Shapley values by the trees' own covers (Lundberg et al., 2018).

A leaf counts for a row by the features on its path: those that the row meets, and of the others the share of training rows that go the
leaf's way. For each set of met features a leaf's contributions are computed once, from the tree alone (Yang, 2021); a row then only
finds out which features it meets and looks its contributions up. The forest is broadcast, at most so many numbers as `most_numbers`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Tree:
    """Nodes as arrays: feature (-1 at a leaf), threshold, children, cover (training rows) and value. Rows go left where x <= threshold, or x < threshold if `strict`."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    cover: np.ndarray
    value: np.ndarray
    strict: bool = False

    def expected(self) -> float:
        leaf = self.feature < 0
        return float((self.cover[leaf] * self.value[leaf]).sum() / self.cover[0])

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), int)
        while (inner := np.flatnonzero(self.feature[at] >= 0)).size:
            k = at[inner]
            seen, bound = x[inner, self.feature[k]], self.threshold[k]
            at[inner] = np.where(seen < bound if self.strict else seen <= bound, self.left[k], self.right[k])
        return self.value[at]

    def leaves(self) -> Iterator[tuple[float, dict[int, tuple[float, float, float]]]]:
        """(value, {feature: (low, high, share)}) of each leaf: the range of the feature that leads to it, and the share of rows that go its way where it is split on."""
        held: list[tuple[int, dict[int, tuple[float, float, float]]]] = [(0, {})]
        while held:
            node, path = held.pop()
            f = int(self.feature[node])
            if f < 0:
                yield float(self.value[node]), path
                continue
            low, high, share = path.get(f, (-math.inf, math.inf, 1.0))
            cut = float(self.threshold[node])
            for child, bounds in ((int(self.left[node]), (low, min(high, cut))), (int(self.right[node]), (max(low, cut), high))):
                part = self.cover[child] / self.cover[node] if self.cover[node] else 0.0
                held.append((child, path | {f: (*bounds, share * part)}))


def leaf_table(value: float, shares: Sequence[float]) -> np.ndarray:
    """[2**m, m]: what each of a leaf's m features adds, for each set of features that a row meets (bit j: feature j)."""
    m = len(shares)
    met = (np.arange(1 << m)[:, None] >> np.arange(m) & 1).astype(float)
    weight = np.array([math.factorial(s) * math.factorial(m - 1 - s) / math.factorial(m) for s in range(m)])
    out = np.empty((1 << m, m))
    for i in range(m):
        poly = np.ones((1 << m, 1))  # by how many of the others are taken from the row
        for j in range(m):
            if j != i:
                poly = np.pad(poly * shares[j], ((0, 0), (0, 1))) + np.pad(poly * met[:, j : j + 1], ((0, 0), (1, 0)))
        out[:, i] = value * (met[:, i] - shares[i]) * (poly @ weight)
    return out


@dataclass
class Explained:
    """A forest made ready: for each leaf its features, their ranges and its table; the mean of the trees' values over the training rows."""

    leaves: list
    base: float
    strict: bool

    def values(self, x: np.ndarray) -> np.ndarray:
        """[rows, features]: contributions; with `base` they add up to the forest's mean value of each row."""
        out = np.zeros(x.shape)
        for features, low, high, table in self.leaves:
            seen = x[:, features]
            met = (seen >= low) & (seen < high) if self.strict else (seen > low) & (seen <= high)
            out[:, features] += table[met @ (1 << np.arange(len(features)))]
        return out


def explain(trees: Sequence[Tree], most_numbers: int = 50_000_000) -> Explained:
    """The mean over trees; raises where the leaves' tables would hold more than `most_numbers` numbers."""
    found, held = [], 0
    for tree in trees:
        for value, path in tree.leaves():
            if not path:
                continue
            features = np.array(sorted(path))
            held += len(features) << len(features)
            if held > most_numbers:
                raise ValueError(f"the trees are too deep: over {most_numbers} numbers")
            low, high, shares = (np.array([path[f][k] for f in features.tolist()]) for k in range(3))
            found.append((features, low, high, leaf_table(value / len(trees), shares)))
    return Explained(found, float(np.mean([t.expected() for t in trees])) if trees else 0.0, bool(trees) and trees[0].strict)


def forest_trees(model, spark: SparkSession) -> list[Tree]:
    """The trees of a fitted random forest of pyspark.ml with numeric splits; the value of a node is its share of class 1, or its mean."""

    def walk(root) -> Tree:
        rows: list[list] = []

        def add(node) -> int:
            at, stats = len(rows), node.impurityStats()
            counts = list(stats.stats())
            value = float(node.prediction()) if len(counts) != 2 else (counts[1] / sum(counts) if sum(counts) else 0.0)
            rows.append([-1, 0.0, 0, 0, float(stats.count()), value])
            if node.subtreeDepth() > 0:
                split = node.split()
                rows[at][:2] = [int(split.featureIndex()), float(split.threshold())]
                rows[at][2] = add(node.leftChild())
                rows[at][3] = add(node.rightChild())
            return at

        add(root)
        f, t, left, right, cover, value = (np.array(c) for c in zip(*rows))
        return Tree(f.astype(int), t, left.astype(int), right.astype(int), cover, value)

    return [walk(t._java_obj.rootNode()) for t in model.trees]


def attributions(encoded: DataFrame, explained: Explained, column: str = "features", name: str = "contributions") -> DataFrame:
    """`encoded` with an array of contributions, one a feature, computed where the rows are."""
    shared = encoded.sparkSession.sparkContext.broadcast(explained)

    @F.pandas_udf("array<double>")
    def add(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in parts:
            yield pd.Series(list(shared.value.values(np.stack(rows.to_list()))) if len(rows) else [], dtype=object)

    return encoded.withColumn(name, add(column))


def mean_contributions(attributed: DataFrame, names: Sequence[str], by: Sequence[str] = (), name: str = "contributions") -> DataFrame:
    """(by..., feature, importance, mean): of each feature the mean size and the mean of its contributions."""
    x = attributed.select(*by, F.posexplode(name).alias("_at", "_x")).groupBy(*by, "_at").agg(F.avg(F.abs("_x")).alias("importance"), F.avg("_x").alias("mean"))
    return x.select(*by, F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_at") + 1).alias("feature"), "importance", "mean")
