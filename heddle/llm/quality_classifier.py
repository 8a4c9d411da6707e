"""Quality scores: a regularised quadratic discriminant (Friedman, 1989) over transformed statistics of a document.

Each class, good and bad, has a normal density; its covariance is shrunk towards that of both classes and towards a multiple of the
identity. A document's score comes from the difference of the two log densities: squared Mahalanobis distances by Cholesky factors that
are inverted once. Means and covariances are sums over all labelled rows; only these sums reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, stage

_LOWER, _UPPER, _DIGIT = slice(97, 123), slice(65, 91), slice(48, 58)
#: Bytes of marks that prose ends its words with, and of other marks.
_PROSE = np.frombuffer(b".,;:?'\"-()", np.uint8)
_OTHER = np.frombuffer(b"!#$%&*+/<=>@[\\]^_`{|}~", np.uint8)
NAMES = ("chars", "word_length", "letters", "upper", "digits", "blanks", "prose_marks", "other_marks", "entropy", "distinct_words", "top_word", "distinct_pairs", "short_words", "marked_words", "distinct_lines", "line_length")


def _log_odds(share: float) -> float:
    return float(np.log((share + 0.01) / (1.01 - share)))


def statistics(text: str | bytes | None) -> list[float]:
    """The statistics of a whole text, in the order of NAMES: logs of lengths, log odds of shares; null counts as empty."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    n = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size, words, lines = max(len(raw), 1), raw.split(), [x for x in raw.split(b"\n") if x]
    lower, upper, wide = int(n[_LOWER].sum()), int(n[_UPPER].sum()), int(n[128:].sum())
    p = n[n > 0] / size
    count, tally = max(len(words), 1), {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    lasts = np.bincount(np.frombuffer(b"".join([w[-1:] for w in words]), np.uint8), minlength=256)
    return [
        np.log1p(len(raw)),
        np.log1p((size - n[32] - n[10]) / count),
        _log_odds((lower + upper + wide) / size),
        _log_odds(upper / max(lower + upper, 1)),
        _log_odds(int(n[_DIGIT].sum()) / size),
        _log_odds((n[32] + n[10] + n[9]) / size),
        _log_odds(n[_PROSE].sum() / size),
        _log_odds(n[_OTHER].sum() / size),
        float(-(p * np.log2(p)).sum()),
        np.log(len(tally) + 1.0) / np.log(count + 2.0),
        _log_odds(max(tally.values(), default=0) / count),
        _log_odds(len(set(zip(words, words[1:]))) / max(len(words) - 1, 1)),
        _log_odds(sum(c for w, c in tally.items() if len(w) <= 3) / count),
        _log_odds(lasts[_OTHER].sum() / count),
        _log_odds(len(set(lines)) / max(len(lines), 1)),
        np.log1p(len(raw) / max(len(lines), 1)),
    ]


def held_out(id_col: str = "doc_id"):
    """Whether a row's labels are kept from training: crc32 of the id as text leaves 0 modulo 5. False for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass
class Discriminant:
    """Class means, inverted Cholesky factors of the shrunk covariances, and what of each log density does not depend on the document."""

    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """How likely each row of x is good, 0 to 1."""
        if not len(self.means):
            return np.full(len(x), self.prior)
        bad, good = (k - 0.5 * (((x - m) @ f.T) ** 2).sum(1) for m, f, k in zip(self.means, self.factors, self.constants))
        return 1 / (1 + np.exp(-np.clip(good - bad, -35, 35)))


def discriminant(counts: np.ndarray, sums: np.ndarray, products: np.ndarray, to_both: float = 0.3, to_identity: float = 0.05) -> Discriminant:
    """From the rows, sums and sums of products of the classes bad and good. A class without rows leaves the prior alone, (good + 1) / (all + 2)."""
    prior = float((counts[1] + 1) / (counts.sum() + 2))
    if counts.min() < 1:
        return Discriminant(np.zeros((0, 0)), np.zeros((0, 0, 0)), np.zeros(0), prior)
    means = sums / counts[:, None]
    own = products / counts[:, None, None] - means[:, :, None] * means[:, None, :]
    both = (own * counts[:, None, None]).sum(0) / counts.sum()
    scale = np.sqrt(np.maximum(np.diag(both), 1e-6))  # the identity is one of statistics with deviation 1
    factors, constants = [], []
    for k, share in enumerate((1 - prior, prior)):
        cov = ((1 - to_both) * own[k] + to_both * both) / np.outer(scale, scale)
        cov = (1 - to_identity) * cov + to_identity * max(np.trace(cov) / len(cov), 1e-6) * np.eye(len(cov))
        low = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(low) / scale)
        constants.append(np.log(share) - np.log(np.diag(low)).sum())
    return Discriminant(means, np.stack(factors), np.array(constants), prior)


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, f) of each row."""
    ship(docs.sparkSession)

    def measure(batches):
        for b in batches:
            f = [statistics(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f, pa.list_(pa.float64()))], names=["doc_id", "f"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary")).mapInArrow(measure, "doc_id bigint, f array<double>")


def fit(measured: DataFrame, labels: DataFrame, **shrinkage: float) -> Discriminant:
    """The model of all rows of (doc_id, f) that are labelled and not held out. An id labelled both ways counts as bad; labels without an id or value are ignored."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("doc_id is not null and y is not null").where(~held_out())
    rows = measured.join(known.groupBy("doc_id").agg(F.min("y").alias("y")), "doc_id").select("y", "f")
    d = len(NAMES)

    def add(batches):
        n, sums, products = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
        for b in batches:
            y, f = (b.column(0).to_numpy(zero_copy_only=False) > 0).astype(int), b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            for k in (0, 1):
                x = f[y == k]
                n[k], sums[k], products[k] = n[k] + len(x), sums[k] + x.sum(0), products[k] + x.T @ x
        flat = np.concatenate([n, sums.ravel(), products.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["at", "x"])

    got = rows.mapInArrow(add, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).toPandas()
    flat = np.zeros(2 + 2 * d + 2 * d * d)
    flat[got["at"].to_numpy()] = got["x"].to_numpy()
    return discriminant(flat[:2], flat[2 : 2 + 2 * d].reshape(2, d), flat[2 + 2 * d :].reshape(2, d, d), **shrinkage)


def score(measured: DataFrame, model: Discriminant) -> DataFrame:
    """(doc_id, score) of rows of (doc_id, f)."""

    def scored(batches):
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    return measured.mapInArrow(scored, "doc_id bigint, score double")


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **shrinkage: float) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs, repeated rows and null ids included.

    Null texts score as empty ones. Without labelled rows of both classes every score is the prior, 0.5 where there are none at all. An
    empty table gives an empty one; columns other than doc_id and text are ignored.
    """
    measured = stage(document_statistics(docs), "document-statistics")
    scored = score(measured, fit(measured, labels, **shrinkage))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
