"""Collocations, hard negatives and quality scores against brute force, held-out accuracy, and on odd rows."""

import collections
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.llm import collocations as C
from heddle.llm import common, queries
from heddle.llm import hard_negatives as H
from heddle.llm import quality_classifier as Q

DOCS = "doc_id long, text string, lang string, phrase string, n long, score double"  # the last three clash with names inside


def phrases(rows, threshold, longest=5, best=2000):
    """(lang, rank, phrase, a, l, r, n, score) by counting everything."""
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    cands = {p: a for p, a in f.items() if a >= threshold and len(p[1]) > 1}
    gone = {(lang, p[i:j]) for (lang, p), a in cands.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and a >= f[lang, p[i:j]]}
    out = collections.defaultdict(list)
    for (lang, p), a in cands.items():
        if (lang, p) not in gone:
            score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]], n[lang]))
    return sorted((lang, r + 1, x[2].decode(), -x[1], x[3], x[4], x[5], -x[0]) for lang in out for r, x in enumerate(sorted(out[lang])[:best]))


def mined(docs, **options):
    return sorted(tuple(r) for r in C.collocations(docs, **options).collect())


@pytest.mark.parametrize("parts, shards, threshold, longest", [(9, 3, 8, 4), (1, 2, 25, 5)])
def test_collocations_of_documents(spark, sf, parts, shards, threshold, longest):
    docs = common.table(spark, sf, "documents").repartition(parts)
    rows = [(r.lang, r.text) for r in docs.collect()]
    assert mined(docs, threshold=threshold, shards=shards, longest=longest) == phrases(rows, threshold, longest)


def odd_rows():
    """Ties, overlaps, marks, blanks, null languages, wide characters, one long text, repeated rows."""
    texts = ["a a a a b", "A\ta a. a a", "x y;x y, x y!x y?x y", "x\ny\x0bz\x0cx y\rz", "É é É é", "", None, " . , ", "     ", "x y z " * 30_000, "q w e r t q w e r t q w e r t"]
    rows = [(k % 4 or None, t, [None, "en", "und", "de"][k % 4], "p", 1, 0.5) for k, t in enumerate(texts * 3)]
    return rows + [(7, "same same same", "en", "p", 1, 0.5)] * 6


@pytest.mark.parametrize("threshold, best", [(2, 2000), (3, 4)])
def test_collocations_of_odd_rows(spark, monkeypatch, threshold, best):
    monkeypatch.setattr(C, "_SEGMENT", 100)
    docs = spark.createDataFrame(odd_rows(), DOCS).repartition(5)
    want = phrases([(r[2], r[1]) for r in odd_rows()], threshold, best=best)
    assert want and mined(docs, threshold=threshold, best=best) == want
    monkeypatch.setattr(C, "BROADCAST_PHRASES", 0)  # candidates joined by a shuffle
    assert mined(docs, threshold=threshold, best=best) == want


def test_collocations_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert mined(empty) == [] and mined(spark.createDataFrame(odd_rows()[:3], DOCS)) == []
    assert C.collocations(empty).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_score_is_exact_beyond_64_bits(spark):
    rows = [("en", 1, "a", 3 * 10**9), ("en", 1, "b", 3 * 10**9), ("en", 2, "a b", 2 * 10**9)]
    known = spark.createDataFrame([(a, k, p.encode(), n) for a, k, p, n in rows], "lang string, k int, phrase binary, n long")
    words = spark.createDataFrame([("en", 10**13)], "lang string, n long")
    old = C.frequent_phrases
    C.frequent_phrases = lambda *_: (known, words)
    try:
        assert C.collocations(known).collect() == [("en", 1, "a b", 2 * 10**9, 3 * 10**9, 3 * 10**9, 10**13, 1000 * 2 * 10**9 * 10**13 // (9 * 10**18))]
    finally:
        C.frequent_phrases = old


def test_full_bitmaps_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(C, "LEAST_BITS", 64)
    monkeypatch.setattr(C, "MOST_BITS", 64)  # so small that nearly all phrases get through
    assert mined(spark.createDataFrame(odd_rows(), DOCS).repartition(4), threshold=3) == phrases([(r[2], r[1]) for r in odd_rows()], 3)


def negatives(rows, every=100, positives=5, negatives_=10):
    """Rows are (id, vector, label), all usable."""
    ints = [(i, [int(np.floor(256 * x)) for x in v], label) for i, v, label in rows]
    out = []
    for a, (ida, va, la) in enumerate(ints):
        if ida % every:
            continue
        told = [(-sum(x * y for x, y in zip(va, v)), i, label) for b, (i, v, label) in enumerate(ints) if b != a and len(v) == len(va)]
        for p, idp, _ in sorted(t for t in told if t[2] == la)[:positives]:
            fit = sorted((s, i) for s, i, label in told if label != la and 30 * -p <= 100 * -s <= 90 * -p)
            out += [(ida, idp, r + 1, i, -p, -s) for r, (s, i) in enumerate(fit[:negatives_])]
    return sorted(out)


VECTORS = "vec_id long, embedding array<double>, label int, row long, code string"


def mined_negatives(spark, rows, every=100):
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], VECTORS)
    return sorted(tuple(r) for r in H.hard_negatives(df, F.col("vec_id") % every == 0).collect())


@pytest.mark.parametrize("dim", [1, 3, 64, 100])
def test_hard_negatives(spark, monkeypatch, dim):
    monkeypatch.setattr(H, "LEAST_ROWS", 70)
    monkeypatch.setattr(H, "ANCHORS", 9)
    rng = np.random.default_rng(dim)
    centres = rng.normal(size=(4, dim))
    rows = [(i, (centres[i % 4] * 0.4 + rng.normal(size=dim) * 0.5).tolist(), int(rng.integers(0, 3))) for i in range(300)]
    rows += [(300 + i, rows[7][1], 1) for i in range(40)]  # ties
    want = negatives(rows, every=10)
    assert want and mined_negatives(spark, rows, every=10) == want


def test_intervals_hold():
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(size=(500, 48)) * 300)
    x[0] = 0
    code, along, rest, norm = H.coded(x)
    ones = np.bitwise_count(code).sum(1, dtype=np.int64)
    for q in [x[0], x[1], x[2] * 1e6, np.ones(48)]:
        low, high = H.Anchor(H.rotated(q[None])[0]).bounds(code, ones, along, rest, norm)
        assert (low <= x @ q).all() and (x @ q <= high).all()
    assert np.median(((high - low) / norm)[1:] / np.sqrt(48)) < 1.5  # and say something


def test_hard_negatives_of_odd_rows(spark):
    good = [(0, [1.0, 2.0], 1), (1, [0.5, 2.0], 1), (2, [0.1, 1.5], 2), (3, [1e-9, 1.0], 2), (100, [1.0, 1.0, 1.0], 1), (101, [1.0, 1.0, 1.0], 1), (102, [0.5, 0.5, 0.5], 2), (-100, [-1.0, -0.1], 1), (5, [0.0, 0.0], 2)]
    odd = [(None, [1.0, 2.0], 1), (6, None, 2), (7, [None, 1.0], 2), (8, [float("nan"), 1.0], 2), (9, [float("inf"), 1.0], 2), (10, [1.0, 1.5], None), (11, [], 2), (12, [1e300, 1e300], 2), (200, [], 1)]
    assert mined_negatives(spark, good + odd) == negatives(good)
    twice = [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (3, [0.5, 1.0], 2), (3, [0.5, 1.0], 2)]
    assert mined_negatives(spark, twice) == negatives(twice)
    far = [(0, [2e6, 1.0], 1), (1, [2e6, 1.0], 1), (2, [1e6, 7.0], 2)]  # products beyond 2**53
    got = mined_negatives(spark, far)
    assert got == negatives(far) and got[0][-1] > 2**53
    assert mined_negatives(spark, []) == [] and mined_negatives(spark, [(1, [1.0], 1)]) == []


def auc(scores, labels):
    kinds, at, n = np.unique(scores, return_inverse=True, return_counts=True)
    ranks = (np.cumsum(n) - (n - 1) / 2)[at]
    good = labels == 1
    return (ranks[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op13_quality_classifier(spark, sf).toPandas()
    assert len(got) == common.table(spark, sf, "documents").count() and got["score"].between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(got["doc_id"], got["held_out"]))
    assert ((got["score"] >= 0.3).astype(int) == got["predicted"]).all()
    known = got[got["held_out"]].merge(common.table(spark, sf, "labels").select("doc_id", "quality").toPandas(), on="doc_id")
    assert auc(known["score"].to_numpy(), known["quality"].to_numpy()) > 0.99
    assert known.loc[known["quality"] == 1, "predicted"].mean() > 0.985 and known.loc[known["quality"] == 0, "predicted"].mean() < 0.03


def test_quality_learns_nothing_from_held_out_rows(spark, sf):
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    turned = labels.withColumn("quality", F.when(Q.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted((r.doc_id, round(r.score, 9)) for r in Q.quality(docs, x).collect()) for x in (labels, turned))
    assert a == b


def test_discriminant_is_the_difference_of_log_densities():
    rng = np.random.default_rng(0)
    d = len(Q.NAMES)
    sets = [rng.normal(size=(400, d)) @ rng.normal(size=(d, d)) + k for k in (0, 2)]
    model = Q.discriminant(np.array([400.0, 400.0]), np.stack([s.sum(0) for s in sets]), np.stack([s.T @ s for s in sets]), 0.0, 0.0)
    x = sets[0][:20] * 0.9
    told = []
    for s in sets:
        cov = np.cov(s.T, bias=True)
        told.append(-0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", x - s.mean(0), np.linalg.inv(cov), x - s.mean(0)))
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-np.clip(told[1] - told[0], -35, 35))), atol=1e-6)


def test_quality_of_odd_rows(spark):
    texts = ["", None, "   ", "a", "word " * 300_000, "\n\n", "é😀", "x" * 2_000_000, "same", "same"]
    docs = spark.createDataFrame([(i, t, "f", 1.0, 3) for i, t in enumerate(texts)] + [(None, "no id", "f", 1.0, 3), (3, "a", "f", 1.0, 3)], "doc_id long, text string, f string, score double, y long")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 0), (4, 1), (5, 1), (6, 0), (7, 1), (8, 1), (9, 0)], "doc_id long, quality int")
    got = Q.quality(docs, labels).collect()
    assert len(got) == 12 and all(0 <= r.score <= 1 for r in got) and sum(r.doc_id == 3 for r in got) == 2
    assert [r.held_out for r in got if r.doc_id is None] == [False] and len({r.score for r in got if r.doc_id in (0, 1)}) == 1
    none = Q.quality(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    one = Q.quality(docs, labels.where("quality = 1 and doc_id > 3")).collect()
    assert len({r.score for r in one}) == 1 and 0.5 < one[0].score < 1
    assert Q.quality(docs.limit(0), labels).collect() == []
