"""Repeated ids, both sides of size switches, recall and plans of hard histograms."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.llm import common
from heddle.llm import decontaminate as D
from heddle.llm import ngram_join as J
from heddle.llm import vector_dedup as V
from heddle.llm.packing import best_plan


def linked(rows, threshold=0.95):
    """(n_links, component) of each row (id, vector), every row a vector of its own."""
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= threshold
    np.fill_diagonal(link, False)
    root = np.array([i for i, _ in rows])
    while True:
        low = np.array([min([root[k], *root[link[k]]]) for k in range(len(rows))])
        if (low == root).all():
            return sorted((rows[k][0], int(link[k].sum()), int(root[k])) for k in range(len(rows)))
        root = low


def near(v, seed):
    return (np.array(v) + 0.02 * np.random.default_rng(seed).normal(size=len(v))).tolist()


@pytest.mark.parametrize("rows", ["far", "near", "equal", "mixed"])
def test_vectors_that_repeat_an_id(spark, rows):
    a, b = np.random.default_rng(5).normal(size=(2, 16)).tolist()
    cases = {
        "far": [(1, a), (2, near(a, 1)), (1, b), (3, near(b, 2)), (4, near(b, 3))],
        "near": [(1, a), (1, near(a, 1)), (2, b)],
        "equal": [(1, a), (1, a), (2, near(a, 1)), (7, b)],
        "mixed": [(5, a), (2, near(a, 1)), (5, b), (3, near(b, 2)), (2, near(b, 4)), (9, near(a, 6))],
    }[rows]
    df = spark.createDataFrame(cases, "vec_id long, embedding array<double>")
    got = V.vector_components(df).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == linked(cases)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


@pytest.mark.parametrize("hashes", [2, 3, 4, 5])
def test_recall_by_axes(hashes):
    """Of pairs with cosine at the threshold, how many share a bucket of a table, as the operator picks tables and probes."""
    rng, dim = np.random.default_rng(hashes), 64
    x = rng.normal(size=(1500, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    off = rng.normal(size=x.shape)
    off -= (off * x).sum(1, keepdims=True) * x
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * off / np.linalg.norm(off, axis=1, keepdims=True)
    tables = 6 << (hashes - 2)
    a, b = V.codes(x, tables, hashes, 2), V.codes(y, tables, hashes, 2)
    met = ((a[:, :, :1] == b).any(2) | (a == b[:, :, :1]).any(2)).any(1)
    assert met.mean() >= 0.99


def test_large_buckets_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 5)
    x = np.random.default_rng(2).normal(size=8).tolist()
    rows = [(k, near(x, k)) for k in range(40)] + [(50 + k, np.random.default_rng(100 + k).normal(size=8).tolist()) for k in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    run = lambda: sorted((r.vec_id, r.n_links, r.component_id) for r in V.vector_components(df).collect())
    small = run()
    monkeypatch.setattr(V, "BROADCAST_BUCKETS", 0)
    assert run() == small == linked(rows)


ITEM = "the quick brown fox jumps over a lazy dog while seven wise owls count every star above quiet northern hills"


def overlaps(docs, items, share=0.5):
    """(id, item, matched, words, place) by every alignment of every row; those a seed finds."""
    out = {}
    for i, text in docs:
        d = (text or "").split()
        for item, words in items:
            w, best = words.split(), None
            for at in range(1 - len(w), len(d)):
                same = [0 <= at + k < len(d) and d[at + k] == w[k] for k in range(len(w))]
                seeded = any(at + k >= 0 and at + k + D.SPAN <= len(d) and all(same[k + o] for o in mask) for k in range(len(w) - D.SPAN + 1) for mask in D.MASKS)
                run = any(sum(same[k : k + D.RUN]) >= D.RUN - D.RUN_CHANGES for k in range(len(w) - D.RUN + 1))
                if seeded and (sum(same) >= max(6, -(-len(w) * share // 1)) or run):
                    best = max(best or (0, 0), (sum(same), -at))
            if best and best > out.get((i, item), (0, 0)):
                out[i, item] = best
    return sorted(((i, item, m, len(dict(items)[item].split()), -at) for (i, item), (m, at) in out.items()), key=str)


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_contaminated_rows_that_repeat_an_id(spark, monkeypatch, broadcast):
    monkeypatch.setattr(D, "BROADCAST_ROWS", broadcast)
    w = ITEM.split()
    every_third, every_second = (" ".join("zz" if k % n == n - 1 else x for k, x in enumerate(w)) for n in (3, 2))
    docs = [(1, " ".join(w[:8])), (1, every_second), (2, every_third), (None, f"a b c {ITEM}"), (None, "nothing here at all to be found in it"), (3, ITEM), (3, f"x {ITEM}"), (4, " ".join(w[4:])), (5, ""), (6, None), (7, f"{ITEM} {ITEM}"), (8, " ".join(reversed(w)))]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int")
    items = [(10, ITEM), (11, "one two three four five six seven eight nine ten eleven twelve")]
    got = D.contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == overlaps(docs, items)


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_contaminated_document_full_of_items(spark, monkeypatch, broadcast):
    """60000 words that hold each item many times: its hits, seven a word, do not each hold the document."""
    monkeypatch.setattr(D, "BROADCAST_ROWS", broadcast)
    items = [(k, " ".join(f"w{k}x{j}" for j in range(10 + k))) for k in range(20)] + [(20, "w3x0 w3x1"), (20, "pad " * 12)]
    text = " ".join(["start", *[t for _, t in items[:20]] * 150, *["pad"] * 3000])
    got = D.contaminated(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    at = [1 + sum(10 + j for j in range(k)) for k in range(20)]
    assert sorted(map(tuple, got)) == [(1, k, 10 + k, 10 + k, at[k]) for k in range(20)] + [(1, 20, 12, 12, 1 + 150 * sum(range(10, 30)))]


@pytest.mark.parametrize("low, high", [(250, 409), (300, 420), (100, 300), (20, 2048)])
def test_plans_of_hard_histograms(low, high):
    rng = np.random.default_rng(low)
    lengths = np.arange(low, high + 1)
    hist = {int(k): int(n) for k, n in zip(lengths, rng.integers(300, 700, len(lengths)))}
    plan = best_plan(hist, 2048)
    volume = sum(k * n for k, n in hist.items()) / 2048
    each = 2048 // low if low > 200 else None  # no bin holds more pieces than this
    least = max(volume, sum(hist.values()) / each if each else 0)
    assert plan.bins <= 1.01 * least + 1
    filled = {}
    for bins, content in plan.closed:
        assert sum(k * n for k, n in content) <= 2048
        for k, n in content:
            filled[k] = filled.get(k, 0) + bins * n
    assert filled == hist


@pytest.mark.parametrize("rounds", [(0, 0), (0, 1)])
def test_shingles_dealt_into_parts(spark, monkeypatch, rounds):
    """Rows of a shingle in many parts give the components that one part gives."""
    base = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(60):
        words = list(base)
        for place in np.random.default_rng(k).choice(60, 1 + k % 3, replace=False):
            words[place] = f"x{k}_{place}"
        rows.append((k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    run = lambda: sorted(map(tuple, J.ngram_components(df, size=3, percent=80, star_rounds=rounds[0], hub_rounds=rounds[1]).collect()))
    sets = [set(J.shingles(t, 3).tolist()) for _, t in rows]
    root = list(range(60))
    for _ in range(60):
        root = [min(root[b] for b in range(60) if b == a or 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])) for a in range(60)]
    want = [(k, len(sets[k]), root[k]) for k in range(60)]
    assert run() == want
    monkeypatch.setattr(J, "SALT_ROWS", 2)
    assert run() == want


def test_join_leaves_only_what_its_result_reads(spark, sf):
    """Neither the tables of the search nor its shuffles stay on disk; the result can still be read, twice."""
    fs = common.shared_dir(spark).removeprefix("file://") + "/heddle"
    tables = lambda: set(os.listdir(fs)) if os.path.isdir(fs) else set()
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {x.getName() for x in [files.getAllFiles().apply(i) for i in range(files.getAllFiles().size())] if x.getName().startswith("shuffle_")}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before, held = tables(), shuffled()
    out = J.ngram_components(docs, size=3, percent=80)
    left = {x.rsplit("-", 1)[0] for x in tables() - before}
    assert left <= {"signed", "copies", "comps", "edges"} and len(tables() - before) <= 4
    # of the small counts between the stages alone
    assert len([x for x in shuffled() - held if x.endswith(".data")]) < 60
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, out.collect()))


def test_parities_differ_in_no_more_than_the_sets_do():
    rng = np.random.default_rng(3)
    for n in (1, 5, 40, 400):
        x, y = (np.unique(rng.integers(-(2**63), 2**63 - 1, 2 * n)) for _ in range(2))
        y = np.unique(np.concatenate([x[:n], y[:n]]))
        apart = sum(((a ^ b) & (1 << 64) - 1).bit_count() for a, b in zip(J.parities(x), J.parities(y)))
        assert apart <= len(np.setxor1d(x, y)) and J.parities(x) == J.parities(x[::-1])
        assert apart >= min(len(np.setxor1d(x, y)), 40) // 2  # and say something


def test_join_of_differences_gives_no_rows_of_what_cannot_link(spark, monkeypatch):
    """Copies of one text that lack some of its words, too far apart to link, meet in the index, not in what its join gives."""
    rows = []
    for k in range(200):
        gone = set((np.random.default_rng(k).choice(60, 8, replace=False) * 3 + 1).tolist())
        rows.append((k, " ".join(f"w{j}" for j in range(200) if j not in gone)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets, met, real = [set(J.shingles(t, 3).tolist()) for _, t in rows], [], J._apart_pairs
    monkeypatch.setattr(J, "_apart_pairs", lambda apart, percent: (met.append((apart.where("tok is not null").count(), J._apart_met(apart, percent).count())), real(apart, percent))[1])
    got = sorted(map(tuple, J.ngram_components(df, size=3, percent=90, star_rounds=0).collect()))
    links = [(a, b) for a in range(200) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    assert not links and got == [(k, len(sets[k]), k) for k in range(200)]
    assert met and sum(n for n, _ in met) > 1000 and sum(m for _, m in met) < 200
