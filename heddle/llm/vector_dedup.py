"""Near-duplicate vectors by cross-polytope hashing (Andoni et al., 2015).

A vector is turned by three rounds of random signs and a fast Hadamard transform; its hash is the axis, with sign, that it then lies
nearest to. A bucket is `hashes` such axes; each vector is also put where one axis is the runner-up (multiprobe). Pairs in a bucket are
verified by their cosine in double precision. Equal vectors are one class with a count. A bucket of many vectors is dealt out in blocks
of bounded size. A pair is counted where it first meets and never listed: a block returns counts and a spanning forest.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, ship, stage

BLOCK = 1000
_SEED = 20150
#: Up to so many large buckets are broadcast, 24 MB; more are joined by a shuffle.
BROADCAST_BUCKETS = 1_000_000


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, in place of a power of two columns."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x


def codes(x: np.ndarray, tables: int, hashes: int, probes: int) -> np.ndarray:
    """int64[rows, tables, 1 + probes]: the bucket of each row in each table, then those probed."""
    n, dim = x.shape
    d = 1 << max(1, (dim - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, d - dim)))
    rng = np.random.default_rng(_SEED + dim)
    out = np.empty((n, tables, 1 + probes), np.int64)
    for t in range(tables):
        first, second, gap = (np.empty((n, hashes), kind) for kind in (np.int64, np.int64, float))
        for k in range(hashes):
            y = x
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], d))
            size = np.abs(y)
            top = np.argpartition(size, d - 2, axis=1)[:, -2:]
            swap = np.take_along_axis(size, top, 1)
            top = np.where((swap[:, :1] > swap[:, 1:]), top[:, ::-1], top)  # runner-up, nearest
            near = np.take_along_axis(y, top, 1)
            axis = 2 * top + (near < 0)
            first[:, k], second[:, k], gap[:, k] = axis[:, 1], axis[:, 0], np.abs(near[:, 1]) - np.abs(near[:, 0])
        base = (2 * d) ** np.arange(hashes, dtype=np.int64)
        out[:, t, 0] = (first * base).sum(1)
        order = np.argsort(gap, axis=1)
        for p in range(probes):
            k = order[:, p]
            at = np.arange(n)
            out[:, t, 1 + p] = out[:, t, 0] + (second[at, k] - first[at, k]) * base[k]
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square overflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _packed(x: np.ndarray) -> list[bytes]:
    """Each row as bytes, in single precision where that holds it exactly."""
    with np.errstate(over="ignore"):
        short = x.astype("<f4")
    same = (short == x).all(1)
    return [b"f" + a.tobytes() if k else b"d" + b.tobytes() for k, a, b in zip(same, short, x.astype("<f8"))]


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<f4" if raw[:1] == b"f" else "<f8", offset=1).astype(np.float64)


def _block_pairs(ids, mult, role, code, x, t: int, i: int, j: int, chunk, threshold: float):
    """Counts and a forest of one block: members meet members and probers; a pair counts where it first meets."""
    main = np.flatnonzero(role == 0)
    if not len(main) or len(ids) < 2:
        return None
    rows, cols = np.nonzero(x[main] @ x.T >= threshold)
    a, b = main[rows], cols
    keep = (ids[a] != ids[b]) & ((role[b] == 1) | (ids[a] < ids[b]))
    if i != j:
        keep &= chunk[a] != chunk[b]
    a, b = a[keep], b[keep]
    if not len(a):
        return None
    ca, cb = code[a], code[b]
    twice = (role[b] == 1) & (ca[:, t, 1:] == cb[:, t, :1]).any(1) & (ids[a] > ids[b])
    for e in range(t):
        twice |= (ca[:, e, :1] == cb[:, e]).any(1) | (ca[:, e, 1:] == cb[:, e, :1]).any(1)
    count = np.zeros(len(ids), np.int64)
    np.add.at(count, a[~twice], mult[b[~twice]])
    np.add.at(count, b[~twice], mult[a[~twice]])
    root = ids.copy()
    while True:  # least id over links, to a fixed point
        was = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        if (root == was).all():
            break
    some = (count > 0) | (root != ids)
    return ids[some], count[some], root[some]


def vector_components(vectors: DataFrame, threshold: float = 0.95, tables: int | None = None, hashes: int | None = None, probes: int = 2, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row.

    Links join pairs of cosine >= threshold, in double precision, among those that share a bucket; none below it. Vectors that are null,
    empty, zero or hold null or non-finite components link with nothing, nor do vectors of different lengths, nor rows without an id,
    which have a null component and are not kept. Rows that repeat an id are kept, each a vector of its own that counts as a link; equal
    rows all stay. Without `hashes`, a bucket takes as many axes as leave about one vector a bucket, and `tables` follow so that recall
    stays. An empty table gives an empty one; other columns are ignored.
    """
    spark = vectors.sparkSession
    ship(spark)
    vec = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), vec.alias("v"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    valid = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(~F.exists("v", bad) & F.exists("v", lambda x: x != 0))
    classes = stage(valid.groupBy("v").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("mult")).withColumn("cls", F.monotonically_increasing_id()), "vectors")
    n, dim = classes.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    span = 2 << max(1, ((dim or 1) - 1).bit_length())
    hashes = hashes or max(2, round(math.log(max(n, 1)) / math.log(span)))
    probes = min(probes, hashes)
    tables = tables or 6 << (hashes - 2)
    kind = np.int32 if span**hashes < 2**31 else np.int64  # of a bucket's code

    def hashed(batch):
        ids, mult, vs = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2)
        size = np.diff(vs.offsets.to_numpy()) if len(vs) else np.zeros(0, int)
        flat, at = vs.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(size)])
        for dims in np.unique(size):
            pick = np.flatnonzero(size == dims)
            x = flat[at[pick][:, None] + np.arange(dims)]
            c = codes(_unit(x), tables, hashes, probes)
            # The key is table, length and bucket, folded to 64 bits; the codes tell apart what should meet by chance.
            t = np.arange(tables, dtype=np.uint64)[None, :, None]
            with np.errstate(over="ignore"):
                key = (c.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (t + np.uint64(64 * dims))) * np.uint64(0xC2B2AE3D27D4EB4F)
            yield ids[pick], mult[pick], x, c, (key ^ key >> np.uint64(31)).view(np.int64)

    def keys(batches):
        for b in batches:
            for *_, key in hashed(b):
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel())], names=["key"])

    def entries(batches):
        names = ["key", "tab", "role", "cls", "mult", "code", "x"]
        for b in batches:
            for ids, mult, x, c, key in hashed(b):
                step, told, raw = 1 + probes, [r.tobytes() for r in c.astype(kind)], _packed(x)
                for t in range(tables):
                    m = len(ids) * step
                    rep = np.repeat(np.arange(len(ids)), step)
                    yield pa.RecordBatch.from_arrays([pa.array(key[:, t].ravel()), pa.array(np.full(m, t, np.int32)), pa.array(np.tile(np.minimum(np.arange(step), 1), len(ids)).astype(np.int32)), pa.array(ids[rep]), pa.array(mult[rep]), pa.array([told[i] for i in rep], pa.binary()), pa.array([raw[i] for i in rep], pa.binary())], names=names)

    source = classes.select("cls", "mult", "v")
    sizes = source.mapInArrow(keys, "key bigint").groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    large = sizes.where(F.col("size") > BLOCK).select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("chunks"))
    all_entries = source.mapInArrow(entries, "key bigint, tab int, role int, cls bigint, mult bigint, code binary, x binary")
    dealt = all_entries.join(F.broadcast(large) if large.count() <= BROADCAST_BUCKETS else large, "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("cls", "tab"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "tab", "role", "cls", "mult", "code", "x")
    placed = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def blocks(batches):
        def done(held):
            cols = [np.concatenate([h[k] for h in held]) for k in range(8)]
            if len(cols[0]) > 1:
                code = np.stack([np.frombuffer(r, kind) for r in cols[6]]).reshape(-1, tables, 1 + probes)
                raw = [_unpacked(r) for r in cols[7]]
                for dims in {len(r) for r in raw}:
                    p = np.array([q for q, r in enumerate(raw) if len(r) == dims])
                    got = _block_pairs(cols[4][p], cols[5][p], cols[3][p], code[p], _unit(np.stack([raw[q] for q in p])), int(cols[2][0]), int(held[0][8]), int(held[0][9]), cols[1][p], threshold)
                    if got:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in got], names=["cls", "links", "root"])

        held, now = [], None
        for b in batches:
            key, i, j, chunk, tab, role, cls, mult = (b.column(k).to_numpy(zero_copy_only=False) for k in range(8))
            code, x = (np.array(b.column(k).to_pylist(), dtype=object) for k in (8, 9))
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            for a, z in zip([0, *cuts], [*cuts, len(key)]):
                if a == z:
                    continue
                if (at := (key[a], i[a], j[a])) != now:
                    if held:
                        yield from done(held)
                    held, now = [], at
                held.append((key[a:z], chunk[a:z], tab[a:z], role[a:z], cls[a:z], mult[a:z], code[a:z], x[a:z], i[a], j[a]))
        if held:
            yield from done(held)

    found = stage(placed.mapInArrow(blocks, "cls bigint, links bigint, root bigint"), "links")
    comps = connected_components(found.where("cls != root").select(F.col("cls").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    first = comps.join(classes.select(F.col("cls").alias("id"), "least"), "id").groupBy("component").agg(F.min("least").alias("first"))
    of = classes.join(links, "cls", "left").join(comps.join(first, "component").select(F.col("id").alias("cls"), "first"), "cls", "left")
    of = of.select("v", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("first", "least").alias("component"))
    usable = valid.join(of, "v").select("id", "n_links", "component")
    rest = rows.where(~F.coalesce(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0), F.lit(False)))
    out = usable.union(rest.select("id", F.lit(0).cast("long"), F.col("id")))
    return out.select(F.col("id").alias(id_col), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))
