"""Jaccard self-join over word n-grams with adaptive multi-match prefixes (Wang, Li and Feng, 2012), to connected components.

Order every document's shingles rare first. Two sets that share at least o shingles share l of them within their first
|set| - o + l. A document takes the l of least estimated cost, the rows its prefix adds to the index against the candidates that one
more match saves, and a pair is verified only with as many shared prefix shingles as the smaller l of the two.

Frequencies come from counters of a fixed number, summed over all documents: any order is exact, a good one is fast. Equal sets are one
class from the start. Large groups of near copies are first linked to one of their members, a row a document; then only pairs in
different components are looked for, and the largest component of each shingle is never paired with itself. No link that could join two
components is lost, and no pair inside one is listed.

A crowded shingle has a hub, one of its classes, and every class that shares it is written as its difference from the hub: the shingles
it adds and those it lacks. The difference of two classes is that of their differences, so that linked classes, unless both link with
the hub, share added or lacking shingles, and multi-match prefixes of the differences find them: the text that a group has in common
plays no part.
Classes far from the hub are given another one; what is left is listed by shingle.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .caches import Hashes, use
from .common import connected_components, ship, shuffles_dropped, stage, unstage

COUNTERS, _SLICE = 1 << 20, 1 << 14
#: The columns of a set's parities.
_BITS = ("bits0", "bits1", "bits2", "bits3")
#: One in so many shingles, by hash, is kept beside each set to turn away pairs that cannot link.
_SAMPLED = 8
#: A shingle that so many classes share takes part in the star rounds.
CROWD = 8
#: The rows of a shingle that at least so many classes share are compared by way of its hub; below it, listing the pairs costs less.
HUB_CROWD = 16
#: The rows of a crowded shingle are dealt into so many parts at most; where pairs are listed, each part has about so many rows.
SALTS, SALT_ROWS = 64, 500
#: Up to so many ids, 16 MB, are broadcast to pick out rows; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


_hashes = Hashes()


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word n-grams: A-Z lower-cased, words between ASCII white space; with fewer words, all of them as one."""
    use("shingles", _hashes.clear)
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    n = len(words)
    if not n:
        return np.empty(0, np.int64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, n)
    k = min(n, size)
    out = np.full(n - k + 1, 0x51_7C_C1 + k, np.uint64)
    for i in range(k):
        out = (out ^ h[i : n - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return np.unique(out.view(np.int64))


def _packed(counts: np.ndarray) -> bytes:
    return zlib.compress(counts.astype("<i8").tobytes(), 1)


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), "<i8")


def _counted(docs: DataFrame, size: int) -> np.ndarray:
    """How many rows have a shingle in each counter; slices of the counters are summed in two steps."""

    def count(batches):
        total, some = np.zeros(COUNTERS, np.int64), False
        for b in batches:
            got = [shingles(x, size) for x in b.column(0).to_pylist()]
            if got:
                some = True
                total += np.bincount(np.concatenate(got) & (COUNTERS - 1), minlength=COUNTERS)
        if some:
            from pyspark import TaskContext

            k = COUNTERS // _SLICE
            yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array([TaskContext.get().partitionId() % 64] * k, pa.int32()), pa.array([_packed(total[i * _SLICE : (i + 1) * _SLICE]) for i in range(k)], pa.binary())], names=["slice", "salt", "counts"])

    def add(rows: pa.Table) -> pa.Table:
        total = np.sum([_unpacked(x) for x in rows.column("counts").to_pylist()], axis=0)
        return pa.table({"slice": rows.column("slice")[:1], "salt": rows.column("salt")[:1], "counts": pa.array([_packed(total)], pa.binary())})

    kind = "slice int, salt int, counts binary"
    parts = docs.select("_text").mapInArrow(count, kind)
    for keys in (["slice", "salt"], ["slice"]):
        parts = parts.groupBy(*keys).applyInArrow(add, kind)
    out = np.zeros(COUNTERS, np.int64)
    with shuffles_dropped(docs.sparkSession):
        slices = parts.collect()  # 2**20 numbers whatever the input
    for r in slices:
        out[r["slice"] * _SLICE : (r["slice"] + 1) * _SLICE] = _unpacked(r["counts"])
    return out


def prefix(found: np.ndarray, freq: np.ndarray, usual: float, percent: int, longest: int = 6) -> tuple[int, np.ndarray]:
    """(l, prefix) of a set of shingles: l of least estimated cost; `usual` is what a counter holds by chance."""
    n = len(found)
    share = -(-percent * n // 100)  # shingles that a partner shares at least
    f = freq[found & (COUNTERS - 1)]
    order = np.lexsort((found, f))
    best = cheapest(np.cumsum(np.maximum(f[order] - usual, 1.0)), share, longest)
    return best, found[order[: n - share + best]]


def cheapest(cost: np.ndarray, share: int, longest: int) -> int:
    """How many matches to ask for of sets that share at least `share`, where the first k of a set, rare first, cost cost[k - 1]: more make the prefix longer and the candidates fewer."""
    return min(range(1, min(longest, share) + 1), key=lambda k: cost[len(cost) - share + k - 1] * (1 + 8 / k**1.5))


def _signed(docs: DataFrame, size: int, percent: int, shared) -> DataFrame:
    usual = float(np.median(shared.value))

    def sign(batches):
        import xxhash
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 40
        for b in batches:
            sets = [shingles(x, size) for x in b.column(1).to_pylist()]
            cut = [prefix(s, shared.value, usual, percent) if len(s) else (0, s) for s in sets]
            names = ["row", "id", "n", "digest", "l", "prefix", "sample"]
            yield pa.RecordBatch.from_arrays([pa.array(range(at, at + len(sets)), pa.int64()), b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()), pa.array([c[0] for c in cut], pa.int32()), pa.array([c[1] for c in cut], pa.list_(pa.int64())), pa.array([s[s % _SAMPLED == 0].tobytes() for s in sets], pa.binary())], names=names)
            at += len(sets)

    return docs.select("_id", "_text").mapInArrow(sign, "row bigint, id bigint, n bigint, digest binary, l int, prefix array<bigint>, sample binary")


def _apart(x: np.ndarray, y: np.ndarray) -> int:
    return len(x) + len(y) - 2 * len(np.intersect1d(x, y, assume_unique=True))


def parities(found: np.ndarray) -> list[int]:
    """256 bits of a set of shingles, each the parity of those that fall on it: two sets differ in no fewer shingles than bits."""
    odd = np.bincount((found >> np.int64(40)) & 255, minlength=256) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").tolist()


def _linked_apart(percent: int):
    """The most shingles in which linked sets of n and m shingles differ."""
    return lambda n, m: (n + m) * (100 - percent) // (100 + percent)


def _classes(signed: DataFrame) -> DataFrame:
    """One row of each set of shingles, that of the least id, as its class: (cls, digest, n, l, prefix, sample).

    Only what tells copies apart is shuffled; then the rows that are copies of another are left out wherever the signed rows are read.
    """
    valid = signed.where("id is not null and digest is not null")
    least = valid.groupBy("digest").agg(F.min(F.struct("id", "row")).alias("least"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    others = stage(valid.select("digest", "row").join(least, "digest").where("row != least.row").select("row"), "copies")
    few = others.count() <= BROADCAST_IDS
    return valid.join(F.broadcast(others) if few else others, "row", "left_anti").select(F.col("id").alias("cls"), "digest", "n", "l", "prefix", "sample")


def _of_pairs(rows: DataFrame, key: str, pairs: DataFrame) -> DataFrame:
    """The rows whose key is in a pair."""
    ids = pairs.select(F.col("a").alias(key)).union(pairs.select("b")).distinct()
    few = ids.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if few else ids, key, "left_semi")


def _possible(classes: DataFrame, pairs: DataFrame, most) -> DataFrame:
    """The pairs that their samples do not rule out: sets of n and m that differ in most(n, m) shingles have samples that differ in no more."""
    classes = _of_pairs(classes, "cls", pairs)
    of = classes.select(F.col("cls").alias("b"), F.col("n").alias("bn"), F.col("sample").alias("y"))
    both = pairs.join(classes.select(F.col("cls").alias("a"), F.col("n").alias("an"), F.col("sample").alias("x")), "a").join(of, "b")

    def possible(batches):
        for b in batches:
            keep = []
            for n, m, x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4), b.column(5)):
                keep.append(_apart(*(np.frombuffer(v.as_buffer(), np.int64) for v in (x, y))) <= most(n, m))
            kept = b.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], names=["a", "b"])

    return both.select("a", "b", "an", "bn", "x", "y").mapInArrow(possible, "a bigint, b bigint")


def _with_sets(docs: DataFrame, classes: DataFrame, pairs: DataFrame, size: int, most) -> tuple[DataFrame, DataFrame]:
    """(a, b, x, y): the pairs that can differ in so few shingles, with their whole sets; and the staged pairs that this reads."""
    every = stage(pairs, "pairs")
    pairs = stage(_possible(classes, every, most), "possible")
    unstage(every)
    picked = _of_pairs(docs, "_id", pairs)

    def sets(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(x, size).tobytes() for x in b.column(1).to_pylist()], pa.binary())], names=["id", "found"])

    found = picked.select("_id", "_text").mapInArrow(sets, "id bigint, found binary")
    both = pairs.join(found.withColumnRenamed("id", "a").withColumnRenamed("found", "x"), "a").join(found.withColumnRenamed("id", "b").withColumnRenamed("found", "y"), "b")
    return both.select("a", "b", "x", "y"), pairs


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ids whose sets link, by the exact sizes of intersection and union."""

    def verify(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.int64) for v in (x, y))
                same = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * same >= percent * (len(x) + len(y) - same))
            kept = b.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], names=["a", "b"])

    both, possible = _with_sets(docs, classes, pairs, size, _linked_apart(percent))
    links = stage(both.mapInArrow(verify, "a bigint, b bigint").distinct(), "links")
    unstage(possible)
    return links


def ngram_components(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", star_rounds: int = 1, hub_rounds: int = 2) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row; component_id is the smallest id reachable by links.

    Two rows link when 100 * |intersection| >= percent * |union| of their shingle sets. Null, empty and blank texts have no shingles and
    link with nothing. Rows that repeat an id are kept and count as that one id; a row without an id links with nothing and has a null
    component. An empty table gives an empty one; other columns are ignored. Whole texts of any length are used.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    shared = spark.sparkContext.broadcast(_counted(docs, size))
    signed = stage(_signed(docs, size, percent, shared), "signed")
    classes = _classes(signed)
    rows = classes.select("cls", "n", "l", F.explode("prefix").alias("tok"))
    crowds = stage(rows.groupBy("tok").agg(F.count(F.lit(1)).alias("crowd")).where("crowd > 1"), "crowds")
    live = stage(rows.join(crowds, "tok").withColumn("comp", F.col("cls")), "live")
    unstage(crowds)
    links = comps = None
    used: list[DataFrame] = []  # staged tables that are read to the end of the search
    for k in range(star_rounds):
        pairs = _hub_pairs(live.where(F.col("crowd") >= CROWD), k, percent)
        new = _verified(docs, classes, pairs, size, percent)
        used.append(new)
        if new.isEmpty():
            break
        links = new if links is None else links.union(new)
        unstage(comps)
        comps = stage(connected_components(links), "comps")
        live, last = _live(live, comps), live
        unstage(last)
    used.append(live)
    listed, crowded, pairs = live.where(F.col("crowd") < HUB_CROWD), live.where(F.col("crowd") >= HUB_CROWD), []
    for k in range(hub_rounds):
        rest, crowded, dealt = _by_crowd(crowded)
        used.append(dealt)
        listed = listed.union(rest)
        if crowded.isEmpty():
            break
        apart, crowded = _apart_from_hubs(docs, classes, crowded, shared, star_rounds + k, size, percent)
        used += apart, crowded
        near = apart.where("near").select(F.col("cls").alias("a"), F.col("hub").alias("b"))
        links = near if links is None else links.union(near)
        pairs.append(_apart_pairs(apart, percent))
    pairs.append(_candidates(listed.union(crowded), percent))
    new = _verified(docs, classes, reduce(DataFrame.union, pairs).distinct(), size, percent)
    used.append(new)
    links = new if links is None else links.union(new)
    if not links.isEmpty():
        unstage(comps)
        comps = stage(connected_components(links), "comps")
    unstage(*used)
    ids = signed.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "digest")
    of = classes.select("digest", "cls")
    if comps is not None:
        of = of.join(comps, F.col("cls") == F.col("id"), "left").select("digest", F.coalesce("component", "cls").alias("cls"))
    out = ids.join(of, "digest", "left")
    return out.select(id_col, "n_shingles", F.when(F.col(id_col).isNotNull(), F.coalesce("cls", id_col)).alias("component_id"))


def _hubs(live: DataFrame, k: int) -> DataFrame:
    """(tok, h): a class of each shingle, in round 0 and after it by another hash, that has many of the shingles at hand: what a group of copies has in common."""
    score = live.groupBy("cls").agg(F.count(F.lit(1)).alias("score"))
    return live.join(score, "cls").groupBy("tok").agg(F.max_by(F.struct("cls", "comp", "n"), F.struct("score", F.xxhash64("cls", F.lit(k)))).alias("h"))


def _dealt(live: DataFrame, of: DataFrame) -> DataFrame:
    """The index rows with what `of` says of their shingle, (tok, crowd, ...) with a row a shingle.

    The rows of a shingle are dealt by class into as many as SALTS parts, so that no task has all of a crowd; the row of `of` is repeated
    once a part, no more often than the shingle had rows at first.
    """
    parts = F.least(F.lit(SALTS), F.col("crowd"))
    repeated = of.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))).drop("crowd")
    return live.withColumn("_salt", F.pmod(F.xxhash64("cls"), parts)).repartition("tok", "_salt").join(repeated, ["tok", "_salt"]).drop("_salt")


def _by_crowd(live: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The index rows of shingles that fewer than HUB_CROWD rows have now, the others, and the staged table of both; those of one component alone are left out."""
    now = live.groupBy("tok").agg(F.count(F.lit(1)).alias("_now"), F.max("crowd").alias("crowd"), F.min("comp").alias("_a"), F.max("comp").alias("_b")).where("_a < _b")
    rows = stage(_dealt(live, now.select("tok", "crowd", "_now")), "crowds")
    few, many = (rows.where(test).select(live.columns) for test in (f"_now < {HUB_CROWD}", f"_now >= {HUB_CROWD}"))
    return few, many, rows


def _hub_pairs(live: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): each class with the hub it shares most prefix shingles with."""
    near = live.join(_hubs(live, k), "tok").where("comp != h.comp").where(f"100 * least(n, h.n) >= {percent} * greatest(n, h.n)")
    hits = near.groupBy("cls", F.col("h.cls").alias("hub")).agg(F.count(F.lit(1)).alias("hits"))
    best = hits.groupBy("cls").agg(F.max_by("hub", F.struct("hits", "hub")).alias("hub"))
    return best.select(F.col("cls").alias("a"), F.col("hub").alias("b"))


def _close(percent: int):
    """(inner, outer) of a hub of m shingles: of two linked classes, if one differs from it in at most `inner`, the other does in at most `outer`."""
    return lambda m: (inner := 0.75 * m, inner + (m + inner) * (100 - percent) / percent)


def apart(x: np.ndarray, y: np.ndarray, freq: np.ndarray, percent: int, longest: int = 8) -> tuple[bool, np.ndarray, tuple[int, int], tuple[int, int]]:
    """(linked, shingles, (length, matches) towards unlinked sets, the same towards linked ones) of the difference of set x from its hub y.

    Sets of n and k shingles link if they differ in at most c * (n + k), c = (100 - percent) / (100 + percent). Their differences from the
    hub, of d and e shingles, then share (d + e - c * (n + k)) / 2 or more. A partner that is not linked with the hub has e > c * (m + k),
    so that over (d - c * n + c * m) / 2 are shared. By the triangle inequality e is d less what the two differ in, or more: d - c * (n + k)
    are shared at least, and k is at most n * 100 / percent. An unlinked set further from the hub than two linked steps has no partner
    that links with the hub. A prefix as long as leaves one less than so many outside meets the partner's once, longer ones more often.
    Order: fewest sets first, by the counter of an added shingle and, for one lacking, what its counter is short of the hub's usual ones;
    the latter are complemented.
    """
    more, less = np.setdiff1d(x, y, assume_unique=True), np.setdiff1d(y, x, assume_unique=True)
    d, n, m, w, rest = len(more) + len(less), len(x), len(y), 100 + percent, 100 - percent
    usual = np.quantile(freq[y & (COUNTERS - 1)], 0.9)
    found = np.concatenate([more, ~less])
    rows = np.concatenate([freq[more & (COUNTERS - 1)], np.maximum(usual - freq[less & (COUNTERS - 1)], 1)])
    order = np.lexsort((found, rows))
    cost = np.cumsum(rows[order].astype(float))
    over = w * d - rest * (n + m)
    least = max(1, -(-(percent * d - rest * n) // percent))

    def cut(share: int) -> tuple[int, int]:
        if share > d:
            return 0, 1
        k = cheapest(cost, share, longest)
        return d - share + k, k

    short = cut(max(least, (w * d - rest * (n - m)) // (2 * w) + 1))
    if over <= 0:
        return True, found[order[: short[0]]], short, short
    two_steps = percent * w * d <= rest * (percent * (n + m) + 200 * min(n, m))
    long = cut(max(least, -(-over // (2 * w)))) if two_steps else (0, 1)
    return False, found[order[: max(short[0], long[0])]], short, long


def _apart_from_hubs(docs: DataFrame, classes: DataFrame, live: DataFrame, shared, k: int, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Classes as differences from the hubs of their shingles, with a row a shingle of the prefixes; and the rows of `live` whose hubs are too far.

    A row is (tok, at, cls, n, d, comp, hub, near, short, long, need, need_near, bits0 to bits3): the place of tok in the prefix, the size of the difference, whether tok is of the prefix towards unlinked sets, whether of that
    towards linked ones, how many matches each asks for, and the parities of the whole set.

    An id of several texts is settled when all of them are.
    """
    close = _close(percent)
    hubs = _hubs(live, k).join(live.groupBy("tok").agg(F.max("crowd").alias("crowd")), "tok")
    met = stage(_dealt(live, hubs).where("cls != h.cls"), "met")

    def differ(batches):
        import xxhash

        for b in batches:
            rows = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.int64) for v in (x, y))
                d, (inner, outer) = _apart(x, y), close(len(y))
                near, found, short, long = apart(x, y, shared.value, percent) if d <= outer else (False, x[:0], (0, 1), (0, 1))
                rows.append((len(x), d, d > inner, near, found ^ np.int64(xxhash.xxh3_64_intdigest(y.tobytes()) >> 1), *short, *long, *parities(x)))
            n, apart_in, far, near, found, *cuts = zip(*rows) if rows else ([],) * 13
            arrays = [pa.array(n, pa.int64()), pa.array(apart_in, pa.int64()), pa.array(far, pa.bool_()), pa.array(near, pa.bool_()), pa.array(found, pa.list_(pa.int64())), *[pa.array(c, pa.int32()) for c in cuts[:4]], *[pa.array(c, pa.int64()) for c in cuts[4:]]]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *arrays], names=["cls", "hub", "n", "d", "far", "near", "found", "short", "need", "long", "need_near", *_BITS])

    duos = met.select(F.col("cls").alias("a"), F.col("h.cls").alias("b")).distinct()
    both, possible = _with_sets(docs, classes, duos, size, lambda n, m: close(m)[1])
    seen = stage(both.mapInArrow(differ, "cls bigint, hub bigint, n bigint, d bigint, far boolean, near boolean, found array<bigint>, short int, need int, long int, need_near int, " + ", ".join(f"{b} bigint" for b in _BITS)), "differences")
    settled = seen.groupBy("cls", "hub").agg(F.max("far").alias("far")).where("not far")
    left = met.withColumn("hub", F.col("h.cls")).join(settled, ["cls", "hub"], "left_anti").select(live.columns)
    comp = met.select("cls", F.col("h.cls").alias("hub"), "comp", F.col("h.comp").alias("hub_comp")).groupBy("cls", "hub").agg(F.min("comp").alias("comp"), F.min("hub_comp").alias("hub_comp"))
    at = seen.join(comp, ["cls", "hub"]).withColumn("comp", F.expr("if(near, hub_comp, comp)"))
    rows = at.select("cls", "hub", "n", "d", "comp", "near", "short", "long", "need", "need_near", *_BITS, F.posexplode_outer("found").alias("at", "tok"))
    out = stage(rows.selectExpr("tok", "at", "cls", "n", "d", "comp", "hub", "near", "at < short as short", "at < long as long", "need", "need_near", *_BITS), "apart"), stage(left, "live")
    unstage(met, possible, seen)
    return out


def _apart_pairs(apart: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) in different components whose differences from a hub share enough shingles of their prefixes, one of them at least not linked with it."""
    pair = _apart_met(apart, percent)
    return pair.groupBy("hub", "a", "b").agg(F.count(F.lit(1)).alias("hits"), F.min("need").alias("need")).where("hits >= need").select("a", "b").distinct()


def _apart_met(apart: DataFrame, percent: int) -> DataFrame:
    """(hub, a, b, need) for each shingle that such a pair shares.

    Of two differences both sizes are known where they meet: with what the pair must share, its prefixes are shorter than those of each alone.
    Linked sets differ in no more parities than they may in shingles; the join gives no row of two that do.
    """
    w, rest = 100 + percent, 100 - percent
    some = apart.where("tok is not null")
    sizes = some.groupBy("tok", "comp").agg(F.count(F.lit(1)).alias("c"))
    tagged = some.join(_largest(sizes), "tok")
    side = lambda x: ["tok", "hub", f"cls {x}", f"n {x}n", f"comp {x}c", f"near {x}near", f"d {x}d", f"at {x}at", f"short {x}short", f"if(near, short, long) {x}long", f"need {x}need", f"if(near, need, need_near) {x}needn", *(f"{b} {x}{b}" for b in _BITS)]
    x = _every_part(tagged.where("comp != big")).selectExpr(*side("a"), "_part")
    y = _own_part(tagged).selectExpr(*side("b"), "big", "_part").drop("hub")
    met = x.join(y, ["tok", "_part"]).where("ac != bc and (bc = big or a < b) and if(anear = bnear, not anear and ashort and bshort, along and blong)")
    need = "if(anear = bnear, least(aneed, bneed), least(aneedn, bneedn))"
    share = f"greatest(1, ({w} * (ad + bd) - {rest} * (an + bn) + {2 * w - 1}) div {2 * w})"
    met = met.where(f"{' + '.join(f'bit_count(a{b} ^ b{b})' for b in _BITS)} <= (an + bn) * {rest} div {w}")
    met = met.where(f"100 * least(an, bn) >= {percent} * greatest(an, bn) and {share} <= least(ad, bd) and aat < ad - {share} + {need} and bat < bd - {share} + {need}")
    return met.selectExpr("hub", "least(a, b) a", "greatest(a, b) b", f"{need} need")


def _live(live: DataFrame, comps: DataFrame) -> DataFrame:
    """The index rows with their components now, of shingles that still meet more than one."""
    rows = live.drop("comp").join(comps, F.col("cls") == F.col("id"), "left").select("tok", "cls", "n", "l", "crowd", F.coalesce("component", "cls").alias("comp"))
    mixed = rows.groupBy("tok").agg(F.min("comp").alias("_a"), F.max("comp").alias("_b")).where("_a < _b").select("tok")
    return stage(rows.join(mixed, "tok"), "live")


def _largest(sizes: DataFrame) -> DataFrame:
    """(tok, big, parts) of the shingles that more than one component has: the component of most rows, and into how many parts the rows are dealt."""
    of = sizes.groupBy("tok").agg(F.max_by("comp", F.struct("c", "comp")).alias("big"), F.count(F.lit(1)).alias("kinds"), F.sum("c").alias("rows"))
    return of.where("kinds > 1").select("tok", "big", F.least(F.lit(SALTS), F.ceil(F.col("rows") / SALT_ROWS)).cast("int").alias("parts"))


def _own_part(rows: DataFrame) -> DataFrame:
    """Rows with the part of their shingle that they are dealt to, by class."""
    return rows.withColumn("_part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))


def _every_part(rows: DataFrame) -> DataFrame:
    """Rows once for each part of their shingle."""
    return rows.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))


def _candidates(live: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) in different components with enough shared prefix shingles."""
    sizes = live.groupBy("tok", "comp").agg(F.count(F.lit(1)).alias("c"))
    tagged = live.join(_largest(sizes), "tok")
    x = _every_part(tagged.where("comp != big")).select("tok", "_part", F.col("cls").alias("a"), F.col("n").alias("an"), F.col("l").alias("al"), F.col("comp").alias("ac"))
    y = _own_part(tagged).select("tok", "_part", F.col("cls").alias("b"), F.col("n").alias("bn"), F.col("l").alias("bl"), F.col("comp").alias("bc"), "big")
    met = x.join(y, ["tok", "_part"]).where("ac != bc and (bc = big or a < b)").where(f"100 * least(an, bn) >= {percent} * greatest(an, bn)")
    pair = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.least("al", "bl").alias("need"))
    return pair.groupBy("a", "b").agg(F.count(F.lit(1)).alias("hits"), F.min("need").alias("need")).where("hits >= need").select("a", "b")
