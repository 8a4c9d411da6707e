"""Phrase collocations by dynamic itemset counting (Brin, Motwani, Ullman and Tsur, 1997) over cyclic scans of shards.

The texts are dealt into shards that are scanned in turn, round and round. Words are counted from the first scan on; a longer phrase is
counted from the scan after that in which both phrases it starts and ends with have reached the threshold, and for one full cycle. So
phrases of all lengths are counted side by side, and an end to it comes when no phrase is left within its cycle.

A task turns phrases away by fixed-size bitmaps of what has reached the threshold; what they let through by chance is counted a shard
apart and does no harm. What a shard holds of a phrase is aggregated in the task, then by key, and written; a phrase that comes to the
threshold has its share of it, threshold / shards, in some shard at least, so only those few are ever added up over shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from .caches import use
from .common import scratch, ship, stage

#: Up to so many phrases, 100 MB at most where a phrase has 50 bytes, are broadcast; more are joined by a shuffle.
BROADCAST_PHRASES = 500_000
#: Bits of one bitmap: 16 for each phrase that it holds, within these bounds. Eight of them are broadcast, 64 MB at most.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 26
_SEGMENT = 4 << 20
_ENDS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(_ENDS + b"\tABCDEFGHIJKLMNOPQRSTUVWXYZ", b"." * len(_ENDS) + b" abcdefghijklmnopqrstuvwxyz")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _nothing() -> None:
    pass


def _begin() -> None:
    use("collocations", _nothing)  # others let go of their caches; this one has none


def _segments(texts: list[bytes]) -> Iterator[bytes]:
    """Texts in lower case with an end of piece as a word `.`, some megabytes at a time; cut at ends of pieces alone."""
    for k, blob in enumerate(texts):
        texts[k] = blob.translate(_TABLE)
    blob, at = b".".join(texts), 0
    while at < len(blob):
        end = blob.find(b".", at + _SEGMENT)
        end = len(blob) if end < 0 else end
        yield blob[at:end].replace(b".", b" . ")
        at = end + 1


def _words(segment: bytes) -> tuple[np.ndarray, pa.Array]:
    """Word numbers, -1 at ends of pieces, and the words."""
    offsets = pa.py_buffer(np.array([0, len(segment)], np.int64).tobytes())
    one = pa.LargeStringArray.from_buffers(1, offsets, pa.py_buffer(segment))
    coded = pc.ascii_split_whitespace(one).flatten().dictionary_encode()
    words = coded.dictionary.cast(pa.large_binary())
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    dot = pc.index(words, pa.scalar(b".", pa.large_binary())).as_py()
    ids[ids == dot] = -1
    empty = pc.index(words, pa.scalar(b"", pa.large_binary())).as_py()
    if empty >= 0:  # what stands before the first blank
        ids = ids[ids != empty]
    return ids, words


def _mixed(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint64(31))) * _STEP


def _word_hashes(words: pa.Array) -> np.ndarray:
    """Hashes of binary words: sums of their bytes times powers of an odd number, modulo 2**64. Chance meetings only let a phrase past a bitmap."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(words) else np.zeros(0, np.uint8)
    starts, size = offsets[:-1] - offsets[0], np.diff(offsets)
    powers = np.cumprod(np.full(int(size.max(initial=0)) + 1, _STEP))
    parts = (data.astype(np.uint64) + np.uint64(1)) * powers[np.arange(len(data)) - np.repeat(starts, size)]
    return _mixed(np.add.reduceat(np.append(parts, np.uint64(0)), starts)) if len(words) else np.zeros(0, np.uint64)


def _lang_hash(lang: str) -> np.uint64:
    return _word_hashes(pa.array([lang.encode()], pa.large_binary()))[0]


def _slots(h: np.ndarray, level: int, bits: int) -> np.ndarray:
    h = _mixed(h + np.uint64(level))
    return (h ^ (h >> np.uint64(29))) & np.uint64(bits - 1)


def _has(bitmap: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bitmap[(slots >> np.uint64(6)).astype(np.int64)] >> (slots & np.uint64(63))) & np.uint64(1) == 1


def _distinct(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of columns of numbers below 2**31, column by column, and how often each occurs."""
    code, parts = columns[0], []
    for column in columns[1:]:
        pairs, code, n = np.unique(code << 32 | column, return_inverse=True, return_counts=True)
        parts.append(pairs)
    out, at = [], np.arange(len(pairs))
    for pairs in reversed(parts):
        at = pairs[at]
        out.append(at & 0xFFFFFFFF)
        at = at >> 32
    return [at, *reversed(out)], n


def _phrase_hashes(lang: str, phrases: list[bytes], size: int) -> np.ndarray:
    """Of phrases of `size` words."""
    words = _word_hashes(pa.array([w for p in phrases for w in p.split(b" ")], pa.large_binary())).reshape(-1, size)
    h = np.full(len(phrases), _lang_hash(lang), np.uint64)
    for k in range(size):
        h = _mixed(h) + words[:, k]
    return h


def count_segment(lang: str, segment: bytes, count_words: bool, reached: np.ndarray | None, fresh: np.ndarray | None, longest: int) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """(length, phrases, counts) of what is under count in one segment; reached and fresh are bitmaps, a row a length."""
    ids, words = _words(segment)
    if not len(ids):
        return
    if count_words:
        n = np.bincount(ids[ids >= 0], minlength=len(words))
        some = np.flatnonzero(n)
        yield 1, words.take(pa.array(some)), n[some]
    if reached is None:
        return
    bits = reached.shape[1] * 64
    hashes, seed = _word_hashes(words), _mixed(np.array([_lang_hash(lang)]))
    slots = _slots(seed + hashes, 1, bits)
    in_all, in_new = np.append(_has(reached[0], slots), False), np.append(_has(fresh[0], slots), False)  # the last is -1
    at = np.flatnonzero(in_all[ids])
    new, h = in_new[ids[at]], seed + hashes[ids[at]]
    for size in range(2, longest + 1):
        # `at` has where phrases of size - 1 words start that have reached the threshold: two in a row make a phrase.
        pair = np.flatnonzero(at[1:] == at[:-1] + 1)
        start, wanted = at[pair], new[pair] | new[pair + 1]
        if not len(start):
            return
        if wanted.any():
            of, n = _distinct([ids[start[wanted] + k] for k in range(size)])
            phrases = pc.binary_join_element_wise(*[words.take(pa.array(x)) for x in of], pa.scalar(b" ", pa.large_binary()))
            yield size, phrases, n
        if size < longest:
            h = _mixed(h[pair]) + hashes[ids[start + size - 1]]
            slots = _slots(h, size, bits)
            keep = _has(reached[size - 1], slots)
            at, new, h = start[keep], _has(fresh[size - 1], slots)[keep], h[keep]


def _by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Texts by language, gathered over batches to about a segment each; all that is held together is a few segments at most."""
    held, sizes = {}, {}
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
            text = text.as_py()
            held.setdefault(lang, []).append(text)
            sizes[lang] = sizes.get(lang, 0) + len(text)
        full = sum(sizes.values()) > 4 * _SEGMENT
        for lang in [x for x, n in sizes.items() if full or n >= _SEGMENT]:
            del sizes[lang]
            yield lang, held.pop(lang)
    yield from held.items()


def _counted(shard: DataFrame, count_words: bool, bitmaps, longest: int) -> DataFrame:
    """(lang, k, phrase, n) of a shard."""

    def count(batches):
        _begin()
        reached, fresh = bitmaps.value if bitmaps is not None else (None, None)
        for lang, texts in _by_lang(batches):
            for segment in _segments(texts):
                for size, phrases, n in count_segment(lang, segment, count_words, reached, fresh, longest):
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), len(n)), pa.repeat(pa.scalar(size, pa.int32()), len(n)), phrases.cast(pa.binary()), pa.array(n, pa.int64())], names=["lang", "k", "phrase", "n"])

    rows = shard.select("lang", F.col("text").cast("binary")).mapInArrow(count, "lang string, k int, phrase binary, n bigint")
    return rows.groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n"))


class _Counts:
    """What the scans have counted, in the shared folder: a folder a scan, in it one a length."""

    def __init__(self, spark: SparkSession, shards: int, threshold: int):
        self.spark, self.path, self.shards, self.threshold = spark, scratch(spark, "phrase-counts"), shards, threshold
        self.share, self.candidates = -(-threshold // shards), 0

    def add(self, step: int, rows: DataFrame) -> None:
        seen = Observation()
        rows.observe(seen, F.count_if(F.col("n") >= self.share).alias("n")).write.option("compression", "zstd").partitionBy("k").parquet(f"{self.path}/step={step}")
        self.candidates += seen.get["n"] or 0

    def rows(self) -> DataFrame:
        """(lang, phrase, n, step, k) of all scans so far."""
        return self.spark.read.schema("lang string, phrase binary, n bigint, step int, k int").parquet(self.path)

    def frequent(self, levels: list[int], before: int) -> DataFrame:
        """(lang, k, phrase, n, is_new) of phrases of those lengths counted `threshold` times or more so far; new ones were not by scan `before`."""
        rows = self.rows().where(F.col("k").isin(levels))
        some = rows.where(F.col("n") >= self.share).select("lang", "k", "phrase")
        held = rows.join(F.broadcast(some) if self.candidates <= BROADCAST_PHRASES else some, ["lang", "k", "phrase"], "left_semi")
        of = F.pmod("step", F.lit(self.shards))
        parts = {f"{kind}{s}": F.max(F.when((of == s) & in_time, F.col("n"))) for s in range(self.shards) for kind, in_time in (("all", F.lit(True)), ("old", F.col("step") <= before))}  # counted again by chance: the same
        total = lambda kind: sum((F.coalesce(f"{kind}{s}", F.lit(0)) for s in range(self.shards)), F.lit(0).cast("long"))
        added = held.groupBy("lang", "k", "phrase").agg(*[x.alias(name) for name, x in parts.items()])
        return added.select("lang", "k", "phrase", total("all").alias("n"), (total("old") < self.threshold).alias("is_new")).where(F.col("n") >= self.threshold)


def _set_bits(frequent: DataFrame, bits: int) -> pd.DataFrame:
    """(k, is_new, word, bit) rows: the words of bitmaps that hold the phrases, at most bits / 64 a bitmap."""

    def slots(batches):
        _begin()
        for b in batches:
            groups: dict = {}
            for i, key in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(4).to_pylist())):
                groups.setdefault(key, []).append(i)
            phrases = b.column(2).to_pylist()
            for (lang, size, is_new), rows in groups.items():
                s, n = _slots(_phrase_hashes(lang, [phrases[i] for i in rows], size), size, bits), len(rows)
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(size, pa.int32()), n), pa.repeat(pa.scalar(is_new), n), pa.array((s >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (s & np.uint64(63))).view(np.int64))], names=["k", "is_new", "word", "bit"])

    return frequent.mapInArrow(slots, "k int, is_new boolean, word bigint, bit bigint").groupBy("k", "is_new", "word").agg(F.bit_or("bit").alias("bit")).toPandas()


def frequent_phrases(docs: DataFrame, threshold: int = 100, longest: int = 5, shards: int = 2, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(lang, k, phrase, n) of all phrases of up to `longest` words that occur `threshold` times or more, and (lang, n) of all words."""
    spark = docs.sparkSession
    ship(spark)
    path, kinds = scratch(spark, "phrase-shards"), "lang string, text string"
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows.withColumn("shard", F.pmod(F.spark_partition_id(), F.lit(shards))).write.option("compression", "zstd").partitionBy("shard").parquet(path)
    dealt, counts = spark.read.schema(f"{kinds}, shard int").parquet(path), _Counts(spark, shards, threshold)
    bits, reached, fresh, shared, step, history = 0, None, None, None, 0, [[1]]  # history: the lengths counted in each scan
    while history[-1]:
        counts.add(step, _counted(dealt.where(F.col("shard") == step % shards), step < shards, shared, longest))
        if shared is not None:
            shared.unpersist()
        levels = sorted({k for counted in history[-shards:] for k in counted if k < longest})
        wanted = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * counts.candidates).bit_length()))
        if wanted > bits:  # all bitmaps anew
            bits, reached, levels = wanted, np.zeros((longest - 1, wanted // 64), np.uint64), list(range(1, longest))
        fresh = np.zeros_like(reached)
        for is_new, got in _set_bits(counts.frequent(levels, step - shards), bits).groupby("is_new"):
            for bitmap in (reached, fresh) if is_new else (reached,):
                np.bitwise_or.at(bitmap, (got["k"].to_numpy() - 1, got["word"].to_numpy()), got["bit"].to_numpy().view(np.uint64))
        shared, step = spark.sparkContext.broadcast((reached, fresh)), step + 1
        history.append([1] * (step < shards) + [k + 2 for k in range(longest - 1) if fresh[k].any()])
    words = counts.rows().where(F.col("k") == 1).groupBy("lang").agg(F.sum("n").alias("n"))
    return stage(counts.frequent(list(range(1, longest + 1)), -1).drop("is_new"), "phrases"), words


def _ranked(rows: DataFrame, best: int) -> DataFrame:
    """The first `best` rows of each lang with their rank. Rows are sorted over all partitions, so that no language meets in one task."""
    order = ["lang", F.col("score").desc(), F.col("a").desc(), "phrase"]
    sorted_rows = stage(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "phrases-sorted")
    part = F.shiftrightunsigned("_at", 33)
    starts = sorted_rows.groupBy("lang", part.alias("_part")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))  # a row a partition, and one more a language
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("lang").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = starts.select("lang", "_part", "_first", before.alias("_before")).where(F.col("_before") < best)
    placed = sorted_rows.withColumn("_part", part).join(F.broadcast(starts), ["lang", "_part"])
    rank = F.col("_before") + F.col("_at") - F.col("_first") + 1
    return placed.withColumn("rank", rank).where(F.col("rank") <= best).drop("_at", "_part", "_first", "_before")


def collocations(docs: DataFrame, threshold: int = 100, longest: int = 5, best: int = 2000, shards: int = 2, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `best` phrases of two to `longest` words.

    a is the phrase's count, l and r those of its two parts at the cut of lowest floor(1000 a n / (l r)), ties to the earliest cut; n is
    the language's words. A phrase that every time is part of one longer phrase is left out. Null texts are empty, a null language is
    `und`; repeated rows count each; other columns are ignored. Without phrases at the threshold, or rows, the result is empty.
    """
    phrases, words = frequent_phrases(docs, threshold, longest, shards, text_col, lang_col)
    parts = F.split(F.col("phrase").cast("string"), " ")
    cands = phrases.where("k > 1").select("lang", "k", "phrase", F.col("n").alias("a"))
    # Whatever a phrase is always part of, it is always part of one that is a word longer.
    shorter = F.explode(F.array(*[F.encode(F.array_join(F.slice(parts, at, F.col("k") - 1), " "), "UTF-8") for at in (1, 2)]))
    longer = cands.where("k > 2").select("lang", shorter.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = cands.join(longer, ["lang", "phrase"], "left").where("most is null or most < a").select("lang", "phrase", "k", "a")
    part = lambda at, n: F.encode(F.array_join(F.slice(parts, at, n), " "), "UTF-8")
    cut = kept.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cut = cut.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("left"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    known = phrases.select("lang", "phrase", "n")
    cut = cut.join(known.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    cut = cut.join(known.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    big = lambda x: F.col(x).cast("decimal(19,0)")
    score = F.call_function("div", big("a") * big("n") * F.lit(1000).cast("decimal(4,0)"), big("l") * big("r"))
    scored = cut.join(F.broadcast(words), "lang").select("lang", "phrase", "a", "l", "r", "n", "cut", score.alias("score"))  # as many rows as languages
    least = F.min(F.struct("score", "cut", "l", "r")).alias("x")
    out = scored.groupBy("lang", "phrase", "a", "n").agg(least).select("lang", F.col("phrase").cast("string").alias("phrase"), "a", "x.l", "x.r", "n", "x.score")
    return _ranked(out, best).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
