"""Samples by block with estimates and their error, and stored samples that validators share."""

from __future__ import annotations

import hashlib
import json
import math
import uuid
from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SLOTS = 1 << 20


def in_sample(key: Column, rate: float, seed: int) -> Column:
    """Whether a key's hash falls in a share `rate` of all: the same keys each time."""
    if not 0 < rate <= 1:
        raise ValueError("rate must be over 0 and at most 1")
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(_SLOTS)) < math.ceil(rate * _SLOTS)


def block_sample(df: DataFrame, rate: float, seed: int = 42, block_rows: int | None = None) -> DataFrame:
    """Whole blocks of a table of files, with `_block` to tell them apart; each block is in with probability `rate`.

    A block is a file: Spark drops the other files while it lists them, so that they are never opened. Where a table has too few files for
    that, `block_rows` makes each so many rows of a file a block; then all is read but only the blocks go on.
    """
    m = F.col("_metadata")
    if block_rows is None:
        return df.where(in_sample(m["file_path"], rate, seed)).withColumn("_block", F.xxhash64(m["file_path"]))
    block = F.struct(m["file_name"], F.floor(m["row_index"] / block_rows))
    return df.where(in_sample(block, rate, seed)).withColumn("_block", F.xxhash64(block))


def estimate(sample: DataFrame, columns: Sequence[str], rate: float, confidence: float = 0.95, by: str = "_block") -> DataFrame:
    """(column_name, blocks, mean, mean_low, mean_high, total, total_low, total_high) of numeric columns of a block sample.

    Means are ratios of sums, their errors from how the blocks differ (Cochran, 1977, 6.5); totals are sums over the blocks divided by
    `rate`, with the error of blocks taken each by chance. NULLs count for nothing. The intervals hold the value at the rate `confidence`
    where there are some dozens of blocks; with one block they are NULL.
    """
    z = NormalDist().inv_cdf(0.5 + confidence / 2)
    x = sample.groupBy(by).agg(*[F.sum(F.col(f"`{c}`").cast("double")).alias(f"s{i}") for i, c in enumerate(columns)], *[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(columns)])
    stats = F.array(*[F.struct(F.lit(c).alias("column_name"), F.coalesce(f"s{i}", F.lit(0.0)).alias("s"), F.col(f"n{i}").alias("n")) for i, c in enumerate(columns)])
    sums = [F.count(F.lit(1)).alias("blocks"), F.sum("s").alias("s"), F.sum("n").alias("n"), F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum(F.col("s") * F.col("n")).alias("sn"), F.sum(F.col("n") * F.col("n")).alias("nn")]
    t = x.select(F.inline(stats)).groupBy("column_name").agg(*sums)
    mean, m = F.try_divide("s", "n"), F.col("blocks")
    off = F.greatest(F.col("ss") - 2 * mean * F.col("sn") + mean * mean * F.col("nn"), F.lit(0.0))
    mean_error = F.when(m > 1, z * F.sqrt((1 - rate) * m / (m - 1) * off) / F.col("n"))
    total_error = F.when(m > 1, z * F.sqrt((1 - rate) * F.col("ss")) / rate)
    total = F.col("s") / rate
    return t.select("column_name", "blocks", mean.alias("mean"), (mean - mean_error).alias("mean_low"), (mean + mean_error).alias("mean_high"), total.alias("total"), (total - total_error).alias("total_low"), (total + total_error).alias("total_high"))


class SampleStore:
    """Stored samples by table, filter, rate and seed: whoever asks for the same one reads the same rows, and the table is read once.

    A sample is written beside and then renamed to its place, so that of several writers one wins and the others read what it wrote.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def key(self, table: str, where: str | None, keys: Sequence[str], rate: float, seed: int) -> str:
        return hashlib.sha256(json.dumps([table, where, list(keys), rate, seed]).encode()).hexdigest()[:32]

    def sample(self, table: str, source: DataFrame, keys: Sequence[str], rate: float, seed: int = 42, where: str | None = None) -> DataFrame:
        """The rows of `source`, called `table`, whose keys fall in the sample; a row's place in it depends on its keys alone."""
        from heddle.sources.tables import fs_of

        final = f"{self.path}/{self.key(table, where, keys, rate, seed)}"
        p, fs = fs_of(self.spark, final)
        if not fs.exists(p):
            rows = (source.where(where) if where else source).where(in_sample(F.struct(*keys), rate, seed))
            beside = f"{self.path}/_writing-{uuid.uuid4().hex}"
            rows.write.parquet(beside)
            b, _ = fs_of(self.spark, beside)
            if fs.exists(p) or not fs.rename(b, p):
                fs.delete(b, True)
        return self.spark.read.parquet(final)

    def drop(self, table: str, keys: Sequence[str], rate: float, seed: int = 42, where: str | None = None) -> bool:
        """Forget a sample, so that the next to ask for it draws it from the table as it is then."""
        from heddle.sources.tables import fs_of

        p, fs = fs_of(self.spark, f"{self.path}/{self.key(table, where, keys, rate, seed)}")
        return bool(fs.delete(p, True))
