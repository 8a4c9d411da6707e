"""Token counts with a digest cache.

Counts are kept in a table of (tokenizer digest, text digest, n_tokens). A call joins the digests of its texts to the stored counts,
encodes each distinct text that is missing once, appends those counts to the table and joins them back.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, ship
from .encoder import encoder

_CACHE = "tokenizer_digest string, text_digest binary, n_tokens bigint"


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _load(spark, cache_path: str, version: str) -> DataFrame:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(cache_path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], _CACHE)
    return spark.read.schema(_CACHE).parquet(cache_path).where(F.col("tokenizer_digest") == version)


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of each row.

    The content is normalised to the UTF-8 bytes of the whole text, null as empty: no other normalisation leaves every count as it is.
    Null and repeated ids keep a row each; an empty table gives an empty one; other columns are ignored. An empty or null text has 0 tokens.
    The texts meet in one shuffle by digest, where copies are dropped before they are sent. A cached table grows by one row a distinct
    text; concurrent writers may append the same digest twice with the same count, which the read resolves.
    """
    spark = docs.sparkSession
    ship(spark)
    cache_path, version = cache_path or scratch(spark, "token-counts"), tokenizer_digest(tokenizer_path)
    text = F.coalesce(F.col(text_col), F.lit(""))
    digested = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("text_digest"))
    known = _load(spark, cache_path, version).groupBy("text_digest").agg(F.max("n_tokens").alias("n_tokens"))
    missing = digested.groupBy("text_digest").agg(F.first("text").alias("text")).join(known, "text_digest", "left_anti")

    def encode(batches):
        enc = encoder(tokenizer_path)
        for b in batches:
            texts = b.column(1).to_pylist()
            counts = []
            for i in range(0, len(texts), 256):
                counts += [len(x) // 4 for x in enc.encode(texts[i : i + 256])]
            yield pa.RecordBatch.from_arrays([pa.array([version] * len(counts), pa.string()), b.column(0).cast(pa.binary()), pa.array(counts, pa.int64())], names=["tokenizer_digest", "text_digest", "n_tokens"])

    missing.mapInArrow(encode, _CACHE).write.mode("append").parquet(cache_path)
    stored = _load(spark, cache_path, version).groupBy("text_digest").agg(F.max("n_tokens").alias("n_tokens"))
    sized = digested.select("id", F.octet_length("text").cast("long").alias("n_bytes"), "text_digest")
    return sized.join(stored, "text_digest").select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
