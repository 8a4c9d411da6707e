"""A training corpus from `documents`: toxic documents go, one document of each near-duplicate group stays, documents with benchmark text go, the rest is packed."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.common import stage, table
from heddle.llm.decontaminate import contaminated
from heddle.llm.ngram_join import ngram_components
from heddle.llm.packing import pack
from heddle.llm.toxicity import fit, score

TOKENIZER = "byte_bpe_50k.json"


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7; those without text stay."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    blank = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"\S")
    return score(docs, model, name="_score").where((F.col("_score") < 0.7) | blank).select(*docs.columns)


def row_keys(docs: DataFrame) -> DataFrame:
    """The rows with `_key`, a digest of id and text: rows share one only where they are the same document."""
    return docs.withColumn("_key", F.xxhash64("doc_id", F.col("doc_id").isNull(), "text", F.col("text").isNull()))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five-word shingles, 0.8) the row of least id, rows without an id last; of rows of the same id and text one.

    Rows with neither an id nor words are copies of nothing and stay.
    """
    keyed = row_keys(docs)
    comps = ngram_components(keyed, size=5, percent=80, id_col="_key").select(F.col("_key").alias("_of"), "component_id").distinct()
    ranked = keyed.select("_key", "doc_id").distinct().join(comps, F.col("_key") == F.col("_of"))
    best = ranked.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_key")).alias("b")).select(F.col("b._key").alias("_key"))
    bare = F.col("doc_id").isNull() & ~F.coalesce(F.col("text"), F.lit("")).rlike(r"\S")
    one = keyed.where(~bare).join(best, "_key", "left_semi").dropDuplicates(["_key"])
    return one.select(*docs.columns).unionByName(docs.where(bare))


def remove_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that overlap with no benchmark item, whatever other rows of their id do."""
    keyed = row_keys(docs)
    hit = contaminated(keyed, table(spark, sf_dir, "benchmark"), id_col="_key").select("_key").distinct()
    return keyed.join(hit, "_key", "left_anti").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("toxicity", remove_toxic), ("near_copies", keep_one_of_near_copies), ("benchmark", remove_benchmark_text), ("packing", pack_sequences)]

#: SQL can express none of the model, the tokenizer and the packing; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, name)
    return docs
