"""The queries of this subpackage; digest columns are derived here from the operators' own outputs."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import chat_windows, read_windows
from .collocations import collocations
from .common import scratch, stage, table
from .decontaminate import contaminated
from .hard_negatives import hard_negatives
from .html_extract import extract
from .license_scan import scan_licenses
from .ngram_join import ngram_components
from .packing import pack
from .quality_classifier import quality
from .token_counts import count_tokens
from .token_output import document_digests, write_tokens
from .toxicity import toxicity
from .vector_dedup import vector_components

TOKENIZER = "byte_bpe_50k.json"


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), scratch(spark, "tokens"))
    return document_digests(spark, path)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), scratch(spark, "token-counts"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gathers each conversation for its digests alone; the windows stay within their budget."""
    odd = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id bigint, turn bigint, role string, text string"))
    read = read_windows(stage(chat_windows(turns), "chat"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = read.select("conv_id", F.size("turns").cast("long").alias("n"), "n_chars", F.struct("window", said.alias("said"), F.col("loss_text").alias("loss")).alias("x"))
    conv = rows.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("n_chars").alias("formatted_chars"), F.array_sort(F.collect_list("x")).alias("x"))
    joined = lambda name: F.array_join(F.transform("x", lambda w: w[name]), "")
    conv = conv.select("conv_id", "n_turns", "formatted_chars", joined("said").alias("said"), joined("loss").alias("loss"))
    return conv.select("conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"), size=3, percent=90)


def op10_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_components(table(spark, sf_dir, "embeddings"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of rows whose id is divisible by 7 are moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_OP11 = """
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
split AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pieces),
said AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase FROM split, (VALUES (1), (2), (3), (4), (5)) v(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS c FROM said GROUP BY lang, k, phrase),
words AS (SELECT lang, CAST(sum(c) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
often AS (SELECT lang, k, phrase, c AS a, string_split(phrase, ' ') AS w FROM f WHERE c >= 100),
inside AS (SELECT lang, part, max(a) AS most FROM (SELECT lang, a, unnest([array_to_string(w[1 : k - 1], ' '), array_to_string(w[2 : k], ' ')]) AS part FROM often WHERE k > 2) GROUP BY lang, part),
kept AS (SELECT o.* FROM often o LEFT JOIN inside i ON i.lang = o.lang AND i.part = o.phrase WHERE o.k > 1 AND (i.most IS NULL OR i.most < o.a)),
cuts AS (SELECT lang, phrase, a, w, k, unnest(range(1, k)) AS cut FROM kept),
scored AS (SELECT c.lang, c.phrase, c.a, x.a AS l, y.a AS r, n, c.cut, CAST((1000::HUGEINT * c.a * n) // (x.a::HUGEINT * y.a) AS BIGINT) AS score FROM cuts c JOIN often x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : cut], ' ') JOIN often y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[cut + 1 : c.k], ' ') JOIN words ON words.lang = c.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest) WHERE rank <= 2000
"""
_OP12 = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, v.vec_id AS id, a.label = v.label AS same, CAST(list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * v.e[i])) AS BIGINT) AS score FROM v a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score QUALIFY rank <= 10
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_token_output, op2_license_scan, op3_packing, op4_token_counts, op5_toxicity, op6_chat_format, op7_html_extract, op8_decontaminate, op9_ngram_join, op10_vector_dedup, op11_collocations, op12_hard_negatives, op13_quality_classifier, pipeline)}
ORACLE_SQL: dict[str, str] = {"op11_collocations": _OP11, "op12_hard_negatives": _OP12}
