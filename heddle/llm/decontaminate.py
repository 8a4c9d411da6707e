"""Benchmark decontamination by spaced seeds (Ma, Tromp and Li, 2002), with DataFrame functions alone.

A fixed mask reads six of eight neighbouring words and ignores two, so a hit survives substitutions at the ignored places; the masks
ignore two words at each distance from one to five. Test and training hashes are joined; each hit fixes an alignment of the document with
the item, where the words that agree are counted along the whole item and along each run of it. Items shorter than a mask are matched whole.
A hit takes from its document only the words that the item covers, and hits of one alignment are one row, so that no row holds a whole
document and a task's memory does not grow with hits times words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import once

#: Places that each mask reads.
MASKS = ((0, 1, 2, 4, 5, 7), (0, 1, 3, 4, 6, 7), (0, 2, 3, 5, 6, 7), (0, 1, 2, 5, 6, 7), (0, 1, 2, 4, 6, 7), (0, 1, 3, 4, 5, 7), (0, 2, 3, 4, 5, 7))
SPAN = 8
#: A run of so many words of an item, of which at most so many are substituted, is an overlap however long the item.
RUN, RUN_CHANGES = 13, 2
#: Up to so many item hashes, 64 MB, are broadcast; more are joined by a shuffle of hashes.
BROADCAST_ROWS = 1_000_000


def word_hashes(text: Column) -> Column:
    """Hashes of a text's words: lower case, runs of letters and digits. Null as empty."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def seeds(rows: DataFrame, words: str, at: str) -> DataFrame:
    """A row a place and mask: the place and the hash of the words that the mask reads there."""
    placed = rows.where(F.size(words) >= SPAN).withColumn(at, F.explode(F.sequence(F.lit(0), F.size(words) - SPAN)))
    word = lambda o: F.get(F.col(words), F.col(at) + o)
    return placed.withColumn("seed", F.explode(F.array(*[F.xxhash64(F.lit(k), *[word(o) for o in mask]) for k, mask in enumerate(MASKS)])))


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, matched_words, item_words, doc_word) of each document and item that overlap.

    They overlap when at one alignment at least `share` of the item's words agree, or all but RUN_CHANGES of RUN words in a row, and a seed
    finds that alignment: six of some eight neighbouring words agree, at the places that a mask reads. So two of eight may be substituted,
    or every third or fourth word, but every second one is not found. doc_word is where the item would start, below 0 where the document has only a later part of it (the best alignment's;
    of equal ones the first). An item of fewer than eight words overlaps where all its words stand in a row. Null and empty texts overlap
    with nothing, nor do texts of fewer than eight words with longer items. Rows that repeat an id are one document; those without an id come under null. Other columns are ignored.
    """
    every = benchmark.select("item_id", once(word_hashes(F.col("text"))).alias("_iw"))
    items = every.where(F.size("_iw") >= SPAN)
    longest = F.max(F.size("_iw")).over(Window.partitionBy("item_id")).alias("_n")
    index = seeds(items.select("item_id", "_iw", longest), "_iw", "_ip").select("seed", "item_id", "_ip", "_n").distinct()
    small = index.count() <= BROADCAST_ROWS
    hint = F.broadcast if small else (lambda df: df)
    source = docs.select(F.col(id_col).alias("_id"), once(word_hashes(F.col(text_col))).alias("_dw"))
    at = (F.col("_dp") - F.col("_ip")).alias("doc_word")
    if small:
        hits = seeds(source, "_dw", "_dp").join(hint(index), "seed").withColumn("doc_word", at)
    else:  # only hashes and places are shuffled; the words are joined to the hits, row by row: a row is its id and text
        rows = docs.select(F.col(id_col).alias("_id"), F.md5(F.coalesce(text_col, F.lit(""))).alias("_row"), once(word_hashes(F.col(text_col))).alias("_dw"))
        narrow = seeds(rows, "_dw", "_dp").select("_id", "_row", "_dp", "seed").join(index, "seed").select("_id", "_row", "item_id", "_n", at).distinct()
        of = rows.dropDuplicates(["_id", "_row"]).withColumnsRenamed({"_id": "_of", "_row": "_of_row"})
        hits = narrow.join(of, F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_row") == F.col("_of_row")))
    first = F.greatest("doc_word", F.lit(0))
    hits = hits.select("_id", "item_id", "doc_word", F.slice("_dw", first + 1, F.col("doc_word") + F.col("_n") - first).alias("_seen")).distinct().join(hint(items), "item_id")
    flags = F.transform(F.sequence(F.lit(0), F.size("_iw") - 1), lambda k: F.coalesce(F.get("_seen", F.col("doc_word") - first + k) == F.get("_iw", k), F.lit(False)))
    scored = hits.select(F.col("_id").alias(id_col), "item_id", "doc_word", F.size("_iw").alias("item_words"), once(flags).alias("_flags"))
    count = lambda x: F.size(F.filter(x, lambda f: f))
    scored = scored.withColumn("matched_words", count(F.col("_flags")))
    runs = F.when(F.col("item_words") >= RUN, F.sequence(F.lit(1), F.col("item_words") - RUN + 1))
    run = F.exists(runs, lambda k: count(F.slice("_flags", k, F.lit(RUN))) >= RUN - RUN_CHANGES)
    least = F.greatest(F.lit(len(MASKS[0])), F.ceil(F.col("item_words") * share))
    met = scored.where((F.col("matched_words") >= least) | F.coalesce(run, F.lit(False))).drop("_flags")
    short = every.where(F.size("_iw").between(1, SPAN - 1)).withColumn("item_words", F.size("_iw")).withColumn("seed", F.xxhash64("_iw"))
    if lengths := {r["item_words"]: r["count"] for r in short.groupBy("item_words").count().collect()}:
        placed = source.withColumn("doc_word", F.explode(F.sequence(F.lit(0), F.size("_dw")))).withColumn("n", F.explode(F.array(*map(F.lit, sorted(lengths)))))
        placed = placed.where(F.col("doc_word") + F.col("n") <= F.size("_dw")).select("_id", "doc_word", F.slice("_dw", F.col("doc_word") + 1, F.col("n")).alias("_seen"))
        near = F.broadcast(short) if sum(lengths.values()) <= BROADCAST_ROWS else short
        whole = placed.withColumn("seed", F.xxhash64("_seen")).join(near, "seed").where(F.col("_seen") == F.col("_iw"))
        met = met.unionByName(whole.select(F.col("_id").alias(id_col), "item_id", "doc_word", "item_words", F.col("item_words").alias("matched_words")))
    best = met.groupBy(id_col, "item_id").agg(F.max_by(F.struct("matched_words", "doc_word"), F.struct("matched_words", -F.col("doc_word"))).alias("b"), F.max("item_words").alias("item_words"))
    return best.select(id_col, "item_id", F.col("b.matched_words").alias("matched_words"), "item_words", F.col("b.doc_word").alias("doc_word"))
