"""Token ids in directly addressable codes (Brisaboa, Ladra and Navarro, 2013).

A segment holds the ids of a run of whole documents. Each id is split into 8-bit chunks, lowest first. Level 0 has a chunk of every
id; level k + 1 has one of each id that goes on beyond level k. A bitmap a level marks which ids go on, and a directory has the ones
before each 512 bits, so that rank, and with it any single token, is found without decoding its neighbours.

Layout of a segment, little-endian: magic DAC1, u32 levels, u64 ids, u64 documents; documents' ids i64[], their ends in the segment
u64[]; for each level u64 chunks, u8 chunks[], bitmap u8[(chunks + 7) // 8, to 64 bytes], directory u32[chunks // 512 + 1]; the last
level has no bitmap or directory.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, ship
from .encoder import encoder

_BLOCK = 512
_BITS = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint16)
_NULL_ID = -(2**63)
_TABLE = "part int, segment int, n_docs bigint, n_ids bigint, before bigint, codes binary"


def pack_segment(doc_ids, ends, ids: np.ndarray) -> bytes:
    """One segment of documents whose ids end at `ends`."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 255
        chunk, n = (rest & 255).astype(np.uint8), len(rest)
        if not more.any():
            levels.append(struct.pack("<Q", n) + chunk.tobytes())
            break
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % 64, np.uint8)])
        before = np.concatenate([[0], np.cumsum(_BITS[bits].reshape(-1, 64).sum(1, dtype=np.uint32))])[: n // _BLOCK + 1].astype("<u4")
        levels.append(struct.pack("<Q", n) + chunk.tobytes() + bits.tobytes() + before.tobytes())
        rest = rest[more] >> 8
    return b"".join([b"DAC1", struct.pack("<IQQ", len(levels), len(ids), len(ends)), np.asarray(doc_ids, "<i8").tobytes(), np.asarray(ends, "<u8").tobytes(), *levels])


class Segment:
    """Reads a segment in place."""

    def __init__(self, raw: bytes):
        if raw[:4] != b"DAC1":
            raise ValueError("not a segment")
        n_levels, self.n_ids, n_docs = struct.unpack_from("<IQQ", raw, 4)
        at = 24
        take = lambda kind, n: np.frombuffer(raw, kind, n, at)
        self.doc_ids = take("<i8", n_docs)
        at += 8 * n_docs
        self.ends = take("<u8", n_docs).astype(np.int64)
        at += 8 * n_docs
        self.levels = []
        for k in range(n_levels):
            (n,) = struct.unpack_from("<Q", raw, at)
            at += 8
            chunks, bits, before = take(np.uint8, n), None, None
            at += n
            if k < n_levels - 1:
                size = -(-((n + 7) // 8) // 64) * 64
                bits = take(np.uint8, size)
                at += size
                before = take("<u4", n // _BLOCK + 1)
                at += 4 * (n // _BLOCK + 1)
            self.levels.append((chunks, bits, before))

    def _rank(self, k: int, i: int) -> int:
        """Ids of level k before place i that go on."""
        _, bits, before = self.levels[k]
        block = min(i // _BLOCK, len(before) - 1)
        a, full = block * (_BLOCK // 8), i // 8
        n = int(before[block]) + int(_BITS[bits[a:full]].sum())
        return n + (int(_BITS[bits[full] & ((1 << (i % 8)) - 1)]) if i % 8 else 0)

    def token(self, i: int) -> int:
        """The id at place i alone."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value = 0
        for k, (chunks, bits, _) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * k)
            if bits is None or not bits[i // 8] >> (i % 8) & 1:
                break
            i = self._rank(k, i)
        return value

    def span(self, a: int, b: int) -> np.ndarray:
        """The ids at places a to b, by rank from level to level; nothing before a is read."""
        out, where = np.zeros(b - a, dtype=np.uint32), np.arange(b - a)
        for k, (chunks, bits, _) in enumerate(self.levels):
            out[where] |= chunks[a:b].astype(np.uint32) << np.uint32(8 * k)
            if bits is None or a == b:
                break
            more = np.unpackbits(bits[a // 8 : (b + 7) // 8], bitorder="little")[a % 8 : a % 8 + b - a].astype(bool)
            where, first = where[more], self._rank(k, a)
            a, b = first, first + len(where)
        return out

    def document(self, k: int) -> np.ndarray:
        return self.span(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


def write_tokens(docs: DataFrame, tokenizer_path: str, path: str | None = None, end_id: int = 0, segment_ids: int = 1 << 18, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode documents in ascending id order into segments; returns the table's path.

    The table has a row a segment: part, segment (order: part, then segment), n_docs, n_ids, the ids of the part before it, and the bytes. Null texts are
    empty and have the end id alone; null ids come first; repeated ids are ordered by their text. A document is never split, so a very
    long one makes a longer segment. Spark's committer writes the table, so a task that runs again leaves no second copy.
    """
    spark = docs.sparkSession
    ship(spark)
    path = path or scratch(spark, "tokens")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange(F.col("id").asc_nulls_first(), tie).sortWithinPartitions(F.col("id").asc_nulls_first(), tie, "text")
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches):
        enc, part, k = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        ids, held, n, before = [], [], 0, 0

        def flush():
            ends = np.cumsum([len(x) // 4 for x in held], dtype=np.int64)
            raw = pack_segment(ids, ends, np.frombuffer(b"".join(held), "<u4"))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([k], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([n], pa.int64()), pa.array([before], pa.int64()), pa.array([raw], pa.binary())], names=["part", "segment", "n_docs", "n_ids", "before", "codes"])

        for b in batches:
            keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i in range(0, len(texts), 128):
                for key, x in zip(keys[i : i + 128], enc.encode(texts[i : i + 128])):
                    ids.append(_NULL_ID if key is None else key)
                    held.append(x + end)
                    n += len(x) // 4 + 1
                    if n >= segment_ids:
                        yield flush()
                        ids, held, n, k, before = [], [], 0, k + 1, before + n
        if held:
            yield flush()

    ordered.mapInArrow(encode, _TABLE).write.option("compression", "uncompressed").parquet(path)
    return path


def read_tokens(spark, path: str) -> DataFrame:
    """The segments with start, the ids in all segments before.

    The sums run over, and the broadcast holds, one row a part: as many as the write had partitions, 20 bytes each.
    """
    segments = spark.read.schema(_TABLE).parquet(path)
    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    base = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    return segments.join(F.broadcast(base), "part").withColumn("start", F.col("base") + F.col("before"))


def token_at(spark, path: str, place: int) -> int:
    """The id at a place of the whole corpus: the segment that holds it is found by its start, and no other id of it is decoded."""
    row = read_tokens(spark, path).where((F.col("start") <= place) & (place < F.col("start") + F.col("n_ids"))).select("codes", "start").first()
    if row is None:
        raise IndexError(place)
    return Segment(bytes(row.codes)).token(place - row.start)


def document_digests(spark, path: str) -> DataFrame:
    """Per document as read back from the segments: doc_id, start, n_tokens, ids_crc32."""
    import zlib

    ship(spark)

    def decode(batches):
        for b in batches:
            for raw, start in zip(b.column("codes"), b.column("start").to_pylist()):
                s = Segment(raw.as_buffer().to_pybytes())
                firsts = np.concatenate([[0], s.ends[:-1]]) if len(s.ends) else s.ends
                every = memoryview(s.span(0, s.n_ids).astype("<u4").tobytes())
                crc = [zlib.crc32(every[4 * a : 4 * z]) for a, z in zip(firsts.tolist(), s.ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids, pa.int64(), mask=s.doc_ids == _NULL_ID), pa.array(firsts + start, pa.int64()), pa.array(s.ends - firsts, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return read_tokens(spark, path).select("codes", "start").mapInArrow(decode, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
