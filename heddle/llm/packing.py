"""Best-fit packing of documents into sequences by linear grouping (Fernandez de la Vega and Lueker, 1981).

Only the histogram of piece lengths, at most `capacity` rows however many documents there are, reaches the driver:
1. lengths over a fraction of the capacity are grouped, longest first, into groups of equal cardinality and rounded up in each;
2. the few rounded sizes are packed by column generation over configurations (Gilmore and Gomory, 1961), rounded down to whole bins;
3. actual lengths take the place of the rounded ones, whole runs of equal bins at a time;
4. what is left, and the small lengths, go into the tightest bins that hold them, longest first.
Each piece then gets its rank among the pieces of its length, from counts by partition, and the plan tells its sequence and offset.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, stage
from .encoder import encoder


def group_lengths(hist: dict[int, int], k: int) -> list[tuple[int, list[list[int]]]]:
    """Groups of equal cardinality, longest first: (rounded length, runs of [length, count])."""
    total = sum(hist.values())
    groups, room, size = [], 0, -(-total // max(1, k))
    for length in sorted(hist, reverse=True):
        n = hist[length]
        while n:
            if not room:
                if not groups or groups[-1][0] != length:  # groups that round to one length are one
                    groups.append((length, []))
                room = size
            take = min(n, room)
            groups[-1][1].append([length, take])
            n, room = n - take, room - take
    return groups


def _best_column(duals: np.ndarray, s: np.ndarray, capacity: int, left: np.ndarray) -> np.ndarray:
    """The column of most dual value: a knapsack of one more document a level.

    `left[i, c]` is the place of c - s[i] among the values, after the sentinels. The last level is asked for at the capacity alone and the
    one before it where one size is left out, so that only the levels between, if any, are filled at every length.
    """
    width, levels, k = int(s.max()), capacity // int(s.min()), len(s)
    value, picks = np.concatenate([np.full(width, -np.inf), np.zeros(capacity + 1)]), []
    for level in range(1, levels + 1):
        at = np.array([capacity]) if level == levels else np.unique(capacity - s) if level == levels - 1 else np.arange(capacity + 1)
        more = duals[:, None] + value[left if len(at) > k else left[:, at]]
        pick = more.argmax(0)
        best = more[pick, np.arange(len(at))]
        better = best > value[width + at] + 1e-12
        chosen = np.full(capacity + 1, -1)
        chosen[at] = np.where(better, pick, -1)
        picks.append(chosen)
        value[width + at] = np.where(better, best, value[width + at])
    column, c = np.zeros(k), capacity
    for pick in reversed(picks):
        if pick[c] >= 0:
            column[pick[c]] += 1
            c -= s[pick[c]]
    return column


def best_configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 20_000, gap: float = 2e-4) -> list[tuple[tuple[int, ...], int]]:
    """Whole bins of the configuration programme: (how many of each size, bins), rounded down; the fractional bins are within `gap` of the least."""
    k = len(sizes)
    if not k:
        return []
    s, d = np.array(sizes), np.array(demand, float)
    basis = np.diag((capacity // s).astype(float))
    left = np.arange(capacity + 1)[None, :] - s[:, None] + int(s.max())
    for at in range(rounds):
        if at % 64 == 0:  # between, the inverse is kept by pivots
            inverse = np.linalg.inv(basis)
            x = np.maximum(inverse @ d, 0)
        duals = inverse.sum(0)
        column = _best_column(duals, s, capacity, left)
        if column @ duals <= 1 + gap:
            break
        move = inverse @ column
        ratio = np.where(move > 1e-9, x / np.where(move > 1e-9, move, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out] = column
        step = ratio[out]
        x = np.maximum(x - step * move, 0)
        x[out] = step
        pivot = inverse[out] / move[out]
        inverse -= np.outer(move, pivot)
        inverse[out] = pivot
    x = np.linalg.solve(basis, d)
    return [(tuple(int(v) for v in basis[:, j]), int(x[j] + 1e-9)) for j in range(k) if x[j] + 1e-9 >= 1]


class Plan:
    """Bins of equal content, kept as (bins, [(length, times), ...]); filled from a histogram of lengths."""

    def __init__(self, hist: dict[int, int], capacity: int, small: float = 0.2, groups: int = 150):
        self.capacity, self.open, self.bins = capacity, defaultdict(list), 0
        self.closed: list[tuple[int, list[tuple[int, int]]]] = []
        hist = {int(k): int(v) for k, v in hist.items() if v}
        if any(not 0 < k <= capacity for k in hist):
            raise ValueError("a length is outside 1 to capacity")
        if n := hist.pop(capacity, 0):
            self._keep(n, [(capacity, 1)], 0)
        large = {k: v for k, v in hist.items() if k > small * capacity}
        rest = {k: v for k, v in hist.items() if k <= small * capacity}
        for run in self._configured(group_lengths(large, groups)):
            rest[run[0]] = rest.get(run[0], 0) + run[1]
        for length in sorted(rest, reverse=True):
            self._best_fit(length, rest[length])
        for kinds in self.open.values():
            self.closed += kinds
        self.bins = sum(n for n, _ in self.closed)

    def _keep(self, n: int, content: list[tuple[int, int]], left: int) -> None:
        if n:
            self.open[left].append((n, content)) if left else self.closed.append((n, content))

    def _configured(self, groups: list[tuple[int, list[list[int]]]]) -> list[list[int]]:
        """Bins of the configurations with actual lengths in them; returns the runs that are left."""
        queues = [list(map(list, runs)) for _, runs in groups]
        for config, bins in best_configurations([g[0] for g in groups], [sum(n for _, n in g[1]) for g in groups], self.capacity):
            slots = []
            for g, times in enumerate(config):
                for _ in range(times):
                    need, runs, queue = bins, [], queues[g]
                    while need and queue:
                        take = min(need, queue[0][1])
                        runs.append([queue[0][0], take])
                        need, queue[0][1] = need - take, queue[0][1] - take
                        if not queue[0][1]:
                            queue.pop(0)
                    slots.append(runs + ([[0, need]] if need else []))
            while slots and slots[0]:
                n = min(runs[0][1] for runs in slots)
                content: dict[int, int] = {}
                for runs in slots:
                    if runs[0][0]:
                        content[runs[0][0]] = content.get(runs[0][0], 0) + 1
                    runs[0][1] -= n
                    if not runs[0][1]:
                        runs.pop(0)
                if content:
                    self._keep(n, list(content.items()), self.capacity - sum(k * v for k, v in content.items()))
        return [run for queue in queues for run in queue]

    def _best_fit(self, length: int, count: int) -> None:
        while count:
            left = min((r for r, kinds in self.open.items() if r >= length and kinds), default=0)
            if left:
                n, content = self.open[left].pop()
                each = min(left // length, count)
                used = min(n, count // each)
            else:
                each = min(self.capacity // length, count)
                left, used, content = self.capacity, count // each, []
                n = used
            self._keep(n - used, content, left)
            self._keep(used, [*content, (length, each)], left - each * length)
            count -= used * each

    def runs(self) -> np.ndarray:
        """Rows of length, first rank, sequence, how many a bin, offset; by length and rank."""
        rank: dict[int, int] = defaultdict(int)
        rows, sequence = [], 0
        for n, content in self.closed:
            at = 0
            for length, each in content:
                rows.append((length, rank[length], sequence, each, at))
                rank[length] += n * each
                at += length * each
            sequence += n
        return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Pieces of every document with their partition and their rank among its pieces of that length."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        enc, part, seen = encoder(tokenizer_path), TaskContext.get().partitionId(), defaultdict(int)
        for b in batches:
            ids, texts, rows = b.column(0).to_pylist(), b.column(1).to_pylist(), []
            for i in range(0, len(texts), 128):
                for key, raw in zip(ids[i : i + 128], enc.encode(texts[i : i + 128])):
                    raw += end
                    n = len(raw) // 4
                    a, k = 0, 0
                    first = n % capacity or capacity
                    while a < n:
                        size = capacity if a else first
                        rows.append((key, k, a, size, zlib.crc32(raw[4 * a : 4 * (a + size)]), part, seen[size]))
                        seen[size] += 1
                        a, k = a + size, k + 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "local_rank"])

    rows = docs.select(F.col(id_col).cast("long"), F.coalesce(text_col, F.lit("")))
    return rows.mapInArrow(cut, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, local_rank bigint")


def best_plan(hist: dict[int, int], capacity: int, thresholds: tuple[float, ...] = (0.2, 0.12)) -> Plan:
    """The plan of fewest bins by where large lengths begin. More lengths among the large take longer and help where few small ones are there
    to fill the gaps, so a further threshold is only tried while a plan is over 0.5 % from the bins that the volume asks for."""
    least, best = -(-sum(k * v for k, v in hist.items()) // capacity), None
    for small in thresholds:
        plan = Plan(hist, capacity, small)
        best = plan if best is None or plan.bins < best.bins else best
        if best.bins <= 1.005 * least:
            break
    return best


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of each piece of each document.

    Only documents over the capacity are cut; their first piece takes the remainder. Null texts are empty and have the end id alone;
    null and repeated ids keep a row each; an empty table gives an empty one; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    pieces = stage(cut_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    hist = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most `capacity` rows
    runs = best_plan(hist, capacity).runs()
    before = counts.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    ranked = pieces.join(before, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("local_rank")).alias("rank"))
    keys = runs[:, 0] << 40 | runs[:, 1]

    def place(batches):
        for b in batches:
            length, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            run = runs[np.searchsorted(keys, length << 40 | rank, side="right") - 1]
            j = rank - run[:, 1]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(run[:, 2] + j // run[:, 3]), pa.array(run[:, 4] + j % run[:, 3] * length)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
