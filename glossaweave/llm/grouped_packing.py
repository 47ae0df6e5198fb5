"""Best-fit packing into few sequences, by linear grouping.

A document's ids are cut into pieces of the capacity and a rest. How many pieces have each length, at most one number a
length, is all that planning needs, so the plan's size and time do not grow with the rows:

1. Lengths over a SMALL-th of the capacity are large. Large pieces, longest first, are dealt into GROUPS groups of equal
   cardinality, and each is rounded up to the longest of its group.
2. The configurations (multisets of rounded lengths that fit a sequence) are optimised as a linear program by column
   generation: the dual prices of a basis, a knapsack over the capacity for the best new configuration, a change of
   basis, until no configuration pays. Whole parts of the solution are used.
3. Actual pieces take the slots: each the longest one left that fits the slot and what the slots before it left over.
4. What the whole parts left over and all small pieces go, longest first, where least room stays; a new sequence is
   opened where nothing fits.

Steps 3 and 4 move runs of pieces of one length into runs of like sequences, so the plan is a table of runs: pieces a to
a + n of a length go k to a sequence, from one sequence and one offset on. A task numbers the pieces of each length
while it writes them; the counts of each task, summed up in order of tasks, make these numbers global; a search in the
runs then gives sequence and offset. Texts move in no shuffle, and pieces only where the table of counts is too large to
be broadcast.

Sequences hold no padding; all but few are nearly full. A repeated task writes the same numbers, as what it wrote is read
back. Other splits of the input give other, equally valid sequences.

Defined results: a null text counts as empty; an empty text is its end id alone. Repeated rows and rows that share a
doc_id, null included, are documents of their own. Very long texts become many pieces, encoded few texts at a time. An
empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, slices, small, text_of, written
from .tokens import SLICE, encoder

CAPACITY = 4096
#: Lengths over capacity / SMALL are grouped, into so many groups.
SMALL, GROUPS = 8, 64
#: Bits of a piece's number among those of its length, in keys of the table of runs.
RANK_BITS = 46


def grouped(counts: dict[int, int], groups: int = GROUPS) -> list[list[tuple[int, int]]]:
    """(length: pieces) -> groups of equal cardinality (the last may be smaller), each (length, pieces) longest first. Where there are no more
    lengths than groups, each length is one: nothing is rounded."""
    if len(counts) <= groups:
        return [[(length, counts[length])] for length in sorted(counts, reverse=True)]
    each = -(-sum(counts.values()) // groups)
    out, room = [], 0
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            if not room:
                out.append([])
                room = each
            take = min(n, room)
            out[-1].append((length, take))
            n, room = n - take, room - take
    return out


def _best_configuration(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes of largest price that fits: an unbounded knapsack, a size's steps taken a block of its length at a time."""
    value, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for i, (size, price) in enumerate(zip(sizes.tolist(), prices.tolist())):
        if price <= 0:
            continue
        for start in range(size, capacity + 1, size):
            end = min(start + size, capacity + 1)
            gain = value[start - size : end - size] + price
            better = gain > value[start:end] + 1e-12
            value[start:end][better] = gain[better]
            last[start:end][better] = i
    chosen, at = np.zeros(len(sizes)), int(np.argmax(value))
    best = value[at]
    while last[at] >= 0:
        chosen[last[at]] += 1
        at -= int(sizes[last[at]])
    return best, chosen


def configurations(sizes: list[int], demand: list[int], capacity: int, near: float = 5e-4, rounds: int = 3000) -> list[tuple[int, list[int]]]:
    """[(sequences, slots of each size)]: whole parts of a basis whose number of sequences is within a share `near` of the linear program's
    least (the best price bounds that). `rounds` bounds the changes of basis; any basis is feasible."""
    size, want, k = np.array(sizes), np.array(demand, float), len(sizes)
    basis, cost = np.diag(capacity // size).astype(float), np.ones(k)
    for done in range(rounds):
        if done % 100 == 0:
            inverse = np.linalg.inv(basis)
        prices = cost @ inverse
        if prices.min() < -1e-9:  # more of a size than is needed may pay
            column, price = np.zeros(k), 0.0
            column[int(np.argmin(prices))] = -1
        else:
            value, column = _best_configuration(size, prices, capacity)
            if value <= 1 + near:
                break
            price = 1.0
        x, step = inverse @ want, inverse @ column
        ratio = np.where(step > 1e-9, np.maximum(x, 0) / np.where(step > 1e-9, step, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        basis[:, out], cost[out] = column, price
        row = inverse[out] / step[out]
        inverse = inverse - np.outer(step, row)
        inverse[out] = row
    x = np.linalg.solve(basis, want)
    return [(int(np.floor(n + 1e-6)), basis[:, j].astype(int).tolist()) for j, n in enumerate(x) if cost[j] and n >= 1 - 1e-6]


class Plan:
    """Places runs of pieces of one length into runs of sequences. rows: (length, first number, pieces, first sequence, pieces a sequence, offset)."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY, small: int = SMALL, groups: int = GROUPS):
        self.capacity, self.sequences, self.rows = capacity, 0, []
        self.left, self.used = dict(counts), dict.fromkeys(counts, 0)
        #: By room: runs (first sequence, sequences).
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
        self.some = np.zeros(capacity + 1, bool)
        self._configured({n: c for n, c in counts.items() if n * small > capacity}, groups)
        for length in sorted(self.left, reverse=True):
            self._best_fit(length)

    def _take(self, length: int, n: int) -> int:
        first = self.used[length]
        self.used[length] += n
        self.left[length] -= n
        return first

    def _open(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def _put(self, room: int, first: int, n: int) -> None:
        if room and n:
            self.runs[room].append((first, n))
            self.some[room] = True

    def _configured(self, large: dict[int, int], groups: int) -> None:
        demand: dict[int, int] = {}
        for group in grouped(large, groups):
            demand[group[0][0]] = demand.get(group[0][0], 0) + sum(n for _, n in group)
        sizes, stock = sorted(demand, reverse=True), np.zeros(self.capacity + 1, bool)
        if not sizes:
            return
        stock[list(large)] = True
        for n, slots in configurations(sizes, [demand[s] for s in sizes], self.capacity):
            order = [s for s, times in zip(sizes, slots) for _ in range(times)]
            like = [(None, n, 0)]  # (first sequence, sequences, filled)
            for slot in range(len(order)):
                after, later = [], sum(order[slot + 1 :])
                for first, m, filled in like:
                    room = self.capacity - filled - later
                    while m:
                        length = room - int(np.argmax(stock[room::-1]))
                        if not stock[length]:  # nothing is left for this slot
                            after.append((first, m, filled))
                            break
                        take = min(m, self.left[length])
                        at = self._open(take) if first is None else first
                        self.rows.append((length, self._take(length, take), take, at, 1, filled))
                        after.append((at, take, filled + length))
                        first, m = None if first is None else first + take, m - take
                        stock[length] = self.left[length] > 0
                like = after
            for first, m, filled in like:
                if first is not None:
                    self._put(self.capacity - filled, first, m)

    def _best_fit(self, length: int) -> None:
        while n := self.left[length]:
            room = length + int(np.argmax(self.some[length:]))
            if self.some[room]:
                first, m = self.runs[room].pop()
                self.some[room] = bool(self.runs[room])
            else:
                room, m = self.capacity, -(-n // (self.capacity // length))
                first = self._open(m)
            each = room // length
            filled = min(n // each, m)
            rest = min(n - filled * each, each - 1) if filled < m else 0
            take = filled * each + rest
            self.rows.append((length, self._take(length, take), take, first, each, self.capacity - room))
            self._put(room - each * length, first, filled)
            if filled < m:
                self._put(room - rest * length, first + filled, 1)
                self._put(room, first + filled + 1, m - filled - 1)


SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]


def pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """One row a piece, with its task (part) and its number among the task's pieces of its length (pos)."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, seen = encoder(vocabulary), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in slices(batches, "text", SLICE):
            rows, held = [], []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), coder.encode(batch.column("text"))):
                ids = np.append(ids, np.array([end_id], ids.dtype))
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    some = ids[start : start + capacity].astype("<u4")
                    rows.append((doc, piece, start, len(some), zlib.crc32(some), part, seen[len(some)]))
                    seen[len(some)] += 1
                    if with_ids:
                        held.append(some.tolist())
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(held, pa.list_(pa.int64()))] * with_ids], [*names, *["ids"] * with_ids])

    schema = SCHEMA + ", part int, pos long" + ", ids array<long>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, schema)


def placed(rows: list[tuple]):
    """A column function of a length and a piece's number among those of its length: its sequence_id and offset. The table of runs goes to
    the tasks; its size depends on the capacity and the groups, not on the rows."""
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 6)
    keys = (table[:, 0] << RANK_BITS) + table[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        length, rank = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        run = table[np.searchsorted(keys, (length << RANK_BITS) + rank, side="right") - 1]
        at = rank - run[:, 1]
        return pd.DataFrame({"sequence_id": run[:, 3] + at // run[:, 4], "offset": run[:, 5] + at % run[:, 4] * length})

    return place


def pack(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int = 1, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row a piece; with_ids adds its ids."""
    cut = written(pieces(docs, vocabulary, end_id, capacity, with_ids), "pieces")
    counts = written(cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    plan = Plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    ranked = cut.join(small(base, counts.count()), ["length", "part"])
    if not plan.rows:
        plan.rows.append((0, 0, 0, 0, 1, 0))
    kept = [c.split()[0] for c in SCHEMA.split(", ")]
    out = ranked.select(*kept, placed(plan.rows)("length", F.col("pos") + F.col("base")).alias("at"), *["ids"] * with_ids)
    return out.select(*kept, "at.sequence_id", "at.offset", *["ids"] * with_ids)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: all documents packed into few sequences of at most 4096 ids."""
    return pack(documents(spark, sf_dir))
