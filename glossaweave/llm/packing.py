"""Sum-of-squares online packing of documents into training sequences.

A document's ids are cut into full windows and a remainder. Remainders arrive one by one; n[h] counts the open windows
filled to h. A remainder of s ids goes to the level h (0: a new window) that makes the sum of n[h]**2 smallest: the
change is 1 - 2 n[h] for leaving h and 1 + 2 n[h + s] for reaching h + s, nothing for a full window, so one vector sum
over the level array finds it. Ties go to the fullest level.

Sizes that never fit each other would pile up open windows. While MAX_OPEN are open, a remainder that fits none is cut
instead of opening another: it fills up the window of the level whose loss makes the sum smallest, and its rest arrives
as a remainder of its own. So placing goes by the sum of squares to the end, and memory is bounded by MAX_OPEN windows.
When a task's rows are used up, its open windows are run together into full ones and the last is cut at powers of two:
no sequence needs padding.

Every task packs the rows that it reads, without a shuffle. A repeated task reads the same rows in the same order, so
sequences do not change; other splits of the input give other, equally valid sequences.

Defined results: a null text counts as empty; an empty text is its end id alone. Repeated rows are packed as often as
they occur. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, slices, text_of
from .tokens import SLICE, encoder

LENGTH = 2048
MAX_OPEN = 8192
#: (document, start in it, ids)
Piece = tuple[tuple, int, np.ndarray]


class Packer:
    """Takes documents, gives closed sequences as lists of pieces."""

    def __init__(self, length: int = LENGTH, max_open: int = MAX_OPEN):
        self.length, self.max_open, self.open = length, max_open, 0
        self.windows: list[list[list[Piece]]] = [[] for _ in range(length)]
        #: Change of the sum when a window leaves a level (infinite where there is none) and when one reaches it.
        self.leave, self.reach = np.full(length + 1, np.inf), np.ones(length + 1)
        self.leave[0], self.reach[length] = 0, 0

    def counts(self) -> np.ndarray:
        return np.array([len(w) for w in self.windows])

    def _level(self, h: int) -> None:
        n = len(self.windows[h])
        self.leave[h], self.reach[h] = 1 - 2 * n if n else np.inf, 2 * n + 1

    def level_for(self, size: int) -> int:
        """The level that a remainder of `size` goes to; while no window may be opened, 0 says that it fits none."""
        cost = self.leave[: self.length - size + 1] + self.reach[size:]
        if self.open >= self.max_open:
            cost[0] = np.finfo(float).max  # below the infinity of a level without windows
        return len(cost) - 1 - int(np.argmin(cost[::-1]))

    def add(self, doc: tuple, ids: np.ndarray) -> Iterator[list[Piece]]:
        full = len(ids) - len(ids) % self.length
        for start in range(0, full, self.length):
            yield [(doc, start, ids[start : start + self.length])]
        size = len(ids) - full
        if not size:
            return
        start, ids = full, ids[full:].copy()
        while self.open >= self.max_open and not self.level_for(len(ids)):
            h = self.length - int(np.argmin(self.leave[self.length - 1 : 0 : -1])) - 1
            room = self.length - h
            yield [*self._taken(h), (doc, start, ids[:room])]
            start, ids = start + room, ids[room:]
        h = self.level_for(len(ids))
        window = [*(self._taken(h) if h else []), (doc, start, ids)]
        if h + len(ids) == self.length:
            yield window
        else:
            self._put(window, h + len(ids))

    def _taken(self, h: int) -> list[Piece]:
        window = self.windows[h].pop()
        self._level(h)
        self.open -= 1
        return window

    def _put(self, window: list[Piece], h: int) -> None:
        self.windows[h].append(window)
        self._level(h)
        self.open += 1

    def close(self) -> Iterator[list[Piece]]:
        """What is still open: full windows, then powers of two."""
        pieces = [p for level in self.windows for window in level for p in window]
        self.__init__(self.length, self.max_open)
        left = sum(len(p[2]) for p in pieces)
        room_for = lambda n: self.length if n >= self.length else 1 << max(0, n.bit_length() - 1)
        room, now, size = room_for(left), [], 0
        for doc, start, ids in pieces:
            while len(ids):
                take = min(len(ids), room - size)
                now.append((doc, start, ids[:take]))
                start, ids, size, left = start + take, ids[take:], size + take, left - take
                if size == room:
                    yield now
                    now, size, room = [], 0, room_for(left)


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long"
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def pack(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int = 1, length: int = LENGTH, max_open: int = MAX_OPEN, with_ids: bool = False) -> DataFrame:
    """One row a piece; with_ids adds its ids. sequence_id is the task's number and a count within the task."""
    schema = SCHEMA + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, packer = encoder(vocabulary), Packer(length, max_open)
        sequence, rows = TaskContext.get().partitionId() << 40, []

        def put(closed):
            nonlocal sequence
            for window in closed:
                offset, total = 0, sum(len(p[2]) for p in window)
                for (doc, size), start, ids in window:
                    row = (doc, start, len(ids), zlib.crc32(ids.astype("<u4")), size, sequence, offset, total)
                    rows.append((*row, ids.tolist()) if with_ids else row)
                    offset += len(ids)
                sequence += 1

        def batch_of():
            columns = [pa.array(c, pa.int64()) for c in list(zip(*rows))[: len(_NAMES)]]
            if with_ids:
                columns.append(pa.array([r[-1] for r in rows], pa.list_(pa.int32())))
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, [*_NAMES, *["ids"] * with_ids])

        for batch in slices(batches, "text", SLICE):
            for doc, ids in zip(batch.column("doc_id").to_pylist(), coder.encode(batch.column("text"))):
                ids = np.append(ids, np.array([end_id], ids.dtype))
                put(packer.add((doc, len(ids)), ids))
            if rows:
                yield batch_of()
        put(packer.close())
        if rows:
            yield batch_of()

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: all documents packed into sequences of at most 2048 ids."""
    return pack(documents(spark, sf_dir))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)
