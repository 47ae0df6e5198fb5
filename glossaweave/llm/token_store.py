"""Binary token store: a concatenated id array whose document boundaries are Elias-Fano coded.

The store is a Parquet table of blocks in the shared folder. A block's payload is self-contained:

    magic "GWT2" | id width 2 or 4 | documents n | ids u | first doc_id | ends | doc_ids | ids
    ends, doc_ids: low bits l | lengths of low, high and samples | low | high | samples

Boundaries (the end of each document in the block's id array) ascend, so the lowest l = floor(log2(u / n)) bits of each
are packed side by side and the rest is unary: bit (end >> l) + i of `high` is set for document i. That is at most
2 + log2(u / n) bits a document. `samples` has the place of every 64th one bit in 32 bits, and select(i) counts on from
there: the reader takes every offset from it. No table of 64-bit offsets is kept: a block's place among all ids comes from
the sums of the blocks before it. doc_ids ascend too and are kept in the same way, counted from the block's first.

Defined results: a null text counts as empty; an empty text has the end id alone. Documents are stored by ascending
doc_id, those without one first; repeated rows are stored as often as they occur, rows of equal doc_id by a hash of their
text, which also deals an id that fills more than one range. An empty table makes an empty store. Extra columns are
ignored. A document of any length is one run of ids in one block; a block closes once it has BLOCK_IDS, so only a longer
document makes it larger.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NO_ID, documents, id_bounds, partitions, range_number, shared_dir, slices, text_of
from .tokens import SLICE, encoder

BLOCK_IDS = 1 << 18
SAMPLE = 64
MAGIC = b"GWT2"
HEAD = struct.Struct("<4sBxxxIIq")
SEQUENCE = struct.Struct("<BxxxIII")


def _pack(values: np.ndarray, bits: int) -> bytes:
    if not bits or not len(values):
        return b""
    return np.packbits(((values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little").tobytes()


def _unpack(raw: bytes, bits: int, n: int) -> np.ndarray:
    if not bits or not n:
        return np.zeros(n, np.int64)
    grid = np.unpackbits(np.frombuffer(raw, np.uint8), count=bits * n, bitorder="little").reshape(n, bits)
    return grid.astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))


class EliasFano:
    """An ascending sequence of n numbers up to u."""

    def __init__(self, n: int, bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.bits, self.low, self.high, self.samples = n, bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        u = int(values[-1]) if n else 0
        bits = max(0, (u // n).bit_length() - 1) if n else 0
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        low = _pack(values & np.uint64((1 << bits) - 1), bits)
        return cls(n, bits, low, np.packbits(high, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u4").tobytes())

    def select(self, i: int) -> int:
        """The i-th number, from the sample before it on."""
        at = int(np.frombuffer(self.samples, "<u4")[i // SAMPLE])
        left = i % SAMPLE
        byte = at // 8
        word = self.high[byte] >> (at % 8) << (at % 8)
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = self.high[byte]
        for _ in range(left):
            word &= word - 1
        place = byte * 8 + (word & -word).bit_length() - 1
        begin = i * self.bits
        piece = int.from_bytes(self.low[begin // 8 : (begin + self.bits + 7) // 8], "little") >> (begin % 8)
        return ((place - i) << self.bits) | (piece & ((1 << self.bits) - 1))

    def values(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n]
        return ((ones - np.arange(self.n)) << self.bits) | _unpack(self.low, self.bits, self.n)

    def to_bytes(self) -> bytes:
        return SEQUENCE.pack(self.bits, len(self.low), len(self.high), len(self.samples)) + self.low + self.high + self.samples

    @classmethod
    def at(cls, raw: memoryview, n: int, at: int) -> tuple[EliasFano, int]:
        """A sequence that starts at a place of a block, and the place behind it."""
        bits, *lengths = SEQUENCE.unpack_from(raw, at)
        at += SEQUENCE.size
        parts = []
        for length in lengths:
            parts.append(bytes(raw[at : at + length]))
            at += length
        return cls(n, bits, *parts), at


def pack_block(doc_ids: list[int], ids: list[np.ndarray]) -> bytes:
    flat = np.concatenate(ids)
    ends = EliasFano.of(np.cumsum([len(x) for x in ids]))
    docs = EliasFano.of(np.array(doc_ids, np.int64).view(np.uint64) - np.array(doc_ids[:1], np.int64).view(np.uint64))
    return b"".join([HEAD.pack(MAGIC, flat.dtype.itemsize, len(ids), len(flat), doc_ids[0]), ends.to_bytes(), docs.to_bytes(), flat.tobytes()])


def open_block(raw: bytes | memoryview) -> tuple[int, EliasFano, EliasFano, np.ndarray]:
    """First doc_id, doc_ids counted from it, ends and ids of a block, without a copy of the ids."""
    magic, width, n, u, first = HEAD.unpack_from(raw)
    if magic != MAGIC:
        raise ValueError("not a token block")
    ends, at = EliasFano.at(raw, n, HEAD.size)
    docs, at = EliasFano.at(raw, n, at)
    return first, docs, ends, np.frombuffer(raw, f"<u{width}", u, at)


def write(docs: DataFrame, path: str, vocabulary: str = "byte_bpe_50k.json", end_id: int = 0) -> None:
    """The texts' ids, end_id after each, as blocks (part, base, n_docs, n_ids, payload) by ascending doc_id; base: the ids before the block in its part."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), text_of().alias("text"))
    count = partitions(spark)
    part = range_number(id_bounds(rows, count, repeated=True))
    dealt = rows.withColumn("part", part("doc_id", F.xxhash64("text"))).repartition(count, "part").sortWithinPartitions("part", "doc_id", F.xxhash64("text"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = encoder(vocabulary), np.array([end_id])
        part, base, held, ids, size = None, 0, [], [], 0

        def close():
            nonlocal base, held, ids, size
            row = [[part], [base], [len(held)], [size], [pack_block(held, ids)]]
            base, held, ids, size = base + size, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()))], ["part", "base", "n_docs", "n_ids", "payload"])

        for batch in slices(batches, "text", SLICE):
            coded = coder.encode(batch.column("text"))
            for p, doc, own in zip(batch.column("part").to_pylist(), batch.column("doc_id").to_pylist(), coded):
                if p != part:
                    if held:
                        yield close()
                    part, base = p, 0
                held.append(doc)
                ids.append(np.append(own, end.astype(own.dtype)))
                size += len(own) + 1
                if size >= BLOCK_IDS:
                    yield close()
        if held:
            yield close()

    out = dealt.mapInArrow(blocks, "part int, base long, n_docs int, n_ids long, payload binary")
    out.write.option("parquet.block.size", 16 << 20).option("compression", "zstd").parquet(path)


def with_base(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of a store, `base` counting from the start of the store."""
    blocks = spark.read.parquet(path)
    # One row a range of doc_ids: as many as shuffle partitions when the store was written.
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_base"))
    return blocks.join(F.broadcast(before), "part").withColumn("base", F.col("base") + F.col("part_base"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every stored document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, raw in zip(batch.column("base").to_pylist(), batch.column("payload")):
                first, docs, ends, ids = open_block(memoryview(raw.as_buffer()))
                doc_ids = [first + docs.select(i) for i in range(docs.n)]
                stop = [ends.select(i) for i in range(ends.n)]
                start = [0, *stop[:-1]]
                crc = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(start, stop)]
                columns = [pa.array([None if d == NO_ID else d for d in doc_ids], pa.int64()), pa.array([base + a for a in start], pa.int64()), pa.array([b - a for a, b in zip(start, stop)], pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return with_base(spark, path).select("base", "payload").mapInArrow(rows, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: documents written to a token store and read back."""
    import uuid

    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write(documents(spark, sf_dir), path)
    return read(spark, path)
