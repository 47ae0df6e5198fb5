"""Substring dedup by fixed-block anchors.

A window is WINDOW (50) consecutive words. Every window covers a whole reference block: the aligned, non-overlapping
blocks of BLOCK = 25 words of a document. So a window that occurs in two documents shows as a hit: a rolling 25-word
window of one whose hash is that of a reference block of the other.

1. Texts with the same words are one from here on: the smallest doc_id owns them. (A later copy loses all its windows.)
2. The blocks are the index and all rolling windows are the probes. Texts are dealt into chunks by their digest; a
   chunk sends, to each range of hashes, the sorted set of its windows' hashes, two bits each (a reference block; in
   two texts) and coded by differences, about two and a half bytes a probe. A range sends back to each chunk those of
   its hashes that are a block and occur in two texts at least: the hits. This is a filter on shortened hashes; a
   false hit costs work below, never a result.
3. Hits are extended: all 50-word windows round a hit are hashed with 96 bits and grouped. A window repeats if its
   smallest owner is smaller than its own; the repeating windows of a text, joined where they overlap, are the maximal
   exact repeats that end in an earlier document. Hot passages are combined before the shuffle and joined by adaptive
   execution; no pairs of documents are formed, so a passage shared by n documents costs n rows, not n * n.

Words are maximal runs of characters other than SPACE, unchanged. Windows are judged on the input.

Defined results: a null text has no words. Texts under 50 words lose nothing. Rows without a doc_id count as later than
all others; rows with equal doc_ids are not earlier than each other. An empty table gives an empty result. Extra columns
are ignored. Texts of any length are read whole; memory in a task is bounded by FLUSH windows and one text.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, partitions, slices, text_of, written

WINDOW, BLOCK = 50, 25
#: Windows that a chunk holds on average, and hashes that a range of them holds.
CHUNK, RANGE = 1_500_000, 2_000_000
#: Windows after which a chunk sends what it has.
FLUSH = 1_500_000
#: Bits of a probe beyond those that number all windows.
SPARE_BITS = 12
LAST = 2**63 - 1
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_HEAD = struct.Struct("<IBII")


@cache
def _codec():
    import zstandard

    return zstandard.ZstdCompressor(3), zstandard.ZstdDecompressor()


def word_hashes(text: bytes) -> np.ndarray:
    """One 64-bit hash a word of a text whose words are joined by single spaces."""
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, text.split(b" ")), np.uint64) if text else np.zeros(0, np.uint64)


@cache
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


def rolling(hashes: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """A hash of every run of `length` words, from running sums of word hashes times powers of an odd number, modulo 2**64."""
    n = len(hashes)
    if n < length:
        return np.zeros(0, np.uint64)
    up, down = _powers(_BASES[which], 1 << max(10, n.bit_length()))
    with np.errstate(over="ignore"):
        if which:
            hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        total = np.append(np.uint64(0), np.cumsum(hashes * up[:n]))
        out = (total[length:] - total[:-length]) * down[: n - length + 1]
        out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return out ^ (out >> np.uint64(32))


def encode_set(values: np.ndarray, flags: np.ndarray) -> bytes:
    """Ascending distinct numbers with two flag bits each."""
    gaps = np.diff(values, prepend=np.uint64(0))
    high = gaps >> np.uint64(16)
    width = 1 if int(high[1:].max(initial=0)) < 256 else 6
    rest = high[1:].astype(np.uint8).tobytes() if width == 1 else high[1:].astype("<u8").tobytes()
    press = _codec()[0].compress
    high_bytes, flag_bytes = press(values[:1].astype("<u8").tobytes() + rest), press(np.packbits(np.stack([flags & 1, flags >> 1])).tobytes())
    return _HEAD.pack(len(values), width, len(high_bytes), len(flag_bytes)) + high_bytes + flag_bytes + gaps[1:].astype("<u2").tobytes()


def decode_set(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, width, a, b = _HEAD.unpack_from(raw)
    at, open_ = _HEAD.size, _codec()[1].decompress
    high = open_(raw[at : at + a])
    first = np.frombuffer(high, "<u8", 1)
    rest = np.frombuffer(high, np.uint8 if width == 1 else "<u8", n - 1, 8).astype(np.uint64)
    low = np.frombuffer(raw, "<u2", n - 1, at + a + b).astype(np.uint64)
    flags = np.unpackbits(np.frombuffer(open_(raw[at + a : at + a + b]), np.uint8), count=2 * n).reshape(2, n)
    return np.cumsum(np.append(first, (rest << np.uint64(16)) | low)), flags[0] | flags[1] << 1


def digests(docs: DataFrame) -> DataFrame:
    """key (doc_id, LAST for null), doc_id, digest (SHA-256 of the words joined by single spaces), n_words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = [t.encode("utf-8", "surrogatepass").split() for t in batch.column("text").to_pylist()]
            sha = [hashlib.sha256(b" ".join(w)).digest() for w in words]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sha, pa.binary()), pa.array(list(map(len, words)), pa.int64())], ["doc_id", "digest", "n_words"])

    rows = docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, "doc_id long, digest binary, n_words long")
    return rows.withColumn("key", F.coalesce("doc_id", F.lit(LAST)))


def _texts(docs: DataFrame, chunks: int) -> DataFrame:
    """chunk, digest and packed words of the texts with a window, each distinct text once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, press = set(), _codec()[0].compress
        for batch in slices(batches, "text"):
            out = []
            for t in batch.column("text").to_pylist():
                words = t.encode("utf-8", "surrogatepass").split()
                if len(words) >= WINDOW:
                    own = b" ".join(words)
                    sha = hashlib.sha256(own).digest()
                    if sha not in seen:
                        seen.add(sha)
                        out.append((sha, press(own)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out)], ["digest", "words"])

    rows = docs.select(text_of().alias("text")).mapInArrow(run, "digest binary, words binary")
    return rows.withColumn("chunk", _chunk(chunks))


def _chunk(chunks: int):
    return F.pmod(F.xxhash64("digest"), F.lit(chunks)).cast("int")


def _rows(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns))


def _probes(texts: DataFrame, width: int, ranges: int) -> DataFrame:
    """chunk, range, hashes: the sets that the chunks send."""
    count = partitions(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array([(i << width) // ranges for i in range(1, ranges)], np.uint64)
        held, size, now, last = [], 0, None, None

        def flush():
            every = np.concatenate([h for h in held])
            text = np.repeat(np.arange(len(held)), [len(h) for h in held])
            block = np.concatenate([np.arange(len(h)) % BLOCK == 0 for h in held])
            order = np.argsort(every, kind="stable")
            every, text, block = every[order], text[order], block[order]
            first = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
            end = np.append(first[1:], len(every)) - 1
            flags = np.logical_or.reduceat(block, first).astype(np.uint8) | (text[first] != text[end]).astype(np.uint8) << 1
            every = every[first]
            cuts = [0, *np.searchsorted(every, edges).tolist(), len(every)]
            rows = [(now, i, encode_set(every[a:b], flags[a:b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary()))], ["chunk", "range", "hashes"])

        for chunk, sha, words in _rows(batches, "chunk", "digest", "words"):
            if held and (chunk != now or size >= FLUSH):
                yield flush()
                size = 0
            if sha == last:
                continue
            now, last = chunk, sha
            held.append(rolling(word_hashes(_codec()[1].decompress(words)), BLOCK) >> np.uint64(64 - width))
            size += len(held[-1])
        if held:
            yield flush()

    dealt = texts.select("chunk", "digest", "words").repartition(count, "chunk").sortWithinPartitions("chunk", "digest")
    return dealt.mapInArrow(run, "chunk int, range int, hashes binary")


def _hits(probes: DataFrame) -> DataFrame:
    """chunk, hits: for each chunk its hashes of a range that are a block and in two texts."""
    count = partitions(probes.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None

        def answer():
            sets = [decode_set(raw) for _, raw in held]
            every, flags = np.concatenate([s[0] for s in sets]), np.concatenate([s[1] for s in sets])
            sender = np.repeat(np.arange(len(sets)), [len(s[0]) for s in sets])
            order = np.argsort(every, kind="stable")
            every, flags, sender = every[order], flags[order], sender[order]
            new = np.append(True, every[1:] != every[:-1])
            first, group = np.flatnonzero(new), np.cumsum(new) - 1
            size = np.diff(np.append(first, len(every)))
            flag = np.bitwise_or.reduceat(flags, first)
            hit = ((flag & 1 > 0) & ((flag & 2 > 0) | (size > 1)))[group]
            every, sender = every[hit], sender[hit]
            order = np.argsort(sender, kind="stable")
            every, sender = every[order], sender[order]
            cuts = np.searchsorted(sender, np.arange(len(sets) + 1)).tolist()
            rows = [(held[i][0], every[a:b].astype("<u8").tobytes()) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["chunk", "hits"])

        for number, chunk, raw in _rows(batches, "range", "chunk", "hashes"):
            if held and number != now:
                yield answer()
            now = number
            held.append((chunk, raw))
        if held:
            yield answer()

    dealt = probes.repartition(count, "range").sortWithinPartitions("range", "chunk")
    return dealt.mapInArrow(run, "chunk int, hits binary")


def _candidates(texts: DataFrame, hits: DataFrame, owners: DataFrame, width: int) -> DataFrame:
    """digest, owner, words, starts, h1, h2 of the texts with hits: the 50-word windows that cover a hit."""
    none = F.lit(None)
    mail = hits.select("chunk", F.lit(0).alias("kind"), none.cast("binary").alias("digest"), none.cast("long").alias("owner"), F.col("hits").alias("body"))
    mail = mail.unionByName(owners.select("chunk", F.lit(1).alias("kind"), "digest", "owner", none.cast("binary").alias("body")))
    mail = mail.unionByName(texts.select("chunk", F.lit(1).alias("kind"), "digest", none.cast("long").alias("owner"), F.col("words").alias("body")))
    # A text's owner comes just before it, the hits of its chunk before all.
    dealt = mail.repartition(partitions(texts.sparkSession), "chunk").sortWithinPartitions("chunk", "kind", "digest", F.col("owner").isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known, live, owner, done, out, size = None, [], None, None, None, [], 0

        def batch_of():
            columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32())))]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, ["digest", "owner", "words", "starts", "h1", "h2"])

        for chunk, kind, sha, own, body in _rows(batches, "chunk", "kind", "digest", "owner", "body"):
            if chunk != now:
                now, known, live = chunk, [], None
            if kind == 0:
                known.append(np.frombuffer(body, "<u8"))
                continue
            if live is None:
                live = np.unique(np.concatenate(known)) if known else np.zeros(0, np.uint64)
            if body is None:
                owner = own
                continue
            if sha == done or not len(live):
                continue
            done = sha
            hashes = word_hashes(_codec()[1].decompress(body))
            probe = rolling(hashes, BLOCK) >> np.uint64(64 - width)
            at = np.searchsorted(live, probe)
            hit = np.flatnonzero(live[np.minimum(at, len(live) - 1)] == probe)
            if not len(hit):
                continue
            n = len(hashes) - WINDOW + 1
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, np.minimum(np.maximum(hit - (WINDOW - BLOCK), 0), n), 1)
            np.add.at(edge, np.minimum(hit + 1, n), -1)
            starts = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
            h1 = rolling(hashes, WINDOW)[starts].view(np.int64)
            h2 = (rolling(hashes, WINDOW, 1)[starts] >> np.uint64(32)).astype(np.uint32).view(np.int32)
            out.append((sha, owner, body, starts.astype(np.int32), h1, h2))
            size += len(starts)
            if size > 200_000:
                yield batch_of()
                size = 0
        if out:
            yield batch_of()

    return dealt.mapInArrow(run, "digest binary, owner long, words binary, starts array<int>, h1 array<long>, h2 array<int>")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for sha, raw, starts in zip(*(batch.column(c).to_pylist() for c in ("digest", "words", "starts"))):
            words = _codec()[1].decompress(raw).split(b" ")
            edge = np.zeros(len(words) + 1, np.int64)
            edge[starts] += 1
            np.add.at(edge, np.array(starts) + WINDOW, -1)
            keep = np.cumsum(edge[:-1]) == 0
            kept = b" ".join([words[i] for i in np.flatnonzero(keep)])
            out.append((sha, int((~keep).sum()), kept))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.int64(), pa.binary()))], ["digest", "n_removed", "kept"])


def dedup(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows (key, doc_id, digest, n_words, owner), and the texts that lose something: digest, n_removed, kept (words joined by single spaces)."""
    rows = written(digests(docs), "word-digests")
    owners = rows.groupBy("digest").agg(F.min("key").alias("owner"))
    total = rows.agg(F.sum("n_words")).first()[0] or 0
    chunks, ranges = max(1, -(-total // CHUNK)), max(1, -(-total // RANGE))
    width = min(62, max(20, total.bit_length() + SPARE_BITS))
    texts = _texts(docs, chunks)
    hits = _hits(_probes(texts, width, ranges))
    placed = rows.filter(F.col("n_words") >= WINDOW).groupBy("digest").agg(F.min("key").alias("owner")).withColumn("chunk", _chunk(chunks))
    found = written(_candidates(texts, hits, placed, width), "candidates")
    windows = found.select("digest", "owner", F.explode(F.arrays_zip("starts", "h1", "h2")).alias("w")).select("digest", "owner", "w.starts", "w.h1", "w.h2")
    first = windows.groupBy("h1", "h2").agg(F.min("owner").alias("first"), F.max("owner").alias("last")).filter("first < last").drop("last")
    first = written(first, "first-windows")  # so that the join reads two plain shuffles, which adaptive execution splits
    repeats = windows.join(first, ["h1", "h2"]).filter("first < owner").groupBy("digest").agg(F.collect_list("starts").alias("starts"))
    cut = found.select("digest", "words").join(repeats, "digest").mapInArrow(_cut, "digest binary, n_removed long, kept binary")
    return rows.join(owners, "digest"), cut


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: words removed of every document and the digest of those kept."""
    rows, cut = dedup(documents(spark, sf_dir))
    removed = cut.select("digest", F.col("n_removed").alias("cut_words"), F.sha2("kept", 256).alias("cut_sha"))
    copy = (F.col("key") > F.col("owner")) & (F.col("n_words") >= WINDOW)
    n = F.when(copy, F.col("n_words")).otherwise(F.coalesce("cut_words", F.lit(0).cast("long")))
    sha = F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("cut_sha", F.lower(F.hex("digest"))))
    return rows.join(removed, "digest", "left").select("doc_id", "n_words", n.alias("n_removed"), sha.alias("kept_sha256"))
