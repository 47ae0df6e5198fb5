"""Document fingerprints: a homomorphic multiset hash over paragraphs.

Every paragraph (line) hashes to a wide vector of LANES lanes, and a document's fingerprint is their sum, each lane
modulo 2**16. So the order of paragraphs does not matter, and one is inserted or deleted by adding or subtracting its
vector alone. A paragraph's vector is itself a sum of vectors of +1 and -1, one bit of BLAKE2b a lane: one for the whole
paragraph and one for each of its clauses, so that a paragraph that is cut keeps the part of its clauses. The sums of
independent vectors are nearly orthogonal, so the cosine of two fingerprints estimates the share of pieces they have in
common, with a standard error of about LANES ** -0.5.

Defined results: a null text counts as empty; an empty text is one empty paragraph. Equal texts, and texts whose
paragraphs are the same multiset, have equal fingerprints. A lane that passes 2**15 (a piece repeated so often) wraps:
equality stays exact, likeness gets coarse. Rows without a doc_id come last in descending order; equal doc_ids are put
in order by a hash of the text. A table of one row is its own next document, an empty table gives an empty result. Very long
texts come few at a time and are hashed whole. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, documents, id_bounds, partitions, range_number, slices, text_of

LANES = 512
_CLAUSE = re.compile(r"[^.!?,;:|]+[.!?,;:|]*\s*")


def pieces(paragraph: str) -> list[bytes]:
    """What is hashed of a paragraph: itself, marked as a whole, and its clauses."""
    return [b"\x00" + paragraph.encode("utf-8", "surrogatepass"), *(c.strip().encode("utf-8", "surrogatepass") for c in _CLAUSE.findall(paragraph))]


def vector(paragraphs: Iterable[str]) -> np.ndarray:
    """The sum of the paragraphs' vectors, uint16 lanes."""
    digests, total, n = [], np.zeros(LANES, np.int64), 0
    for p in paragraphs:
        digests += [hashlib.blake2b(x, digest_size=LANES // 8).digest() for x in pieces(p)]
        if len(digests) > 4096:
            total, n, digests = total + _ones(digests), n + len(digests), []
    return ((2 * (total + _ones(digests)) - (n + len(digests))) & 0xFFFF).astype("<u2")


def _ones(digests: list[bytes]) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(b"".join(digests), np.uint8)).reshape(-1, LANES)
    return bits.sum(axis=0, dtype=np.int64)


def of_text(text: str | None) -> np.ndarray:
    return vector((text or "").split("\n"))


def insert(fingerprint: np.ndarray, paragraphs: Iterable[str]) -> np.ndarray:
    return fingerprint + vector(paragraphs)


def delete(fingerprint: np.ndarray, paragraphs: Iterable[str]) -> np.ndarray:
    return fingerprint - vector(paragraphs)


def encode(fingerprint: np.ndarray) -> str:
    return base64.b64encode(fingerprint.astype("<u2").tobytes()).decode()


def decode(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u2")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """1 for equal fingerprints; else the cosine of the lanes as signed numbers, 0 at least."""
    if np.array_equal(a, b):
        return 1.0
    x, y = a.astype("<u2").view("<i2").astype(float), b.astype("<u2").view("<i2").astype(float)
    norm = float(np.sqrt((x @ x) * (y @ y)))
    return max(0.0, min(1.0, float(x @ y) / norm)) if norm else 0.0


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (base64) of every row."""

    def run(batches):
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([encode(of_text(t)) for t in batch.column("text").to_pylist()], pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def with_next(docs: DataFrame) -> DataFrame:
    """The rows dealt into id ranges and sorted for a sequential read: part, doc_id, text, place.

    place is 0 for a range's own rows, 1 for the first row of the next lower range, 2 for the first row of all after the
    last of the lowest range. Only the rows at the ends of ranges are sent twice.
    """
    rows = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    bounds = id_bounds(rows, partitions(docs.sparkSession))
    top = len(bounds) - 1
    key = F.coalesce(F.col("doc_id"), F.lit(NO_ID))
    own = F.struct(F.col("part"), F.lit(0).alias("place"))
    above = F.when((F.col("part") < top) & F.col("at_end"), F.struct((F.col("part") + 1).alias("part"), F.lit(1).alias("place")))
    around = F.when((F.col("part") == top) & F.col("at_end"), F.struct(F.lit(0).alias("part"), F.lit(2).alias("place")))
    numbered = rows.withColumn("part", range_number(bounds)(key, F.lit(0).cast("long"))).withColumn("at_end", key.isin(bounds) if len(bounds) <= 100 else F.array_contains(F.lit(bounds), key))
    dealt = numbered.withColumn("to", F.explode(F.filter(F.array(own, above, around), lambda x: x.isNotNull())))
    dealt = dealt.select("to.part", "to.place", key.alias("key"), "doc_id", "text")
    return dealt.repartition(partitions(docs.sparkSession), "part").sortWithinPartitions("part", "place", F.desc("key"), F.xxhash64("text"))


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    held, closed = None, None

    def rows():
        nonlocal held, closed
        for batch in slices(batches, "text"):
            for part, place, doc, text in zip(*(batch.column(c).to_pylist() for c in ("part", "place", "doc_id", "text"))):
                if part == closed:
                    continue
                now = of_text(text)
                if held and held[0] == part:
                    yield finish(held, text, now)
                if place:
                    held, closed = None, part
                else:
                    held = (part, doc, text, now)

    def finish(row, following, theirs):
        _, doc, text, own = row
        n = len(text)
        edited = text[: n - n // 3] + following[: n // 3]
        changed = of_text(edited)
        sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        return doc, n, sha, encode(own), encode(changed), likeness(own, changed), likeness(own, theirs)

    out = []
    for row in rows():
        out.append(row)
        if len(out) == 1000:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), _TYPES)], names)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), _TYPES)], names)


_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: fingerprints of every document and of its edited text."""
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(documents(spark, sf_dir)).mapInArrow(_edited, schema)
