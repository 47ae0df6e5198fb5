"""Line dedup by pairwise alignment.

A document is aligned with earlier ones by patience diff, and loses the aligned blocks that count. A block is a run of lines
that stand together in both, blank lines (white space alone) aside; it counts if it has MIN_LINES lines or MIN_BYTES bytes
of text, or if it is the whole later document. The rule knows neither frequencies nor the size of the table.

1. Lines are hashed with 128 bits. Each line begins a unit, and each ends one: the smallest run there that counts. A block
   that counts consists of such units, so documents overlap where they share one, and no pair of documents has to be
   formed to find out.
2. Each unit that several documents hold links every later holder to its first one, with the unit's places in both: one row
   a document and unit, however many documents share it. So groups of copies never unfold into pairs. A text of short lines
   that is no unit is looked up as a whole among single lines and pairs of lines.
3. A later document is aligned with its first holders, those with its rarest lines first; one whose units are all gone by
   then is left out. The lines of the common units are aligned by patience diff: the common head and tail, then the lines
   that are unique on both sides, in their longest increasing order, then the gaps between them in the same way. What was
   moved across other common lines is not aligned, and stays.
4. Aligned lines that stand together in both are a common block, and deleted from the later document if it counts.

A pair that shares units with other first holders alone is not aligned, and lines that are in no common unit do not steer an
alignment: against an alignment of all pairs, whole texts, a test demands that at least 95 % of the lines are judged alike.

Later means a larger doc_id; rows without one are later than all others, and equal doc_ids go by a hash of the text.

Defined results: a null text counts as empty; an empty text is one blank line. Blank lines stay. Repeated rows (equal doc_id
and text) are one document and lose nothing to each other. Kept lines stay in order, joined by line feeds. An empty table
gives an empty result. Very long texts are cut few at a time, and one document's shared units are in one task. Extra columns
are ignored. Joins on a unit or a document are split by adaptive execution where hot.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, partitions, slices, text_of, written

MIN_LINES = 3
MIN_BYTES = 40
LAST = 2**63 - 1
#: A unit that is only looked up by others, one that counts, one that counts because it is the whole document.
INDEX, UNIT, WHOLE = 0, 1, 2


def lines_with_text(text: str) -> tuple[list[bytes], list[int], list[int]]:
    """Digests, sizes (without white space around) and line numbers of the lines that are not blank."""
    from xxhash import xxh3_128_digest

    digests, sizes, numbers = [], [], []
    for i, line in enumerate(text.encode("utf-8", "surrogatepass").split(b"\n")):
        if bare := line.strip():
            digests.append(xxh3_128_digest(line))
            sizes.append(len(bare))
            numbers.append(i)
    return digests, sizes, numbers


def counts(lines: int, size: int) -> bool:
    return lines >= MIN_LINES or size >= MIN_BYTES


def units(digests: list[bytes], sizes: list[int]) -> dict[bytes, tuple[int, int, list[int]]]:
    """{joined digests: (kind, lines, places)} of a document's units. Places count the lines that are not blank."""
    n, out = len(digests), {}

    def add(start: int, end: int, kind: int) -> None:
        key = b"".join(digests[start:end])
        old = out.get(key)
        if old is None:
            out[key] = (kind, end - start, [start])
        else:
            if old[2][-1] != start:
                old[2].append(start)
            if kind > old[0]:
                out[key] = (kind, *old[1:])

    for i in range(n):
        size = 0
        for j in range(i, min(n, i + MIN_LINES)):
            size += sizes[j]
            if counts(j + 1 - i, size):
                add(i, j + 1, UNIT)
                break
            add(i, j + 1, WHOLE if j + 1 - i == n else INDEX)
    for j in range(n):
        size = 0
        for i in range(j, max(-1, j - MIN_LINES), -1):
            size += sizes[i]
            if counts(j + 1 - i, size):
                add(i, j + 1, UNIT)
                break
    return {k: (kind, lines, sorted(set(places))) for k, (kind, lines, places) in out.items()}


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Places of aligned equal items of two lists, ascending."""
    out, stack = [], [(0, len(a), 0, len(b))]
    while stack:
        a0, a1, b0, b1 = stack.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {b[j]: j for j in range(b0, b1)}
        both = [(i, where[a[i]]) for i in range(a0, a1) if in_a[a[i]] == 1 and in_b[a[i]] == 1]
        # Longest run of these that ascends in b: piles of smallest ends, each item remembering the pile before.
        ends, tops, back = [], [], [-1] * len(both)
        for k, (_, j) in enumerate(both):
            pile = bisect_left(ends, j)
            if pile == len(ends):
                ends.append(j)
                tops.append(k)
            else:
                ends[pile], tops[pile] = j, k
            back[k] = tops[pile - 1] if pile else -1
        k = tops[-1] if tops else -1
        right = (a1, b1)
        while k >= 0:
            i, j = both[k]
            out.append((i, j))
            stack.append((i + 1, right[0], j + 1, right[1]))
            right, k = (i, j), back[k]
        if tops:
            stack.append((a0, right[0], b0, right[1]))
    return sorted(out)


def blocks(pairs: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
    """Aligned places, cut where they do not stand together in both documents."""
    block = []
    for i, j in pairs:
        if block and (i, j) != (block[-1][0] + 1, block[-1][1] + 1):
            yield block
            block = []
        block.append((i, j))
    if block:
        yield block


def common_places(shared: list[tuple[int, list[bytes], list[int], list[int], list[int]]], whole: int | None = None) -> set[int]:
    """The places of the later document that go: those in aligned blocks that count. shared: the units that it has in common with one earlier
    document, as (kind, digests and sizes of their lines, places in the later, places in the earlier)."""
    later, earlier, size, gone = {}, {}, {}, set()
    for _, digests, sizes, here, there in shared:
        for k, (d, n) in enumerate(zip(digests, sizes)):
            later.update([(p + k, d) for p in here])
            earlier.update([(p + k, d) for p in there])
            size[d] = n
    x, y = sorted(later), sorted(earlier)
    for block in blocks([(x[i], y[j]) for i, j in patience([later[p] for p in x], [earlier[p] for p in y])]):
        if counts(len(block), sum(size[later[i]] for i, _ in block)) or len(block) == whole:
            gone.update(i for i, _ in block)
    return gone


def _identity() -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("key"), F.xxhash64(text_of()).alias("tie")]


_COLUMNS = "key long, tie long, h1 long, h2 long, kind int, digests binary, sizes array<int>, places array<int>, numbers array<int>"


def units_of(docs: DataFrame) -> DataFrame:
    """One row a document and unit: its hash (h1, h2), kind, its lines' digests and sizes, its places, and the line numbers there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()))
        names, seen = [c.split()[0] for c in _COLUMNS.split(", ")], set()
        for batch in slices(batches, "text"):
            rows = []
            for key, tie, text in zip(*(batch.column(c).to_pylist() for c in ("key", "tie", "text"))):
                if (key, tie) in seen:
                    continue
                seen.add((key, tie))
                digests, sizes, numbers = lines_with_text(text)
                for joined, (kind, lines, places) in units(digests, sizes).items():
                    h = joined if lines == 1 else xxh3_128_digest(joined)
                    at = [numbers[p + k] for p in places for k in range(lines)] if kind else []
                    first = places[0]
                    rows.append((key, tie, int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True), kind, joined if kind else b"", sizes[first : first + lines] if kind else [], places, at))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return docs.select(*_identity(), text_of().alias("text")).mapInArrow(run, _COLUMNS)


def removed_lines(docs: DataFrame) -> DataFrame:
    """key, tie, n_removed, gone (by line number up to the last one: whether it goes) of the documents that lose lines."""
    rows = written(units_of(docs), "units")
    first = F.min(F.struct("key", "tie", "places")).alias("first")
    shared = rows.groupBy("h1", "h2").agg(first, F.count(F.lit(1)).alias("df"), F.max("kind").alias("most")).filter("df > 1 AND most > 0").drop("most")
    shared = written(shared, "shared-units")  # so that the join reads two plain shuffles, which adaptive execution splits
    links = rows.filter("kind > 0").join(shared, ["h1", "h2"]).filter("struct(key, tie) > struct(first.key, first.tie)")
    links = links.select("key", "tie", F.col("first.key").alias("key1"), F.col("first.tie").alias("tie1"), "df", "kind", "digests", "sizes", "places", "numbers", F.col("first.places").alias("places1"))
    dealt = links.repartition(partitions(docs.sparkSession), "key", "tie").sortWithinPartitions("key", "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("key", "tie", "key1", "tie1", "df", "kind", "digests", "sizes", "places", "numbers", "places1")
        now, held, out = None, [], []

        def batch_of():
            rows = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.bool_())))], ["key", "tie", "n_removed", "gone"])
            out.clear()
            return rows

        def close():
            partners, number, rarest = {}, {}, {}
            for key1, tie1, df, kind, digests, sizes, places, numbers, places1 in held:
                lines = [digests[i : i + 16] for i in range(0, len(digests), 16)]
                partners.setdefault((key1, tie1), []).append((kind, lines, sizes, places, places1))
                rarest[key1, tie1] = min(df, rarest.get((key1, tie1), df))
                number.update(zip([p + k for p in places for k in range(len(lines))], numbers))
            gone: set[int] = set()
            for partner in sorted(partners, key=lambda p: (rarest[p], p)):
                shared = partners[partner]
                if all(p + k in gone for _, lines, _, places, _ in shared for p in places for k in range(len(lines))):
                    continue
                gone |= common_places(shared, next((len(lines) for kind, lines, *_ in shared if kind == WHOLE), None))
            mask = [False] * (max(number[p] for p in gone) + 1)
            for p in gone:
                mask[number[p]] = True
            out.append((*now, len(gone), mask))
            held.clear()

        for batch in batches:
            for key, tie, *row in zip(*(batch.column(c).to_pylist() for c in names)):
                if held and now != (key, tie):
                    close()
                now = (key, tie)
                held.append(row)
            if len(out) >= 1000:
                yield batch_of()
        if held:
            close()
        if out:
            yield batch_of()

    return dealt.mapInArrow(run, "key long, tie long, n_removed long, gone array<boolean>")


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, kept (the kept lines)."""
    gone = removed_lines(docs).withColumnsRenamed({"key": "k", "tie": "t"})
    rows = docs.select("doc_id", *_identity(), text_of().alias("text"))
    joined = rows.join(gone, (rows["key"] == gone["k"]) & (rows["tie"] == gone["t"]), "left")
    lines = F.split("text", "\n", -1)
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.coalesce(F.get("gone", i), F.lit(False))), "\n")
    return joined.select("doc_id", F.size(lines).cast("long").alias("n_lines"), F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: lines removed of every document and the digest of those kept."""
    return dedup(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
