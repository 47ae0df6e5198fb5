"""SimHash near-dedup: fingerprints of word shingles, linked by a self-join of binary tries.

The self-join walks pairs of trie nodes together from the root: a pair of nodes with the bits that their prefixes
differ in; its children are the four pairs of their subtrees, two of which differ in one bit more. A pair is dropped as
soon as its differing bits pass the budget; pairs of leaves that are left are links. A trie is a sorted array, a node a
range of it, and a whole level of node pairs is expanded at once.

Distribution: of BUDGET + 1 = 4 blocks of 16 bits, two fingerprints within the budget agree in one at least. So each
distinct fingerprint enters four tries, each with another block rotated to its top; the subtree under 16 equal bits is a
unit of work, and a task walks the subtrees that it holds. A subtree of more than HOT fingerprints is split: of its
three other blocks one differs in at most one bit, so a member enters a smaller subtree for each of them under its own
value and under those one bit away. No cap is set and no pair within the budget is missed.

Equal fingerprints are one node from the start (grouped where the texts are read), and a task gives the links of a
spanning forest of what it found, at most one a member, so groups of copies never unfold into pairs. Components are
joined from these by stars (components.py).

Defined results: a null text counts as empty; without words the fingerprint is zero, linked like any other; fewer words
than a shingle are one shingle. The component's id is its smallest doc_id (null if none has one). Repeated rows share
their component. An empty table gives an empty result. Very long texts are read whole, few at a time, their shingles hashed in
runs. Extra columns are ignored (the stage keeps them).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, partitions, slices, small, text_of, written
from .components import components

BUDGET = 3
SHINGLE = 3
SEED = 42
BLOCKS, WIDTH = 4, 16
#: Members of one subtree beyond which it is split, and node pairs that a task expands at once.
HOT = 50_000
FRONT = 1_000_000
#: Fingerprints that a task walks together, whole subtrees at a time.
BUFFER = 500_000
_RUN = 1 << 16


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Unsigned 64 bits: the majority of the bits of its shingles' XXH64."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = max(1, len(words) - shingle + 1) if words else 0
    if not n:
        return 0
    ones = np.zeros(64, np.int64)
    for start in range(0, n, _RUN):
        hashes = [xxh64_intdigest(b" ".join(words[i : i + shingle]), SEED) for i in range(start, min(n, start + _RUN))]
        ones += np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (signed long), text_hash of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            fps = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps), batch.column("text_hash")], ["doc_id", "fp", "text_hash"])

    rows = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"), F.xxhash64(text_of()).alias("text_hash"))
    return rows.mapInArrow(run, "doc_id long, fp long, text_hash long")


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _one_tree(label: np.ndarray, al: np.ndarray, ah: np.ndarray, bl: np.ndarray, bh: np.ndarray) -> np.ndarray:
    """Which pairs of ranges hold members of one tree alone."""
    run = np.cumsum(np.append(0, label[1:] != label[:-1]))
    return (run[al] == run[ah - 1]) & (run[bl] == run[bh - 1]) & (label[al] == label[bl])


def walk(keys: np.ndarray, group: np.ndarray, depth: int, budget: int = BUDGET, trees: Callable[[], np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places in `keys` within the budget, a chunk at a time. keys: uint64 sorted within their group, whose members share the first
    `depth` bits. trees: labels of the places as they are by now; node pairs within one tree are dropped, and nothing else."""
    edge = np.flatnonzero(np.diff(group, prepend=group[0] - 1 if len(group) else 0)) if len(group) else np.zeros(0, np.int64)
    lo, hi = edge, np.append(edge[1:], len(keys))
    many = hi - lo > 1
    lo, hi = lo[many], hi[many]
    zero = np.zeros(len(lo), np.int8)
    stack = [(depth, lo, hi, lo, hi, zero)]
    ones_at: dict[int, np.ndarray] = {}
    while stack:
        depth, al, ah, bl, bh, diff = stack.pop()
        if len(al) > FRONT:
            half = len(al) // 2
            stack += [(depth, al[half:], ah[half:], bl[half:], bh[half:], diff[half:]), (depth, al[:half], ah[:half], bl[:half], bh[:half], diff[:half])]
            continue
        if trees:
            apart = ~_one_tree(trees(), al, ah, bl, bh)
            al, ah, bl, bh, diff = (v[apart] for v in (al, ah, bl, bh, diff))
        # Node pairs of two leaves are decided by all bits at once.
        leaf = (ah - al == 1) & (bh - bl == 1)
        if leaf.any():
            x, y = al[leaf], bl[leaf]
            near = (x != y) & (_popcount(keys[x] ^ keys[y]) <= budget)
            if near.any():
                yield x[near], y[near]
            al, ah, bl, bh, diff = (v[~leaf] for v in (al, ah, bl, bh, diff))
        if not len(al):
            continue
        if depth == 64:  # members with equal keys: all their pairs, in halves where they are many
            many = (ah - al) * (bh - bl)
            if many.sum() > FRONT:
                half = len(al) // 2
                if half:
                    stack += [(64, *(v[half:] for v in (al, ah, bl, bh, diff))), (64, *(v[:half] for v in (al, ah, bl, bh, diff)))]
                    continue
                am, bm = (al + ah) // 2, (bl + bh) // 2
                quarters = [(al, am, bl, bm), (am, ah, bm, bh), (al, am, bm, bh)] + ([] if al[0] == bl[0] and ah[0] == bh[0] else [(am, ah, bl, bm)])
                stack += [(64, *q, diff) for q in quarters if q[1] > q[0] and q[3] > q[2]]
                continue
            at = np.repeat(np.arange(len(al)), many)
            k = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
            x, y = al[at] + k // (bh - bl)[at], bl[at] + k % (bh - bl)[at]
            pairs = (x < y) | ((al != bl) | (ah != bh))[at]
            if pairs.any():
                yield x[pairs], y[pairs]
            continue
        if depth not in ones_at:
            bit = (keys >> np.uint64(63 - depth)) & np.uint64(1)
            ones_at[depth] = np.append(0, np.cumsum(bit.astype(np.int64)))
        ones = ones_at[depth]
        am, bm = ah - (ones[ah] - ones[al]), bh - (ones[bh] - ones[bl])
        same = (al == bl) & (ah == bh)  # a node with itself: its mixed pair counts once
        cross = diff < budget
        parts = [
            (al, am, bl, bm, diff, np.ones(len(al), bool)),
            (am, ah, bm, bh, diff, np.ones(len(al), bool)),
            (al, am, bm, bh, diff + 1, cross),
            (am, ah, bl, bm, diff + 1, cross & ~same),
        ]
        nxt = []
        for a0, a1, b0, b1, d, ok in parts:
            ok = ok & (a1 > a0) & (b1 > b0) & ~((a0 == b0) & (a1 == b1) & (a1 - a0 == 1))
            nxt.append((a0[ok], a1[ok], b0[ok], b1[ok], d[ok].astype(np.int8)))
        stack.append((depth + 1, *(np.concatenate(v) for v in zip(*nxt))))


class Forest:
    """Labels 0 to n - 1, joined by arrays of pairs."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, x: np.ndarray, y: np.ndarray) -> None:
        while True:
            a, b = self.label[x], self.label[y]
            apart = a != b
            if not apart.any():
                return
            x, y, a, b = x[apart], y[apart], a[apart], b[apart]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.label[self.label]
                if (up == self.label).all():
                    break
                self.label = up


def forest_links(groups: np.ndarray, keys: np.ndarray, depth: int, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """Places of linked members and of their trees' roots."""
    forest = Forest(len(keys))
    for x, y in walk(keys, groups, depth, budget):
        forest.join(x, y)
    member = np.flatnonzero(forest.label != np.arange(len(keys)))
    return member, forest.label[member]


def _rotated(fp: np.ndarray, by: int) -> np.ndarray:
    x = fp.view(np.uint64)
    return x if not by else (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def links(distinct: DataFrame, budget: int = BUDGET, hot: int = HOT) -> DataFrame:
    """Links (a, b) of a spanning forest of all pairs of distinct fingerprints (column fp) within the budget."""
    if budget >= BLOCKS:
        raise ValueError(f"the budget is {BLOCKS - 1} at most")
    spark = distinct.sparkSession

    def block(i):
        return F.shiftrightunsigned("fp", 64 - WIDTH * (i + 1)).bitwiseAND(F.lit(0xFFFF))

    tries = F.explode(F.array(*[F.struct(F.lit(i).alias("trie"), block(i).alias("top")) for i in range(BLOCKS)]))
    rows = distinct.select("fp", tries.alias("t")).select("fp", "t.trie", "t.top")
    sizes = rows.groupBy("trie", "top").count()
    large = [(r["trie"], r["top"]) for r in sizes.filter(F.col("count") > hot).collect()]  # at most 4 N / hot subtrees
    unit = F.struct(F.col("trie"), F.col("top"), F.lit(-1).alias("second"), F.lit(0).alias("value"))
    if large:
        big = spark.createDataFrame(large, "trie int, top long").withColumn("split", F.lit(True))
        rows = rows.join(F.broadcast(big) if len(large) <= 10_000 else big, ["trie", "top"], "left")
        finer = [
            F.struct(F.col("trie"), F.col("top"), F.lit(j).alias("second"), (block(j).bitwiseXOR(F.lit(0 if k < 0 else 1 << k))).cast("int").alias("value"))
            for j in range(BLOCKS)
            for k in range(-1, WIDTH)
        ]
        split = F.filter(F.array(*finer), lambda x: x["second"] != F.col("trie"))
        units = F.explode(F.when(F.col("split"), split).otherwise(F.array(unit))).alias("u")
    else:
        units = unit.alias("u")
    dealt = rows.select("fp", units).select("fp", "u.*").repartition(partitions(spark), "trie", "top", "second", "value").sortWithinPartitions("trie", "top", "second", "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(table: pa.Table):
            fp = table.column("fp").to_numpy()
            code = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("trie", "top", "second", "value")])
            new = np.append(True, (code[:, 1:] != code[:, :-1]).any(axis=0))
            group, trie = np.cumsum(new), code[0]
            keys = np.empty(len(fp), np.uint64)
            for i in range(BLOCKS):
                keys[trie == i] = _rotated(fp[trie == i], WIDTH * i)
            order = np.lexsort((keys, group))
            member, root = forest_links(group[order], keys[order], WIDTH, budget)
            own = fp[order]
            return pa.RecordBatch.from_arrays([pa.array(own[member]), pa.array(own[root])], ["a", "b"])

        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size >= BUFFER:
                table = pa.Table.from_batches(held)
                last = [table.column(c)[-1].as_py() for c in ("trie", "top", "second", "value")]
                code = [table.column(c).to_numpy() == v for c, v in zip(("trie", "top", "second", "value"), last)]
                begin = int(np.argmax(np.logical_and.reduce(code)))  # the last subtree may go on
                if begin:
                    yield linked(table.slice(0, begin))
                    held, size = table.slice(begin).to_batches(), table.num_rows - begin
        if held:
            yield linked(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, "a long, b long")


def near_groups(docs: DataFrame, shingle: int = SHINGLE, budget: int = BUDGET, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, fp, text_hash), and for each fingerprint its component's first row (fp, best: no_id, doc_id, text_hash)."""
    rows = written(fingerprints(docs, shingle), "simhash")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first")
    distinct = written(rows.groupBy("fp").agg(first), "distinct-simhash")
    roots = components(links(distinct.select("fp"), budget, hot))
    placed = written(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "placed-simhash")
    best = placed.groupBy("root").agg(F.min("first").alias("best"))
    return rows, placed.join(best, "root").select("fp", "best")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: fingerprint and component of every document."""
    rows, best = near_groups(documents(spark, sf_dir))
    return rows.join(best, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("best.doc_id").alias("component_id"))


# The pipeline's stage: near copies by word shingles of five words and a similarity of 0.8 or more.
#
# At a Jaccard similarity of 0.8 about 15 % of the bits of two SimHashes differ, far beyond three of 64. So the stage
# takes signatures of WIDE bits and walks many tries. Each trie has its own order of the bits, from a fixed permutation;
# its subtrees under `top` equal first bits are the units of work, walked over the next 64 bits, and a pair of leaves
# is proposed if at most CANDIDATE of all bits differ. Two texts at 0.8 agree in all of `top` bits with 0.849 ** top, so
# the number of tries is set for them to meet in one with over 99 %, and nearly always at 0.9. Both numbers follow the
# number of distinct signatures.
#
# The exact similarity of the texts decides, on the sets of their shingles' 64-bit hashes. The tries' proposals give components;
# each member is compared with its component's root. Where a component falls apart, all its members are dealt as blocks, a
# unit of work for each two blocks, and all of its pairs within CANDIDATE that are not in one tree yet are compared there. So
# every proposed pair is either decided by its texts or within one component already.
WIDE = 512
#: Signatures at a similarity of 0.8 differ in WIDE * acos(2 * 0.8 / 1.8) / pi = 78 bits on average, with a standard error of 8, and up
#: to 96 where there are few shingles (four of five).
MOST_DIFFER = 88
CANDIDATE = 120
AT_LIMIT = 0.849
WALK_BITS = 22
COPY_SHINGLE = 5
#: Members of a subtree beyond which runs of near neighbours are joined before it is walked.
DENSE = 5_000
#: Members of a top beyond which it is dealt in blocks.
HOT_TOP = 200_000
#: Blocks of a component that falls apart: members of one at least and at most, and how many blocks are made before they grow.
BLOCK_LEAST, BLOCK_MOST, BLOCK_COUNT = 500, 20_000, 64


def shingles_of(text: str, shingle: int = COPY_SHINGLE) -> set[bytes]:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = max(1, len(words) - shingle + 1) if words else 0
    return {b" ".join(words[i : i + shingle]) for i in range(n)}


def shingle_hashes(text: str) -> np.ndarray:
    """The ascending 64-bit hashes of a text's different shingles."""
    from xxhash import xxh3_64_intdigest

    return np.unique(np.fromiter(map(xxh3_64_intdigest, shingles_of(text)), np.uint64))


def near(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sets, ascending arrays, is 0.8 or more."""
    return bool(near_to(x, y, np.array([len(y)]))[0])


def near_to(x: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the set x is near each of the sets that stand one behind the other in `flat`."""
    if not len(x):
        return sizes == 0
    hit = x[np.minimum(np.searchsorted(x, flat), len(x) - 1)] == flat
    both = np.diff(np.append(0, np.cumsum(hit))[np.append(0, np.cumsum(sizes))])
    return 5 * both >= 4 * (len(x) + sizes - both)


def signature(text: str, shingle: int = COPY_SHINGLE) -> bytes:
    """WIDE bits: the majorities of the bits of the hashes of the different shingles."""
    from xxhash import xxh3_128_digest

    shingles = list(shingles_of(text, shingle))
    ones = np.zeros(WIDE, np.int64)
    for start in range(0, len(shingles), _RUN):
        raw = b"".join([xxh3_128_digest(s, seed) for s in shingles[start : start + _RUN] for seed in range(WIDE // 128)])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, WIDE // 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(shingles)).tobytes()


def trie_plan(distinct: int) -> tuple[int, int]:
    """Bits of the top and number of tries for so many signatures."""
    top = max(10, distinct.bit_length() - 9)
    return top, int(np.ceil(5 / AT_LIMIT**top))


def _order(trie: int) -> np.ndarray:
    return np.random.default_rng([SEED, trie]).permutation(WIDE)


def _distance(words: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words[x] ^ words[y]).sum(axis=1)


class SpanningPairs(Forest):
    """A forest that keeps the pairs that joined its trees."""

    def __init__(self, n: int):
        super().__init__(n)
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def join(self, x: np.ndarray, y: np.ndarray) -> None:
        while True:
            a, b = self.label[x], self.label[y]
            apart = a != b
            if not apart.any():
                return
            x, y, a, b = x[apart], y[apart], a[apart], b[apart]
            high, low = np.maximum(a, b), np.minimum(a, b)
            order = np.lexsort((low, high))
            first = order[np.append(True, high[order][1:] != high[order][:-1])]
            self.pairs.append((x[first], y[first]))
            self.label[high[first]] = low[first]
            while (up := self.label[self.label])[...].tobytes() != self.label.tobytes():
                self.label = up


def near_pairs(group: np.ndarray, bits: np.ndarray, most: int = MOST_DIFFER, dense: int = DENSE) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places that span the near members of each group. bits: members x WIDE/8 bytes, in the trie's order behind its top."""
    words = np.ascontiguousarray(bits).view("<u8")
    keys = bits[:, :8].copy().view(">u8").ravel().astype(np.uint64)
    order = np.lexsort((keys, group))
    forest = SpanningPairs(len(keys))
    crowded = np.bincount(group)[group] > dense
    if crowded.any():
        # Neighbours in several orders of the bits join first, so that the walk can drop what is in one tree.
        for turn in range(0, 64, 8):
            turned = np.flatnonzero(crowded)
            turned = turned[np.lexsort((_rotated(keys[turned].view(np.int64), turn), group[turned]))]
            for step in (1, 2, 3, 4):
                x, y = turned[:-step], turned[step:]
                near = (group[x] == group[y]) & (_distance(words, x, y) <= most)
                forest.join(x[near], y[near])
    for x, y in walk(keys[order], group[order], 0, WALK_BITS, lambda: forest.label[order]):
        x, y = order[x], order[y]
        near = _distance(words, x, y) <= most
        forest.join(x[near], y[near])
    if not forest.pairs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(p) for p in zip(*forest.pairs))


def _signatures(column: pa.Array) -> np.ndarray:
    """A column of signatures as rows of bytes."""
    if not len(column):
        return np.zeros((0, WIDE // 8), np.uint8)
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset :][: len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].reshape(-1, WIDE // 8)


def _turned(own: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The signatures' bits in another order, unpacked a chunk at a time."""
    out = np.empty_like(own)
    for i in range(0, len(own), 20_000):
        out[i : i + 20_000] = np.packbits(np.unpackbits(own[i : i + 20_000], axis=1)[:, order], axis=1)
    return out


def near_copy_links(signatures: DataFrame, plan: tuple[int, int], hot: int = HOT_TOP) -> DataFrame:
    """Links (a, b) of a spanning forest of each task's nodes of near signatures. signatures: node long, sig binary, distinct.

    A top with more than `hot` members is dealt as blocks of them: a unit of work for each two blocks, so that each pair of
    members meets in one at least and none holds more than twice as many."""
    top, tries = plan
    spark = signatures.sparkSession
    carried = ["node", "sig"]

    def deal(names):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                bits = np.unpackbits(_signatures(batch.column("sig")), axis=1)
                for trie in range(tries):
                    first = bits[:, _order(trie)[:top]].astype(np.int64) @ (1 << np.arange(top, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), trie, np.int32)), pa.array(first), *(batch.column(c) for c in names)], ["trie", "top", *names])

        return run

    rows = signatures.select(*carried)
    sizes = rows.mapInArrow(deal([]), "trie int, top long").groupBy("trie", "top").count()
    large = [(r["trie"], r["top"], -(-r["count"] // hot)) for r in sizes.filter(F.col("count") > hot).collect()]  # at most tries x N / hot
    dealt = rows.mapInArrow(deal(carried), "trie int, top long, node long, sig binary")
    if large:
        big = spark.createDataFrame(large, "trie int, top long, blocks long")
        dealt = dealt.join(F.broadcast(big) if len(large) <= 10_000 else big, ["trie", "top"], "left")
        own = F.pmod(F.xxhash64("node"), F.col("blocks"))
        units = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda x: F.least(x, own) * F.col("blocks") + F.greatest(x, own))
        unit = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(units))
        dealt = dealt.select("trie", "top", unit.alias("unit"), *carried)
    else:
        dealt = dealt.withColumn("unit", F.lit(0).cast("long"))
    dealt = dealt.repartition(partitions(spark), "trie", "top", "unit").sortWithinPartitions("trie", "top", "unit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(trie, rows):
            first, node, own = (np.concatenate(c) for c in zip(*rows))
            group = np.cumsum(np.append(True, (first[1:] != first[:-1]).any(axis=1))) - 1
            several = np.bincount(group)[group] > 1
            if not several.any():
                return None
            node, own = node[several], own[several]
            group = np.unique(group[several], return_inverse=True)[1]
            x, y = near_pairs(group, _turned(own, np.roll(_order(trie), -top)), CANDIDATE)
            return pa.RecordBatch.from_arrays([pa.array(node[x]), pa.array(node[y])], ["a", "b"]) if len(x) else None

        held, now, size = [], None, 0
        for batch in batches:
            trie = batch.column("trie").to_numpy()
            units = np.stack([batch.column(c).to_numpy() for c in ("top", "unit")], axis=1)
            # Cut where the trie changes; and, with enough in hand, where the unit does.
            new = (trie[1:] != trie[:-1]) | (units[1:] != units[:-1]).any(axis=1)
            cuts = np.flatnonzero(new) + 1 if size + len(trie) >= BUFFER else np.flatnonzero(np.diff(trie)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(trie)]):
                if a == b:
                    continue
                if held and (now != trie[a] or (size >= BUFFER and (held[-1][0][-1] != units[a]).any())):
                    out = linked(now, held)
                    if out is not None:
                        yield out
                    held, size = [], 0
                part = batch.slice(a, b - a)
                held.append((units[a:b], part.column("node").to_numpy(), _signatures(part.column("sig"))))
                now, size = trie[a], size + b - a
        if held and (out := linked(now, held)) is not None:
            yield out

    return dealt.mapInArrow(run, "a long, b long")


def exact_links(links: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the links (a, b) whose texts are near. sets: node, hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column("hashes_a"), batch.column("hashes_b"))
            keep = [near(*(np.frombuffer(h.as_buffer(), "<u8") for h in pair)) for pair in both]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    first = sets.select(F.col("node").alias("a"), F.col("hashes").alias("hashes_a"))
    second = sets.select(F.col("node").alias("b"), F.col("hashes").alias("hashes_b"))
    return links.join(first, "a").join(second, "b").select("a", "b", "hashes_a", "hashes_b").mapInArrow(run, "a long, b long")


def links_of_unit(tree: np.ndarray, side: np.ndarray, sigs: np.ndarray, sets: list[np.ndarray], most: int = CANDIDATE) -> list[tuple[int, int]]:
    """Places of near members that join the trees of two blocks (side 0 and 1; one block alone: all 0) as far as they can be joined."""
    words, label, found = np.ascontiguousarray(sigs).view("<u8"), np.unique(tree, return_inverse=True)[1], []
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == side.max())
    for i in left.tolist():
        others = right if side.max() else right[right > i]
        others = others[label[others] != label[i]]
        if not len(others):
            continue
        distance = np.bitwise_count(words[others] ^ words[i]).sum(axis=1)
        close = distance <= most
        others = others[close][np.argsort(distance[close], kind="stable")]
        while len(others):
            some, others = others[:64], others[64:]
            hit = some[near_to(sets[i], np.concatenate([sets[j] for j in some]), np.array([len(sets[j]) for j in some]))]
            for j in hit.tolist():
                if label[j] != label[i]:
                    found.append((i, j))
                    label[label == label[j]] = label[i]
            if len(hit):
                others = others[label[others] != label[i]]
    return found


def links_of_parts(loose: DataFrame) -> DataFrame:
    """Links (a, b) between near members of each component that fell apart. loose: node, root, tree, sig, hashes."""
    sizes = loose.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    blocks = F.greatest(F.least(F.ceil(F.col("n") / BLOCK_LEAST), F.lit(BLOCK_COUNT)), F.ceil(F.col("n") / BLOCK_MOST))
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    others = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    units = F.transform(others, lambda x: F.struct((F.least(x, own) * F.col("blocks") + F.greatest(x, own)).alias("unit"), (own > x).cast("int").alias("side")))
    dealt = loose.join(sizes.select("root", blocks.alias("blocks")), "root").withColumn("u", F.explode(units)).select("root", "u.unit", "u.side", "node", "tree", "sig", "hashes")
    dealt = dealt.repartition(partitions(loose.sparkSession), "root", "unit").sortWithinPartitions("root", "unit", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None

        def linked():
            node, tree, side, sigs, sets = (list(c) for c in zip(*held))
            pairs = links_of_unit(np.array(tree), np.array(side), np.frombuffer(b"".join(sigs), np.uint8).reshape(len(sigs), -1), [np.frombuffer(x, "<u8") for x in sets])
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([node[i] for i, _ in pairs], pa.int64()), pa.array([node[j] for _, j in pairs], pa.int64())], ["a", "b"])

        for batch in batches:
            for root, unit, *row in zip(*(batch.column(c).to_pylist() for c in ("root", "unit", "node", "tree", "side", "sig", "hashes"))):
                if held and now != (root, unit):
                    yield linked()
                now = (root, unit)
                held.append(row)
        if held:
            yield linked()

    return dealt.mapInArrow(run, "a long, b long")


def near_copy_roots(distinct: DataFrame, texts_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """node, root of every node (of `distinct`: node, sig) that has near copies. texts_of: the texts (node, text) of some nodes."""
    links = near_copy_links(distinct.select("node", "sig"), trie_plan(distinct.count()))
    roots = written(components(links), "proposed-roots")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([shingle_hashes(t).tobytes() for t in batch.column("text").to_pylist()], pa.binary())], ["node", "hashes"])

    sets = written(texts_of(roots.select("node")).mapInArrow(hashed, "node long, hashes binary"), "near-shingles")
    star = roots.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    near_root = written(exact_links(star, sets), "near-links")
    # A component's members that are near its root are one tree, each other member is one of its own.
    parts = near_root.select(F.col("a").alias("n"))
    placed = written(roots.join(parts, F.col("node") == F.col("n"), "left").select("node", "root", F.when(F.col("n").isNull(), F.col("node")).otherwise(F.col("root")).alias("tree")), "near-parts")
    apart = placed.groupBy("root").agg(F.min("tree").alias("x"), F.max("tree").alias("y")).filter("x <> y").select("root")
    loose = placed.join(apart, "root", "left_semi").join(distinct.select("node", "sig"), "node").join(sets, "node")
    last = written(links_of_parts(written(loose.select("node", "root", "tree", "sig", "hashes"), "loose")), "near-links")
    return components(near_root.union(last))


def first_of_near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash of the first row (smallest doc_id) of each group of near copies."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([signature(t) for t in batch.column("text").to_pylist()], pa.binary()), batch.column("text_hash")], ["doc_id", "sig", "text_hash"])

    rows = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"), F.xxhash64(text_of()).alias("text_hash"))
    signed = written(rows.mapInArrow(sign, "doc_id long, sig binary, text_hash long"), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first")
    distinct = written(signed.groupBy("sig").agg(first).withColumn("node", F.xxhash64("sig")), "distinct-signatures")
    # Different signatures of one node number, if there ever are any, take no part, so no text goes for another's sake.
    clash = written(distinct.groupBy("node").count().filter("count > 1").select("node"), "clashing-nodes")
    clashes = clash.count()
    alone = distinct.join(small(clash, clashes), "node", "left_semi").select("first.doc_id", "first.text_hash")
    distinct = distinct.join(small(clash, clashes), "node", "left_anti") if clashes else distinct

    def texts_of(nodes: DataFrame) -> DataFrame:
        wanted = distinct.join(nodes, "node", "left_semi").select("node", F.col("first.doc_id").alias("id"), F.col("first.text_hash").alias("hash"))
        found = rows.join(wanted, rows["doc_id"].eqNullSafe(wanted["id"]) & (rows["text_hash"] == wanted["hash"]))
        return found.select("node", "text").dropDuplicates(["node"])

    roots = near_copy_roots(distinct, texts_of)
    placed = distinct.select(F.col("node").alias("n"), "first").join(roots, F.col("n") == F.col("node"), "left")
    return placed.groupBy(F.coalesce("root", "n").alias("root")).agg(F.min("first").alias("best")).select("best.doc_id", "best.text_hash").union(alone)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row of each group of near copies, with all its columns."""
    keep = written(first_of_near_copies(docs), "first-copies").select(F.col("doc_id").alias("__gw_doc"), F.col("text_hash").alias("__gw_hash"))
    seen = docs.withColumn("__gw_own", F.xxhash64(text_of()))
    joined = seen.join(keep, seen["doc_id"].cast("long").eqNullSafe(keep["__gw_doc"]) & (seen["__gw_own"] == keep["__gw_hash"]))
    first = F.row_number().over(Window.partitionBy("__gw_doc", "__gw_hash").orderBy(F.length(text_of())))
    return joined.withColumn("__gw_row", first).filter("__gw_row = 1").select(*docs.columns)
