"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Targets: each source's share of all words by its weight, at most three times its size, the excess shared again by
   weight. That is min(weight * level, 3 * size) for the level at which targets add up; sorted by 3 * size / weight, it
   comes from running sums over the source table.
2. Blocks: a document is cut into blocks of BLOCK_WORDS words (the whole document with block_words=None). A source that
   has whole passes takes every block so often; the rest of its target is drawn without repeats: its blocks in the order
   of a keyed hash (a random permutation), until their words reach the rest. The number of draws is the source's quota.
   The order is global but not sorted in one task: hash ranges are counted and summed first, then each range is ordered
   by itself, so a source with a third of all rows is many ranges.
3. Tree: the vector of quotas is split between the two halves of the output shards by a multivariate hypergeometric draw
   of half of all draws, and each half again, down to single shards. So every shard has its exact quota of each source,
   as if all draws had been shuffled and dealt, and the split of a node depends on its own seed alone.
4. A source's draws, in permuted order, go to the shards in runs of these quotas, so blocks are disjoint; each shard is
   then put in the order of another keyed hash.

Shards are 64, or as many more (by powers of two) as it takes for one to hold about SHARD_WORDS words.

Words are maximal runs of characters other than SPACE. Sources are ordered by code point, null last, and weigh 1, 2, 3,
repeating. Only the source table (one row a source) and the shards' quotas of each source are on the driver; they are
broadcast after a check of their number, else joined by a shuffle.

Defined results: a null text has no words; a document or source without words takes nothing. Documents are told apart by
doc_id, source and a hash of their text, and rows that agree in all three by a number. An empty table gives an empty
result. Very long texts are blocks like any other. Extra columns are ignored. Reruns agree, whatever the partitions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, documents, small, text_of, written

BLOCK_WORDS = 256
SHARDS, SHARD_WORDS = 64, 20_000_000
SEED = 20_240_601
MOST = 3
#: Blocks that a hash range holds on average.
RANGE = 1_000
_WORD = "[^" + SPACE[1:] + "+"


#: What tells documents apart.
_ID = ("doc_id", "source", "text_hash", "copy")


def word_count(column: str = "text") -> Column:
    return F.regexp_count(text_of(column), F.lit(_WORD)).cast("long")


def sizes_of(docs: DataFrame) -> DataFrame:
    """doc_id, source, text_hash, size, copy; copy numbers rows that agree in all the others."""
    rows = docs.select(F.col("doc_id").cast("long"), "source", F.xxhash64(text_of()).alias("text_hash"), word_count().alias("size"))
    same = Window.partitionBy("doc_id", "source", "text_hash").orderBy("size")
    return rows.withColumn("copy", F.row_number().over(same))


def targets(rows: DataFrame) -> DataFrame:
    """source, source_size, weight, target of every source."""
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    # The windows below run over one row a source.
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weighed = sources.withColumn("weight", (F.row_number().over(order) - 1) % 3 + 1)
    cap = (MOST * F.col("source_size")).cast("double")
    by_cap = Window.orderBy(cap / F.col("weight"), F.col("source").isNull(), "source")
    before, everything = by_cap.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum(cap).over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    # A source is capped if the level shared among it and all after it passes its cap; these come first in this order.
    stepped = weighed.withColumn("level", left / open_weight).withColumn("capped", F.col("level") * F.col("weight") > cap)
    final = F.min(F.when(~F.col("capped"), F.struct(cap / F.col("weight"), F.col("source").isNull(), F.col("source"), F.col("level")).alias("x"))).over(everything)
    level = F.coalesce(final["level"], F.lit(float("inf")))
    return stepped.withColumn("target", F.least(level * F.col("weight"), cap)).select("source", "source_size", "weight", "target")


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """The number of good ones among the draws, by inversion: probabilities up to 12 standard deviations from the mode, from the ratios of
    neighbours. Beyond lie less than 1e-30 of all."""
    least, most = max(0, draws - bad), min(good, draws)
    if least == most:
        return least
    total = good + bad
    share = good / total
    reach = 20 + int(12 * (draws * share * (1 - share) * (total - draws) / max(1, total - 1)) ** 0.5)
    mode = min(most, max(least, (draws + 1) * (good + 1) // (total + 2)))
    k = np.arange(max(least, mode - reach), min(most, mode + reach) + 1, dtype=np.float64)
    steps = np.log((good - k[:-1]) * (draws - k[:-1])) - np.log((k[:-1] + 1) * (bad - draws + k[:-1] + 1))
    logs = np.append(0, np.cumsum(steps))
    below = np.cumsum(np.exp(logs - logs.max()))
    return int(k[min(len(k) - 1, int(np.searchsorted(below, rng.random() * below[-1], side="right")))])


def splitting_tree(quotas: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """shards x sources: exact quotas of each shard. Shards hold equal numbers of draws, to within one."""
    out = np.zeros((shards, len(quotas)), np.int64)
    stack = [(0, shards, list(quotas))]
    while stack:
        low, high, here = stack.pop()
        if high - low == 1:
            out[low] = here
            continue
        rng = np.random.default_rng([seed, low, high])
        middle = (low + high) // 2
        total = sum(here)
        draws, left, first = total * (middle - low) // (high - low), total, []
        for q in here:
            left -= q
            first.append(hypergeometric(rng, q, left, draws))
            draws -= first[-1]
        stack += [(low, middle, first), (middle, high, [q - f for q, f in zip(here, first)])]
    return out


def blocks_of(rows: DataFrame, block_words: int | None) -> DataFrame:
    """doc_id, source, text_hash, copy, block, words, key: the blocks with words, key a keyed hash."""
    if block_words:
        count = F.floor((F.col("size") + block_words - 1) / F.lit(block_words)).cast("long")
        cut = rows.filter("size > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
        cut = cut.withColumn("words", F.least(F.lit(block_words).cast("long"), F.col("size") - F.col("block") * block_words))
    else:
        cut = rows.filter("size > 0").withColumn("block", F.lit(0).cast("long")).withColumn("words", F.col("size"))
    return cut.withColumn("key", F.xxhash64(F.lit(SEED), "doc_id", "text_hash", "copy", "block"))


def permuted(blocks: DataFrame, ranges: int) -> DataFrame:
    """The blocks with `place` (0, 1, ...) in their source's order of keys and `before`, the words of the blocks ahead."""
    dealt = blocks.withColumn("range", F.shiftrightunsigned("key", 40).cast("long") * ranges / F.lit(1 << 24)).withColumn("range", F.floor("range"))
    # One row a source and hash range: at most blocks / RANGE + sources of them.
    sums = dealt.groupBy("source", "range").agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("w"))
    ahead = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("n0"), F.coalesce(F.sum("w").over(ahead), F.lit(0)).alias("w0"))
    inner = Window.partitionBy("source", "range").orderBy("key", "doc_id", "text_hash", "copy", "block")
    placed = dealt.withColumn("i", F.row_number().over(inner) - 1).withColumn("w", F.sum("words").over(inner.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words"))
    joined = placed.join(base, placed["source"].eqNullSafe(base["s"]) & (placed["range"] == base["r"]))
    return joined.select(*_ID, "block", "words", "key", (F.col("i") + F.col("n0")).alias("place"), (F.col("w") + F.col("w0")).alias("before"))


def shards_for(words: int) -> int:
    return max(SHARDS, 1 << max(0, -(-words // SHARD_WORDS) - 1).bit_length())


def mix(docs: DataFrame, block_words: int | None = BLOCK_WORDS, shards: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, source, text_hash, size, copy), targets, and draws (doc_id, source, text_hash, copy, block, words, pass, shard, position)."""
    spark = docs.sparkSession
    rows = written(sizes_of(docs), "sizes")
    aims = written(targets(rows), "targets")
    sources, total = aims.agg(F.count(F.lit(1)), F.sum("source_size")).first()
    shards = shards or shards_for(total or 0)
    blocks = blocks_of(rows, block_words)
    ranges = max(1, -(-blocks.count() // RANGE))
    order = permuted(blocks, ranges)
    a = aims.select(F.col("source").alias("aim_source"), "source_size", "target")
    passes = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MOST))).otherwise(0)
    rest = F.col("target") - F.col("passes") * F.col("source_size")
    aimed = order.join(small(a, sources), order["source"].eqNullSafe(a["aim_source"])).withColumn("passes", passes)
    # The last block taken is the one whose middle lies before the rest: the source ends within half a block of its target.
    times = (F.col("passes") + (F.col("before") + F.col("words") / 2 <= rest).cast("long")).cast("int")
    drawn = written(aimed.withColumn("times", times).filter("times > 0").select(*_ID, "block", "words", "key", "place", "times"), "drawn")
    quotas = drawn.groupBy("source").agg(F.sum("times").alias("quota"), F.max("place").alias("last"), F.count(F.lit(1)).alias("n")).orderBy(F.col("source").isNull(), "source").collect()
    cuts = np.cumsum(splitting_tree([int(r["quota"]) for r in quotas], shards), axis=0).T.tolist()
    table = spark.createDataFrame([(r["source"], r["n"], cut) for r, cut in zip(quotas, cuts)], "quota_source string, n long, cuts array<long>")
    # Draw number: all draws of the first pass in permuted order, then those of the second.
    draws = drawn.withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
    counted = draws.groupBy("source", "pass").count()
    ahead = Window.partitionBy("source").orderBy("pass").rowsBetween(Window.unboundedPreceding, -1)
    passes_before = counted.select(F.col("source").alias("s"), F.col("pass").alias("p"), F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("start"))
    placed = draws.join(small(table, sources, 10_000), draws["source"].eqNullSafe(F.col("quota_source")))
    placed = placed.join(small(passes_before, (MOST + 1) * sources), placed["source"].eqNullSafe(F.col("s")) & (F.col("pass") == F.col("p")))
    number = F.col("start") + F.col("place")
    shard = F.size(F.filter("cuts", lambda c: c <= number))
    position = F.xxhash64(F.lit(SEED + 1), "doc_id", "text_hash", "copy", "block", "pass")
    return rows, aims, placed.select(*_ID, "block", "words", "pass", shard.alias("shard"), position.alias("position"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: what the mix takes of every document, and where its first block comes: a shard and a place in its order."""
    rows, aims, draws = mix(documents(spark, sf_dir))
    taken = draws.groupBy(*_ID).agg(F.sum("words").alias("taken"), F.count(F.lit(1)).alias("draws"), F.min(F.struct("shard", "position")).alias("first"))
    t = taken.select(F.col("doc_id").alias("d"), F.col("source").alias("s"), F.col("text_hash").alias("h"), F.col("copy").alias("c"), "taken", "draws", "first")
    same = rows["doc_id"].eqNullSafe(t["d"]) & rows["source"].eqNullSafe(t["s"]) & (rows["text_hash"] == t["h"]) & (rows["copy"] == t["c"])
    a = aims.select(F.col("source").alias("aim_source"), "source_size", "target")
    full = rows.join(t, same, "left").join(small(a, aims.count()), rows["source"].eqNullSafe(a["aim_source"]))
    zero = F.lit(0).cast("long")
    return full.select("doc_id", "size", "source_size", "target", F.coalesce("taken", zero).alias("taken"), F.coalesce("draws", zero).alias("draws"), F.col("first.shard").alias("first_shard"), F.col("first.position").alias("first_position"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of docs, each as often as the mix takes it, shard by shard in shuffled order; blocks are whole documents. Texts move
    twice: to their draws and to their shard."""
    rows, aims, draws = mix(docs, block_words=None)
    shards = shards_for(aims.agg(F.sum("source_size")).first()[0] or 0)
    # Two hashes without nulls as the key, so that numbering repeated rows needs no shuffle beyond the join's.
    key = lambda hashed: [F.xxhash64(F.lit(SEED + 2), F.col("doc_id").cast("long"), "source").alias("__gw_key"), hashed.alias("__gw_hash")]
    drawn = draws.select(*key(F.col("text_hash")), F.struct("copy", "shard", "position").alias("draw")).groupBy("__gw_key", "__gw_hash").agg(F.collect_list("draw").alias("__gw_draws"))
    joined = docs.select(*docs.columns, *key(F.xxhash64(text_of()))).join(drawn.hint("merge"), ["__gw_key", "__gw_hash"])
    numbered = joined.withColumn("__gw_copy", F.row_number().over(Window.partitionBy("__gw_key", "__gw_hash").orderBy("__gw_hash")))
    own = F.filter("__gw_draws", lambda x: x["copy"] == F.col("__gw_copy"))
    out = numbered.select(*docs.columns, F.explode(own).alias("__gw_draw")).select(*docs.columns, F.col("__gw_draw.shard").alias("__gw_shard"), F.col("__gw_draw.position").alias("__gw_position"))
    return out.repartitionById(shards, F.col("__gw_shard")).sortWithinPartitions("__gw_shard", "__gw_position").select(*docs.columns)
