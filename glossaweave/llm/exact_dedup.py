"""Exact dedup against a history kept as minimal perfect hash tables.

The distinct digests of the historical rows are dealt into shards. Each shard gets a minimal perfect hash (levels of bit
arrays: a key takes the first level where it falls on a bit alone; its slot is the rank of that bit). A slot holds the
full 32-byte digest, the winner's locator (its length and doc_id) and the number of rows. The shards are a Parquet table
in the shared folder, so a later delivery is compared with them without the historical texts.

New rows are first grouped by digest where they are read, so that a group of copies of any size arrives as one row a
task. Each distinct new digest looks up its slot and compares all 32 bytes: members are repeats of history and join the
slot's group, nonmembers are grouped among themselves.

Defined results: a null text counts as empty, so all null, empty and blank texts are one group. Of equal texts the row
with the most code points in its original text stays, then the one with the smallest doc_id; a null doc_id loses ties.
Rows that agree in digest, length and doc_id are repeats; exactly one of them is kept. An empty table gives an empty
result. Very long texts are normalised and hashed row by row in the JVM. Extra columns are ignored (the stage keeps them).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, documents, text_of, written

#: Distinct digests a shard holds: 56 bytes each.
SHARD_KEYS = 60_000
#: Bits per key at each level of a table, and levels before the seed is changed for a sorted remainder.
GAMMA, LEVELS = 2.0, 40

TABLE = "shard long, sizes array<int>, bits binary, n long, digests binary, chars binary, ids binary, counts binary"
GROUP = "digest binary, n_chars int, inverse_id long, rows long"


def normalised(column: str = "text") -> Column:
    return F.regexp_replace(text_of(column), SPACE, "")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, digest (SHA-256 of the normalised text), n_chars of the original text."""
    return docs.select("doc_id", F.unhex(F.sha2(normalised().cast("binary"), 256)).alias("digest"), F.length(text_of()).alias("n_chars"))


def grouped(prints: DataFrame) -> DataFrame:
    """One row a digest. inverse_id is the bitwise complement of doc_id: larger means a smaller id, and null is smallest."""
    best = F.max(F.struct("n_chars", F.bitwise_not(F.col("doc_id").cast("long")).alias("inverse_id")))
    return prints.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("rows")).select("digest", "best.n_chars", "best.inverse_id", "rows")


def _words(digests: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(digests).view("<u8").reshape(-1, 4)


def _place(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """Where each digest falls at a level. Digests are uniform already; a multiply-xor step makes the levels independent."""
    with np.errstate(over="ignore"):
        x = words[:, level % 4] ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) + words[:, (level + 1) % 4]
    return (x % np.uint64(size)).astype(np.int64)


def build_table(digests: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Bit-array sizes, all bits, and the slot of each of the distinct digests (n x 32 bytes). Slots are 0 to n - 1, each used once."""
    words, n = _words(digests), len(digests)
    left, sizes, arrays = np.arange(n), [], []
    taken: list[tuple[np.ndarray, np.ndarray]] = []
    while len(left):
        level = len(sizes)
        if level >= LEVELS:
            raise ValueError("the digests are not distinct")
        size = max(64, int(GAMMA * len(left)))
        at = _place(words[left], level, size)
        alone = np.bincount(at, minlength=size) == 1
        fits = alone[at]
        taken.append((left[fits], at[fits] + sum(sizes)))
        sizes.append(size)
        arrays.append(alone)
        left = left[~fits]
    bits = np.concatenate(arrays) if arrays else np.zeros(0, bool)
    rank = np.cumsum(bits) - 1
    slot = np.empty(n, np.int64)
    for keys, at in taken:
        slot[keys] = rank[at]
    return sizes, bits, slot


def look_up(digests: np.ndarray, sizes: list[int], bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """The slot of each digest, -1 for a nonmember: the slot's 32 bytes decide."""
    words, found = _words(digests), np.full(len(digests), -1, np.int64)
    rank, left, base = np.cumsum(bits) - 1, np.arange(len(digests)), 0
    for level, size in enumerate(sizes):
        at = _place(words[left], level, size) + base
        hit = bits[at]
        found[left[hit]] = rank[at[hit]]
        left, base = left[~hit], base + size
    member = found >= 0
    member[member] = (slots[found[member]] == digests[member]).all(axis=1)
    return np.where(member, found, -1)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, 32)


def _packed(pdf: pd.DataFrame, order: np.ndarray) -> dict:
    ids = pdf["inverse_id"].astype("Int64")
    flag = ids.isna().to_numpy()
    values = ids.fillna(0).to_numpy(np.int64)
    return {"digests": _matrix(pdf["digest"])[order].tobytes(), "chars": pdf["n_chars"].to_numpy("<i8")[order].tobytes(), "ids": values[order].astype("<i8").tobytes() + flag[order].tobytes(), "counts": pdf["rows"].to_numpy("<i8")[order].tobytes()}


def _table(pdf: pd.DataFrame) -> pd.DataFrame:
    sizes, bits, slot = build_table(_matrix(pdf["digest"]))
    return pd.DataFrame([{"shard": pdf["shard"].iat[0], "sizes": sizes, "bits": np.packbits(bits).tobytes(), "n": len(pdf)} | _packed(pdf, np.argsort(slot))])


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(shards))


def build_history(groups: DataFrame, shards: int) -> DataFrame:
    """The tables of the historical groups (rows as of grouped()), one row a shard, written to the shared folder."""
    dealt = groups.withColumn("shard", _shard(shards))
    return written(dealt.groupBy("shard").applyInPandas(_table, TABLE), "history")


def _merge(new: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
    if not len(table):
        return new[["digest", "n_chars", "inverse_id", "rows"]]
    row = table.iloc[0]
    n, sizes = int(row["n"]), [int(x) for x in row["sizes"]]
    slots = np.frombuffer(row["digests"], np.uint8).reshape(n, 32)
    chars, rows = np.frombuffer(row["chars"], "<i8"), np.frombuffer(row["counts"], "<i8").copy()
    ids = pd.Series(np.frombuffer(row["ids"][: 8 * n], "<i8")).astype("Int64").mask(np.frombuffer(row["ids"][8 * n :], bool))
    old = pd.DataFrame({"digest": [slots[i].tobytes() for i in range(n)], "n_chars": chars, "inverse_id": ids, "rows": rows})
    if not len(new):
        return old
    bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=sum(sizes)).astype(bool)
    slot = look_up(_matrix(new["digest"]), sizes, bits, slots)
    member = slot >= 0
    repeats, apart = new[member], new[~member]
    at = slot[member]
    old.loc[at, "rows"] = rows[at] + repeats["rows"].to_numpy(np.int64)
    mine = repeats["inverse_id"].astype("Int64").fillna(-(2**63)).to_numpy(np.int64)
    theirs = old["inverse_id"].fillna(-(2**63)).to_numpy(np.int64)[at]
    length = repeats["n_chars"].to_numpy(np.int64)
    better = (length > chars[at]) | ((length == chars[at]) & (mine > theirs))
    old.loc[at[better], "n_chars"] = length[better]
    old.loc[at[better], "inverse_id"] = repeats["inverse_id"].astype("Int64").to_numpy()[better]
    return pd.concat([old, apart[["digest", "n_chars", "inverse_id", "rows"]].astype({"inverse_id": "Int64"})])


def against_history(new_groups: DataFrame, tables: DataFrame, shards: int) -> DataFrame:
    """All groups of history and the new rows together, one row a distinct digest."""
    dealt = new_groups.withColumn("shard", _shard(shards))
    return dealt.groupBy("shard").cogroup(tables.groupBy("shard")).applyInPandas(_merge, GROUP)


def dedup(docs: DataFrame, historical: Column | None = None) -> DataFrame:
    """doc_id, digest, n_chars, keep_id, keep_chars, group_size, kept for every row; `historical` says which rows are history (the older half of the id range)."""
    prints = written(fingerprints(docs), "digests")
    if historical is None:
        low, high = prints.agg(F.min("doc_id"), F.max("doc_id")).first()
        historical = F.col("doc_id") <= F.lit(None if low is None else (low + high) // 2)
    old = F.coalesce(historical, F.lit(False))
    past = written(grouped(prints.filter(old)), "past")
    # By all rows as well, so that a short history does not gather all new rows in a few shards.
    shards = max(1, -(-past.count() // SHARD_KEYS), -(-prints.count() // (2 * SHARD_KEYS)))
    tables = build_history(past, shards)
    groups = against_history(grouped(prints.filter(~old)), tables, shards)
    winners = groups.select("digest", F.bitwise_not("inverse_id").alias("keep_id"), F.col("n_chars").alias("keep_chars"), F.col("rows").alias("group_size"))
    # Repeated rows are numbered before the join, by keys that no hot group shares: a group's rows differ in doc_id.
    numbered = prints.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", "digest", "n_chars").orderBy("n_chars")))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars")) & (F.col("copy") == 1)
    return numbered.join(winners, "digest").withColumn("kept", kept).drop("copy")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: every document with the row of its group that stays."""
    out = dedup(documents(spark, sf_dir))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    keep = dedup(docs).filter("kept").select(F.col("doc_id").alias("__gw_doc"), F.col("digest").alias("__gw_digest"))
    seen = docs.withColumn("__gw_own", F.unhex(F.sha2(normalised().cast("binary"), 256)))
    joined = seen.join(keep, seen["doc_id"].eqNullSafe(keep["__gw_doc"]) & (seen["__gw_own"] == keep["__gw_digest"]))
    first = F.row_number().over(Window.partitionBy("__gw_doc", "__gw_digest").orderBy(F.length(text_of()).desc()))
    return joined.withColumn("__gw_row", first).filter("__gw_row = 1").select(*docs.columns)


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS txt FROM documents),
n AS (SELECT doc_id, length(txt) AS n_chars, sha256(regexp_replace(txt, '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM t),
g AS (SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w = 1 AS kept, count(*) OVER (PARTITION BY text_sha256) AS group_size
      FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM g
"""
