"""Units that name the one after them, in any order: joined along their links by pointer doubling.

A unit's `next_tu_id` is the id of the unit that continues it, wherever in the document that stands. Each round every unit
that is not at an end takes over how far its furthest unit has come: links of 1, 2, 4, ... units, so a chain of n units takes
about log2(n) rounds of one join, and no task walks a chain. The units that reach one end are one chain, in order of
their distance to it; the last step gathers a chain's texts, which is its result.

Defined results: a link to an id that is not there ends the chain. Of repeated ids the last counts. Of several units that
name the same one, the first continues with it; the others end there, with a notice. Units in a circle stand alone, with
a notice. Ids are those of one document; null ids are no units. An empty table gives an empty result.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .targets import last_wins


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a new folder where that is unset (local runs)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("glossaweave.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("on a cluster, spark.checkpoint.dir must name a shared folder")
        found = tempfile.mkdtemp(prefix="glossaweave-")
        spark.conf.set("glossaweave.shared.dir", found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: rounds do not compute those before them again, and outlive lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def links(units: DataFrame) -> DataFrame:
    """units (doc_id, tu_id, next_tu_id, ordinal, ...) -> doc_id, tu_id, ordinal, next (null at an end), refused: whether another unit goes on
    with what this one names."""
    known = units.select("doc_id", F.col("tu_id").alias("next_tu_id"), F.lit(True).alias("found"))
    named = units.select("doc_id", "tu_id", "ordinal", "next_tu_id").join(known, ["doc_id", "next_tu_id"], "left")
    first = named.filter("found").groupBy("doc_id", "next_tu_id").agg(F.min(F.struct("ordinal", "tu_id")).alias("first"))
    both = named.join(first, ["doc_id", "next_tu_id"], "left")
    mine = F.coalesce(F.col("first") == F.struct("ordinal", "tu_id"), F.lit(False))
    return both.select("doc_id", "tu_id", "ordinal", F.when(mine, F.col("next_tu_id")).alias("next"), (F.col("found").isNotNull() & ~mine).alias("refused"))


def ranked(links: DataFrame) -> DataFrame:
    """links -> doc_id, tu_id, ordinal, refused, end (the chain's last unit), far (links to it), circle."""
    start = F.coalesce("next", "tu_id")
    now = written(links.select("doc_id", "tu_id", "ordinal", "refused", start.alias("end"), F.col("next").isNotNull().cast("long").alias("far"), F.col("next").isNotNull().alias("live")), "chains")
    most, length = now.count(), 1
    while length <= 2 * most and not now.filter("live").isEmpty():
        further = now.select("doc_id", F.col("tu_id").alias("end"), F.col("end").alias("end_"), F.col("far").alias("far_"), F.col("live").alias("live_"))
        moved = now.filter("live").join(further, ["doc_id", "end"]).select("doc_id", "tu_id", "ordinal", "refused", F.col("end_").alias("end"), (F.col("far") + F.col("far_")).alias("far"), F.col("live_").alias("live"))
        now = written(now.filter("NOT live").unionByName(moved), "chains")
        length *= 2
    # What is not at an end after more steps than there are units goes round: nothing leads into a circle, as each unit continues one at most.
    return now.select("doc_id", "tu_id", "ordinal", "refused", F.when(F.col("live"), F.col("tu_id")).otherwise(F.col("end")).alias("end"), F.when(F.col("live"), 0).otherwise(F.col("far")).alias("far"), F.col("live").alias("circle"))


def follow(units: DataFrame, column: str = "text") -> tuple[DataFrame, DataFrame]:
    """units (doc_id, tu_id, next_tu_id, ordinal, the column) -> (doc_id, tu_id of the first unit, units, the joined column) of each chain, and
    diagnostics (doc_id, tu_id, severity, message)."""
    plain = units.select(F.struct("doc_id", "tu_id").alias("key"), "next_tu_id", "ordinal", F.col(column).alias("body")).filter("key.tu_id IS NOT NULL")
    rows = written(last_wins(plain, "key").select("key.doc_id", "key.tu_id", "next_tu_id", "ordinal", "body"), "chain-units")
    placed = ranked(links(rows))
    bodies = placed.join(rows.select("doc_id", "tu_id", "body"), ["doc_id", "tu_id"])
    pieces = F.sort_array(F.collect_list(F.struct((-F.col("far")).alias("o"), "tu_id", F.coalesce("body", F.lit("")).alias("t"))))
    chains = bodies.groupBy("doc_id", "end").agg(pieces.alias("p")).select("doc_id", F.col("p")[0]["tu_id"].alias("tu_id"), F.size("p").alias("units"), F.array_join(F.col("p.t"), "").alias(column))
    told = F.when(F.col("circle"), "units that follow each other in a circle stand alone").when(F.col("refused"), "the next unit already continues another")
    return chains, placed.select("doc_id", "tu_id", F.lit(2).alias("severity"), told.alias("message")).filter("message IS NOT NULL")
