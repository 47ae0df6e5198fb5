"""What the operators share: reading tables, the shared folder, id ranges and white space."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every word and normalisation rule here, as a Java regular expression class.
SPACE = r"[\x20\x09-\x0D]"
#: What a row without a doc_id counts as where ids are put in order.
NO_ID = -(2**63)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors see: spark.checkpoint.dir, or a new one where that is unset (local runs)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("glossaweave.shared.dir", None)
        if not found:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("on a cluster, spark.checkpoint.dir must name a shared folder")
            found = tempfile.mkdtemp(prefix="glossaweave-")
            spark.conf.set("glossaweave.shared.dir", found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as a Parquet table in the shared folder and read again: it cuts the lineage and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int, most: int = 100_000) -> DataFrame:
    """df to be broadcast if its number of rows, which the caller has counted, is at most `most`; else as it is, for a shuffled join."""
    return F.broadcast(df) if rows <= most else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_bounds(ids: DataFrame, parts: int, column: str = "doc_id", repeated: bool = False) -> list[int]:
    """At most `parts` ascending ids that occur in the column, the last the largest of all, each the upper end of a range of about as many rows.
    repeated: an id that fills several ranges by itself stands as often."""
    keys = ids.select(F.coalesce(F.col(column).cast("long"), F.lit(NO_ID)).alias("k"))
    shares = F.array(*[F.lit((i + 1) / parts) for i in range(parts)])
    row = keys.agg(F.percentile_approx("k", shares, max(10_000, 20 * parts)).alias("at"), F.max("k").alias("last")).first()
    if row["last"] is None:
        return []
    return sorted([*row["at"], *[row["last"]] * (row["last"] not in row["at"])] if repeated else {*row["at"], row["last"]})


def range_number(bounds: list[int]):
    """A column function of an id and a hash: the number of the range of id_bounds in which the id lies; of the ranges that one id fills, that
    of its hash."""
    at = np.array(bounds, dtype=np.int64)

    @F.pandas_udf("int")
    def number(k: pd.Series, h: pd.Series) -> pd.Series:
        k = k.to_numpy(np.int64)
        first = np.searchsorted(at, k, side="left")
        several = np.maximum(np.searchsorted(at, k, side="right") - first, 1)
        share = (h.to_numpy(np.int64) >> 32).astype(np.float64) / 2**32 + 0.5
        return pd.Series((first + np.minimum((share * several).astype(np.int64), several - 1)).astype(np.int32))

    return number


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 16_000_000) -> Iterator[pa.RecordBatch]:
    """The batches, cut by rows so that the named column of each holds about `most` bytes at most: very long texts come few at a time."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(np.nan_to_num(pa.compute.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)))
        start = 0
        while start < batch.num_rows:
            base = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, base + most, side="right")))
            yield batch.slice(start, end - start)
            start = end
