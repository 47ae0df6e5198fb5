"""Documents as they arrive: a file stream whose every document is tokenised and segmented by itself, without state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.units import segments
from ..schema import paragraphs


def arriving(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_segments(docs: DataFrame, read: Callable[[DataFrame], DataFrame], boundary: str = "SENTENCE") -> DataFrame:
    return segments(paragraphs(read(docs)), boundary)


def write_units(units: DataFrame, path: str, checkpoint: str):
    """Appends to a Parquet table; a restart goes on where the checkpoint ends. All that has arrived is taken, then it stops."""
    return units.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
