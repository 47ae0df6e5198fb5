"""Translation units: paragraphs cut into segments, numbered and linked within their paragraph."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codes, sentences, text
from ..schema import kept, stable_id


def _marked(hidden: bool):
    """Marks the sentences of paragraphs with codes (cut); those of others are marked already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = zip(batch.column("cut").to_pylist(), batch.column("marked").to_pylist())
            made = pa.array([marked if cut is None else codes.core_segments(cut, hidden) for cut, marked in done], pa.list_(pa.string()))
            keys = [n for n in batch.schema.names if n not in ("cut", "marked")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keys), made], [*keys, "marked"])

    return run


def segments(paragraphs: DataFrame, boundary: str = "SENTENCE", hidden: bool = False, language: Column | None = None, coded: bool = True) -> DataFrame:
    """doc_id, part_no, seg_no, marked, seg_of: a paragraph's segments, their cores marked, and their number. Sentences are those of the language (a
    column of the table; English without one). Paragraphs without codes are cut and marked by column expressions; Python sees the others
    alone, and none where the caller says that there are none (coded)."""
    if boundary == "PARAGRAPH" and not hidden:
        plain = paragraphs.filter(~F.col("text").contains("<")).withColumn("marked", text.mark_core(F.col("text"))).filter("marked <> ''")
        tagged = paragraphs.filter(F.col("text").contains("<")).withColumn("marked", codes.column(lambda t: codes.mark_core(t, False))(F.col("text"))).filter("marked <> ''")
        both = plain.unionByName(tagged)
        return both.select("doc_id", "part_no", F.lit(0).alias("seg_no"), "marked", F.lit(1).alias("seg_of"), *kept(paragraphs))
    column, keys = F.col("text"), ["doc_id", "part_no", *kept(paragraphs)]
    tagged = F.lit(coded) & (F.lit(hidden) | column.contains("<"))
    marked = F.when(~tagged, sentences.core_segments(column, language))
    if coded:
        both = paragraphs.select(*keys, marked.alias("marked"), F.when(tagged, sentences.cut(column, language)).alias("cut"))
        paragraphs = both.mapInArrow(_marked(hidden), both.drop("cut").schema)
        marked = F.col("marked")
    # An outer explode of one array: no test of its size is put before it, which would compute it twice.
    out = paragraphs.select(*keys, sentences.counted(marked).alias("all")).select(*keys, F.explode_outer("all").alias("s"))
    return out.filter("s.seg_no IS NOT NULL").select("doc_id", "part_no", "s.seg_no", "s.marked", "s.seg_of", *keys[2:])


def trans_units(marked: DataFrame) -> DataFrame:
    """The table of units. A segment is mergeable if one follows it in its paragraph. Neighbours' ids come from their numbers: no shuffle."""
    key = lambda n: stable_id(F.col("doc_id"), F.col("part_no"), n)
    more = F.col("seg_no") + 1 < F.col("seg_of")
    m = F.col("marked")
    return marked.select(
        "doc_id", key(F.col("seg_no")).alias("tu_id"), key(F.lit(0)).alias("para_id"), "part_no", "seg_no", "seg_of",
        more.alias("mergeable"), F.when(more, key(F.col("seg_no") + 1)).alias("next_tu_id"), text.prefix_text(m).alias("prefix"), text.core_text(m).alias("core"), text.suffix_text(m).alias("suffix"), *kept(marked),
    )
