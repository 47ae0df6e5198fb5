"""Target texts of translation units: the last of repeated units, the choice by language and review phase, defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import plain_source


def last_wins(units: DataFrame, key: str = "tu_id", order: str = "ordinal") -> DataFrame:
    """Of repeated keys the row with the largest ordinal: one aggregation, combined before the shuffle."""
    columns = [c for c in units.columns if c not in (key, order)]
    last = F.max_by(F.struct(*columns), order).alias("last")
    return units.groupBy(key).agg(last, F.max(order).alias(order)).select(key, *[F.col(f"last.{c}").alias(c) for c in columns], order)


def phase_rank(phase: Column, wanted: str | None, most: int) -> Column:
    """0 for the best phase, more for those fallen back to; null for a phase that may not be taken. A numeric phase up to the
    largest falls back to lower ones; '0' starts at the largest; any other has to be met exactly."""
    if not wanted:
        return F.lit(0)
    exact = F.when(phase == wanted, 0)
    if not wanted.isdigit() or int(wanted) > most:
        return exact
    number = F.when(phase.rlike("^[0-9]{1,9}$"), phase.cast("int"))
    start = int(wanted) or most
    lower = F.when(number.between(1, start), start - number + (0 if int(wanted) else 1))
    return F.coalesce(exact, lower)


def choose(targets: DataFrame, lang: str, phase: str | None = None, most: int = 0, key: str = "tu_id") -> DataFrame:
    """One target a unit: of its language (case aside), by phase, targets before alternatives, then by ordinal. Aggregated, not
    sorted: a unit with very many targets does not gather in one task."""
    rank = phase_rank(F.col("phase"), phase, most)
    fit = targets.filter(F.lower(F.col("lang")) == lang.lower()).withColumn("rank", rank).filter("rank IS NOT NULL")
    order = F.struct("rank", (F.col("kind") != "target").cast("int").alias("alt"), "ordinal")
    return fit.groupBy(key).agg(F.min_by("text", order).alias("text"), F.min_by("phase", order).alias("phase"))


def untranslated(position: Column, source: Column, amp_entities: bool = True) -> Column:
    plain = plain_source(source)
    plain = plain if amp_entities else F.replace(plain, F.lit("&amp;"), F.lit("&"))
    return F.concat(F.lit(" [Segment "), position.cast("string"), F.lit(" not yet translated: "), plain, F.lit("] "))


def with_default(units: DataFrame, chosen: DataFrame, amp_entities: bool = True) -> DataFrame:
    """units (tu_id, ordinal counted from 1, core, ...) with `target`: the chosen text, or a note where there is none."""
    joined = units.join(chosen.select("tu_id", F.col("text").alias("_target")), "tu_id", "left")
    return joined.withColumn("target", F.coalesce("_target", untranslated(F.col("ordinal"), F.col("core"), amp_entities))).drop("_target")
