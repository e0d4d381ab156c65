"""Plate registries: where each strand's sequence is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def lookup(strands: DataFrame, plates: DataFrame) -> DataFrame:
    """All (plate, well) of each strand's sequence; NULLs when it is in none."""
    return strands.join(plates, "sequence", "left")


def orphans(strands: DataFrame, plates: DataFrame, limit: int = 1000) -> DataFrame:
    """Strands shorter than ``limit`` whose sequence is in no plate."""
    return (strands.filter(F.length("sequence") < limit)
            .join(plates.select("sequence").distinct(), "sequence", "left_anti"))


def report(strands: DataFrame, plates: DataFrame) -> DataFrame:
    """Strands per (plate, well), each strand counted at its first hit (lowest plate, well)."""
    first = plates.groupBy("sequence").agg(F.min(F.struct("plate", "well")).alias("h"))
    return (strands.join(first, "sequence").groupBy("h.plate", "h.well")
            .agg(F.count(F.lit(1)).alias("n")))


def full_report(strands: DataFrame, plates: DataFrame) -> DataFrame:
    """The report (plate, well, n) and a row (strand, n = 1) for each strand that is in no plate."""
    lost = orphans(strands, plates, (1 << 31) - 1).select("strand")
    empty = F.lit(None).cast("string")
    return report(strands, plates).select(
        "plate", "well", F.lit(None).cast("bigint").alias("strand"), "n").unionByName(lost.select(
            empty.alias("plate"), empty.alias("well"), F.col("strand").cast("bigint").alias("strand"),
            F.lit(1).cast("bigint").alias("n")))


def import_plates(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Add plates whose name is new; an existing plate is never changed."""
    new = incoming.join(current.select("plate").distinct(), "plate", "left_anti")
    return current.unionByName(new)
