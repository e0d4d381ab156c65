"""Per-strand and per-structure summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from molframe.operators.sequences import sequences


def selection_sequence(mono: DataFrame, selection: DataFrame) -> DataFrame:
    """Sequence of a selection, strands by descending id: read the rows in order and join them."""
    return (sequences(mono.join(selection.select("id"), "id", "left_semi"))
            .orderBy(F.desc("strand"), "part"))


def lengths(mono: DataFrame) -> DataFrame:
    """system, strand, length, system_length."""
    per = mono.groupBy("system", "strand").agg(F.count(F.lit(1)).alias("length"))
    total = per.groupBy("system").agg(F.sum("length").alias("system_length"))
    return per.join(total, "system")


def length_groups(mono: DataFrame) -> DataFrame:
    """Strands of each length: length, n_strands, strand (one row per strand)."""
    per = mono.groupBy("strand").agg(F.count(F.lit(1)).alias("length"))
    return per.join(per.groupBy("length").agg(F.count(F.lit(1)).alias("n_strands")), "length")


def sequence_counts(mono: DataFrame) -> DataFrame:
    """Distinct sequences with multiplicity: strand (an example), part, sequence, n.

    Strands compare by the fingerprint of their parts, so only fingerprints are shuffled
    between strands.
    """
    parts = sequences(mono)
    prints = parts.groupBy("strand").agg(F.sha2(F.array_join(F.transform(F.array_sort(
        F.collect_list(F.struct("part", F.sha2("sequence", 256).alias("h")))),
        lambda x: x["h"]), ""), 256).alias("print"))
    counts = prints.groupBy("print").agg(F.count(F.lit(1)).alias("n"), F.min("strand")
                                         .alias("strand"))
    return parts.join(counts.drop("print"), "strand")


def circular(mono: DataFrame) -> DataFrame:
    """A strand is circular when no monomer lacks a 3' neighbour."""
    return mono.groupBy("strand").agg(F.bool_and(F.col("n3").isNotNull()).alias("circular"))


def scaffold(mono: DataFrame) -> DataFrame:
    """Longest strand per structure, the first on ties."""
    per = mono.groupBy("structure", "strand").agg(F.count(F.lit(1)).alias("length"))
    return per.groupBy("structure").agg(
        F.max_by("strand", F.struct("length", -F.col("strand"))).alias("strand"),
        F.max("length").alias("length"))


def contains_u(mono: DataFrame) -> DataFrame:
    return mono.groupBy("structure").agg(F.bool_or(F.upper("base") == "U").alias("is_rna"))


def grid_mass(points: DataFrame, cell_angstrom: float) -> tuple[DataFrame, DataFrame]:
    """Bin points into cells: (cells with mean position and mass, members of each cell)."""
    cell = cell_angstrom / 8.518
    p = F.col("p")
    low = points.agg(F.struct(*[F.min(p[a]).alias(a) for a in "xyz"]).alias("lo")).scalar()
    placed = points.withColumn("_lo", low)
    members = placed.select("id", "p", *[
        F.floor((p[a] - F.col("_lo")[a]) / cell).alias("c" + a) for a in "xyz"])
    keys = ["cx", "cy", "cz"]
    cells = members.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("mass"), *[F.avg(p[a]).alias(a) for a in "xyz"])
    return cells, members.select(*keys, "id")


def index_average(values: DataFrame, groups: DataFrame) -> DataFrame:
    """Average of ``value`` over index groups. ``groups``: grp, id (one row per member)."""
    return groups.join(values, "id").groupBy("grp").agg(F.avg("value").alias("value"))


def least_squares(df: DataFrame, by: list[str], x: str = "x", y: str = "y") -> DataFrame:
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("m"), F.regr_intercept(y, x).alias("b"))


def least_squares_origin(df: DataFrame, by: list[str], x: str = "x", y: str = "y") -> DataFrame:
    return df.groupBy(*by).agg((F.sum(F.col(x) * F.col(y)) / F.sum(F.col(x) * F.col(x))).alias("m"))
