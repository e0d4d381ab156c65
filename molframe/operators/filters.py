"""Selections over monomer tables. A selection is a DataFrame with an ``id`` column."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def by_ids(mono: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found monomers, ids that do not exist)."""
    wanted = ids.select("id").distinct()
    return mono.join(wanted, "id", "left_semi"), wanted.join(mono, "id", "left_anti")


def by_residue(residues: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted``: residue and chain; a NULL chain means any chain."""
    exact = residues.join(wanted.filter(F.col("chain").isNotNull()), ["chain", "residue"],
                          "left_semi")
    anywhere = residues.join(wanted.filter(F.col("chain").isNull()).select("residue"), "residue",
                             "left_semi")
    return exact.unionByName(anywhere).dropDuplicates(["id"])


def five_prime_ends(mono: DataFrame) -> DataFrame:
    """Monomers without a 5' neighbour; for circular strands the stored start (pos 0)."""
    return mono.filter(F.col("n5").isNull() | (F.col("pos") == 0))


def three_prime_ends(mono: DataFrame) -> DataFrame:
    return mono.filter(F.col("n3").isNull() | (F.col("pos") == F.col("len") - 1))


def by_colour(mono: DataFrame, selection: DataFrame) -> DataFrame:
    """Monomers whose custom colour occurs in the selection."""
    colours = (mono.join(selection.select("id"), "id", "left_semi")
               .filter(F.col("color").isNotNull()).select("color").distinct())
    return mono.join(colours, "color", "left_semi")


def id_range(mono: DataFrame, selection: DataFrame) -> DataFrame:
    """Ids from the smallest up to, not including, the largest selected id."""
    low = selection.agg(F.min("id").alias("v")).scalar()
    high = selection.agg(F.max("id").alias("v")).scalar()
    return mono.filter((F.col("id") >= low) & (F.col("id") < high))


def strand_range(mono: DataFrame, ends: DataFrame) -> DataFrame:
    """Sub-strands between monomers ``a`` and ``b`` of one strand, both included.

    ``ends``: a, b (ids). Ends on different strands give nothing. One row per strand segment is
    joined by (strand, chunk) so a long strand stays spread.
    """
    chunk = 1 << 16
    at = mono.select("id", "strand", "pos")
    e = (ends.join(at.toDF("a", "strand", "pa"), "a").join(at.toDF("b", "strand", "pb"),
                                                         ["b", "strand"])
         .select("strand", "a", "b", F.least("pa", "pb").alias("lo"),
                 F.greatest("pa", "pb").alias("hi"))
         .withColumn("_chunk", F.explode(F.sequence(F.floor(F.col("lo") / chunk),
                                                    F.floor(F.col("hi") / chunk)))))
    return (mono.withColumn("_chunk", F.floor(F.col("pos") / chunk))
            .join(e, ["strand", "_chunk"])
            .filter(F.col("pos").between(F.col("lo"), F.col("hi"))).drop("_chunk", "lo", "hi"))


def invert(mono: DataFrame, selection: DataFrame) -> DataFrame:
    return mono.join(selection.select("id"), "id", "left_anti")


def by_class(mono: DataFrame, *classes: str) -> DataFrame:
    return mono.filter(F.col("class").isin(*classes))


def overstretched(sites: DataFrame, limit: float = 1.2) -> DataFrame:
    """Both ends of backbone bonds longer than ``limit``. ``sites``: id, n3, p."""
    from molframe.functions.geometry import dist
    other = sites.select(F.col("id").alias("n3"), F.col("p").alias("_q"))
    bonds = sites.join(other, "n3").filter(dist(F.col("p"), F.col("_q")) > limit)
    return bonds.select(F.explode(F.array("id", "n3")).alias("id")).distinct()


def named_selection(selections: DataFrame, name: str) -> DataFrame:
    """Members of one stored selection in order. ``selections``: name, ord, id."""
    return selections.filter(F.col("name") == name).select("ord", "id")
