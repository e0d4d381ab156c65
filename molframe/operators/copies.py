"""Copies and merges of structures into one id space."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from molframe.functions.geometry import add, vec
from molframe.plans.graph import spread_nulls
from molframe.plans.ordered import dense_index


def copy_remap(mono: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(monomers with copies appended, ligations asked for).

    ``mono``: id, strand, cluster, n3, n5, bp; ``chosen``: id. Copies get fresh ids above the
    largest; links and pairs inside the copy are remapped. A link that leaves the copy is kept
    as a ligation if the monomer outside has that end open, a pair if it is free; else dropped.
    Tables of one row per monomer are small as files and large in memory, so their joins never broadcast.
    """
    top = mono.agg(F.max("id").alias("m")).scalar()
    new = dense_index(chosen.select(F.col("id").alias("old")).distinct(), [], ["old"], "_g", "_k")
    new = new.select("old", F.col("_k").alias("_k"))
    src = mono.join(new.withColumnRenamed("old", "id").hint("merge"), "id")
    last = mono.agg(F.max("cluster").alias("m")).scalar()
    groups = dense_index(src.filter(F.col("cluster") > 0).select("cluster").distinct(), [],
                         ["cluster"], "_g", "_c").select("cluster", "_c")
    src = src.withColumn("_key", spread_nulls("cluster", "id")).join(
        groups.withColumnRenamed("cluster", "_key").hint("merge"), "_key", "left").drop("_key")
    # monomers outside that could take a link or a pair
    outer = mono.select("id", F.col("n5").isNull().alias("_o5"), F.col("n3").isNull().alias("_o3"),
                        F.col("bp").isNull().alias("_ob"))
    for c, free in (("n3", "_o5"), ("n5", "_o3"), ("bp", "_ob")):
        src = src.withColumn("_key", spread_nulls(c, "id"))
        src = src.join(new.select(F.col("old").alias("_key"), F.col("_k").alias(f"_in_{c}")).hint(
            "merge"), "_key", "left")
        src = src.join(outer.select(F.col("id").alias("_key"), F.col(free).alias(f"_open_{c}")).hint(
            "merge"), "_key", "left").drop("_key")
    fresh = lambda k: top + 1 + F.col(k)
    s = src.withColumn("_new", fresh("_k"))
    outside = lambda c: F.when(F.col(f"_in_{c}").isNull() & F.col(f"_open_{c}"), F.col(c))
    lig = s.select(F.col("_new").alias("id"), outside("n3").alias("n3"), outside("n5").alias("n5")) \
        .filter(F.col("n3").isNotNull() | F.col("n5").isNotNull())
    link = lambda c: F.when(F.col(f"_in_{c}").isNotNull(), fresh(f"_in_{c}"))
    keep = [c for c in mono.columns if c not in ("id", "cluster", "n3", "n5", "bp")]
    copies = s.select(F.col("_new").alias("id"), *keep, (last + 1 + F.col("_c")).cast(
        mono.schema["cluster"].dataType).alias("cluster"), link("n3").alias("n3"),
        link("n5").alias("n5"), F.coalesce(link("bp"), outside("bp")).alias("bp"))
    return mono.unionByName(copies), lig


def lattice_copies(mono: DataFrame, spacing: float, n: int = 3) -> DataFrame:
    """n x n x n copies of a structure: id = base + cell x size, one shift of cell x spacing each.

    ``mono``: id (dense from 0), n3, n5, bp, p. Adds ``cell``.
    """
    size = mono.agg((F.max("id") + 1).alias("n")).scalar()
    d = mono.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(n ** 3 - 1))))
    at = F.col("cell")
    shift = vec((at % n) * spacing, (F.floor(at / n) % n) * spacing, F.floor(at / (n * n)) * spacing)
    moved = {c: F.col(c) + at * size for c in ("id", "n3", "n5", "bp")}
    return d.withColumns({**moved, "p": add(F.col("p"), shift)})


def merge_systems(mono: DataFrame) -> DataFrame:
    """Several files into one id space: file, id, strand, cluster -> new_id, new_strand, new_cluster."""
    ids = dense_index(mono.select("file", "id", "strand", "cluster"), [], ["file", "id"], "new_id",
                      "_p")
    key = lambda c, out: dense_index(mono.filter(F.col(c).isNotNull()).select("file", c).distinct(),
                                     [], ["file", c], "_g", out).select("file", c, out)
    d = ids.join(key("strand", "new_strand"), ["file", "strand"])
    d = d.withColumn("_key", spread_nulls("cluster", "id")).join(
        key("cluster", "_c").withColumnRenamed("cluster", "_key"), ["file", "_key"], "left")
    return d.select("file", "id", "new_id", "new_strand", (F.col("_c") + 1).alias("new_cluster"))
