"""Moves, rotations, colours and trap forces on monomer tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from molframe.functions.geometry import add, dist, mean, rotate, scale, sub, unit, vec

COLOUR_STEPS = 512


def translate(mono: DataFrame, selection: DataFrame, by: Column) -> DataFrame:
    """Shift the monomers whose id is in ``selection`` (id)."""
    chosen = selection.select("id").distinct().withColumn("_sel", F.lit(True))
    return (mono.join(chosen, "id", "left")
            .withColumn("p", F.when(F.col("_sel"), add(F.col("p"), by)).otherwise(F.col("p")))
            .drop("_sel"))


def rotate_selection(mono: DataFrame, selection: DataFrame, axis: Column, angle: float,
                     about: Column | None = None) -> DataFrame:
    """Turn a selection about ``about`` (its own centre if None); p, a1 and a3 turn alike."""
    chosen = selection.select("id").distinct().withColumn("_sel", F.lit(True))
    marked = mono.join(chosen, "id", "left")
    if about is None:
        about = (mono.join(chosen, "id", "left_semi").agg(mean(F.col("p")).alias("c"))).scalar()
    marked = marked.withColumn("_about", about)
    c = F.col("_about")
    turned = {"p": add(rotate(sub(F.col("p"), c), axis, angle), c),
              "a1": rotate(F.col("a1"), axis, angle), "a3": rotate(F.col("a3"), axis, angle)}
    return marked.withColumns({k: F.when(F.col("_sel"), v).otherwise(F.col(k))
                               for k, v in turned.items()}).drop("_sel", "_about")


def move_to(mono: DataFrame, selection: DataFrame, target: Column) -> DataFrame:
    """Move ``selection`` (id, ord) so that its first member lands on ``target``."""
    first = (mono.join(selection, "id").agg(F.min_by("p", "ord").alias("p"))).scalar()
    chosen = selection.select("id").distinct().withColumn("_sel", F.lit(True))
    offset = sub(target, F.col("_first"))
    return (mono.join(chosen, "id", "left").withColumn("_first", first)
            .withColumn("p", F.when(F.col("_sel"), add(F.col("p"), offset)).otherwise(F.col("p")))
            .drop("_sel", "_first"))


def colour_key(mode: str, palette: int = 11) -> Column:
    """Palette index by mode; -1 = noise red, NULL = grey. Columns: strand, system, cluster,
    overlay, color."""
    if mode == "strand":
        return F.pmod(F.abs("strand") + F.col("system"), F.lit(palette))
    if mode == "system":
        return F.pmod(F.col("system"), F.lit(palette))
    if mode == "cluster":
        c = F.col("cluster")
        return F.when(c > 0, F.pmod(c, F.lit(palette))).otherwise(-1)
    if mode == "overlay":
        return F.col("overlay")
    return F.coalesce("color", "overlay")


def colour_index(value: Column, low: Column, high: Column, steps: int = COLOUR_STEPS) -> Column:
    """Step 0 .. steps - 1 of a value clamped to [low, high]."""
    share = (F.least(F.greatest(value, low), high) - low) / F.nullif(high - low, F.lit(0.0))
    return F.least(F.floor(F.coalesce(share, F.lit(0.0)) * steps), F.lit(steps - 1)).cast("bigint")


def colour_scale(overlay: DataFrame, value: str = "value") -> DataFrame:
    """Colour step over the global range of all loaded systems."""
    bounds = overlay.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"))).scalar()
    return overlay.withColumn("_b", bounds).withColumn(
        "step", colour_index(F.col(value), F.col("_b.lo"), F.col("_b.hi"))).drop("_b")


def trap_vectors(traps: DataFrame, sites: DataFrame) -> DataFrame:
    """Trap force towards the reference particle and the equilibrium point.

    ``traps``: particle, ref_particle, stiff, r0; ``sites``: id, bb. Also what an observer needs
    after each frame.
    """
    a = sites.select(F.col("id").alias("particle"), F.col("bb").alias("_p1"))
    b = sites.select(F.col("id").alias("ref_particle"), F.col("bb").alias("_p2"))
    p1, p2 = F.col("_p1"), F.col("_p2")
    along = unit(sub(p2, p1))
    return (traps.join(a, "particle").join(b, "ref_particle")
            .withColumn("force", scale(along, (dist(p1, p2) - F.col("r0")) * F.col("stiff")))
            .withColumn("eq_point", add(p1, scale(along, F.col("r0"))))
            .drop("_p1", "_p2"))


__all__ = ["translate", "rotate_selection", "move_to", "colour_key", "colour_index",
           "colour_scale", "trap_vectors", "vec"]
