"""Centres, orientations and periodic boxes. ``by`` is the key of one configuration."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from molframe.functions.geometry import add, dot, mean, norm, scale, sub, unit, vec
from molframe.functions.nucleic import backbone_site, base_site


def centre(mono: DataFrame, by: list[str], p: str = "p") -> DataFrame:
    return mono.groupBy(*by).agg(mean(F.col(p)).alias("p"))


def selection_centre(frames: DataFrame, selection: DataFrame, key: str, by: list[str],
                     p: str = "p") -> DataFrame:
    return centre(frames.join(selection.select(key).distinct(), key, "left_semi"), by, p)


def mean_orientation(mono: DataFrame, by: list[str]) -> DataFrame:
    """Mean base centre and the unit vector from it to the mean backbone site."""
    p, a1, a3 = F.col("p"), F.col("a1"), F.col("a3")
    m = mono.groupBy(*by).agg(mean(base_site(p, a1)).alias("origin"),
                              mean(backbone_site(F.col("class"), p, a1, a3)).alias("bb"))
    return m.withColumn("direction", unit(sub(F.col("bb"), F.col("origin")))).drop("bb")


def mean_a3(mono: DataFrame, by: list[str], order: str = "pos") -> DataFrame:
    """Mean stacking direction after turning every a3 to the side of the first member's."""
    u = mono.withColumn("a3", unit(F.col("a3")))
    ref = u.groupBy(*by).agg(F.min_by("a3", order).alias("_ref"))
    a3, r = F.col("a3"), F.col("_ref")
    turned = u.join(ref, by).withColumn("a3", F.when(dot(a3, r) < 0, scale(a3, -1)).otherwise(a3))
    return turned.groupBy(*by).agg(mean(F.col("a3")).alias("a3")).withColumn("a3", unit(F.col("a3")))


def periodic_centre(mono: DataFrame, by: list[str], box: float) -> DataFrame:
    """Centre of mass on circles of circumference ``box``."""
    k = 2 * math.pi / box
    p = F.col("p")
    sums = [f(p[a] * k).alias(f"{n}{a}") for a in "xyz"
            for f, n in ((lambda c: F.avg(F.sin(c)), "s"), (lambda c: F.avg(F.cos(c)), "c"))]
    return mono.groupBy(*by).agg(*sums).select(*by, vec(*[
        (F.atan2(-F.col("s" + a), -F.col("c" + a)) + math.pi) / k for a in "xyz"]).alias("p"))


def wrapped(p: Column, box: float, centre_at: float | None = None) -> Column:
    """Image of ``p`` in the box around ``centre_at`` (default: box middle)."""
    shift = box / 2 - (box / 2 if centre_at is None else centre_at)
    return vec(*[F.pmod(p[a] + shift, F.lit(float(box))) - shift for a in "xyz"])


def wrap_monomers(mono: DataFrame, box: float, centre_at: float | None = None) -> DataFrame:
    return mono.withColumn("p", wrapped(F.col("p"), box, centre_at))


def wrap_strands(mono: DataFrame, by: list[str], box: float,
                 centre_at: float | None = None) -> DataFrame:
    """Move whole strands so that their centres lie in the box."""
    c = centre(mono, by).select(*by, sub(wrapped(F.col("p"), box, centre_at), F.col("p"))
                                .alias("_by"))
    return mono.join(c, by).withColumn("p", add(F.col("p"), F.col("_by"))).drop("_by")


def centre_frames(mono: DataFrame, by: list[str], box: float, to: float | None = None) -> DataFrame:
    """Put each configuration's periodic centre on ``to`` (default: box middle), then wrap."""
    goal = box / 2 if to is None else to
    c = periodic_centre(mono, by, box).withColumnRenamed("p", "_c")
    moved = mono.join(c, by).withColumn("p", add(F.col("p"), sub(vec(goal, goal, goal),
                                                                F.col("_c")))).drop("_c")
    return wrap_monomers(moved, box, goal)


def bounds(mono: DataFrame, by: list[str]) -> DataFrame:
    """Extent per axis; anything below 2 counts as 2.5."""
    p = F.col("p")
    size = lambda a: F.max(p[a]) - F.min(p[a])
    return mono.groupBy(*by).agg(*[F.when(size(a) < 2, 2.5).otherwise(size(a)).alias(a)
                                   for a in "xyz"])


__all__ = ["centre", "selection_centre", "mean_orientation", "mean_a3", "periodic_centre",
           "wrapped", "wrap_monomers", "wrap_strands", "centre_frames", "bounds", "norm"]
