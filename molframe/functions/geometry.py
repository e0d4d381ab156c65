"""3-vector arithmetic on struct<x,y,z> columns; everything stays inside codegen."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def vec(x, y, z) -> Column:
    cols = [v if isinstance(v, Column) else F.lit(float(v)) for v in (x, y, z)]
    return F.named_struct(*[e for c, n in zip(cols, "xyz") for e in (F.lit(n), c.cast("double"))])


def _map(f, *vs: Column) -> Column:
    return vec(*[f(*[v[a] for v in vs]) for a in "xyz"])


def add(u: Column, v: Column) -> Column:
    return _map(lambda a, b: a + b, u, v)


def sub(u: Column, v: Column) -> Column:
    return _map(lambda a, b: a - b, u, v)


def scale(u: Column, k) -> Column:
    k = k if isinstance(k, Column) else F.lit(float(k))
    return _map(lambda a: a * k, u)


def dot(u: Column, v: Column) -> Column:
    return u["x"] * v["x"] + u["y"] * v["y"] + u["z"] * v["z"]


def cross(u: Column, v: Column) -> Column:
    return vec(u["y"] * v["z"] - u["z"] * v["y"],
               u["z"] * v["x"] - u["x"] * v["z"],
               u["x"] * v["y"] - u["y"] * v["x"])


def norm(u: Column) -> Column:
    return F.sqrt(dot(u, u))


def unit(u: Column) -> Column:
    return scale(u, 1.0 / norm(u))


def dist2(u: Column, v: Column) -> Column:
    return ((u["x"] - v["x"]) * (u["x"] - v["x"]) + (u["y"] - v["y"]) * (u["y"] - v["y"])
            + (u["z"] - v["z"]) * (u["z"] - v["z"]))


def dist(u: Column, v: Column) -> Column:
    return F.sqrt(dist2(u, v))


def rotate(u: Column, axis: Column, angle) -> Column:
    """Rodrigues rotation of ``u`` about the unit vector ``axis`` by ``angle`` radians."""
    angle = angle if isinstance(angle, Column) else F.lit(float(angle))
    c, s = F.cos(angle), F.sin(angle)
    k = dot(axis, u) * (1 - c)
    w = cross(axis, u)
    return vec(*[u[a] * c + w[a] * s + axis[a] * k for a in "xyz"])


def mean(u: Column) -> Column:
    """Aggregate: component-wise mean."""
    return F.struct(*[F.avg(u[a]).alias(a) for a in "xyz"])


def flat(u: Column, prefix: str = "", places: int = 4) -> list[Column]:
    """Rounded x, y, z output columns; adding 0.0 removes negative zero."""
    return [r(u[a], places).alias(prefix + a) for a in "xyz"]


def r(c: Column, places: int = 4) -> Column:
    return F.round(c.cast("double"), places) + F.lit(0.0)


def r_near(c: Column, places: int = 4) -> Column:
    """``r`` of values from 0 to 10^9, by products: ``round`` makes a decimal of each value."""
    return F.floor(c * 10.0 ** places + 0.5) / F.lit(10.0 ** places)


def js_round(c: Column) -> Column:
    """Halves round up."""
    return F.floor(c + 0.5).cast("bigint")


DEGREE = math.pi / 180.0
