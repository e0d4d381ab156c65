"""Convex regions given by planes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def inside(p: Column, planes: list[tuple[float, float, float, float]]) -> Column:
    """True where n . p + d >= 0 for every plane (nx, ny, nz, d)."""
    tests = [p["x"] * nx + p["y"] * ny + p["z"] * nz + d >= 0 for nx, ny, nz, d in planes]
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out
