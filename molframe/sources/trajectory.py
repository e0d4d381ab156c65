"""Trajectory files to frame and coordinate tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from molframe.functions.geometry import vec
from molframe.plans.ordered import CHUNK, dense_index, running
from molframe.sources.lines import fields, number, read_lines, whole

HEADER = 3


def framed_lines(lines: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Adds ``frame`` (from 0) and ``row`` (line inside the frame). Frames start at ``t = ``.

    A scan over fixed chunks of lines finds the frames, so neither a long file nor a large frame
    has to fit one row or one task.
    """
    starts = F.col("line").startswith("t ") | F.col("line").startswith("t=")
    out = running(lines, ["file"], "line_no", sums={"frame": F.when(starts, 1).otherwise(0)},
                  lasts={"_at": F.when(starts, F.col("line_no"))}, chunk=chunk)
    return out.filter(F.col("frame") > 0).select(
        "file", (F.col("frame") - 1).alias("frame"), (F.col("line_no") - F.col("_at")).alias("row"),
        "line")


def read_frames(lines: DataFrame) -> DataFrame:
    """Frame table: file, frame, time, box, n (monomer rows), n_bytes."""
    rows = framed_lines(lines)
    value = F.trim(F.regexp_replace("line", "^[^=]*=", ""))
    b = F.max(F.when(F.col("row") == 1, value))
    f = rows.groupBy("file", "frame").agg(
        F.max(F.when(F.col("row") == 0, value)).alias("_t"), b.alias("_b"),
        F.count_if((F.col("row") >= HEADER) & (F.trim("line") != "")).alias("n"),
        F.sum(F.octet_length("line") + 1).alias("n_bytes"))
    box = fields(F.col("_b"))
    return f.select("file", "frame", whole(F.col("_t")).alias("time"),
                    vec(*[number(F.get(box, F.lit(i))) for i in range(3)]).alias("box"),
                    "n", "n_bytes")


def read_coords(lines: DataFrame) -> DataFrame:
    """Coordinate rows of all frames: file, frame, id, p, a1, a3, v, l."""
    rows = framed_lines(lines).filter((F.col("row") >= HEADER) & (F.trim("line") != ""))
    x = [number(F.get("f", F.lit(i))) for i in range(15)]
    return rows.withColumn("f", fields(F.col("line"))).select(
        "file", "frame", (F.col("row") - HEADER).alias("id"),
        *[vec(*x[3 * k:3 * k + 3]).alias(n) for k, n in enumerate(("p", "a1", "a3", "v", "l"))])


def read_trajectory(spark: SparkSession, path: str, sizes: DataFrame | None = None
                    ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(coords, frames, rejected frames). ``sizes``: file, n_monomers; a shorter frame is rejected."""
    lines = read_lines(spark, path)
    frames, coords = read_frames(lines), read_coords(lines)
    if sizes is None:
        return coords, frames, frames.limit(0)
    checked = frames.join(sizes, "file", "left")
    short = F.col("n") < F.col("n_monomers")
    good = checked.filter(F.coalesce(~short, F.lit(True))).drop("n_monomers")
    return (coords.join(good.select("file", "frame"), ["file", "frame"], "left_semi"), good,
            checked.filter(short).drop("n_monomers"))


def catalogue(frames: DataFrame) -> DataFrame:
    """Frame index ordered by time: file, ordinal, frame, time, n, n_bytes, offset (bytes before).

    Store it with the coordinates partitioned by file; it replaces seeking by byte offset.
    """
    f = dense_index(frames, ["file"], ["time", "frame"], pos_col="ordinal").drop("id", "len")
    out = running(f, ["file"], "ordinal", sums={"_end": F.col("n_bytes")})
    return out.select("file", "ordinal", "frame", "time", "n", "n_bytes",
                      (F.col("_end") - F.col("n_bytes")).alias("offset"))


def write_coords(coords: DataFrame, path: str) -> None:
    """Store coordinates so that (file, frame) filters prune files and row groups."""
    (coords.repartitionByRange("file", "frame", "id").sortWithinPartitions("file", "frame", "id")
     .write.partitionBy("file").parquet(path))


def read_xyz(spark: SparkSession, path: str) -> DataFrame:
    """Each ``x y z`` row is its own one-bead strand of type A: file, id, strand, base, p."""
    rows = read_lines(spark, path).withColumn("f", fields(F.col("line"))).filter(F.size("f") >= 3)
    kept = dense_index(rows, ["file"], ["line_no"], id_col="_g", pos_col="id")
    return kept.select("file", "id", F.col("id").alias("strand"), F.lit("A").alias("base"),
                       vec(*[number(F.get("f", F.lit(i))) for i in range(3)]).alias("p"))
