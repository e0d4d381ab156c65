"""Text input with line numbers, for splittable files of any size."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 0), line, for a directory of text files.

    ``file`` is the ``file=<name>`` folder if there is one, else the path below the folder that
    ``path`` names (up to its first wildcard). Parts of a file are taken by the number in their
    name. Line numbers come from the order inside each input split plus the line counts of the
    splits before it: one small aggregate, no sort of the lines.
    """
    return numbered_lines(spark, path).drop("first_of_part")


def split_lines(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """file, _path, _start, line: lines that end at ``separator``, with the input split they stand in."""
    raw = spark.read.text(path, lineSep=separator)
    if "file" in raw.columns:
        name = F.col("file").cast("string")
    else:
        name = below("_metadata.file_path", path)
    return raw.select(name.alias("file"), F.col("_metadata.file_path").alias("_path"),
                      F.col("_metadata.file_block_start").alias("_start"), F.col("value").alias("line"))


def part_number(path: Column) -> Column:
    """The number in the name of a stored part of a file."""
    return F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"^part-(\d+)", 1).try_cast("bigint")


def numbered_lines(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """``read_lines`` with lines that end at ``separator``, and first_of_part for the first line of each
    stored part of a file."""
    raw = split_lines(spark, path, separator).withColumn("_mid", F.monotonically_increasing_id())
    key = ["file", "_path", "_start"]
    splits = raw.groupBy(*key).agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("file").orderBy(part_number(F.col("_path")), "_path", "_start").rowsBetween(
        W.unboundedPreceding, -1)
    splits = splits.select(*key, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0))
                           .alias("_off"))
    return raw.join(splits, key).select(
        "file", (F.col("_off") + F.col("_mid") - F.col("_first")).alias("line_no"), "line",
        ((F.col("_start") == 0) & (F.col("_mid") == F.col("_first"))).alias("first_of_part"))


def below(file_path: str, path: str) -> Column:
    """The file's path below the folder part of ``path``; its name if ``path`` is the file."""
    fixed = re.split(r"[*?\[{]", path)[0]
    folder = fixed if fixed == path else fixed.rpartition("/")[0]
    folder = re.sub(r"^\w+:/+|^/+", "", folder).rstrip("/")
    at = F.instr(file_path, f"{folder}/")
    rest = F.substring(file_path, at + len(folder) + 1, F.length(file_path))
    return F.when((at > 0) & (rest != ""), rest).otherwise(F.element_at(F.split(file_path, "/"), -1))


def fields(line: Column) -> Column:
    """Whitespace-separated fields."""
    return F.filter(F.split(F.trim(line), r"\s+"), lambda x: x != "")


def number(value: Column) -> Column:
    return value.try_cast("double")


def whole(value: Column) -> Column:
    return value.try_cast("bigint")


def blocks(lines: DataFrame, group: list[str], starts: Column, name: str = "block",
           parts: int | None = None) -> DataFrame:
    """Number the blocks of lines that begin where ``starts`` holds; lines before the first get 0."""
    from molframe.plans.ordered import islands
    return islands(lines, group, "line_no", starts, name, parts=parts)
