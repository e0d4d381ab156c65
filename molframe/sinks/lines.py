"""Text output: every sink makes rows (file, line_no, line); one writer stores them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from molframe.plans.ordered import parts_for
from molframe.session import shuffles_deleted


def write_lines(lines: DataFrame, path: str, suffix: str = ".txt", rows: int | None = None) -> None:
    """Write each file as ordered part files under ``path/file=<name>/``.

    Rows are range-partitioned by (file, line_no): a large file becomes several parts whose
    names sort in line order, so reading or concatenating them by name gives the file. ``rows``: about how many
    there are, so that a task sorts no more of them where there are more.
    """
    with shuffles_deleted(lines.sparkSession):
        (lines.select("file", "line_no", "line")
         .repartitionByRange(*([parts_for(lines.sparkSession, rows)] if rows else []), "file", "line_no")
         .sortWithinPartitions("file", "line_no").select("file", "line")
         .write.partitionBy("file").option("fileExtension", suffix.lstrip(".")).text(path))


def with_header(header: DataFrame, rows: DataFrame) -> DataFrame:
    """Header (file, line) as line 0, rows (file, line_no from 0, line) after it."""
    return header.select("file", F.lit(0).cast("bigint").alias("line_no"), "line").unionByName(
        rows.select("file", (F.col("line_no") + 1).cast("bigint").alias("line_no"), "line"))
