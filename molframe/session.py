"""Shared storage: where intermediate tables and checkpoints go."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_memo: dict[tuple[str, str], DataFrame] = {}
#: Tables stored by each open ``scratch``; None where they belong to none.
_open: list[list[DataFrame] | None] = []
#: Deletes what an execution has shuffled when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach.

    A cluster names it in ``spark.checkpoint.dir``. Where neither that setting nor a checkpoint
    folder exists, a temporary one is made for a local master, and anything else is an error:
    executors do not see each other's disks.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if named is None and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = named or tempfile.mkdtemp(prefix="molframe-")
        spark.sparkContext.setCheckpointDir(named)
    return named or current


def new_folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/molframe-{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str = "table") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    The result survives lost executors and is computed once, however often it is used. What was shuffled for it
    is deleted at once, not when the driver next collects garbage.
    """
    spark = df.sparkSession
    path = new_folder(spark, tag)
    with shuffles_deleted(spark):
        df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._stored_at = path
    if _open and _open[-1] is not None:
        _open[-1].append(table)
    return table


@contextmanager
def shuffles_deleted(spark: SparkSession):
    """What is written inside leaves no shuffle files."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


class _Scratch:
    def keep(self, table: DataFrame) -> DataFrame:
        """``table``, a stored one, stays as long as an enclosing scratch."""
        mine = _open[-1]
        mine[:] = [t for t in mine if t is not table]
        if len(_open) > 1 and _open[-2] is not None:
            _open[-2].append(table)
        return table


@contextmanager
def scratch():
    """Tables stored inside are deleted at its end, but those that ``remember`` builds or that are kept.

    What is read later must be written or kept inside.
    """
    _open.append([])
    try:
        yield _Scratch()
    except BaseException:
        _open.pop()
        raise
    discard(*_open.pop())


def discard(*tables: DataFrame | None) -> None:
    """Delete stored tables that nothing reads any more, such as the superseded rounds of a loop."""
    for t in tables:
        path = getattr(t, "_stored_at", None)
        if path is not None:
            delete_folder(t.sparkSession, path)


def delete_folder(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage of an iterative job: a table written to the shared folder.

    Unlike an RDD checkpoint the table has sizes, so the next join can choose its strategy.
    """
    return materialise(df, "round")


def remember(spark: SparkSession, key: str, build) -> DataFrame:
    """Build a stored table once per application."""
    full = (spark.sparkContext.applicationId, key)
    if full not in _memo:
        _open.append(None)
        try:
            _memo[full] = build()
        finally:
            _open.pop()
    return _memo[full]


def forget(spark: SparkSession, key: str) -> None:
    """Delete the stored table of ``remember``, which is built anew if it is asked for again."""
    discard(_memo.pop((spark.sparkContext.applicationId, key), None))
