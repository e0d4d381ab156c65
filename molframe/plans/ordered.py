"""Ordered operators that never put a whole group into one task.

``dense_index`` numbers rows with one range shuffle. Once rows carry a dense position, every
other ordered operator works on fixed-size chunks of it: ``neighbours`` copies a halo of border
rows into the next chunk, ``running`` adds the carry of the earlier chunks to a scan inside
each chunk. A group that holds a third of all rows is thus spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from molframe.session import materialise

CHUNK = 1 << 16
#: Rows of a few numbers that a broadcast holds in some 50 MB.
FEW_ROWS = 500_000

#: Rows that one task sorts.
TASK_ROWS = 500_000


def parts_for(spark: SparkSession, rows: int) -> int:
    """Shuffle partitions of at most ``TASK_ROWS`` rows, which a task sorts in memory."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def few_or_merged(table: DataFrame) -> DataFrame:
    """A stored table as one side of a join: broadcast by its count, as files tell little of the size in memory."""
    return F.broadcast(table) if table.count() <= FEW_ROWS else table.hint("merge")


def dense_index(df: DataFrame, group: list[str], order: list[str],
                id_col: str = "id", pos_col: str = "pos", len_col: str = "len",
                parts: int | None = None) -> DataFrame:
    """Global row number, position inside the group and group size, all from 0.

    ``group + order`` must be unique. The range shuffle balances by the full key, so hot
    groups are split; what is broadcast is one row per range partition, at most the session's
    shuffle partitions or ``parts`` (fewer where AQE joins small ones). Sizes of few groups are
    broadcast too, so the rows are shuffled once.
    """
    keys = [*group, *order]
    ranged = (df.repartitionByRange(*([parts] if parts else []), *keys)
                .sortWithinPartitions(*keys)
                .withColumn("_mid", F.monotonically_increasing_id()))
    stored = materialise(ranged, "ranged")
    rows = (stored.withColumn("_part", F.shiftright("_mid", 33))
            .withColumn("_idx", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = (rows.groupBy("_part").agg((F.max("_idx") + 1).alias("_n"))
             .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")))
    numbered = (rows.join(F.broadcast(parts), "_part")
                .withColumn(id_col, F.col("_off") + F.col("_idx")))
    if not group:
        return _of(stored, numbered.withColumn(pos_col, F.col(id_col)).drop("_mid", "_part", "_idx", "_off"))
    sizes = materialise(numbered.groupBy(*group).agg(
        F.min(id_col).alias("_first"), F.count(F.lit(1)).alias(len_col)), "sizes")
    return _of(stored, numbered.join(few_or_merged(sizes), group)
               .withColumn(pos_col, F.col(id_col) - F.col("_first"))
               .drop("_mid", "_part", "_idx", "_off", "_first"))


def _of(stored: DataFrame, table: DataFrame) -> DataFrame:
    """``table`` with the folder of ``stored``, which goes with it."""
    table._stored_at = stored._stored_at
    return table


def chunk_of(pos: Column, chunk: int) -> Column:
    return F.floor(pos / F.lit(chunk)).cast("bigint")


def neighbours(df: DataFrame, group: list[str], pos: str, outs: dict[str, tuple[Column, int]],
               chunk: int = CHUNK) -> DataFrame:
    """``lag`` / ``lead`` over a dense position: ``outs[name] = (value, offset)``.

    A negative offset looks back. One shuffle by (group, chunk).
    """
    halo = max(abs(o) for _, o in outs.values())
    p = F.col(pos)
    home = chunk_of(p, chunk)
    spread = df.withColumn("_chunk", F.explode(F.array_distinct(F.array(
        chunk_of(p - halo, chunk), home, chunk_of(p + halo, chunk)))))
    w = W.partitionBy(*group, "_chunk").orderBy(pos)
    for name, (value, offset) in outs.items():
        shifted = F.lag(value, -offset) if offset < 0 else F.lead(value, offset)
        spread = spread.withColumn(name, shifted.over(w))
    return spread.filter(F.col("_chunk") == home).drop("_chunk")


def running(df: DataFrame, group: list[str], pos: str, sums: dict[str, Column] | None = None,
            lasts: dict[str, Column] | None = None, chunk: int = CHUNK, parts: int | None = None) -> DataFrame:
    """Inclusive running sums and last non-null values along a dense position.

    Scan inside each chunk, then the exclusive scan over chunk totals (one row per chunk) is
    joined back. ``chunk`` bounds the rows one window holds; ``parts`` is the number of tasks that share
    the chunks, the session's shuffle partitions without it.
    """
    sums, lasts = sums or {}, lasts or {}
    here = df.withColumn("_chunk", chunk_of(F.col(pos), chunk))
    if parts:
        here = here.repartition(parts, *group, "_chunk")
    w = (W.partitionBy(*group, "_chunk").orderBy(pos)
         .rowsBetween(W.unboundedPreceding, W.currentRow))
    scanned = here
    for name, value in {**sums}.items():
        scanned = scanned.withColumn(name, F.sum(value).over(w))
    for name, value in lasts.items():
        scanned = scanned.withColumn(name, F.last(value, ignorenulls=True).over(w))
    aggs = [F.sum(v).alias(f"_c_{n}") for n, v in sums.items()]
    aggs += [F.max_by(v, F.when(v.isNotNull(), F.col(pos))).alias(f"_c_{n}")
             for n, v in lasts.items()]
    totals = here.groupBy(*group, "_chunk").agg(*aggs)
    before = W.partitionBy(*group).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    carries = totals.select(
        *group, "_chunk",
        *[F.sum(f"_c_{n}").over(before).alias(f"_c_{n}") for n in sums],
        *[F.last(f"_c_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in lasts])
    out = scanned.join(carries, [*group, "_chunk"])
    for n in sums:
        out = out.withColumn(n, F.coalesce(F.col(n), F.lit(0))
                             + F.coalesce(F.col(f"_c_{n}"), F.lit(0)))
    for n in lasts:
        out = out.withColumn(n, F.coalesce(F.col(n), F.col(f"_c_{n}")))
    return out.drop("_chunk", *[f"_c_{n}" for n in [*sums, *lasts]])


def islands(df: DataFrame, group: list[str], pos: str, starts: Column, name: str = "island",
            chunk: int = CHUNK, parts: int | None = None) -> DataFrame:
    """Number the runs that begin wherever ``starts`` is true."""
    return running(df, group, pos, sums={name: F.when(starts, 1).otherwise(0)}, chunk=chunk, parts=parts)
