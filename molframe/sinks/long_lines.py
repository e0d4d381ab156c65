"""Lines longer than a value: a data source for text whose lines come and go in parts.

Rows are (file, line_no, part, text, last): the texts of a line in the order of ``part``, and a line end
behind the last one only. Files lie as ``file=<name>/part-<n>.txt`` and are written by many tasks; put
together by name they are the file. Reading takes ranges of bytes, so neither way holds a whole line.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from molframe.plans.ordered import running
from molframe.session import materialise, scratch, shuffles_deleted

NAME = "long_lines"
COLUMNS = ["file", "line_no", "part", "text", "last"]
#: Bytes of a range, and bytes of text of one row read.
RANGE, BLOCK = 64 << 20, 1 << 18
#: Most files of one task.
FILES = 256
_BRIEF = "file string, stored int, start long, head boolean, ends long, full long, tail boolean, first string"
_READ = "file string, stored int, start long, k long, text string, starts boolean, ends boolean"


def _store(path: str):
    """The file system of a path (file, hdfs, s3 and so on) and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


@dataclass
class _Written(WriterCommitMessage):
    moves: list[tuple[str, str]]


class _Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator) -> _Written:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        store, root = _store(self.path)
        now, out, moves = None, None, []
        for row in iterator:
            if row.file != now:
                if out is not None:
                    out.close()
                now, folder = row.file, f"{root}/file={quote(row.file, safe='')}"
                store.create_dir(folder, recursive=True)
                # an attempt that is lost leaves a hidden file that no reader sees
                moves.append((f"{folder}/.{uuid.uuid4().hex}", f"{folder}/part-{number:05d}.txt"))
                out = store.open_output_stream(moves[-1][0])
            out.write((row.text + ("\n" if row.last else "")).encode())
        if out is not None:
            out.close()
        return _Written(moves)

    def commit(self, messages) -> None:
        store, _ = _store(self.path)
        for m in messages:
            for source, target in m.moves if m else ():
                store.move(source, target)

    def abort(self, messages) -> None:
        store, _ = _store(self.path)
        for m in messages:
            for source, _target in m.moves if m else ():
                store.delete_file(source)


@dataclass
class _Range:
    file: str
    stored: int
    path: str
    start: int
    end: int
    before: str | None


@dataclass
class _Task(InputPartition):
    ranges: list[_Range]


class _Reader(DataSourceReader):
    def __init__(self, path: str, size: int, block: int, brief: bool = False):
        self.path, self.size, self.block, self.brief = path, size, block, brief

    def partitions(self) -> list[_Task]:
        from pyarrow import fs

        store, root = _store(self.path)
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.is_file and f.size and not f.base_name.startswith((".", "_")))
        out, last = [], {}
        for path, size in files:
            folder = path[len(root):].strip("/").split("/")[0]
            name = unquote(folder[5:]) if folder.startswith("file=") else folder
            stored, before = last.get(name, (0, None))
            last[name] = stored + 1, path
            out += [_Range(name, stored, path, at, min(at + self.size, size), before)
                    for at in range(0, size, self.size)]
        # small files share a task; opening one costs as much as some text
        tasks, room = [], 0
        for r in out:
            cost = r.end - r.start + self.size // FILES
            if cost > room:
                tasks.append(_Task([]))
                room = self.size + self.size // FILES
            tasks[-1].ranges.append(r)
            room -= cost
        return tasks

    def read(self, partition: _Task) -> Iterator[tuple]:
        store, _ = _store(self.path)
        for r in partition.ranges:
            rows = self.pieces(store, r)
            yield from [self.summary(r, rows)] if self.brief else rows

    def summary(self, r: _Range, rows: Iterator[tuple]) -> tuple:
        """One row of a range: whether the texts before its first and behind its last line end are more than blanks,
        how many line ends it has, how many lines in between are more than blanks, and its first piece."""
        head = tail = False
        ends, full, first = 0, 0, None
        for *_, text, _starts, last in rows:
            first = text if first is None else first
            tail = tail or text.strip(" ") != ""
            if last:
                head, full = (tail, full) if not ends else (head, full + tail)
                ends, tail = ends + 1, False
        return (r.file, r.stored, r.start, tail if not ends else head, ends, full, tail, first)

    def pieces(self, store, partition: _Range) -> Iterator[tuple]:

        def byte(path, at):
            with store.open_input_file(path) as f:
                return f.read_at(1, at if at >= 0 else f.size() + at)
        with store.open_input_file(partition.path) as f:
            total = f.size()
            more = lambda at: at < total and 0x80 <= f.read_at(1, at)[0] < 0xC0
            # a character belongs to the range of its first byte
            start, end = partition.start, partition.end
            while more(start):
                start += 1
            while more(end):
                end += 1
            if partition.start:
                starts = f.read_at(1, partition.start - 1) == b"\n"
            else:
                starts = partition.before is None or byte(partition.before, -1) == b"\n"
            k = 0
            while start < end:
                stop = min(start + self.block, end)
                while stop < end and more(stop):
                    stop += 1
                lines = f.read_at(stop - start, start).decode().split("\n")
                for i, text in enumerate(lines):
                    ends = i < len(lines) - 1
                    if text or ends:
                        yield (partition.file, partition.stored, partition.start, k, text, starts, ends)
                        k, starts = k + 1, ends
                start = stop


class LongLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return _BRIEF if "brief" in self.options else _READ

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], int(self.options.get("range", RANGE)), int(self.options.get("block", BLOCK)),
                       "brief" in self.options)

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"])


def write_parts(lines: DataFrame, path: str) -> None:
    """Write rows of ``COLUMNS``; a large file, or a long line, becomes several stored parts in order."""
    lines.sparkSession.dataSource.register(LongLines)
    # the range shuffle samples its input, so that is stored first
    with scratch():
        stored = materialise(lines.select(*COLUMNS), "parts")
        with shuffles_deleted(lines.sparkSession):
            stored.repartitionByRange("file", "line_no", "part").sortWithinPartitions("file", "line_no", "part").write.format(
                NAME).mode("append").save(path)


def count_lines(spark: SparkSession, path: str, size: int = RANGE, block: int = BLOCK) -> DataFrame:
    """file, n (lines that are more than blanks), first (the first piece of the first line) of every file below ``path``.

    A range comes as one row, so text is neither stored nor shuffled.
    """
    spark.dataSource.register(LongLines)
    raw = materialise(spark.read.format(NAME).option("path", path).option("range", size).option("block", block)
                      .option("brief", "yes").load(), "counted")
    before = W.partitionBy("file").orderBy("stored", "start").rowsBetween(W.unboundedPreceding, -1)
    here = raw.withColumn("_line", F.coalesce(F.sum((F.col("ends") > 0).cast("int")).over(before), F.lit(0)))
    # a line that goes over ranges: behind the last line end of one, up to the first one of a later range
    over = here.select("file", F.explode(F.array(
        F.struct("_line", F.col("head").alias("text")),
        F.struct((F.col("_line") + (F.col("ends") > 0).cast("int")).alias("_line"), F.col("tail").alias("text")))).alias("x"))
    over = over.groupBy("file", "x._line").agg(F.bool_or("x.text").alias("text")).groupBy("file").agg(
        F.count_if("text").alias("_over"))
    per = raw.groupBy("file").agg(F.sum("full").alias("_full"), F.max(F.when(
        (F.col("stored") == 0) & (F.col("start") == 0), F.col("first"))).alias("first"))
    return per.join(over, "file").select("file", (F.col("_full") + F.col("_over")).alias("n"), "first")


def read_pieces(spark: SparkSession, path: str, size: int = RANGE, block: int = BLOCK) -> DataFrame:
    """file, line_no, at (letters of the line before this piece), text, last, of every line below ``path``."""
    spark.dataSource.register(LongLines)
    raw = materialise(spark.read.format(NAME).option("path", path).option("range", size).option("block", block).load(), "ranges")
    # a row per range
    ranges = raw.groupBy("file", "stored", "start").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("file").orderBy("stored", "start").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.select("file", "stored", "start", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    d = raw.join(ranges, ["file", "stored", "start"]).withColumn("n", F.col("_off") + F.col("k"))
    d = d.withColumn("_len", F.length("text").cast("bigint"))
    d = materialise(running(d, ["file"], "n", sums={"_lines": F.col("starts").cast("bigint"), "_to": F.col("_len")}), "sums")
    d = running(d, ["file"], "n", lasts={"_base": F.when(F.col("starts"), F.col("_to") - F.col("_len"))})
    return d.select("file", (F.col("_lines") - 1).alias("line_no"), (F.col("_to") - F.col("_len") - F.col("_base")).alias("at"),
                    "text", F.col("ends").alias("last"))


def as_parts(lines: DataFrame) -> DataFrame:
    """Lines (file, line_no, line) that are one part each."""
    return lines.select("file", F.col("line_no").cast("bigint").alias("line_no"), F.lit(0).cast("bigint").alias("part"),
                        F.col("line").alias("text"), F.lit(True).alias("last"))
