"""Files for source queries: model tables rendered as text in the shared folder.

Lines may come as a function that makes them: what it stores on the way goes once they are written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from molframe.session import new_folder, scratch
from molframe.sinks.lines import write_lines
from molframe.sinks.long_lines import write_parts


def written(lines: DataFrame | Callable[[], DataFrame], suffix: str = ".txt", rows: int | None = None) -> str:
    """Write lines (file, line_no, line), about ``rows`` of them, and return the folder."""
    with scratch():
        lines = lines() if callable(lines) else lines
        path = new_folder(lines.sparkSession, "files")
        write_lines(lines, path, suffix, rows)
    return path


def written_parts(*parts: DataFrame | Callable[[], DataFrame]) -> str:
    """Write lines that come in parts and return the folder; tables of different files are written one by one."""
    path = None
    for one in parts:
        with scratch():
            lines = one() if callable(one) else one
            path = path or new_folder(lines.sparkSession, "files")
            write_parts(lines, path)
    return path
