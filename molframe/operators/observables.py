"""User-defined observables over frames: DataFrame transforms under a name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

_observables: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_observable(name: str, fn: Callable[[DataFrame], DataFrame]) -> None:
    """Keep a DataFrame -> DataFrame transform over frame rows under a name."""
    _observables[name] = fn


def observe(name: str, frames: DataFrame) -> DataFrame:
    """Apply a registered observable to frame rows (selection, frame, id, p ..)."""
    return _observables[name](frames)


def selected(frames: DataFrame, selections: DataFrame) -> DataFrame:
    """Frame rows of each selection (selection, id)."""
    return frames.join(selections.select("selection", "id"), "id")
