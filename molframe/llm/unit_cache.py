"""Per-worker cache for values of short text units, bounded by two generations."""

from __future__ import annotations


class UnitCache(dict):
    """``cache[unit]`` computes a missing value once and keeps the units in use.

    At ``limit`` entries the present generation becomes the old one and the former old one goes;
    units met again move back. A worker so holds at most twice ``limit`` entries.
    """

    def __init__(self, compute, limit: int = 200_000):
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, unit):
        value = self.old.get(unit)
        if value is None:
            value = self.compute(unit)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        # very long units are rare and would fill the memory
        if len(unit) <= 200:
            self[unit] = value
        return value


_state: dict = {}


def once(key, build):
    """The object of ``key`` in this Python worker, built at its first use.

    Workers serve one operator after another: only the last object stays, so that the caches of
    earlier operators do not pile up.
    """
    if key not in _state:
        _state.clear()
        _state[key] = build()
    return _state[key]
