"""Registry: ID -> query over the driver's tables, and its oracle SQL."""

from __future__ import annotations

import re

from molframe.adapters import VIEWS

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def oracle(body: str) -> str:
    """Put the views that ``body`` names (directly or through others) before it."""
    needed: list[str] = []

    def visit(text: str):
        for name, view in VIEWS.items():
            if name not in needed and re.search(rf"\b(?:FROM|JOIN|,)\s+{name}\b", text):
                visit(view)
                if name not in needed:
                    needed.append(name)

    visit(body)
    own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", body, re.I)
    ctes = ", ".join(f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in needed)
    if not ctes:
        return body
    if own:
        return f"WITH RECURSIVE {ctes}, {body[own.end():]}"
    return f"WITH RECURSIVE {ctes} {body}"


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is its oracle, left out where plain SQL cannot say it."""
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return fn
    return add


def r4(expr: str, places: int = 4) -> str:
    return f"(round(({expr})::DOUBLE, {places}) + 0.0)"
