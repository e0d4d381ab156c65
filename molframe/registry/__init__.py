"""All registered queries."""

import importlib
import pkgutil

from molframe.registry.core import ORACLES, QUERIES

for _m in pkgutil.iter_modules(__path__):
    importlib.import_module(f"{__name__}.{_m.name}")

__all__ = ["ORACLES", "QUERIES"]
