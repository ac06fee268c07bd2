"""Every registered query of the library with its DuckDB counterpart."""

from __future__ import annotations

import importlib
import pkgutil

from canopyframe import queries
from canopyframe.queries.base import ORACLE_SQL, QUERIES

for _m in pkgutil.iter_modules(queries.__path__):
    importlib.import_module(f"canopyframe.queries.{_m.name}")

FLAGSHIP = "curated_class_balance"
__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
