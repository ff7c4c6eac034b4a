"""All queries of the engine by name, and the SQL that checks them."""

from __future__ import annotations

from . import market, records, research, validation

_MODULES = (market, validation, research, records)

QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL: dict[str, str] = {k: v for m in _MODULES for k, v in m.SQL.items()}
