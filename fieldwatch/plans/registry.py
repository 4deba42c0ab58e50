"""All queries of the core, by name."""

from __future__ import annotations

from fieldwatch.plans import activity, detector, evaluation, forecasting, formats, quality

_MODULES = [activity, detector, forecasting, evaluation, formats, quality]
QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
SQL = {name: q for m in _MODULES for name, q in m.SQL.items()}
