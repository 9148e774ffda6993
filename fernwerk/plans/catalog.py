"""All queries of the library and the SQL that checks them."""

from __future__ import annotations

from fernwerk.plans import credits, flagship, layers, records, routes

_MODULES = (flagship, credits, layers, routes, records)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in _MODULES for k, s in m.ORACLES.items()}
