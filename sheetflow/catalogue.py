"""Every query of the core engine and the SQL it is checked against."""

from __future__ import annotations

from .queries import comparing, exporting, loading, replicating, syncing, validation

MODULES = (validation, loading, exporting, comparing, replicating, syncing)

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
