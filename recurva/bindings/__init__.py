"""Every operator bound to the test tables, next to the SQL that must give the same rows."""

from recurva.bindings import ingest, metrics, reports, resolution, series

_PARTS = (metrics, series, ingest, resolution, reports)

QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
