"""All queries of the core."""

from __future__ import annotations

from pagelens.plans import gate, pages, raster, redaction, sessions, spatial, streams, telemetry, training, views

PARTS = (training, pages, telemetry, spatial, redaction, gate, raster, streams, sessions, views)


def queries() -> dict:
    return {k: f for part in PARTS for k, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for part in PARTS for k, s in part.SQL.items()}
