"""Every registered query by name, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from .operators import dashboard, datasets, extraction, fields, history, matching, payloads, positions, quality, records, routing, storage, windows

QUERIES = {**dashboard.QUERIES, **history.QUERIES, **records.QUERIES, **datasets.QUERIES, **routing.QUERIES, **payloads.QUERIES, **fields.QUERIES, **extraction.QUERIES, **quality.QUERIES, **positions.QUERIES, **windows.QUERIES, **matching.QUERIES, **storage.QUERIES}
ORACLES = {**dashboard.ORACLES, **history.ORACLES, **records.ORACLES, **datasets.ORACLES, **routing.ORACLES, **payloads.ORACLES, **fields.ORACLES, **extraction.ORACLES, **quality.ORACLES, **positions.ORACLES, **windows.ORACLES, **matching.ORACLES, **storage.ORACLES}
