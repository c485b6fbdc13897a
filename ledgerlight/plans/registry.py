"""All queries over the driver's tables and their SQL."""

from __future__ import annotations

from . import evidence, facts, figures, grids, layouts, relational, reports, spans, streams, tables

_MODULES = (evidence, facts, relational, figures, grids, layouts, reports, spans, streams, tables)
QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES: dict = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
FLAGSHIP = "d1_evidence_packets"
