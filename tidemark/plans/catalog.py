"""Named queries over the driver's tables, and the SQL that each must agree with."""

from __future__ import annotations

from tidemark.plans import documents, facts, journal, retrieval, scoped

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for module in (documents, facts, journal, retrieval, scoped):
    QUERIES |= module.QUERIES
    ORACLES |= module.ORACLES
