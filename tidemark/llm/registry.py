"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from tidemark.llm import op1, op2, op3, op4, op5, op6, op7, op8, op9, op10

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for module in (op1, op2, op3, op4, op5, op6, op7, op8, op9, op10):
    QUERIES[module.NAME] = module.query
    if module.ORACLE:
        ORACLES[module.NAME] = module.ORACLE
