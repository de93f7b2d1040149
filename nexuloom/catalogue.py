"""All registered queries and their SQL, collected from the modules of ``nexuloom.plans``."""

from __future__ import annotations

from .plans import analytics, building, files, kg, linking, ontology, search

FLAGSHIP = "ctx_kept"
QUERIES: dict = {}
ORACLES: dict = {}
for _m in (kg, ontology, analytics, search, files, building, linking):
    QUERIES |= _m.QUERIES
    ORACLES |= _m.ORACLES
