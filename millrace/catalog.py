"""Named queries of the library's own operators, with the SQL that each must agree with."""

from __future__ import annotations

from .plans import analysis, edits, inventory, more, paths, records, streams, tables, texts

MODULES = (tables, inventory, analysis, edits, more, records, paths, streams, texts)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in MODULES for k, s in m.ORACLE.items()}
