"""Every query of the core with its SQL; the subpackage llm keeps its own list."""

from __future__ import annotations

from corpuscle.plans import core, files, retrieval, texts

_PARTS = [core, retrieval, texts, files]
QUERIES = {k: f for p in _PARTS for k, f in p.QUERIES.items()}
SQL = {k: s for p in _PARTS for k, s in p.SQL.items()}
FLAGSHIP = "bm25_topk"
