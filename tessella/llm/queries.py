"""The registered queries of the text operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import audit, decontam, embeddings, licences, linededup, lmscore, mixing, pii, prefixtrie, sharding, simhash, toxicity, urlfilter

MODULES = (lmscore, urlfilter, decontam, simhash, pii, mixing, toxicity, licences, linededup, embeddings, audit, sharding, prefixtrie)

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}
