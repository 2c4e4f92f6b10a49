"""All queries of the core with their SQL, gathered from the modules of this folder."""

from __future__ import annotations

from partita.plans import corpus, notes, ordered, preferences, requests, selection, storage, streams, tokens, votes

MODULES = (votes, corpus, notes, ordered, preferences, requests, selection, storage, streams, tokens)
QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _m in MODULES:
    QUERIES |= _m.QUERIES
    ORACLE |= _m.ORACLE
FLAGSHIP = "corpus_report"
