"""Every named query and its SQL, gathered from the modules of this folder."""

from __future__ import annotations

from metaloom.plans import evaluation, judging, lookup, merging, normalising, ontology, records, reports, scalars, sources, texts, vectors

MODULES = (evaluation, ontology, merging, vectors, texts, reports, judging, normalising, scalars, sources, records, lookup)
FLAGSHIP = "prf_micro"

QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.ORACLES.items()}
