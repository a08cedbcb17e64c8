"""All queries of the knowledge-base engine: name -> function of (spark, sf_dir), name -> SQL."""

from __future__ import annotations

from quillstone.plans import authoring, bookkeeping, checks, documents, events, lifecycle, maintenance, overtime, provenance, quality, reports, retrieval, serving, streams, upkeep, walking, workspace, writing

QUERIES, ORACLE = {}, {}
for _part in (retrieval, quality, events, provenance, workspace, documents, authoring, lifecycle, bookkeeping, maintenance, overtime, checks, reports, serving, writing, walking, upkeep, streams):
    QUERIES |= _part.QUERIES
    ORACLE |= _part.ORACLE
