"""The queries over the evidence model and their SQL twins; each module of ``plans`` adds its own."""

from __future__ import annotations

from silexa.plans import changes, edits, evidence, facets, judged, measures, passages, relational, surface, texts

QUERIES = {**relational.QUERIES, **evidence.QUERIES, **texts.QUERIES, **facets.QUERIES, **measures.QUERIES, **passages.QUERIES, **changes.QUERIES, **judged.QUERIES, **edits.QUERIES, **surface.QUERIES}
ORACLE_SQL = {**relational.ORACLE_SQL, **evidence.ORACLE_SQL, **texts.ORACLE_SQL, **facets.ORACLE_SQL, **measures.ORACLE_SQL, **passages.ORACLE_SQL, **changes.ORACLE_SQL, **judged.ORACLE_SQL, **edits.ORACLE_SQL, **surface.ORACLE_SQL}
