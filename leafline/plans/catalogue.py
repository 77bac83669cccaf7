"""All registered queries and the SQL that must give the same rows."""

from __future__ import annotations

from leafline.plans import boxes, jobs, relational, review, sequences, texts, writings

QUERIES = {}
ORACLE_SQL = {}
for module in (relational, review, sequences, boxes, texts, jobs, writings):
    QUERIES |= module.QUERIES
    ORACLE_SQL |= module.ORACLE_SQL
