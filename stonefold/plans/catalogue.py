"""All queries over the driver's tables, by name, with the SQL they are held against."""

from __future__ import annotations

from stonefold.plans import analysis, records, storage

QUERIES = storage.query.queries | analysis.query.queries | records.query.queries
ORACLE_SQL = storage.query.oracle_sql | analysis.query.oracle_sql | records.query.oracle_sql
