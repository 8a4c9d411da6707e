"""Registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from . import extended, features, library, observability, workload

QUERIES = workload.QUERIES | library.QUERIES | observability.QUERIES | extended.QUERIES | features.QUERIES
ORACLE_SQL = workload.ORACLE_SQL | library.ORACLE_SQL | observability.ORACLE_SQL | extended.ORACLE_SQL | features.ORACLE_SQL
