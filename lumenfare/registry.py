"""Every registered query of the engine and its oracle SQL."""

from __future__ import annotations

from .plans import chain, feeds, ops, repairs, service, shell, streams


QUERIES: dict = ops.QUERIES | service.QUERIES | chain.QUERIES | streams.QUERIES | repairs.QUERIES | shell.QUERIES | feeds.QUERIES
ORACLE_SQL: dict = ops.ORACLE_SQL | service.ORACLE_SQL | chain.ORACLE_SQL | streams.ORACLE_SQL | repairs.ORACLE_SQL | shell.ORACLE_SQL | feeds.ORACLE_SQL
