"""The library's queries over the driver's tables, and the SQL that gives the same rows.

No table holds packets, so ``virtual`` makes a capture of the events: each event is a
frame, built as bytes and then decoded by the operators of the library. The SQL states
the expected rows from the events themselves.
"""

from __future__ import annotations

from . import stream_queries, virtual_queries

FLAGSHIP = "capture_totals"
QUERIES = virtual_queries.QUERIES | stream_queries.QUERIES
ORACLE_SQL = virtual_queries.ORACLE_SQL | stream_queries.ORACLE_SQL
