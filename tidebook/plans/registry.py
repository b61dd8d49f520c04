"""Every query of the engine, and the SQL of those that SQL can express."""

from __future__ import annotations

from tidebook.plans import inference, market, session

FLAGSHIP = "inside_after_every_message"
QUERIES: dict = market.QUERIES | inference.QUERIES | session.QUERIES
SQL: dict[str, str] = market.SQL | inference.SQL | session.SQL
