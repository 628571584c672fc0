"""All queries of the core by name."""

from __future__ import annotations

from wavemill.plans import events, numbered, relations, signals, statistics

FLAGSHIP = "first_failing_rule"
_PARTS = (signals.REG, relations.REG, statistics.REG, events.REG)
QUERIES = {**numbered.QUERIES}
SQL = {**numbered.SQL}
for _part in _PARTS:
    QUERIES |= _part.queries
    SQL |= _part.sql
