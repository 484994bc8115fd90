"""SQL twins of the queries, for the oracle engine."""

from oracles import decisions, library, pixels, planning, records

ORACLES: dict[str, str] = {}
for _module in (decisions, library, planning, pixels, records):
    ORACLES.update(_module.SQL)
