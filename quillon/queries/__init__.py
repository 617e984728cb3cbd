"""The registered queries over the given tables and the SQL that states the same results."""

from quillon.queries import evaluation, events, later, more, tables

QUERIES = {}
ORACLES = {}
for _module in (events, tables, evaluation, later, more):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
