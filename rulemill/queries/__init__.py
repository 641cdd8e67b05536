"""Registered queries of the rule operators over the driver's tables, with SQL for each that SQL can express."""

from __future__ import annotations

from . import audit, certificates, convergence, documents, graphs, knowledge, predicates, relational, rulebook, rules, streams, texts
from .registry import QUERIES, SQL


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)


_ = (audit, certificates, convergence, documents, graphs, knowledge, predicates, relational, rulebook, rules, streams, texts)
