"""Collects every registered query."""

from __future__ import annotations

from . import graph_queries, ledger_queries, place_queries, record_queries, report_queries, stream_queries  # noqa: F401
from .registry import ORACLES, QUERIES, runnable


def queries():
    return {name: runnable(name) for name in QUERIES}


def oracle_sql():
    return dict(ORACLES)
