"""Registered queries against their SQL. LIGHT ones always; all of them with CASHTRAIL_ALL=1."""

import os

import pytest

import __spark_entry__ as entry
from compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
LIGHT = ("recurring_cashpoints", "canonical_city", "account_totals", "account_features", "chain_timing", "history_cut", "velocity_by_case",
         "split_by_case", "case_graph_nodes", "components", "forward_surface", "alerts", "surface_roll_up", "case_notes", "triage",
         "custody_chain", "certificates", "roc_auc", "replay_hits", "stream_burst_windows")
NAMES = sorted(entry.queries()) if os.environ.get("CASHTRAIL_ALL") else LIGHT


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_comparison_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    rows = [tuple(r) for r in df.collect()]
    if name in entry.oracle_sql():
        cur = con.execute(entry.oracle_sql()[name])
        assert compare(rows, df.columns, cur.fetchall(), [c[0] for c in cur.description]) == ""
