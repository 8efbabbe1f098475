from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from cashtrail.operators import choice
from cashtrail.plans.registry import QUERIES


def test_graph_export_reads_written_nodes_and_edges(spark):
    """The ledger view was worked out again for the edges and for every flag."""
    ledger = spark.createDataFrame([(1, 7, 1, 2, 5.0, 10, 1, 0), (2, 7, 1, 2, 6.0, 20, 1, 0), (3, 7, 2, 3, 6.0, 30, 2, 1)],
                                   "txn_id long, complaint_id long, src_account long, dst_account long, amount double, ts_s long, hop_depth int, is_terminal int")
    ledger = ledger.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("complaint_id")))
    found = QUERIES["graph_json"](SimpleNamespace(ledger=ledger, accounts=spark.createDataFrame([(1, 4, 1.0, 2.0)], "account_id long, bank_id long, lat double, lon double")))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "max_by" not in plan
    assert sorted((r.kind, r.id) for r in found.collect()) == [("edge", "2"), ("edge", "3"), ("node", "1"), ("node", "2"), ("node", "3")]


def test_sums_of_a_learning_step(spark):
    """Gradient and covariance of a batch against the formulas, per run; a step was about thirty array expressions a set before."""
    x = [[[1.0, 2.0], [0.0, 1.0], [3.0, 0.5]], [[2.0, 2.0], [1.0, 0.0]]]
    label = [[0.0, 1.0, 0.0], [0.0, 0.0]]
    batch = pa.RecordBatch.from_pydict({"runs": pa.array([[4], [4, 6]], pa.list_(pa.int32())), "label": label, "x": x})
    weights = {4: np.array([0.3, -0.2]), 6: np.zeros(2)}
    out = next(choice._step_sums(weights, [(0, 0), (0, 1), (1, 1)], True)(iter([batch]))).to_pylist()
    for row, sets in zip(out, ([0, 1], [1])):
        w, g, h = list(weights.values())[row["no"]], np.zeros(2), np.zeros((2, 2))
        for s in sets:
            terms = np.array(x[s])
            p = np.exp(terms @ w) / np.exp(terms @ w).sum()
            g += (np.array(label[s]) - p) @ terms
            h += (p[:, None] * terms).T @ terms - np.outer(p @ terms, p @ terms)
        assert row["n"] == len(sets) and np.allclose([row[f"v{j}"] for j in range(5)], [*g, h[0, 0], h[0, 1], h[1, 1]])
