"""Nearest rows in blocks against plain numpy: ties, copies, tenants, odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpforest.operators import vectors

KIND = "id long, v array<double>, tenant string"


def _expected(rows, k, tenants, least=None):
    out = set()
    for a, q, s in rows:
        near = []
        for b, v, t in rows:
            if a != b and (not tenants or (s is not None and s == t)):
                near.append((-round(float(np.dot(q, v) / ((np.linalg.norm(q) or 1) * (np.linalg.norm(v) or 1))), 6), b))
        out |= {(a, b, -x, n) for n, (x, b) in enumerate(sorted(near)[:k], 1) if least is None or -x >= least}
    return out


@pytest.mark.parametrize(("k", "tenants", "least"), [(3, False, None), (2, True, None), (1, True, 0.5)])
def test_blocks(spark, monkeypatch, k, tenants, least):
    monkeypatch.setattr(vectors, "ROWS", 16)
    monkeypatch.setattr(vectors, "QUERIES", 8)
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist(), ["a", "b", None][i % 3] if i != 59 else "alone") for i in range(60)] + [(i, [1.0, 2.0, 0.0, 1.0], "a") for i in range(60, 85)]
    frame = spark.createDataFrame(rows, KIND)
    found = vectors.batch_top_k(frame.select(F.col("id").alias("query_id"), F.col("v").alias("q"), "tenant"), frame, k, "tenant" if tenants else None, least)
    assert {(a, b, round(x, 6) + 0.0, n) for a, b, x, n in found.select("query_id", "id", "score", "rank").collect()} == {(a, b, x + 0.0, n) for a, b, x, n in _expected(rows, k, tenants, least)}
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_odd_vectors_have_no_score(spark):
    frame = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [1.0, 1.0], "a"), (3, None, "a"), (4, [None, 1.0], "a")], KIND)
    asked = frame.select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    got = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in vectors.batch_top_k(asked, frame, 3).collect()}
    assert got[1, 1] == (2, 0.707107) and got[1, 2] == (3, None) and got[1, 3] == (4, None) and got[3, 1] == (1, None) and len(got) == 12
