"""The cell index against an exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpforest.operators import cells


def _vectors(n, kind, seed=3, d=32):
    rng = np.random.default_rng(seed)
    if kind == "isotropic":
        m = rng.standard_normal((n, d))
    else:
        m = rng.standard_normal((60, d))[rng.integers(0, 60, n)] + 0.3 * rng.standard_normal((n, d))
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _brute(m, asked, k, same=lambda a, b: True):
    s = np.round(m[asked] @ m.T, 6)
    out = {}
    for i, q in enumerate(asked):
        order = sorted((j for j in range(len(m)) if j != q and same(q, j)), key=lambda j: (-s[i, j], j))[:k]
        out[q] = [(j, s[i, j]) for j in order]
    return out


def _got(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    return out


@pytest.mark.parametrize("kind", ["isotropic", "clustered"])
def test_recall_and_exact(spark, tmp_path, monkeypatch, kind):
    monkeypatch.setattr(cells, "BLOCK", 60)
    monkeypatch.setattr(cells, "PART", 7)
    monkeypatch.setattr(cells, "FIRST", 10)
    m = _vectors(4000, kind)
    m[100:400] = m[99]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, v array<double>").repartition(4)
    index = cells.build(rows, f"file://{tmp_path}/index", 40)
    asked = list(range(0, 4000, 100))
    queries = spark.createDataFrame([(i, m[i].tolist()) for i in asked], "query_id long, q array<double>")
    brute = _brute(m, asked, 5)
    assert _got(index.search(queries, 5, recall=None)) == brute
    found = _got(index.search(queries, 5, recall=0.95))
    assert np.mean([len({j for j, _ in found[q]} & {j for j, _ in brute[q]}) / 5 for q in asked]) >= 0.95
    if kind == "clustered":
        # Cells out of reach aren't read: their folders are pruned in the plan.
        plan = index._meet(index._probes(queries.limit(1).withColumn("tenant", F.lit(0)).join(_near(index), "tenant"), 5, 0.95, ()), None, 5)._jdf.queryExecution().toString()
        assert "PartitionFilters: [cell#" in plan


def _near(index):
    stats = index.spark.read.parquet(f"{index.path}/cells")
    return stats.groupBy("tenant").agg(F.collect_list(F.struct("cell", "n", "least", "mean")).alias("near"))


def test_tenants_filters_and_odd_vectors(spark, tmp_path):
    m = _vectors(600, "clustered", d=8)
    tenant = ["a", "b", "c"]
    rows = [(i, [float(x) for x in 3 * v], tenant[i % 3], i % 2) for i, v in enumerate(m)]
    odd = [(9001, None, "a", 0), (9002, [0.0] * 8, "a", 0), (9003, [float("nan")] + [1.0] * 7, "a", 0), (9004, [float("inf")] + [1.0] * 7, "b", 0), (9005, [None] + [1.0] * 7, "b", 0), (9006, [1.0] * 8, "d", 1)]
    frame = spark.createDataFrame(rows + odd, "id long, v array<double>, tenant string, parity int")
    index = cells.build(frame, f"file://{tmp_path}/index", 12)
    asked = list(range(0, 600, 50))
    queries = spark.createDataFrame([(i, m[i].tolist(), tenant[i % 3]) for i in asked] + [(7, [0.0] * 8, "a"), (8, [1.0] * 8, "nobody"), (9, [1.0] * 8, "d")], "query_id long, q array<double>, tenant string")
    expected = _brute(m, asked, 4, lambda a, b: a % 3 == b % 3)
    found = _got(index.search(queries, 4, recall=None))
    assert found.pop(9) == [(9006, 1.0)] and found == expected
    # A filter holds within the search.
    found = _got(index.search(queries, 4, recall=None, where=F.col("parity") == 1))
    assert {q: x for q, x in found.items() if q != 9} == _brute(m, asked, 4, lambda a, b: a % 3 == b % 3 and b % 2 == 1)
    assert index.search(queries.limit(0), 4).count() == 0
    assert cells.build(frame.limit(0), f"file://{tmp_path}/none").search(queries, 4).count() == 0


def test_within(spark, tmp_path):
    """All pairs at or above a cosine, by tenant, with groups of copies; no nested loop in the plan."""
    m = _vectors(500, "clustered", d=16)
    m[50:120] = m[49]
    rows = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(m)], "id long, v array<double>, tenant int")
    index = cells.build(rows, f"file://{tmp_path}/index", 25)
    found = index.within(rows.select(F.col("id").alias("query_id"), F.col("v").alias("q"), "tenant"), 0.9, 100)
    s = np.round(m @ m.T, 6)
    expected = {(i, j) for i in range(500) for j in range(500) if i != j and i % 2 == j % 2 and s[i, j] >= 0.9}
    assert {(r["query_id"], r["id"]) for r in found.collect()} == expected and len(expected) > 1000
    assert "NestedLoop" not in index._meet(index._probes(index._asked(rows.select(F.col("id").alias("query_id"), F.col("v").alias("q"), "tenant")), 5, None, ()), None, 5)._jdf.queryExecution().toString()


def test_expected_numbers():
    """On isotropic rows the expected number that beats a score is what there is, and cells taken hold the share that is due."""
    rng = np.random.default_rng(1)
    m = _vectors(20_000, "isotropic")
    c = _vectors(30, "isotropic", seed=9)
    near = m @ c.T
    cell = near.argmax(axis=1)
    along = near[np.arange(len(m)), cell]
    stats = [(np.sum(cell == j), along[cell == j].min(), along[cell == j].mean()) for j in range(30)]
    n, least, mean = (np.array(x) for x in zip(*stats, strict=True))
    spread = cells._spread(m[:1000], c)
    got, taken = [], []
    for q in _vectors(40, "isotropic", seed=5):
        probe = cells.Probes(q @ c.T, n, least, mean, spread, 10, 0.95)
        scores = m @ q
        got.append(probe.expected(0.45).sum() / max((scores > 0.45).sum(), 1))
        best = np.argsort(-scores)[:10]
        rounds = [*probe.nearest(), *probe.worth(np.sort(scores[np.isin(cell, probe.left, invert=True)])[-10], True)]
        taken.append(np.isin(cell[best], rounds).mean())
        assert all(probe.bound[j] + 1e-9 >= scores[cell == j].max() for j in range(30))
    assert 0.8 < np.mean(got) < 1.25 and np.mean(taken) > 0.85 and rng is not None
