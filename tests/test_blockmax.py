"""Early-ended top-k against scores of all postings."""

import numpy as np
from pyspark.sql import functions as F

from kelpforest.operators import blockmax
from kelpforest.operators import ranking as R


def _postings(spark, n=3000, tokens=40):
    """Texts of very different lengths; the lowest tokens are in most of them."""
    rng = np.random.default_rng(2)
    rows = []
    for i in range(n):
        length = int(min(2 + rng.pareto(1.1) * 6, 4000))
        found, counts = np.unique(np.minimum(rng.zipf(1.3, length), tokens) - 1, return_counts=True)
        rows += [(i, f"t{t}", float(c)) for t, c in zip(found, counts, strict=True)]
    return spark.createDataFrame(rows, "id long, token string, tf double")


def test_equals_a_full_scan(spark, monkeypatch):
    monkeypatch.setattr(blockmax, "BLOCK", 32)
    posts = _postings(spark).cache()
    queries = [(0, "t0", 1.0), (0, "t1", 1.0), (1, "t0", 1.0), (2, "t39", 1.0), (2, "t5", 2.0), (3, "t1", 1.0), (3, "t2", 1.0), (3, "t3", 0.5), (4, "none", 1.0), (5, "t0", 1.0), (5, "none", 1.0)]
    asked = spark.createDataFrame(queries, "query_id int, token string, tf double")
    n = spark.createDataFrame([(3000,)], "n long")
    idf = R.idf_table(posts, n)
    blocks = blockmax.build(posts)
    for k in (1, 10, 5000):
        expected = R.ranked(R.lexical_scores(asked, posts, idf), k).select("query_id", "id", "score", "rank")
        found = blocks.search(asked, idf, k).select("query_id", "id", "score", "rank")
        assert sorted(found.collect()) == sorted(expected.collect())
    # Frequent tokens: a fifth of the postings, or less.
    weighed = asked.where("query_id < 4").join(idf, "token").select("query_id", "token", (F.col("tf") * F.col("idf")).alias("w"))
    read, there = blocks.read(weighed, 10)
    assert there > 8000 and read * 5 <= there, (read, there)


def test_ties_and_nothing(spark, monkeypatch):
    monkeypatch.setattr(blockmax, "BLOCK", 2)
    posts = spark.createDataFrame([(i, "a", 1.0) for i in range(20)], "id long, token string, tf double")
    idf = spark.createDataFrame([("a", 0.1234567)], "token string, idf double")
    asked = spark.createDataFrame([(1, "a", 1.0)], "query_id int, token string, tf double")
    assert [r["id"] for r in blockmax.build(posts).search(asked, idf, 5).orderBy("rank").collect()] == [0, 1, 2, 3, 4]
    assert blockmax.build(posts.limit(0)).search(asked, idf, 5).count() == 0
    assert blockmax.build(posts).search(asked.limit(0), idf, 5).count() == 0
