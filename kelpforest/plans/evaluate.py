"""Retrieval quality on a golden set: which rank a query's expected path gets, with and without rerank."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpforest.operators import ranking
from kelpforest.plans.tools import Tools

SCHEMA = "project string, collection string, query string, expect string"
#: Hits that are looked at, and the least share of queries with a reranked hit among the first three.
DEPTH, LEAST_R3 = 5, 0.8


def golden(tools: Tools, path: str) -> DataFrame:
    """The set in a JSON file: [{"project", "collection", "query", "expect"}]."""
    with open(path) as f:
        rows = json.load(f)
    return tools.spark.createDataFrame([tuple(r[c.split()[0]] for c in SCHEMA.split(", ")) for r in rows], SCHEMA)


def ranks(tools: Tools, asked: DataFrame, rerank: bool) -> DataFrame:
    """(query, rank): the first hit whose path holds what is expected, or null. A golden set is short: each query is a search of its own."""
    found = []
    for r in asked.collect():
        hits = tools.searcher(r["collection"], r["project"]).search(r["query"], r["project"], DEPTH, rerank=rerank)
        path = F.regexp_replace("location", r":\d+-\d+$", "")
        first = hits.where(F.contains(path, F.lit(r["expect"]))).agg(F.min("rank")).first()[0]
        found.append((r["query"], first))
    return tools.spark.createDataFrame(found, "query string, rank int")


def evaluate(tools: Tools, asked: DataFrame) -> DataFrame:
    """(rerank, n, r1, r3, mrr) for both ways."""
    asked = asked.dropDuplicates()
    both = [ranking.metrics(ranks(tools, asked, way)).withColumn("rerank", F.lit(way)) for way in (False, True)]
    return both[0].unionByName(both[1]).select("rerank", "n", "r1", "r3", "mrr")
