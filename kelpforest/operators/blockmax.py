"""Lexical top-k that ends early: postings in blocks of rows with the greatest weight of each token in a block.

Rows are dealt into blocks of ``BLOCK`` in the order of their total weight, so the rows that
can score high share blocks. A block's bound for a query is the sum of its greatest weights; a row of it
can't score more. A search scores the ``SEEDS`` blocks with the highest bounds of each
query, takes the k-th best score of those, and then scores only blocks whose
bound reaches it. Bounds, scores and thresholds are joins on tokens and blocks and sums,
so a query reads the postings of its tokens in such blocks and no others; rows
and scores are those of a full scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kelpforest.operators import ranking as R
from kelpforest.sources.folders import forget, stored

#: Rows of a block (a power of two), and blocks that a query begins with.
BLOCK, SEEDS = 128, 2
#: Scores are rounded; a bound this much below a threshold still reaches it.
SLACK = 2e-6


@dataclass(frozen=True)
class Blocks:
    """``postings``: (block, token, id, tf). ``tops``: (block, token, top, n), the greatest weight and the number of postings."""

    postings: DataFrame
    tops: DataFrame

    def _bounds(self, asked: DataFrame) -> DataFrame:
        """(query_id, block, bound); asked: (query_id, token, w)."""
        return self.tops.join(asked, "token").groupBy("query_id", "block").agg(F.sum(F.col("top") * F.col("w")).alias("bound"))

    def _scores(self, asked: DataFrame, wanted: DataFrame) -> DataFrame:
        """(query_id, id, score) in the wanted (query_id, block)."""
        met = self.postings.join(wanted.join(asked, "query_id"), ["block", "token"])
        return met.groupBy("query_id", "id").agg(F.round(F.sum(F.col("w") * F.col("tf")), 6).alias("score"))

    def plan(self, asked: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """First scores, the blocks that they came from, and the other blocks that can hold one of the ``k`` best rows."""
        bounds = stored(self._bounds(asked), "bounds")
        nth = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("bound"), "block"))
        seeds = stored(bounds.withColumn("_n", nth).where(F.col("_n") <= SEEDS).select("query_id", "block"), "seeds")
        first = stored(R.ranked(self._scores(asked, seeds), k), "first-scores")
        least = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
        rest = bounds.join(seeds, ["query_id", "block"], "left_anti").join(least, "query_id", "left")
        more = stored(rest.where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - SLACK)).select("query_id", "block"), "more-blocks")
        forget(bounds)
        return first, seeds, more

    def search(self, asked: DataFrame, idf: DataFrame, k: int) -> DataFrame:
        """(query_id, id, score, rank) of the ``k`` best rows; asked: (query_id, token, tf), idf: (token, idf)."""
        asked = stored(asked.join(idf.select("token", "idf"), "token").select("query_id", "token", (F.col("tf") * F.col("idf")).alias("w")), "asked")
        first, seeds, more = self.plan(asked, k)
        found = first.select("query_id", "id", "score").unionByName(self._scores(asked, more))
        return R.ranked(found, k)

    def read(self, asked: DataFrame, k: int) -> tuple[int, int]:
        """Postings that a search reads, and those that its tokens have, added up over queries; asked: (query_id, token, w)."""
        _, seeds, more = self.plan(asked, k)
        n = lambda rows: rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        met = self.tops.join(asked, "token")
        return n(met.join(seeds.unionByName(more), ["query_id", "block"])), n(met)


def build(postings: DataFrame) -> Blocks:
    """Blocks of (id, token, tf)."""
    mass = postings.groupBy("id").agg(F.sum("tf").alias("mass"))
    placed = mass.repartitionByRange(F.desc("mass"), "id").sortWithinPartitions(F.desc("mass"), "id")
    # Numbers of a partition's rows follow each other from a multiple of 2 ** 33.
    blocks = stored(placed.select("id", F.shiftright(F.monotonically_increasing_id(), BLOCK.bit_length() - 1).alias("block")), "blocks")
    kept = stored(postings.join(blocks, "id").select("block", "token", "id", "tf").repartitionByRange("token", "block").sortWithinPartitions("token", "block"), "block-postings")
    tops = stored(kept.groupBy("block", "token").agg(F.max("tf").alias("top"), F.count("*").alias("n")), "block-tops")
    forget(blocks)
    return Blocks(kept, tops)
