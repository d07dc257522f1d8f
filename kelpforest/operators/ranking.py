"""Lexical scores, fusion, recency, diversity, expansion and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kelpforest.constants import PER_FILE, RECENCY_DAYS, RECENCY_FLOOR, RECENCY_SPAN, RRF_K, SEPARATOR
from kelpforest.operators import vectors

#: Tokens of queries that meet all postings at a time.
TOKEN_BLOCK = 500_000


def idf_table(postings: DataFrame, n_rows: DataFrame) -> DataFrame:
    """(token, df, idf) over the whole collection; ``n_rows`` is a one-row frame (n)."""
    return idf_of(postings.groupBy("token").agg(F.count("*").alias("df")), n_rows)


def idf_of(df: DataFrame, n_rows: DataFrame) -> DataFrame:
    """(token, df, idf) from counts that are kept."""
    return df.crossJoin(F.broadcast(n_rows)).select("token", "df", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))


def lexical_scores(queries: DataFrame, postings: DataFrame, idf: DataFrame) -> DataFrame:
    """(query_id, id, score): sums of query weight, row weight and idf over shared tokens.

    Queries go to the postings in blocks, so the postings stay where they are, however small they may be.
    """
    out = None
    weighed = queries.join(idf.select("token", "idf"), "token").withColumnRenamed("tf", "q_tf")
    for part in vectors.blocks(weighed, "query_id", TOKEN_BLOCK):
        some = postings.join(part, "token").groupBy("query_id", "id").agg(F.round(F.sum(F.col("q_tf") * F.col("tf") * F.col("idf")), 6).alias("score"))
        out = some if out is None else out.unionByName(some)
    return out


def ranked(scores: DataFrame, k: int, by: str = "query_id") -> DataFrame:
    rank = F.row_number().over(W.partitionBy(by).orderBy(F.desc("score"), "id"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def reciprocal_rank_fusion(branches: list[DataFrame], k: int, constant: int = RRF_K) -> DataFrame:
    """(query_id, id, score, rank) from branches (query_id, id, rank); a missing branch is simply left out of the list."""
    parts = [b.select("query_id", "id", (F.lit(1.0) / (constant + F.col("rank"))).alias("part")) for b in branches]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return ranked(union.groupBy("query_id", "id").agg(F.round(F.sum("part"), 9).alias("score")), k)


def rerank(pool: DataFrame, score: Column, first: int) -> DataFrame:
    """Positions anew: the ``first`` by ``score`` (unscored as -1, ties by old rank), the remainder in its order. One hit stays unscored."""
    size = F.count("*").over(W.partitionBy("query_id"))
    scored = pool.withColumn("rerank", F.when((F.col("rank") <= first) & (size >= 2), F.coalesce(score, F.lit(-1.0))))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("rerank").isNull(), F.desc("rerank"), "rank"))
    return scored.withColumn("position", place)


def recency(score: Column, stamp: Column, now: Column) -> Column:
    """``score`` times 0.85 to 1 by age in whole days; a missing stamp counts as old."""
    age = F.greatest(F.floor((F.unix_timestamp(now) - F.unix_timestamp(stamp)) / 86400), F.lit(0))
    return score * F.when(stamp.isNull(), F.lit(RECENCY_FLOOR)).otherwise(RECENCY_FLOOR + RECENCY_SPAN * F.exp(-age / RECENCY_DAYS))


def diversify(hits: DataFrame, group: list[str], limit: int, per_file: int = PER_FILE, query: str = "query_id") -> DataFrame:
    """At most ``per_file`` hits of a file first, then the overflow, cut to ``limit``. 0 switches the cap off."""
    nth = F.row_number().over(W.partitionBy(query, *group).orderBy("position"))
    over = (F.col("_nth") > per_file) if per_file else F.lit(False)
    placed = hits.withColumn("_nth", nth).withColumn("_over", over)
    final = F.row_number().over(W.partitionBy(query).orderBy("_over", "position"))
    return placed.withColumn("final", final).where(F.col("final") <= limit).drop("_nth", "_over")


def neighbours(chunks: DataFrame, hit: Column, file: list[str], index: str, content: str, start: str, end: str) -> DataFrame:
    """Hits with the chunks before and after them in their file, joined by blank lines, over the widened range of lines."""
    place = W.partitionBy(*file).orderBy(index)
    near = lambda c, by: F.when(F.lag(index, by).over(place) == F.col(index) - by, F.lag(c, by).over(place))
    return (
        chunks.withColumns(
            {
                "expanded": F.concat_ws("\n\n", near(content, 1), F.col(content), near(content, -1)),
                "from_line": F.coalesce(near(start, 1), F.col(start)),
                "to_line": F.coalesce(near(end, -1), F.col(end)),
            }
        )
        .where(hit)
        .select(*file, index, "expanded", "from_line", "to_line")
    )


def location(path: Column, start: Column, end: Column) -> Column:
    return F.when(start.isNull() | (start == 0), path).otherwise(F.format_string("%s:%d-%d", path, start, end))


def page(rows: DataFrame, newest: str, key: str, offset: int, limit: int) -> DataFrame:
    """A page in descending order with the total and whether more follow; limit 1 to 100, offset 0 to 10000."""
    limit, offset = min(max(limit, 1), 100), min(max(offset, 0), 10_000)
    total = rows.agg(F.count("*").alias("total"))
    over = rows.orderBy(F.desc(newest), key).offset(offset).limit(limit + 1)
    numbered = over.withColumn("_n", F.row_number().over(W.orderBy(F.desc(newest), key)))
    more = F.max("_n").over(W.partitionBy()) > limit
    return numbered.withColumn("has_more", more).where(F.col("_n") <= limit).drop("_n").crossJoin(F.broadcast(total))


def holders(items: DataFrame, item: str, docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(item, doc) wherever a document's text holds an item's text.

    A text that is held has its inner words in the document as whole words, so
    the longest of them is an equality key, and only its documents are compared.
    Items without an inner word are compared with all documents, block by block.
    """
    words = F.split(F.col("_body"), SEPARATOR)
    inner = F.filter(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))), lambda w: F.length(w) > 0)
    longest = F.reduce(inner, F.lit(""), lambda best, w: F.when(F.length(w) > F.length(best), w).otherwise(best))
    asked = items.select(item, F.col(text).alias("_body")).withColumn("_word", longest)
    keyed, short = asked.where("_word != ''"), asked.where("_word = ''")
    found = None
    # Items go to the documents, so no text is shuffled; a block at least, which may be empty.
    for part in vectors.blocks(keyed, item):
        words = docs.select(doc, text, F.explode(F.array_distinct(F.split(F.col(text), SEPARATOR))).alias("_word"))
        held = words.join(part, "_word").where(F.contains(text, "_body")).select(item, doc)
        found = held if found is None else found.unionByName(held)
    for part in vectors.blocks(short.select(item, "_body"), item):
        found = found.unionByName(docs.select(doc, text).join(part, F.contains(text, "_body")).select(item, doc))
    return found


def metrics(first_hit: DataFrame) -> DataFrame:
    """R@1, R@3 and MRR of (query, rank of the first hit or null)."""
    rank = F.col("rank")
    return first_hit.agg(
        F.count("*").alias("n"),
        F.round(F.avg(F.when(rank <= 1, 1.0).otherwise(0.0)), 6).alias("r1"),
        F.round(F.avg(F.when(rank <= 3, 1.0).otherwise(0.0)), 6).alias("r3"),
        F.round(F.avg(F.coalesce(1.0 / rank, F.lit(0.0))), 6).alias("mrr"),
    )


def ranked_by(hits: DataFrame, score: Column, query: str = "query_id") -> DataFrame:
    """``position`` anew by ``score``, ties to the old position."""
    scored = hits.withColumn("_by", score)
    place = F.row_number().over(W.partitionBy(query).orderBy(F.desc("_by"), "position"))
    return scored.withColumn("_place", place).drop("position", "_by").withColumnRenamed("_place", "position")
