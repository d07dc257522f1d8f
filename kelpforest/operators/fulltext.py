"""A positional full-text index: words with their places, for all words, phrases and prefixes.

A word is a run of letters and digits in lower case; those of 2 to 30 characters
are indexed, while all count as places. A phrase is found where its words'
places, each less the word's place in the phrase, are the same; that is an equality
of (row, start), so nothing is compared pairwise. Each phrase begins with its
rarest word: only rows that hold it are looked at for the others.

Words of a phrase that aren't indexed may be anything; a phrase without an
indexed word is found nowhere. Null texts have no words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# --- fixed values: characters of indexed words ---
LEAST_CHARS, MOST_CHARS = 2, 30
BETWEEN = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """array<string> in order, indexed or not."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), BETWEEN), lambda w: w != "")


def _indexed(word: Column) -> Column:
    return F.length(word).between(LEAST_CHARS, MOST_CHARS)


def build(rows: DataFrame, key: str, text: str, only: DataFrame | None = None) -> DataFrame:
    """(id, word, places): a row for each word of a text, places in order.

    For one set of queries, ``only`` names their words (word) or the beginnings of them (prefix); other words count as places but get no rows.
    """
    each = rows.select(F.col(key).alias("id"), F.posexplode(words(F.col(text))).alias("place", "word")).where(_indexed(F.col("word")))
    if only is not None and "prefix" in only.columns:
        begins = only.select(_lead(F.col("prefix")).alias("_lead"), F.col("prefix").alias("_prefix")).distinct()
        each = each.join(F.broadcast(begins), (_lead(F.col("word")) == F.col("_lead")) & F.startswith("word", F.col("_prefix")), "left_semi")
    elif only is not None:
        each = each.join(F.broadcast(only.select("word").distinct()), "word", "left_semi")
    return each.groupBy("id", "word").agg(F.sort_array(F.collect_list("place")).alias("places"))


def _lead(word: Column) -> Column:
    return F.left(word, F.lit(LEAST_CHARS))


def frequencies(index: DataFrame) -> DataFrame:
    """(word, df)."""
    return index.groupBy("word").agg(F.count("*").alias("df"))


def phrases(queries: DataFrame, key: str, text: str) -> DataFrame:
    """(query_id, offset, word, due): the indexed words of each phrase, with how many there are."""
    each = queries.select(F.col(key).alias("query_id"), F.posexplode(words(F.col(text))).alias("offset", "word")).where(_indexed(F.col("word")))
    return each.withColumn("due", F.count("*").over(W.partitionBy("query_id")))


def phrase_search(index: DataFrame, queries: DataFrame, key: str, text: str, df: DataFrame | None = None) -> DataFrame:
    """(query_id, id, n, first): rows that hold each phrase, how often, and where first. ``df`` is :func:`frequencies`, counted if it isn't kept."""
    asked = phrases(queries, key, text)
    df = frequencies(index.join(asked.select("word").distinct(), "word", "left_semi")) if df is None else df
    rarest = F.row_number().over(W.partitionBy("query_id").orderBy(F.coalesce("df", F.lit(0)), "offset"))
    ranked = asked.join(df, "word", "left").withColumn("nth", rarest)
    anchor = ranked.where("nth = 1").select("query_id", "word", F.col("offset").alias("by"), "due")
    starts = index.join(F.broadcast(anchor), "word").select("query_id", "id", "due", F.explode(F.transform("places", lambda p: p - F.col("by"))).alias("start")).where("start >= 0")
    others = ranked.where("nth > 1").select("query_id", "word", "offset")
    near = starts.select("query_id", "id").distinct().join(others, "query_id")
    met = index.join(near, ["id", "word"]).select("query_id", "id", F.explode(F.transform("places", lambda p: p - F.col("offset"))).alias("start"))
    found = starts.select("query_id", "id", "start", "due", F.lit(1).alias("one")).unionByName(met.select("query_id", "id", "start", F.lit(None).cast("long").alias("due"), F.lit(1).alias("one")))
    whole = found.groupBy("query_id", "id", "start").agg(F.max("due").alias("due"), F.sum("one").alias("met")).where("met = due")
    return whole.groupBy("query_id", "id").agg(F.count("*").alias("n"), F.min("start").alias("first"))


def all_words(index: DataFrame, queries: DataFrame, key: str, text: str) -> DataFrame:
    """(query_id, id): rows that hold every indexed word of a query, in any order."""
    asked = phrases(queries, key, text).groupBy("query_id", "word").agg(F.lit(1).alias("one"))
    asked = asked.withColumn("due", F.count("*").over(W.partitionBy("query_id"))).drop("one")
    met = index.select("id", "word").join(asked, "word").groupBy("query_id", "id").agg(F.count("*").alias("met"), F.first("due").alias("due"))
    return met.where("met = due").select("query_id", "id")


def prefix_search(index: DataFrame, queries: DataFrame, key: str, prefix: str) -> DataFrame:
    """(query_id, id, n): rows with words that begin with a prefix, and how many occurrences. Prefixes meet words by their first two characters."""
    asked = prefixes(queries, key, prefix)
    known = index.select("word").distinct().withColumn("lead", _lead(F.col("word")))
    wanted = known.join(asked.select("prefix", _lead(F.col("prefix")).alias("lead")).distinct(), "lead").where(F.startswith("word", F.col("prefix"))).select("prefix", "word")
    # Once for all queries of a prefix.
    return index.join(wanted, "word").groupBy("prefix", "id").agg(F.sum(F.size("places")).alias("n")).join(F.broadcast(asked), "prefix").select("query_id", "id", "n")


def prefixes(queries: DataFrame, key: str, prefix: str) -> DataFrame:
    """(query_id, prefix): those that are long enough, in lower case."""
    return queries.select(F.col(key).alias("query_id"), F.lower(F.col(prefix)).alias("prefix")).where(F.length("prefix") >= LEAST_CHARS)
