"""Cosine scores and nearest rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kelpforest.constants import DUPLICATE_COSINE

#: Queries that meet all rows at a time.
QUERY_BLOCK = 10_000
#: Rows and queries that meet in one task at most, rows that are worth a task of their own, and queries that are scored at a time.
ROWS, QUERIES, LEAST_ROWS, AT_ONCE = 32_768, 8_192, 2_048, 128


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def unit(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.when(norm == 0, F.transform(v, lambda x: F.lit(0.0))).otherwise(F.transform(v, lambda x: x.cast("double") / norm))


def checked(v: Column, dim: int) -> Column:
    """``v``, or an error if a row's vector has another dimension."""
    return F.when(F.size(v) == dim, v).otherwise(F.raise_error(F.concat(F.lit(f"a vector of {dim} components is due, not of "), F.size(v).cast("string"))))


def top_k(rows: DataFrame, key: str, vector: str, query: list[float], k: int, where: Column | None = None) -> DataFrame:
    """The ``k`` rows nearest to one query vector; the filter holds within the search."""
    rows = rows if where is None else rows.where(where)
    score = cosine(F.col(vector), F.array(*map(F.lit, query)))
    return rows.select(key, score.alias("score")).orderBy(F.desc("score"), key).limit(k)


def blocks(queries: DataFrame, key: str, size: int = QUERY_BLOCK) -> list[DataFrame]:
    """The queries in hashed parts of about ``size`` rows, each small enough to be sent to every task."""
    parts = max(1, -(-queries.count() // size))
    return [F.broadcast(queries.where(F.pmod(F.xxhash64(key), F.lit(parts)) == i) if parts > 1 else queries) for i in range(parts)]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _best(k: int, least: float | None):
    """The ``k`` best rows of a block for each query of a part, in Arrow; of equal scores those of smaller ids."""

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        which, found, scores = [], [], []
        if asked.num_rows and rows.num_rows:
            rows = rows.sort_by("id")
            ids, own = rows.column("id").to_numpy(), asked.column("own").to_numpy()
            begin, end = np.searchsorted(ids, own, "left"), np.searchsorted(ids, own, "right")
            q, v = _matrix(asked.column("q")), np.ascontiguousarray(_matrix(rows.column("v")).T)
            for at in range(0, len(q), AT_ONCE):
                near = np.round(q[at : at + AT_ONCE] @ v, 6)
                for i, row in enumerate(near):
                    row[begin[at + i] : end[at + i]] = -np.inf
                    at_least = -np.inf if least is None else np.nextafter(least, -np.inf)
                    if len(row) > k:
                        at_least = max(at_least, np.partition(row, len(row) - k)[len(row) - k]) if k > 1 else max(at_least, row.max())
                    # As many of those that are equal to the k-th as are due: rows lie in the order of their ids.
                    over, even = np.flatnonzero(row > at_least), np.flatnonzero(row == at_least) if at_least > -np.inf else np.zeros(0, np.int64)
                    taken = np.concatenate([over[np.argsort(-row[over], kind="stable")], even])[:k]
                    which.append(np.full(len(taken), at + i))
                    found.append(taken)
                    scores.append(row[taken])
        take = lambda column, parts: column.combine_chunks().take(pa.array(np.concatenate(parts) if parts else [], pa.int64()))
        return pa.table([take(asked.column("query_id"), which), take(rows.column("id"), found), pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=["query_id", "id", "score"])

    return run


def _blockwise(left: DataFrame, right: DataFrame, k: int, least: float | None) -> DataFrame:
    """(query_id, id, score): the best of each block of rows for each query; left: (query_id, own, q, _s), right: (id, v, _s).

    Rows lie in blocks and queries in parts, and each block meets each part of its ``_s`` in a task that holds no more than the two.
    """
    cores = right.sparkSession.sparkContext.defaultParallelism
    n, m = right.groupBy("_s").agg(F.count("*").alias("n")), left.groupBy("_s").agg(F.count("*").alias("m"))
    blocks = F.greatest(F.ceil(F.col("n") / ROWS), F.least(F.lit(cores), F.ceil(F.col("n") / LEAST_ROWS))).cast("int")
    shape = n.join(m, "_s").select("_s", blocks.alias("blocks"), F.ceil(F.col("m") / QUERIES).cast("int").alias("parts"))
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    by = ["_s", "block", "part"]
    left = left.join(shape, "_s").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int")).withColumn("block", each("blocks")).select(*by, "query_id", "own", "q")
    right = right.join(shape, "_s").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("part", each("parts")).select(*by, "id", "v")
    kinds = left.schema["query_id"].dataType.simpleString(), right.schema["id"].dataType.simpleString()
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_best(k, least), f"query_id {kinds[0]}, id {kinds[1]}, score double")


def batch_top_k(queries: DataFrame, rows: DataFrame, k: int, same: str | None = None, least: float | None = None) -> DataFrame:
    """(query_id, id, score, rank): for each query (query_id, q[, same]) the nearest of rows (id, v[, same]), itself left out; with ``least``, those of that score or more.

    Queries are a stated set against all rows. Finite vectors of one dimension meet in blocks, as
    products of matrices; what is left of odd ones meets all others by expressions, and has no score where a component is missing.
    """
    tenant = lambda c: (F.col(same) if same else F.lit(0)).alias(c)
    left = queries.select("query_id", F.col("query_id").cast(rows.schema["id"].dataType).alias("own"), unit(F.col("q")).alias("q"), tenant("_s"))
    right = rows.select("id", unit(F.col("v")).alias("v"), tenant("_s")).where("id IS NOT NULL")
    first = left.where("q IS NOT NULL").select(F.size("q").alias("n")).first()
    dim = first["n"] if first else 0
    plain = lambda c: F.coalesce((F.size(c) == dim) & ~F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))
    usual, odd_rows, odd = left.where(plain("q")), right.where(~plain("v")), left.where(~plain("q"))
    found = _blockwise(usual, right.where(plain("v")), k, least)
    if least is None:
        for some, others in ((usual, odd_rows), (odd, right)):
            if some.isEmpty() or others.isEmpty():
                continue
            for part in blocks(some, "query_id"):
                met = others.withColumnRenamed("_s", "_t").join(part, (F.col("query_id") != F.col("id")) & (F.col("_s") == F.col("_t")))
                found = found.unionByName(met.select("query_id", "id", F.round(dot(F.col("q"), F.col("v")), 6).alias("score")))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def duplicates(candidates: DataFrame, stored: DataFrame, least: float = DUPLICATE_COSINE) -> DataFrame:
    """(query_id, duplicate_of, score): the nearest stored row of the same tenant, where it is near enough to refuse the candidate."""
    nearest = batch_top_k(candidates, stored, 1, same="tenant")
    return nearest.where(F.col("score") >= least).select("query_id", F.col("id").alias("duplicate_of"), "score")
