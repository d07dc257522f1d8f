"""Nearest rows by cells: a coarse quantiser trained in Spark, cells as partitions, probes pruned by tenant and bound, exact scores.

Rows belong to the cell of the nearest of up to ``MOST_CELLS`` centroids
(spherical k-means on a bounded sample). The index holds vectors partitioned by
cell, and per tenant and cell the number of rows with the least and the mean cosine to the centroid.

A search has up to three rounds. The first scores the nearest cells of each query until
they hold ``FIRST`` rows for each hit that is due, which gives the score to beat. No row of a cell beats
it whose angle to the query is more than the angle of the beaten score and the
cell's radius; such cells are out. Of the others, the second round takes those with the most
rows expected to beat it, until less than a share of one less ``recall`` is expected in what is left; the third
does so again with what was found by then. With ``recall=None`` the second takes all that are not out, and the
result is exact. The expectation takes a row's part across its centroid to be
spread as in a sample of pairs, so recall is a matter of measurement; the bound is not.

Pairs of a query and a cell meet by tenant and cell, rows in blocks of ``BLOCK`` and
queries in parts of ``PART``, so neither a large cell nor a cell that many ask
for is one task; scores are products of matrices in Arrow batches. Vectors that are null, zero or of other values
than finite ones take no part. Ties go to the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kelpforest.operators import vectors as V
from kelpforest.sources.folders import forget, stored

#: Rows that the centroids are trained on at most, passes over them, and centroids at most.
SAMPLE, PASSES, MOST_CELLS = 100_000, 8, 4096
#: Rows of a cell and queries of a cell that meet in one task; rows of the first round for each hit that is due.
BLOCK, PART, FIRST = 8192, 2048, 200
#: Least rows of a cell's file.
FILE_ROWS = 200_000


def _matrix(column: pa.Array | pa.ChunkedArray, dtype=np.float64) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0), dtype)


def usable(rows: DataFrame, vector: str) -> DataFrame:
    """Rows with finite vectors that have a direction, as doubles of length one."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = rows.withColumn(vector, v).where(F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(vector, lambda x: x != 0))
    return rows.withColumn(vector, V.unit(F.col(vector)))


def train(rows: DataFrame, cells: int, seed: int = 1) -> tuple[np.ndarray, float]:
    """Centroids of (id, v), and how far rows' parts across their centroids spread when seen from other rows.

    The sample is of rows with the least hashes, about ``SAMPLE`` of them; a pass adds up per task and sends the driver a vector a cell and task.
    """
    n = rows.count()
    share = min(1.0, SAMPLE / max(n, 1))
    chosen = rows.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else rows
    tasks = max(1, min(16, n // 4096))
    sample = stored(chosen.select(F.xxhash64("id", F.lit(seed + 1)).alias("h"), "v").repartition(tasks), "cell-sample")
    first = sample.orderBy("h").limit(min(cells, MOST_CELLS)).collect()
    centroids = np.array([r["v"] for r in first], np.float64)
    for _ in range(PASSES if len(first) < n else 0):

        def add(batches: Iterable[pa.RecordBatch], centroids=centroids) -> Iterator[pa.RecordBatch]:
            sums = np.zeros_like(centroids)
            for batch in batches:
                m = _matrix(batch.column("v"))
                cell = (m @ centroids.T).argmax(axis=1)
                order = np.argsort(cell, kind="stable")
                own, start = np.unique(cell[order], return_index=True)
                sums[own] += np.add.reduceat(m[order], start, axis=0)
            used = np.flatnonzero(np.abs(sums).sum(axis=1))
            yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(sums[used].tolist(), pa.list_(pa.float64()))], names=["cell", "sums"])

        # Sums are rounded, so that the order of the tasks doesn't matter.
        total = np.zeros_like(centroids)
        for r in sample.select("v").mapInArrow(add, "cell int, sums array<double>").collect():
            total[r["cell"]] += np.rint(np.array(r["sums"]) * 2**20) / 2**20
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centroids = np.where(norm > 0, total / np.where(norm > 0, norm, 1), centroids)
    some = np.array([r["v"] for r in sample.orderBy("h").limit(1024).collect()], np.float64)
    forget(sample)
    return centroids, _spread(some, centroids)


def _spread(some: np.ndarray, centroids: np.ndarray) -> float:
    """Root mean square of what cosines of pairs have beyond the part along the centroid, in units of the sines."""
    if len(some) < 3:
        return 1.0
    near = some @ centroids.T
    cell = near.argmax(axis=1)
    along = near[np.arange(len(some)), cell]
    seen = near[:, cell]
    across = np.sqrt(np.maximum(1 - along**2, 1e-12))[None, :] * np.sqrt(np.maximum(1 - seen**2, 1e-12))
    z = (some @ some.T - seen * along[None, :]) / np.maximum(across, 1e-6)
    other = ~np.eye(len(some), dtype=bool) & (cell[:, None] != cell[None, :])
    return float(np.sqrt((z[other] ** 2).mean())) if other.any() else 1.0


@dataclass(frozen=True)
class CellIndex:
    """An index under ``path``; build it with :func:`build`."""

    spark: SparkSession
    path: str
    centroids: np.ndarray
    spread: float
    tenants: bool
    schema: StructType

    def vectors(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/vectors")

    def _meet(self, pairs: DataFrame, where, k: int) -> DataFrame:
        """(query_id, id, score) of the best ``k`` of each block for each query that asks for its cell; pairs: (query_id, q, tenant, cell, n)."""
        keys = ["tenant", "cell"]
        wanted = [r["cell"] for r in pairs.select("cell").distinct().collect()]
        rows = self.vectors().where(F.col("cell").isin(wanted)) if len(wanted) < len(self.centroids) else self.vectors()
        rows = rows if where is None else rows.where(where)
        asked = pairs.groupBy(*keys).agg(F.count("*").alias("asked"), F.first("n").alias("n"))
        shape = asked.select(*keys, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("asked") / PART).cast("int").alias("parts"))
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = pairs.join(shape, keys).withColumn("part", F.pmod(F.hash("query_id"), F.col("parts"))).withColumn("block", each("blocks"))
        right = rows.join(shape, keys).withColumn("block", F.pmod(F.hash("id"), F.col("blocks"))).withColumn("part", each("parts"))
        by = [*keys, "block", "part"]
        left, right = left.select(*by, "query_id", "q"), right.select(*by, "id", "v")

        def score(asked: pa.Table, rows: pa.Table) -> pa.Table:
            names = ["query_id", "id", "score"]
            kind = rows.schema.field("id").type
            if not asked.num_rows or not rows.num_rows:
                return pa.table([pa.array([], pa.int64()), pa.array([], kind), pa.array([], pa.float64())], names=names)
            ids = rows.column("id").combine_chunks()
            order = np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable")
            scores = np.round(_matrix(asked.column("q")) @ _matrix(rows.column("v"))[order].T, 6)
            # Rows in the order of their ids, so that a stable sort breaks ties.
            best = np.argsort(-scores, axis=1, kind="stable")[:, : k + 1]
            query = np.repeat(asked.column("query_id").to_numpy(), best.shape[1])
            return pa.table([pa.array(query, pa.int64()), ids.take(pa.array(order[best.ravel()])), pa.array(np.take_along_axis(scores, best, axis=1).ravel())], names=names)

        kind = self.vectors().schema["id"].dataType.simpleString()
        return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(score, f"query_id long, id {kind}, score double")

    def _asked(self, queries: DataFrame) -> DataFrame:
        cells = self.spark.read.parquet(f"{self.path}/cells")
        near = cells.groupBy("tenant").agg(F.collect_list(F.struct("cell", "n", "least", "mean")).alias("near"))
        tenant = F.col("tenant") if self.tenants else F.lit(0)
        return usable(queries.select(F.col("query_id").cast("long").alias("query_id"), "q", tenant.alias("tenant")), "q").join(near, "tenant")

    @staticmethod
    def _best(found: DataFrame, k: int) -> DataFrame:
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
        return found.where(F.col("query_id").cast("string") != F.col("id").cast("string")).withColumn("rank", rank).where(F.col("rank") <= k)

    def _probes(self, asked: DataFrame, k: int, recall: float | None, beats: tuple[str, ...], nearest: bool = True) -> DataFrame:
        """(query_id, q, tenant, cell, n) of a round; asked: (query_id, q, tenant, near array<struct<cell, n, least, mean>>) and the scores to beat after each earlier round."""
        centroids, spread = self.centroids, self.spread

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                m = _matrix(batch.column("q"))
                seen = m @ centroids.T if len(m) else m
                which, cells, counts = [], [], []
                known = [[-2.0 if x is None else x for x in batch.column(c).to_pylist()] for c in beats]
                for i, near in enumerate(batch.column("near")):
                    cell, n, least, mean = (near.values.field(c).to_numpy(zero_copy_only=False) for c in ("cell", "n", "least", "mean"))
                    probe = Probes(np.clip(seen[i, cell], -1, 1), n, least, mean, spread, k, recall)
                    order = probe.nearest() if nearest else None
                    for number, column in enumerate(known):
                        order = probe.worth(column[i], foresee=number == 0)
                    which.append(np.full(len(order), i))
                    cells.append(cell[order])
                    counts.append(n[order])
                at = pa.array(np.concatenate(which) if which else np.zeros(0), pa.int64())
                numbers = [pa.array(np.concatenate(x) if x else [], t) for x, t in ((cells, pa.int32()), (counts, pa.int64()))]
                yield pa.record_batch([*(batch.column(c).take(at) for c in ("query_id", "q", "tenant")), *numbers], names=["query_id", "q", "tenant", "cell", "n"])

        tenant = asked.schema["tenant"].dataType.simpleString()
        return asked.mapInArrow(run, f"query_id long, q array<double>, tenant {tenant}, cell int, n long")

    def search(self, queries: DataFrame, k: int, recall: float | None = 0.95, where=None) -> DataFrame:
        """(query_id, id, score, rank): the ``k`` best rows of each of ``queries`` (query_id, q[, tenant]), the query's own id left out.

        ``where`` filters rows within the search. ``recall=None`` is exact.
        """
        asked, best = self._asked(queries), lambda rows: self._best(rows, k)
        found, beats, tables = None, (), []
        for _ in range(3):
            probes = stored(self._probes(asked, k, recall, beats), "probes")
            tables.append(probes)
            if probes.first() is None:
                break
            more = best(self._meet(probes, where, k))
            tables.append(stored(more if found is None else best(found.unionByName(more).drop("rank")), "found"))
            found = tables[-1]
            name = f"beat{len(beats)}"
            asked = asked.join(found.where(F.col("rank") == k).select("query_id", F.col("score").alias(name)), "query_id", "left")
            beats += (name,)
        forget(*(t for t in tables if t is not found))
        return found if found is not None else self.vectors().limit(0).select(F.lit(0).cast("long").alias("query_id"), "id", F.lit(0.0).alias("score"), F.lit(0).alias("rank"))


    def within(self, queries: DataFrame, least: float, k: int, where=None) -> DataFrame:
        """(query_id, id, score, rank): of each query the ``k`` best rows with a cosine of ``least`` or more; exact, and one round: only cells
        whose bound reaches ``least`` are looked at."""
        asked = self._asked(queries).withColumn("beat", F.lit(float(least)))
        probes = stored(self._probes(asked, k, None, ("beat",), nearest=False), "probes")
        found = stored(self._best(self._meet(probes, where, k).where(F.col("score") >= least), k), "found")
        forget(probes)
        return found


class Probes:
    """One query's cells: which to take in each round. ``left`` are those not taken yet."""

    def __init__(self, along: np.ndarray, n: np.ndarray, least: np.ndarray, mean: np.ndarray, spread: float, k: int, recall: float | None):
        self.along, self.n, self.mean, self.k, self.recall = along, n, mean, k, recall
        self.bound = np.cos(np.maximum(np.arccos(along) - np.arccos(np.clip(least, -1, 1)), 0))
        self.across = np.maximum(np.sqrt(np.maximum(1 - mean**2, 0) * np.maximum(1 - along**2, 0)) * spread, 1e-9)
        self.left = np.argsort(-along, kind="stable")

    def expected(self, beat: float, cells: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Rows of cells that beat a score."""
        return self.n[cells] * _above((beat - self.mean[cells] * self.along[cells]) / self.across[cells])

    def nearest(self) -> np.ndarray:
        enough = np.searchsorted(np.cumsum(self.n[self.left]), FIRST * self.k) + 1
        taken, self.left = self.left[:enough], self.left[enough:]
        return taken

    def foreseen(self) -> float:
        """The score that ``k`` rows are expected to beat."""
        low, high = -1.0, 1.0
        for _ in range(20):
            middle = (low + high) / 2
            low, high = (middle, high) if self.expected(middle).sum() > self.k else (low, middle)
        return low

    def worth(self, beat: float, foresee: bool) -> np.ndarray:
        """Cells that can hold better rows, those with most of them first, until few enough are expected in what is left.

        A score from the nearest cells alone is low, so the one foreseen stands in for it first; the next round goes by what was found.
        """
        self.left = self.left[self.bound[self.left] + 1e-6 >= beat]
        if self.recall is None or beat <= -2 or not len(self.left):
            taken, self.left = self.left, self.left[:0]
            return taken
        expected = self.expected(max(beat, self.foreseen()) if foresee else beat, self.left)
        order = np.argsort(-expected, kind="stable")
        rest = expected.sum() - np.cumsum(expected[order])
        some = int(np.searchsorted(-rest, -(1 - self.recall) * self.k)) + 1 if expected.sum() > (1 - self.recall) * self.k else 0
        taken, self.left = self.left[order[:some]], self.left[order[some:]]
        return taken


_ERF = np.vectorize(math.erfc, otypes=[np.float64])


def _above(z: np.ndarray) -> np.ndarray:
    """The chance of a normal value above ``z``."""
    return 0.5 * _ERF(z / math.sqrt(2)) if len(z) else np.zeros(0)


def build(rows: DataFrame, path: str, cells: int | None = None) -> CellIndex:
    """Index (id, v[, tenant], ...) under ``path``; about the root of the number of rows as cells, if none is named. Other columns can be filtered by."""
    tenants = "tenant" in rows.columns
    rows = stored(usable(rows if tenants else rows.withColumn("tenant", F.lit(0)), "v"), "directions")
    centroids, spread = train(rows, cells or max(1, min(MOST_CELLS, math.isqrt(rows.count()))))
    index = add(rows, path, centroids, spread, tenants)
    forget(rows)
    return index


def add(rows: DataFrame, path: str, centroids: np.ndarray, spread: float, tenants: bool) -> CellIndex:
    """Place (id, v, tenant, ...) of :func:`usable` in their cells, under ``path``."""
    spark = rows.sparkSession

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = _matrix(batch.column("v")) @ centroids.T if batch.num_rows else np.zeros((0, 1))
            cell = near.argmax(axis=1)
            along = near[np.arange(len(cell)), cell]
            yield pa.record_batch([*batch.columns, pa.array(cell, pa.int32()), pa.array(along, pa.float64())], names=[*batch.schema.names, "cell", "along"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    placed = stored(rows.mapInArrow(assign, f"{schema}, cell int, along double"), "placed")
    sizes = placed.groupBy("cell").agg(F.count("*").alias("rows"))
    files = F.broadcast(sizes.select("cell", F.ceil(F.col("rows") / FILE_ROWS).cast("int").alias("files")))
    dealt = placed.join(files, "cell").withColumn("file", F.pmod(F.hash("id"), F.col("files"))).repartition("cell", "file").drop("files", "file", "along")
    dealt.write.partitionBy("cell").parquet(f"{path}/vectors")
    placed.groupBy("tenant", "cell").agg(F.count("*").alias("n"), F.min("along").alias("least"), F.avg("along").alias("mean")).write.parquet(f"{path}/cells")
    forget(placed)
    # The column of the partitions comes last, as it is read back.
    schema = StructType([f for f in dealt.schema if f.name != "cell"] + [dealt.schema["cell"]])
    return CellIndex(spark, path, centroids, spread, tenants, schema)
