"""Nearest neighbours by cosine through shifted space-filling curves.

Every curve projects the unit vectors to a few random directions, spreads each
coordinate over an interval by the normal distribution, shifts the grid, and
takes the Hilbert key. Spark range-partitions and sorts all (curve, key) rows;
members of a curve are cut into blocks of ``BLOCK``, and a query meets the block
it falls into and the one on either side. Each block reranks its queries by the
cosine of the original vectors; the windows of all curves merge to the nearest
per query.

Windows then widen, a round doubling the distance, for each query whose nearest
still change: a query settles when ``PATIENCE`` rounds in a row, each as wide as all before it, have
brought nothing better on any curve, or when the curves are at their end. Data
that lie in clusters settle after those rounds, whatever the table's size; data without
any structure settle late or at the end. That a quiet round means the nearest are found is no
certainty; how often it holds was measured, see the README. With ``settle=False``
every query goes on to the end of its curves, and the answer is exact.

Only keys travel while the order is made. Blocks are written once, a row of
arrays each with their vectors as they came; all have the same size whatever the
data, and the queries that meet in one are dealt in parts of ``ASKING``, so no group is hot. Equal vectors stand in for each other: of a group of
copies only the ``k + 1`` least ids can be among anyone's ``k`` nearest (ties go
to the smaller id), so only those are members, however large the group; all of
its queries are answered.

Rows without id and vectors that are null, empty, zero, of another length than
most, or that hold null or non-finite components take no part. Repeated rows
with one id count once per query, by their best score. Empty tables give an
empty result, extra columns are ignored.

The README has the recall measured against brute force, also where a first window is
a small share of the table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kelpforest.llm.common import forget, stored

CURVES = 6
BLOCK = 8192
DIRECTIONS, BITS = 9, 7
NEAREST = 5
EVERY = 50
#: Quiet rounds before a query settles, and queries that meet a block in one task.
PATIENCE, ASKING = 3, 4096
SEED = 20240601


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Positions on the Hilbert curve of points (n, d) with coordinates below 2 ** bits; needs d * bits <= 63."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    # Undo the excess of each level from the coarsest down.
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & p
            x[0] ^= np.where(high, p, swap)
            if i:
                x[i] ^= np.where(high, 0, swap)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    keys = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            keys = (keys << 1) | ((x[i] >> bit) & 1)
    return keys


def projections(dim: int, curves: int = CURVES, directions: int = DIRECTIONS, seed: int = SEED):
    """For each curve its directions (dim, d) and its shift (d)."""
    random = np.random.default_rng(seed)
    out = []
    for _ in range(curves):
        base, _ = np.linalg.qr(random.standard_normal((dim, max(dim, 1))))
        out.append((base[:, : min(directions, dim)], random.random(min(directions, dim))))
    return out


def curve_key(unit: np.ndarray, directions: np.ndarray, shift: np.ndarray, bits: int = BITS) -> np.ndarray:
    z = unit @ directions * math.sqrt(unit.shape[1])
    spread = 0.5 * (1 + np.tanh(math.sqrt(2 / math.pi) * (z + 0.044715 * z**3)))
    cells = np.minimum(((spread + shift) / 2 * (1 << bits)).astype(np.int64), (1 << bits) - 1)
    return hilbert_keys(cells, bits)


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part; floats stay floats, all else becomes doubles."""
    kind = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    v = F.col("v")
    out = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(f"array<{kind}>").alias("v"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    out = out.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(finite & F.exists(v, lambda x: x != 0))
    sizes = out.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return out.where(F.size("v") == (sizes["d"] if sizes else 0))


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = flat if not isinstance(flat, pa.ChunkedArray) else pa.concat_arrays(flat.chunks)
    n = len(flat)
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1) if n else np.empty((0, 0))


def _units(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _keyed(dim: int, curves: int):
    shapes = projections(dim, curves)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _units(_matrix(batch.column(1)))
            for number, (directions, shift) in enumerate(shapes):
                yield pa.record_batch(
                    [pa.array(np.full(batch.num_rows, number, np.int32)), pa.array(curve_key(unit, directions, shift)), batch.column(0), batch.column(2)],
                    names=["curve", "key", "row", "asks"],
                )

    return run


def _counted(batches):
    """(curve, part, ahead, row, asks): how many members of its curve stand ahead of a row in its partition."""
    part, seen = TaskContext.get().partitionId(), {}
    for batch in batches:
        if not batch.num_rows:
            continue
        curve, asks = batch.column(0).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False)
        ahead = np.empty(batch.num_rows, np.int64)
        for c in np.unique(curve).tolist():
            here = curve == c
            members = np.cumsum(~asks[here])
            ahead[here] = members - ~asks[here] + seen.get(c, 0)
            seen[c] = seen.get(c, 0) + int(members[-1])
        yield pa.record_batch([batch.column(0), pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(ahead), batch.column(2), batch.column(3)], names=["curve", "part", "ahead", "row", "asks"])


def _packed(group: pa.Table) -> pa.Table:
    vectors = np.ascontiguousarray(_matrix(group.column("v")))
    return pa.table(
        {
            "curve": group.column("curve").slice(0, 1),
            "block": group.column("block").slice(0, 1),
            "ids": pa.array([group.column("vec_id").to_numpy().astype(np.int64).tobytes()], pa.binary()),
            "vectors": pa.array([vectors.astype(group.column("v").type.value_type.to_pandas_dtype()).tobytes()], pa.binary()),
        }
    )


def _reranked(k: int, kind: str):
    def run(asking: pa.Table, members: pa.Table) -> pa.Table:
        mine, theirs, scores = [], [], []
        if members.num_rows and asking.num_rows:
            ids = np.frombuffer(members.column("ids")[0].as_buffer(), np.int64)
            vectors = np.frombuffer(members.column("vectors")[0].as_buffer(), kind).reshape(len(ids), -1).astype(float)
            unit, norms = _units(vectors), np.sqrt((vectors * vectors).sum(axis=1))
            names, asked = asking.column("query_id").to_numpy(), _matrix(asking.column("q"))
            for i in range(0, len(names), 256):
                some = asked[i : i + 256]
                near = _units(some) @ unit.T
                near[names[i : i + 256, None] == ids[None, :]] = -np.inf
                for line, query, name in zip(near, some, names[i : i + 256].tolist(), strict=True):
                    found = np.flatnonzero(line > -np.inf)
                    if len(found) > k:
                        # All within rounding of the k-th; the exact measure decides among them.
                        least = np.partition(line, len(line) - k)[len(line) - k]
                        found = np.flatnonzero(line >= least - 1e-9)
                    exact = (vectors[found] * query).sum(axis=1) / (norms[found] * np.sqrt((query * query).sum()))
                    best = np.lexsort((ids[found], -exact))[:k]
                    mine.append(np.full(len(best), name))
                    theirs.append(ids[found][best])
                    scores.append(exact[best])
        join = lambda x, t: np.concatenate(x).astype(t) if x else np.empty(0, t)
        return pa.table({"query_id": join(mine, np.int64), "vec_id": join(theirs, np.int64), "score": join(scores, np.float64)})

    return run


def index(rows: DataFrame, every: int = EVERY, k: int = NEAREST, curves: int = CURVES, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Blocks (curve, block, ids, vectors), and queries by their place: (curve, block, last, row). ``rows`` has (row, vec_id, v)."""
    first = rows.first()
    dim = len(first["v"]) if first else 1
    copies = W.partitionBy("v").orderBy("vec_id")
    members = rows.withColumn("r", F.row_number().over(copies)).where(F.col("r") <= k + 1).select("row", "v", F.lit(False).alias("asks"))
    queries = rows.where(F.col("vec_id") % every == 0).select("row", "v", F.lit(True).alias("asks"))
    keyed = members.unionByName(queries).mapInArrow(_keyed(dim, curves), "curve int, key long, row long, asks boolean")
    ordered = keyed.repartitionByRange("curve", "key", "row").sortWithinPartitions("curve", "key", "row")
    placed = stored(ordered.mapInArrow(_counted, "curve int, part int, ahead long, row long, asks boolean"), "curve-order")
    counts = placed.groupBy("curve", "part").agg(F.sum((~F.col("asks")).cast("long")).alias("n"))
    before = W.partitionBy("curve").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("curve", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(W.partitionBy("curve")).alias("all"))
    ranked = placed.join(F.broadcast(counts), ["curve", "part"]) if placed.rdd.getNumPartitions() <= 10_000 else placed.join(counts, ["curve", "part"])
    last = F.floor((F.col("all") - 1) / block)
    ranked = ranked.select("curve", F.least(F.floor((F.col("before") + F.col("ahead")) / block), last).alias("block"), last.alias("last"), "row", "asks")
    held = ranked.where("NOT asks").join(rows, "row").select("curve", "block", "vec_id", "v")
    blocks = stored(held.groupBy("curve", "block").applyInArrow(_packed, "curve int, block long, ids binary, vectors binary"), "curve-blocks")
    asked = stored(ranked.where("asks").select("curve", "block", "last", "row"), "curve-queries")
    forget(placed)
    return blocks, asked


def nearest(vectors: DataFrame, every: int = EVERY, k: int = NEAREST, curves: int = CURVES, block: int = BLOCK, settle: bool = True) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found of each row whose id ``every`` divides."""
    rows = stored(valid(vectors).withColumn("row", F.monotonically_increasing_id()), "vectors")
    kind = "<f4" if rows.schema["v"].dataType.simpleString() == "array<float>" else "<f8"
    blocks, asked = index(rows, every, k, curves, block)
    end = asked.agg(F.coalesce(F.max("last"), F.lit(0))).first()[0]
    texts = rows.where(F.col("vec_id") % every == 0).select("row", F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best, open_, inner, outer = None, asked.withColumn("quiet", F.lit(0)), -1, 1
    while True:
        low, high = F.greatest(F.col("block") - outer, F.lit(0)), F.least(F.col("block") + outer, F.col("last"))
        near = F.filter(F.sequence(low, high), lambda b: F.abs(b - F.col("block")) > inner)
        met = open_.select("curve", "row", F.explode(near).alias("block"))
        parts = met.groupBy("curve", "block").agg(F.ceil(F.count("*") / ASKING).cast("int").alias("parts"))
        asking = met.join(parts, ["curve", "block"]).withColumn("part", F.pmod(F.hash("row"), F.col("parts"))).join(texts, "row").drop("row", "parts")
        members = blocks.join(parts, ["curve", "block"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        by = ["curve", "block", "part"]
        found = asking.groupBy(*by).cogroup(members.groupBy(*by)).applyInArrow(_reranked(k, kind), "query_id long, vec_id long, score double")
        found = found if best is None else found.unionByName(best.drop("rank"))
        merged = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        now = stored(merged.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "nearest")
        if outer >= end:
            return now
        if best is not None:
            if settle:
                moved = now.join(best, ["query_id", "vec_id"], "left_anti").select("query_id").distinct()
                moved = texts.join(moved, "query_id", "left_semi").select("row", F.lit(True).alias("moved"))
                quiet = F.when(F.col("moved"), 0).otherwise(F.col("quiet") + 1)
                open_ = stored(open_.join(moved, "row", "left").withColumn("quiet", quiet).drop("moved").where(F.col("quiet") < PATIENCE), "curve-open")
                if open_.first() is None:
                    return now
            forget(best)
        best, inner, outer = now, outer, 2 * outer
