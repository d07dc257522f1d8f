"""Hybrid search over chunk tables: two branches, fusion, rerank, recency, diversity, cut, expansion, in this order."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpforest.constants import EXTRAS, MOST_HITS, PER_FILE, PREFETCH, RERANK_POOL
from kelpforest.functions import text as T
from kelpforest.operators import ranking as R
from kelpforest.operators import vectors as V
from kelpforest.plans.index import BUCKETS
from kelpforest.plans.models import Judge


def matches(filters: dict) -> Column:
    """All filters hold; a list means any of its values, and an array column matches by any element (name it ``column[]``)."""
    out = F.lit(True)
    for name, value in filters.items():
        if value is None:
            continue
        values = value if isinstance(value, (list, tuple)) else [value]
        out &= F.arrays_overlap(F.col(name[:-2]), F.array(*map(F.lit, values))) if name.endswith("[]") else F.col(name).isin(*values)
    return out


def coverage(query: str, content: Column) -> Column:
    """The offline scorer: the share of a query's distinct tokens that a text holds, 0 to 1."""
    wanted = F.array_distinct(F.transform(T.weighted_tokens(F.lit(query)), lambda t: t["token"]))
    have = F.transform(T.weighted_tokens(content), lambda t: t["token"])
    return F.when(F.size(wanted) > 0, F.size(F.array_intersect(wanted, have)) / F.size(wanted)).otherwise(F.lit(0.0))


def yes_share(yes: Column, no: Column) -> Column:
    """Score of a yes/no judge from log-probabilities: a missing side counts as 0, both missing as no score."""
    y, n = F.coalesce(F.exp(yes), F.lit(0.0)), F.coalesce(F.exp(no), F.lit(0.0))
    return F.when(yes.isNull() & no.isNull(), F.lit(None).cast("double")).otherwise(y / (y + n))


_NEEDED = {"start_line": "int", "end_line": "int", "chunk_index": "int", "symbol_name": "string", "heading_path": "string", "dense": "array<float>"}


class Searcher:
    """Queries over one table (id, project, source_path, content, ...) and its ``postings`` (id, token, tf).

    Columns of chunks or notes that the table lacks count as null. ``embed``
    turns a query into a vector; without it, or where it fails, only the lexical
    branch answers, and a query without tokens, or one whose lexical branch fails, only has the dense one.
    ``frequencies`` (token, df[, bucket]) and ``size`` (n, one row) are kept counts of the whole collection; without them postings and
    rows are counted. Postings that have a project are filtered by it, and joined with rows for other filters only.
    ``judge`` scores texts for a query; hits keep
    the order of the fusion if it fails, and are scored by shared tokens if there is none.
    ``projects`` lists the known tenants; ``recent`` prefers newer rows.
    """

    def __init__(
        self,
        table: DataFrame,
        postings: DataFrame,
        embed: Callable[[str], list[float]] | None = None,
        projects: list[str] | None = None,
        judge: Judge | None = None,
        recent: bool = False,
        bucketed: bool = False,
        frequencies: DataFrame | None = None,
        size: DataFrame | None = None,
    ):
        missing = {c: F.lit(None).cast(t) for c, t in _NEEDED.items() if c not in table.columns}
        self.table, self.postings, self.embed, self.projects = table.withColumns(missing), postings, embed, projects
        self.judge, self.recent, self.bucketed, self.frequencies, self.size = judge, recent, bucketed, frequencies, size

    def _vector(self, query: str) -> list[float] | None:
        try:
            return self.embed(query) if self.embed else None
        except Exception:
            return None

    def _lexical(self, query: str, inside: DataFrame, limit: int, project: str | None = None, filtered: bool = True) -> DataFrame | None:
        spark = self.table.sparkSession
        asked = T.postings(spark.createDataFrame([(0, query)], "query_id int, text string"), "query_id", "text").collect()
        tokens = [r["token"] for r in asked]
        if not tokens:
            return None
        asked = spark.createDataFrame(asked, "query_id int, token string, tf double")

        def of_tokens(rows: DataFrame) -> DataFrame:
            rows = rows.where(F.col("token").isin(*tokens))
            return rows.where(F.col("bucket").isin(*{token_bucket_of(t) for t in tokens})) if self.bucketed and "bucket" in rows.columns else rows

        posts = of_tokens(self.postings)
        size = self.table.agg(F.count("*").alias("n")) if self.size is None else self.size
        idf = R.idf_table(posts, size) if self.frequencies is None else R.idf_of(of_tokens(self.frequencies), size)
        if project is not None and "project" in posts.columns:
            posts = posts.where(F.col("project") == project)
        elif project is not None:
            filtered = True
        if filtered:
            posts = posts.join(inside.select("id"), "id", "left_semi")
        best = R.ranked(R.lexical_scores(asked, posts, idf), limit)
        return spark.createDataFrame(best.collect(), best.schema)

    def _reranked(self, query: str, pool: DataFrame, first: int) -> DataFrame:
        """``position`` and ``rerank``; the pool has 25 rows at most."""
        if self.judge is None:
            return R.rerank(pool, coverage(query, F.col("content")), first)
        rows = pool.where(F.col("rank") <= first).select("id", "content").orderBy("rank").collect()
        scores = self.judge.scores(query, [r["content"] for r in rows])
        if scores is None:
            return pool.withColumns({"rerank": F.lit(None).cast("double"), "position": F.col("rank")})
        found = pool.sparkSession.createDataFrame([(r["id"], s if s is None else float(s)) for r, s in zip(rows, scores, strict=True)], "id string, _judged double")
        return R.rerank(pool.join(F.broadcast(found), "id", "left"), F.col("_judged"), first).drop("_judged")

    def search(
        self,
        query: str,
        project: str | None = None,
        limit: int = 6,
        filters: dict | None = None,
        rerank: bool = True,
        max_per_file: int = PER_FILE,
        expand: bool = False,
        now: Column | None = None,
        most: int = MOST_HITS,
    ) -> DataFrame:
        """The ``limit`` best hits, ``most`` at the most."""
        if project is not None and self.projects is not None and project not in self.projects:
            raise ValueError(f"there is no project {project!r}")
        limit = min(max(limit, 1), most)
        inside = self.table.where(matches({"project": project} | (filters or {})))
        branches = []
        vector = self._vector(query)
        if vector is not None:
            dense = V.checked(F.col("dense"), len(vector))
            near = inside.where("dense IS NOT NULL").select(F.lit(0).alias("query_id"), "id", F.round(V.cosine(dense, F.array(*map(F.lit, vector))), 9).alias("score"))
            branches.append(R.ranked(near, limit * PREFETCH))
        filtered = any(value is not None for value in (filters or {}).values())
        try:
            lexical = self._lexical(query, inside, limit * PREFETCH, project, filtered)
        except Exception:
            if not branches:
                raise
            lexical = None
        if lexical is not None:
            branches.append(lexical)
        candidates = self.judge.candidates if self.judge else RERANK_POOL
        if branches:
            fused = R.reciprocal_rank_fusion(branches, max(limit, candidates if rerank else limit))
            # A bounded number of rows, on which all that follows works.
            pool = fused.join(self.table, "id")
            pool = pool.sparkSession.createDataFrame(pool.collect(), pool.schema)
        else:
            pool = self.table.limit(0).withColumns({"query_id": F.lit(0), "score": F.lit(0.0), "rank": F.lit(0)})
        if rerank:
            pool = self._reranked(query, pool, max(candidates, limit))
        else:
            pool = pool.withColumns({"rerank": F.lit(None).cast("double"), "position": F.col("rank")})
        if self.recent:
            base = F.coalesce("rerank", 1.0 / F.col("position"))
            stamps = [F.col(c) for c in ("updated_at", "created_at") if c in pool.columns] or [F.lit(None).cast("timestamp")]
            pool = R.ranked_by(pool, R.recency(base, F.coalesce(*stamps), F.current_timestamp() if now is None else now))
        hits = R.diversify(pool, ["project", "source_path"], limit, max_per_file)
        if expand:
            file, keys = ["project", "source_path"], ["project", "source_path", "chunk_index"]
            wide = R.neighbours(self.table.join(hits.select(*file).distinct(), file, "left_semi"), F.lit(True), file, "chunk_index", "content", "start_line", "end_line")
            hits = hits.join(wide, keys).withColumns({"content": F.col("expanded"), "start_line": F.col("from_line"), "end_line": F.col("to_line")})
        return hits.select(
            F.col("final").alias("rank"),
            "id",
            F.round("score", 4).alias("score"),
            F.round("rerank", 4).alias("rerank"),
            "project",
            R.location(F.col("source_path"), F.col("start_line"), F.col("end_line")).alias("location"),
            "content",
            F.coalesce("symbol_name", "heading_path").alias("symbol"),
            *(c for c in EXTRAS if c in hits.columns),
        ).orderBy("rank")


def token_bucket_of(token: str) -> int:
    return zlib.crc32(token.encode()) % BUCKETS
