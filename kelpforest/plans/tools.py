"""The calls that users make: searches by kind, a briefing, sync in the background."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpforest.constants import MOST_BROWSED, MOST_HITS, SYNC_GRACE
from kelpforest.functions import text as T
from kelpforest.operators import notes
from kelpforest.plans import index, registry
from kelpforest.plans.memory import Notes
from kelpforest.plans.models import Embedder, Judge
from kelpforest.plans.search import Searcher
from kelpforest.sources.snapshots import Snapshots


class Tools:
    """Searches and jobs over the tables of one home folder."""

    def __init__(self, spark: SparkSession, home: str, embedder: Embedder | None = None, judge: Judge | None = None, local: str | None = None):
        """``home`` is where tables lie, for Spark; ``local`` the driver's folder of the registry and the lock."""
        self.spark, self.embedder, self.judge = spark, embedder or Embedder(), judge
        self.local = local or home.removeprefix("file://")
        self.registry = registry.Registry(f"{self.local}/projects.json")
        self.store = Snapshots(spark, f"{home}/tables")
        self.notes = Notes(spark, f"{home}/memory", self.registry.names, lambda t: self.embedder.documents([t])[0], lock=f"{self.local}/notes.lock")
        self._jobs: dict[str, tuple[threading.Thread, dict]] = {}
        self._guard = threading.Lock()

    def _chunks(self, collection: str, project: str | None = None) -> Searcher:
        entry = self.store.current()[1].get("chunks")
        if entry is None:
            raise ValueError("nothing is indexed yet")
        if entry["version"] != index.SCHEMA_VERSION:
            raise ValueError(f"rows of schema version {entry['version']} are left; index again")
        mine = {"collection": collection} | ({} if project is None else {"project": project})
        chunks, posts = self.store.read("chunks", **mine), self.store.read("postings", **mine)
        frequencies = self.store.read("frequencies", collection=collection)
        size = self.store.read("sizes", collection=collection).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
        return Searcher(chunks, posts, self.embedder.query, self.registry.names(), self.judge, bucketed=True, frequencies=frequencies, size=size)

    def search_code(self, query: str, project: str, language: str | None = None, symbol_type: str | None = None, limit: int = 6, expand: bool = False) -> DataFrame:
        return self._chunks("code", project).search(query, project, limit, {"language": language, "symbol_type": symbol_type}, expand=expand)

    def search_docs(self, query: str, project: str, doc_type: str | None = None, limit: int = 6, expand: bool = False) -> DataFrame:
        return self._chunks("docs", project).search(query, project, limit, {"doc_type": doc_type}, expand=expand)

    def search_memory(
        self, query: str, project: str | None = None, memory_type: str | None = None, include_superseded: bool = False, limit: int = 6, rerank: bool = True, now: Column | None = None, most: int = MOST_HITS
    ) -> DataFrame:
        return self.notes_searcher().search(
            query, project, limit, {"memory_type": memory_type, "status": None if include_superseded else "active"}, rerank=rerank, now=now, most=most
        )

    def searcher(self, collection: str, project: str | None = None) -> Searcher:
        return self.notes_searcher() if collection == "memory" else self._chunks(collection, project)

    def notes_searcher(self) -> Searcher:
        return search_notes(self.notes.current(), self.embedder.query, self.registry.names(), self.judge)

    def browse(self, query: str = "", project: str | None = None, memory_type: str | None = None, limit: int = 30) -> DataFrame:
        """Active notes: the newest without a query, else by a search without rerank; 1 to 100."""
        if not query.strip():
            return self.notes.listed(project, memory_type, limit=limit)
        return self.search_memory(query, project, memory_type, limit=limit, rerank=False, most=MOST_BROWSED)

    def briefing(self, project: str, now: Column | None = None) -> str:
        """What one needs to go on with a project: counts, the last session, all decisions in full, the newest others."""
        known = {p["name"]: p for p in self.registry.projects()}
        if project not in known:
            raise ValueError(f"there is no project {project!r}")
        sizes = self.store.read("sizes", project=project)
        n = {r["collection"]: r["n"] for r in sizes.groupBy("collection").agg(F.sum("n").alias("n")).collect()} if sizes is not None else {}
        mine = self.notes.current().where(F.col("project") == project)
        row = notes.briefing(mine, F.current_timestamp() if now is None else now).first()
        lines = [f"# {project}", "", known[project]["description"], "", f"{n.get('code', 0)} code chunks, {n.get('docs', 0)} doc chunks, {row['n'] if row else 0} notes", ""]
        for title, kind in (("Last session", "session"), ("Decisions", "decision"), ("Other notes", "other")):
            shown = (row[kind] if row else None) or []
            if shown:
                lines += [f"## {title}", *(r["line"] for r in shown), ""]
        return "\n".join(lines)

    def status(self) -> DataFrame:
        """Per project and collection: chunks and when they were last indexed, with the embedding model's name."""
        sizes, known = self.store.read("sizes"), self.registry.frame(self.spark)
        rows = known.select("project") if sizes is None else registry.sized(known, sizes)
        return rows.withColumn("model", F.lit(getattr(self.embedder.call, "__name__", "model")))

    def register(self, name: str, root: str, description: str, only: list[str] | None = None) -> dict:
        """Register a project and index it at once."""
        self.registry.register(name, root, description, only)
        return self.sync(name)

    def _run(self, project: str, said: dict) -> None:
        try:
            entry = next(p for p in self.registry.projects() if p["name"] == project)
            with registry.writer_lock(f"{self.local}/index.lock") as lock:
                if not lock:
                    said["state"] = "another process is indexing"
                    return
                row = index.index_project(self.spark, self.store, entry["root"], project, only=",".join(entry["only"]), embedder=self.embedder, beat=lock.beat).first()
                said.update(row.asDict(), state="done")
        except Exception as e:
            said["state"] = f"failed: {e}"

    def sync(self, project: str, grace: float = SYNC_GRACE, run: Callable[[str, dict], None] | None = None) -> dict:
        """Index what has changed, in the background; one job a project. Waits for ``grace`` seconds, then says "running"."""
        if project not in self.registry.names():
            raise ValueError(f"there is no project {project!r}")
        with self._guard:
            job = self._jobs.get(project)
            if job is None or not job[0].is_alive():
                said: dict = {"state": "running"}
                job = (threading.Thread(target=run or self._run, args=(project, said), daemon=True), said)
                self._jobs[project] = job
                job[0].start()
        job[0].join(grace)
        return dict(job[1]) if not job[0].is_alive() else {"state": "running"}


def search_notes(current: DataFrame, embed=None, projects: list[str] | None = None, judge: Judge | None = None) -> Searcher:
    """A searcher over notes as they are now; newer ones are preferred."""
    return Searcher(current, T.postings(current.withColumn("text", F.concat_ws("\n\n", "title", "content")), "id", "text"), embed, projects, judge, recent=True)

