"""Notes over an append-only log: store, update, supersede, list, hand over, seed."""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpforest.constants import DUPLICATE_COSINE
from kelpforest.functions import text as T
from kelpforest.operators import notes, ranking, vectors
from kelpforest.plans.index import SCHEMA_VERSION
from kelpforest.plans.registry import writer_lock
from kelpforest.sources.snapshots import backups, import_notes, stored

SCHEMA = (
    "id string, version int, op string, project string, memory_type string, title string, content string, tags array<string>, "
    "created_at timestamp, supersedes string, links boolean, source_path string, dense array<float>, schema_version int"
)


class Notes:
    """``projects`` names the registered tenants; ``embed`` turns a text into a vector, without which no duplicates are refused.

    ``lock`` is a path on the driver that writers take turns by; without it there must be one writer.
    """

    def __init__(self, spark: SparkSession, path: str, projects: Callable[[], list[str]], embed: Callable[[str], list[float]] | None = None, lock: str | None = None):
        self.spark, self.path, self.projects, self.embed, self.lock = spark, path, projects, embed, lock

    def log(self) -> DataFrame:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop)
        return self.spark.read.schema(SCHEMA).parquet(self.path) if there else self.spark.createDataFrame([], SCHEMA)

    def current(self) -> DataFrame:
        return notes.current(self.log())

    def _append(self, rows: DataFrame) -> None:
        rows.select(*(f.split()[0] for f in SCHEMA.split(", "))).coalesce(1).write.mode("append").parquet(self.path)

    def store(self, project: str, memory_type: str, title: str, content: str, tags: list[str] | None = None, allow_duplicate: bool = False, supersedes: str | None = None, links: bool = True) -> str:
        row = self.spark.createDataFrame([(project, memory_type, title, content, tags or [])], "project string, memory_type string, title string, content string, tags array<string>")
        reason = row.select(notes.reject_reason(*(F.col(c) for c in ("project", "memory_type", "title", "content")), self.projects()).alias("r")).first()["r"]
        if reason:
            raise ValueError(reason)
        dense = self.embed(f"{title}\n\n{content}") if self.embed else None
        if dense is not None and not allow_duplicate and supersedes is None:
            same = self.current().where((F.col("status") == "active") & (F.col("project") == project) & F.col("dense").isNotNull())
            near = vectors.top_k(same.withColumn("dense", vectors.checked(F.col("dense"), len(dense))), "id", "dense", dense, 1).first()
            if near and near["score"] >= DUPLICATE_COSINE:
                raise ValueError(f"too close to note {near['id']}")
        new = str(uuid.uuid4())
        carried = tags
        if supersedes is not None and not tags:
            old = self.log().where(F.col("id") == supersedes).select("tags").first()
            carried = old["tags"] if old else tags
        values = (
            new, 1, "put", project, memory_type, title, content, sorted(set(carried or [])), datetime.now(timezone.utc), supersedes, links,
            f"memory/{memory_type}/{new[:8]}", dense, SCHEMA_VERSION,
        )
        self._append(self.spark.createDataFrame([values], SCHEMA))
        return new

    def update(self, note_id: str, title: str | None = None, content: str | None = None, tags: list[str] | None = None) -> str:
        """A new note in place of an active one; null fields carry over."""
        old = self.get(note_id)
        if old["status"] == "superseded":
            raise ValueError("this note is superseded already")
        return self.store(old["project"], old["memory_type"], old["title"] if title is None else title, old["content"] if content is None else content, tags, supersedes=note_id)

    def get(self, note_id: str):
        row = self.current().where(F.col("id") == note_id).first()
        if row is None:
            raise KeyError(note_id)
        return row

    def delete(self, note_id: str) -> None:
        self.get(note_id)
        self._append(self.log().where(F.col("id") == note_id).limit(1).withColumns({"op": F.lit("delete"), "version": F.col("version") + 1}))

    def listed(self, project: str | None = None, memory_type: str | None = None, include_superseded: bool = False, limit: int = 30, offset: int = 0) -> DataFrame:
        rows = self.current()
        for column, value in (("project", project), ("memory_type", memory_type), ("status", None if include_superseded else "active")):
            rows = rows if value is None else rows.where(F.col(column) == value)
        return ranking.page(rows.withColumn("preview", T.preview(F.col("content"))).drop("dense"), "created_at", "id", offset, limit)

    def save_session(self, project: str, summary: str, next_steps: str | None = None, files: list[str] | None = None) -> str:
        """A handoff that supersedes the project's last one, which isn't linked back."""
        body = "\n\n".join(x for x in (summary, next_steps and f"Next: {next_steps}", files and "Files: " + ", ".join(files)) if x)
        active = self.current().where((F.col("status") == "active") & (F.col("project") == project) & (F.col("memory_type") == "session"))
        last = notes.newest_active(active, ["project"], "created_at").first()
        return self.store(project, "session", f"Session of {datetime.now(timezone.utc):%Y-%m-%d}", body, allow_duplicate=True, supersedes=last["id"] if last else None, links=False)

    def seed(self, project: str, rows: list[dict]) -> list[str]:
        """Store prepared notes, unless the project is unknown or has one of their titles."""
        if project not in self.projects():
            return []
        titles = self.spark.createDataFrame([(r["title"],) for r in rows], "title string")
        if titles.join(self.current().where(F.col("project") == project), "title", "left_semi").first():
            raise ValueError("some of these notes are there already")
        return [self.store(project, r["memory_type"], r["title"], r["content"], r.get("tags"), allow_duplicate=True) for r in rows]

    @contextlib.contextmanager
    def _alone(self) -> Iterator[None]:
        if self.lock is None:
            yield
            return
        with writer_lock(self.lock) as lock:
            if not lock:
                raise RuntimeError("another writer is at the notes")
            yield

    def compact(self) -> None:
        """Rewrite the log as one file. Rows that both hold count once, so readers may come at any time."""
        with self._alone():
            files = self.log().inputFiles()
            if len(files) < 2:
                return
            self._append(self.log().dropDuplicates(["id", "version"]))
            for name in files:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, False)

    def import_backup(self, folder: str, name: str | None = None, dry_run: bool = False) -> dict:
        """Bring notes back by their ids from a backup, the newest if none is named: embedded anew and stamped with this schema version.

        A dry run only lists them. Projects of notes that aren't registered are told as ``orphans``; their notes come back, too.
        """
        found = backups(self.spark, folder)
        if name is None and not found:
            raise ValueError(f"there are no backups in {folder}")
        path = f"{folder}/{name or found[-1]}"
        fields = ", ".join(f for f in SCHEMA.split(", ") if f.split()[0] not in ("dense", "schema_version"))
        known = self.spark.createDataFrame([(p,) for p in self.projects()], "project string")
        rows, orphans = import_notes(self.spark, path, fields, known, check=not dry_run)
        listed = {"backup": path, "notes": rows.count(), "orphans": sorted(r["project"] for r in orphans.select("project").distinct().collect())}
        if dry_run:
            return listed | {"restored": 0, "titles": [r["title"] for r in rows.select("title").orderBy("title").limit(1000).collect()]}
        embed = self.embed
        if embed is None:
            made = rows.withColumn("dense", F.lit(None).cast("array<float>"))
        else:

            def run(batches):
                for batch in batches:
                    texts = [f"{t or ''}\n\n{c or ''}" for t, c in zip(batch.column("title").to_pylist(), batch.column("content").to_pylist(), strict=True)]
                    vectors_ = pa.array([embed(t) for t in texts], pa.list_(pa.float32()))
                    yield pa.record_batch([*batch.columns, vectors_], names=[*batch.schema.names, "dense"])

            made = rows.mapInArrow(run, f"{fields}, dense array<float>")
        # A note that is there already gets a version above all it has.
        last = self.log().groupBy("id").agg(F.max("version").alias("_last"))
        made = made.withColumn("schema_version", F.lit(SCHEMA_VERSION)).join(last, "id", "left")
        made = made.withColumns({"version": F.coalesce(F.col("_last") + 1, "version", F.lit(1)), "op": F.lit("put")})
        with self._alone():
            self._append(stored(made, "notes-restored"))
        return listed | {"restored": listed["notes"]}

    def briefing(self, now=None) -> DataFrame:
        return notes.briefing(self.current(), now if now is not None else F.current_timestamp())


def to_json(rows: DataFrame) -> str:
    """Results as one JSON text, for callers over a wire; only for results of a bounded page."""
    return json.dumps([json.loads(x) for x in rows.toJSON().collect()], ensure_ascii=False)
