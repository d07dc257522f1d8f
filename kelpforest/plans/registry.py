"""Projects: registration, lookup, removal and status; a lock for those who write."""

from __future__ import annotations

import contextlib
import json
import os
import re
import threading
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpforest.constants import STALE_LOCK
from kelpforest.operators import classify
from kelpforest.plans import index
from kelpforest.sources.snapshots import Snapshots

# --- fixed values: names of projects ---
SLUG = re.compile(r"[a-z0-9][a-z0-9-]{0,49}")


class Registry:
    """Projects in order of registration, in a JSON file on the driver."""

    def __init__(self, path: str):
        self.path = path

    def projects(self) -> list[dict]:
        try:
            with open(self.path) as f:
                return json.load(f)
        except FileNotFoundError:
            return []

    def names(self) -> list[str]:
        return [p["name"] for p in self.projects()]

    def _write(self, projects: list[dict]) -> None:
        with open(self.path + ".new", "w") as f:
            json.dump(projects, f, indent=1)
        os.replace(self.path + ".new", self.path)

    def register(self, name: str, root: str, description: str, only: list[str] | None = None) -> None:
        root = root.rstrip("/") or "/"
        if not SLUG.fullmatch(name):
            raise ValueError("a project's name has small letters, digits and dashes, 50 at most")
        if not os.path.isabs(root) or not os.path.isdir(root):
            raise ValueError(f"{root} is no absolute path of a folder")
        if not description.strip():
            raise ValueError("a project needs a description")
        others = [p for p in self.projects() if p["name"] != name]
        if any(p["root"] == root for p in others):
            raise ValueError(f"{root} is registered under another name")
        mine = {"name": name, "root": root, "description": description, "only": only or []}
        known = self.names()
        self._write([mine if p["name"] == name else p for p in self.projects()] if name in known else [*others, mine])

    def unregister(self, name: str, store: Snapshots | None = None) -> None:
        """Drop a project and its derived rows; notes stay."""
        self._write([p for p in self.projects() if p["name"] != name])
        if store:
            index.remove(store, name)

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(p["name"], p["root"], i) for i, p in enumerate(self.projects())]
        return spark.createDataFrame(rows, "project string, root string, ordinal int")

    def find(self, spark: SparkSession, path: str) -> str | None:
        """The first project whose root is the path or above it."""
        row = classify.owning_project(spark.createDataFrame([(path,)], "path string"), self.frame(spark)).first()
        return row["project"] if row else None


def status(registry: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per project and collection: chunks and when they were last indexed; registered projects without any show 0."""
    found = chunks.groupBy("project", "collection").agg(F.count("*").alias("n"), F.max("indexed_at").alias("last_indexed"))
    return registry.select("project").join(found, "project", "left").select("project", "collection", F.coalesce("n", F.lit(0)).alias("n"), "last_indexed")


def sized(registry: DataFrame, sizes: DataFrame) -> DataFrame:
    """As :func:`status`, of the sizes that commits keep: no chunk is read."""
    found = sizes.groupBy("project", "collection").agg(F.sum("n").alias("n"), F.max("indexed_at").alias("last_indexed"))
    return registry.select("project").join(found, "project", "left").select("project", "collection", F.coalesce("n", F.lit(0)).alias("n"), "last_indexed")


def check_versions(chunks: DataFrame, version: int) -> None:
    """An error where rows of another schema version are left."""
    other = chunks.where(F.col("schema_version") != version).select("schema_version").first()
    if other:
        raise ValueError(f"rows of schema version {other[0]} are left; index again")


class Lock:
    """A lock file that is touched while its holder works; only its own holder removes it."""

    def __init__(self, path: str, stale: float):
        self.path, self.stale, self.token = path, stale, uuid.uuid4().hex
        self._over = threading.Event()

    def _mine(self) -> bool:
        try:
            with open(self.path) as f:
                return f.read() == self.token
        except FileNotFoundError:
            return False

    def take(self) -> bool:
        with contextlib.suppress(FileNotFoundError):
            if time.time() - os.path.getmtime(self.path) > self.stale:
                # Of several that find it stale, one gets to move it away.
                aside = f"{self.path}.{self.token}"
                os.rename(self.path, aside)
                if time.time() - os.path.getmtime(aside) <= self.stale:
                    # It was a fresh one by then: it goes back, unless a third one has come.
                    with contextlib.suppress(FileExistsError):
                        os.link(aside, self.path)
                    os.unlink(aside)
                    return False
                os.unlink(aside)
        # Written aside and linked, so that a lock is never seen without its holder's token.
        with open(f"{self.path}.{self.token}.new", "w") as f:
            f.write(self.token)
        try:
            os.link(f.name, self.path)
        except FileExistsError:
            return False
        finally:
            os.unlink(f.name)
        threading.Thread(target=self._keep, daemon=True).start()
        return True

    def _keep(self) -> None:
        while not self._over.wait(self.stale / 4):
            with contextlib.suppress(RuntimeError):
                self.beat()

    def beat(self) -> None:
        """Touch the lock; an error if another has taken it over."""
        if not self._mine():
            self._over.set()
            raise RuntimeError("another writer has taken the lock over")
        os.utime(self.path)

    def drop(self) -> None:
        self._over.set()
        if self._mine():
            with contextlib.suppress(FileNotFoundError):
                os.unlink(self.path)


@contextlib.contextmanager
def writer_lock(path: str, stale: float = STALE_LOCK) -> Iterator[Lock | None]:
    """The lock for the one writer, None for others; one that hasn't been touched for ``stale`` seconds is taken over."""
    lock = Lock(path, stale)
    if not lock.take():
        yield None
        return
    try:
        yield lock
    finally:
        lock.drop()
