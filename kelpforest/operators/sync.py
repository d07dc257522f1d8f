"""Incremental maintenance: what is new, gone, renamed or unchanged against the ledger of a collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ledger(chunks: DataFrame) -> DataFrame:
    """(collection, path, hash) of what is indexed; a path's last chunk decides."""
    return chunks.groupBy("collection", "path").agg(F.max_by("hash", "chunk_index").alias("hash"))


def diff(files: DataFrame, old: DataFrame) -> DataFrame:
    """(collection, path, hash, action): action is unchanged, index or delete; both sides are joined once on (collection, path)."""
    now = files.select("collection", "path", F.col("hash").alias("new"))
    then = old.select("collection", "path", F.col("hash").alias("was"))
    action = F.when(F.col("new").isNull(), "delete").when(F.col("new") == F.col("was"), "unchanged").otherwise("index")
    return now.join(then, ["collection", "path"], "full").select("collection", "path", F.coalesce("new", "was").alias("hash"), action.alias("action"))


def renames(changes: DataFrame, files: DataFrame) -> DataFrame:
    """Deleted rows whose content is somewhere on disk; they are counted as deletes, too."""
    return changes.where("action = 'delete'").join(files.select("hash").distinct(), "hash", "left_semi")


def statistics(changes: DataFrame, files: DataFrame) -> DataFrame:
    counts = changes.agg(*(F.count(F.when(F.col("action") == a, 1)).alias(a) for a in ("index", "unchanged", "delete")))
    return counts.crossJoin(F.broadcast(renames(changes, files).agg(F.count("*").alias("renamed"))))


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """The next snapshot: ``new`` replaces rows of the same key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def replace_files(chunks: DataFrame, changes: DataFrame, fresh: DataFrame) -> DataFrame:
    """The next snapshot of chunks: files to delete or index lose their rows, and the indexed ones get ``fresh`` ones."""
    gone = changes.where("action != 'unchanged'").select("collection", "path")
    return chunks.join(gone, ["collection", "path"], "left_anti").unionByName(fresh)


def delete_project(chunks: DataFrame, project: str, collection: str) -> DataFrame:
    if collection == "memory":
        raise ValueError("notes are not derived data; they are not deleted with a project")
    return chunks.where((F.col("project") != project) | (F.col("collection") != collection))
