"""Versioned tables: segments of new rows and tombstones, manifests that list them, merge on read; JSON backups of notes."""

from __future__ import annotations

import contextlib
import json
import os
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kelpforest.sources.folders import forget, stored

KEEP = 30
#: Tables that can be built again from the sources, and the one that can't.
DERIVED, NOTES = ("chunks", "postings", "frequencies", "sizes"), "memory"
#: Segments of one level that are merged into one of the next; files that a manifest lists with their ranges; tombstones that are sent to every task.
FANOUT, LISTED, SENT = 8, 64, 100_000


class Conflict(RuntimeError):
    """Another writer has published a version meanwhile."""


@dataclass(frozen=True)
class Layout:
    """How a table is kept: rows are written in ``order``, tombstones name them by ``keys``. With ``sums`` the table holds signed
    amounts of that column, which are added up by ``keys`` where it is read; rows that come to 0 aren't there."""

    keys: tuple[str, ...] = ()
    order: tuple[str, ...] = ()
    sums: str | None = None


@dataclass(frozen=True)
class Change:
    """What a commit does to a table: ``gone`` (its keys, any columns more) takes away all earlier rows, ``rows`` are added."""

    rows: DataFrame | None = None
    gone: DataFrame | None = None
    layout: Layout = Layout()
    dim: int | None = None
    version: int | None = None


class Snapshots:
    """Tables under ``root`` on any file system that Spark reaches.

    A table is a list of segments, oldest first. A commit writes one segment a
    table: new rows, and tombstones of the keys whose earlier rows are gone; so it
    writes in proportion to the change. Readers join a segment's rows with the tombstones of later
    ones whose range of keys overlaps its own. ``compact`` merges the newest ``FANOUT``
    segments of a level into one of the next, so a row is written again once a level.

    A commit is published by a manifest, a numbered file. It is written aside
    and then put in place whole, which fails with :class:`Conflict` if its number is taken: of two
    writers one leaves nothing behind. A reader keeps the version that it has
    resolved, and passes over a manifest that is no JSON.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # --- manifests ---

    def _manifest(self, number: int) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/_manifests/{number}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def numbers(self) -> list[int]:
        folder = self._path(f"{self.root}/_manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName().removesuffix(".json") for s in self._fs.listStatus(folder)]
        return sorted(int(n) for n in names if n.isdigit())

    def current(self) -> tuple[int, dict]:
        """The newest version's number and its tables: {name: {"path", "dim", "version", "schema", "layout", "segments"}}."""
        for number in reversed(self.numbers()):
            with contextlib.suppress(ValueError):
                return number, self._manifest(number)
        return 0, {}

    def _publish(self, number: int, tables: dict) -> None:
        folder = f"{self.root}/_manifests"
        aside, final = self._path(f"{folder}/.{number}-{uuid.uuid4().hex}"), self._path(f"{folder}/{number}.json")
        stream = self._fs.create(aside, False)
        stream.write(json.dumps(tables).encode())
        stream.close()
        try:
            if self._fs.getUri().getScheme() == "file":
                # A link fails if the name is taken; renaming a local file would replace it.
                os.link(aside.toUri().getPath(), final.toUri().getPath())
            else:
                options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
                self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(aside, final, options)
        except Exception as e:
            raise Conflict(f"version {number} is there already") from e
        finally:
            self._fs.delete(aside, False)

    # --- segments ---

    def _folders(self, entry: dict, segment: dict) -> tuple[str, str]:
        return f"{entry['path']}/_seq={segment['name']}", f"{entry['path']}.gone/_seq={segment['name']}"

    def _scan(self, entry: dict, paths: list[str], gone: bool = False) -> DataFrame:
        """Rows, or tombstones, as they lie in folders or files of segments, with the number ``_at`` of the commit."""
        schema = StructType.fromJson(entry["schema"])
        if gone:
            schema = StructType([schema[k] for k in entry["layout"]["keys"]])
        if not paths:
            return self.spark.createDataFrame([], schema).withColumn("_at", F.lit(0))
        found = self.spark.read.schema(schema).option("basePath", entry["path"] + ".gone" * gone).parquet(*paths)
        return found.withColumn("_at", F.regexp_extract("_seq", r"^s(\d+)-", 1).cast("int")).drop("_seq")

    @staticmethod
    def _meets(a: dict, low, high) -> bool:
        return a["low"] is None or low is None or a["low"] <= high and low <= a["high"]

    def _merged(self, entry: dict, segments: list[dict], equal: dict | None = None) -> DataFrame:
        """The rows of segments that no later one of them has taken away, with ``_at``."""
        layout, equal = entry["layout"], equal or {}
        first = layout["order"][0] if layout["order"] else None
        values = None if first not in equal else equal[first] if isinstance(equal[first], list) else [equal[first]]
        near = lambda low, high: values is None or low is None or any(low <= v <= high for v in values)
        filters = F.lit(True)
        for name, value in equal.items():
            filters &= F.col(name).isin(value) if isinstance(value, list) else F.col(name) == value
        takers = [x for x in segments if x["gone"] and near(x["gone_low"], x["gone_high"])]
        clean, torn = [], []
        for s in segments:
            later = [x for x in takers if x["at"] > s["at"]]
            # Of a segment that lists its files, each goes its own way.
            for f in [s] if s["files"] is None else s["files"]:
                if f["rows"] and near(f["low"], f["high"]):
                    met = any(self._meets(f, x["gone_low"], x["gone_high"]) for x in later)
                    (torn if met else clean).append((s, None if f is s else f["name"]))

        def read(some: list[tuple[dict, str | None]]) -> DataFrame:
            return self._scan(entry, [self._folders(entry, s)[0] + (f"/{f}" if f else "") for s, f in some]).where(filters)

        out = read(clean)
        if torn:
            gone = self._scan(entry, [self._folders(entry, x)[1] for x in takers], gone=True).where(_only(filters, equal, layout["keys"])).groupBy(*layout["keys"]).agg(F.max("_at").alias("_gone"))
            gone = F.broadcast(gone) if sum(x["gone"] for x in takers) <= SENT else gone
            met = read(torn).join(gone, list(layout["keys"]), "left").where("_gone IS NULL OR _at >= _gone").drop("_gone")
            out = out.unionByName(met)
        return out

    def _rows(self, entry: dict, equal: dict | None = None) -> DataFrame:
        columns = [f["name"] for f in entry["schema"]["fields"]]
        rows = self._merged(entry, entry["segments"], equal)
        return (_added(rows, entry["layout"]) if entry["layout"]["sums"] else rows).select(*columns)

    def read(self, table: str, **equal) -> DataFrame | None:
        """A table's rows, those that have the given values (lists: one of them) if there are any; segments and listed files out of range aren't opened."""
        entry = self.current()[1].get(table)
        return self._rows(entry, equal) if entry else None

    def _write(self, entry: dict, rows: DataFrame | None, gone: DataFrame | None, at: int, level: int = 0) -> dict | None:
        """Write a segment; None if it would be empty. Its description goes by what was written."""
        name = f"s{at}-{uuid.uuid4().hex}"
        segment = {"name": name, "at": at, "level": level, "rows": 0, "gone": 0, "bytes": 0, "low": None, "high": None, "files": [], "gone_low": None, "gone_high": None}
        to, gone_to = self._folders(entry, segment)
        order = entry["layout"]["order"]
        first = order[0] if order else None
        try:
            if rows is not None:
                # Either way small partitions are put together, and none is written empty.
                dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else rows.hint("rebalance")
                dealt.write.parquet(to)
                low, high = (F.min(first), F.max(first)) if first else (F.lit(None), F.lit(None))
                each = self.spark.read.schema(rows.schema).parquet(to).groupBy(F.col("_metadata.file_name").alias("name")).agg(F.count("*").alias("rows"), low.alias("low"), high.alias("high"))
                files = [r.asDict() for r in each.limit(LISTED + 1).collect()]
                if len(files) > LISTED:
                    top = each.agg(F.sum("rows").alias("rows"), F.min("low").alias("low"), F.max("high").alias("high")).first().asDict()
                    segment |= top | {"files": None}
                elif files:
                    # A file without a value there has no range, and is always read.
                    ends = [f for f in files if f["low"] is None] == []
                    segment |= {"files": files, "rows": sum(f["rows"] for f in files)}
                    segment |= {"low": min(f["low"] for f in files), "high": max(f["high"] for f in files)} if ends else {}
            if gone is not None and entry["layout"]["keys"]:
                keys = entry["layout"]["keys"]
                gone.select(*keys).distinct().coalesce(1).write.parquet(gone_to) if level == 0 else gone.select(*keys).distinct().write.parquet(gone_to)
                lead = (F.min(first), F.max(first)) if first in keys else (F.lit(None), F.lit(None))
                schema = StructType([f for f in gone.select(*keys).schema])
                n, low, high = self.spark.read.schema(schema).parquet(gone_to).agg(F.count("*"), *lead).first()
                segment |= {"gone": n, "gone_low": low, "gone_high": high}
            for path, n in ((to, segment["rows"]), (gone_to, segment["gone"])):
                if n:
                    segment["bytes"] += self._fs.getContentSummary(self._path(path)).getLength()
                else:
                    self._fs.delete(self._path(path), True)
        except BaseException:
            self._forget(entry, segment)
            raise
        return segment if segment["rows"] or segment["gone"] else None

    def _forget(self, entry: dict, segment: dict) -> None:
        for path in self._folders(entry, segment):
            self._fs.delete(self._path(path), True)

    # --- commits ---

    def _commit(self, changes: dict[str, Change], base: int | None, anew: bool) -> int:
        number, now = self.current()
        if base is not None and base != number:
            raise Conflict(f"version {number} has come after {base}")
        at = max(self.numbers(), default=0) + 1
        after, due, written = dict(now), [], []
        try:
            for name, change in changes.items():
                old = now.get(name)
                fields = change.rows.schema.jsonValue() if change.rows is not None else old["schema"] if old else None
                if fields is None:
                    continue
                if old and change.dim is not None and old["dim"] not in (None, change.dim):
                    raise ValueError(f"{name} has vectors of {old['dim']} components, not of {change.dim}; index into a new table")
                fresh = old is None or anew
                if not fresh:
                    known = {f["name"] for f in old["schema"]["fields"]}
                    fields = {**old["schema"], "fields": old["schema"]["fields"] + [f for f in fields["fields"] if f["name"] not in known]}
                entry = {
                    "path": f"{self.root}/{name}",
                    "dim": change.dim if change.dim is not None else old["dim"] if old else None,
                    "version": change.version if change.version is not None else old["version"] if old else None,
                    "schema": fields,
                    "layout": asdict(change.layout) if fresh else old["layout"],
                    "segments": [] if fresh else list(old["segments"]),
                }
                due.append((entry, change.rows, None if fresh else change.gone))
                after[name] = entry
            # Tables are written side by side, as most of a small commit is waiting.
            with ThreadPoolExecutor(max(len(due), 1)) as pool:
                jobs = [(entry, pool.submit(self._write, entry, rows, gone, at)) for entry, rows, gone in due]
            failed = [job.exception() for _, job in jobs if job.exception()]
            written = [(entry, job.result()) for entry, job in jobs if not job.exception() and job.result()]
            if failed:
                raise failed[0]
            for entry, segment in written:
                entry["segments"].append(segment)
            self._publish(at, after)
        except BaseException:
            for entry, segment in written:
                self._forget(entry, segment)
            raise
        return at

    def apply(self, changes: dict[str, Change], base: int | None = None) -> int:
        """Publish changes of several tables as one version after ``base`` (the newest, if none is named)."""
        return self._commit(changes, base, anew=False)

    def commit_all(self, tables: dict[str, DataFrame], base: int | None = None, layouts: dict[str, Layout] | None = None) -> int:
        """Start tables anew with these rows, as one version."""
        return self._commit({name: Change(rows, layout=(layouts or {}).get(name, Layout())) for name, rows in tables.items()}, base, anew=True)

    def commit(self, table: str, rows: DataFrame) -> int:
        return self.commit_all({table: rows})

    def compact(self, table: str, everything: bool = False) -> bool:
        """Merge the newest segments of one level, if there are ``FANOUT`` of them, or all; whether there was something to merge.

        Tombstones go with the rows that they have taken away; they stay where older segments are left.
        """
        number, now = self.current()
        entry = now.get(table)
        segments = entry["segments"] if entry else []
        run = segments if everything else [s for s in segments if segments and s["level"] == segments[-1]["level"]]
        if len(run) < (2 if everything else FANOUT) and not (everything and run and run[0]["gone"]):
            return False
        older = segments[: len(segments) - len(run)]
        rows = self._merged(entry, run)
        rows = _added(rows, entry["layout"]) if entry["layout"]["sums"] else rows
        gone = [self._folders(entry, s)[1] for s in run if s["gone"]] if older else []
        gone = self._scan(entry, gone, gone=True) if gone else None
        one = self._write(entry, rows.select(*(f["name"] for f in entry["schema"]["fields"])), gone, run[-1]["at"], run[-1]["level"] + 1)
        try:
            self._publish(max(self.numbers()) + 1, now | {table: entry | {"segments": older + ([one] if one else [])}})
        except BaseException:
            if one:
                self._forget(entry, one)
            raise
        return True

    # --- upkeep ---

    def ensure(self, table: str, empty: DataFrame, dim: int | None = None, layout: Layout = Layout()) -> bool:
        """Create a table if it isn't there (True); one whose vectors have another dimension is an error."""
        now = self.current()[1]
        if table not in now or dim not in (None, now[table]["dim"]):
            self.apply({table: Change(empty.limit(0) if table not in now else None, layout=layout, dim=dim)})
        return table not in now

    def recreate(self, table: str, empty: DataFrame, dim: int | None = None) -> None:
        """Start a derived table anew; notes and unknown tables are refused."""
        if table not in DERIVED:
            raise ValueError(f"{table} is not built from sources, so it isn't dropped")
        self._drop([table])
        self.ensure(table, empty, dim)

    def status(self) -> list[dict]:
        """Per table: rows and dimension."""
        return [{"table": t, "rows": self._rows(e).count(), "dim": e.get("dim")} for t, e in self.current()[1].items()]

    def expire(self, keep: int = 2) -> None:
        """Delete all but the newest ``keep`` versions, and the segments that only those named."""
        numbers = self.numbers()
        gone, kept = numbers[:-keep], numbers[-keep:]
        manifests = {}
        for number in numbers:
            with contextlib.suppress(ValueError):
                manifests[number] = self._manifest(number)
        needed = {(e["path"], s["name"]) for n in kept for e in manifests.get(n, {}).values() for s in e["segments"]}
        for number in gone:
            for entry in manifests.get(number, {}).values():
                for segment in entry["segments"]:
                    if (entry["path"], segment["name"]) not in needed:
                        self._forget(entry, segment)
            self._fs.delete(self._path(f"{self.root}/_manifests/{number}.json"), False)

    def _drop(self, tables: list[str]) -> None:
        _, now = self.current()
        self._publish(max(self.numbers(), default=0) + 1, {t: e for t, e in now.items() if t not in tables})
        for t in tables:
            for segment in now[t]["segments"] if t in now else ():
                self._forget(now[t], segment)

    def damaged(self) -> list[str]:
        """Tables that can't be read to their end."""
        bad = []
        for t, entry in self.current()[1].items():
            try:
                self._rows(entry).write.format("noop").mode("overwrite").save()
            except Exception:
                bad.append(t)
        return bad

    def recover(self) -> list[str]:
        """Where a derived table is damaged, drop all of them, to be indexed again; damaged notes are refused, and nothing is touched."""
        bad = self.damaged()
        if NOTES in bad:
            raise ValueError("the notes are damaged; restore them from a backup first")
        gone = [t for t in self.current()[1] if t in DERIVED] if bad else []
        if gone:
            self._drop(gone)
        return gone


def _only(filters, equal: dict, keys) -> object:
    """The filters that speak of keys alone, for tombstones; all or nothing."""
    return filters if set(equal) <= set(keys) else F.lit(True)


def _added(rows: DataFrame, layout: dict) -> DataFrame:
    """Signed amounts summed by key; what comes to 0 is gone."""
    amount = layout["sums"]
    return rows.groupBy(*layout["keys"]).agg(F.sum(amount).alias(amount)).where(F.col(amount) != 0)


def _file_system(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    return hadoop, hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())


def backups(spark: SparkSession, path: str) -> list[str]:
    """Names of the backups in a folder, oldest first."""
    hadoop, fs = _file_system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(hadoop(path)) if s.isDirectory()) if fs.exists(hadoop(path)) else []


def export_notes(notes: DataFrame, path: str, now: datetime | None = None, keep: int = KEEP) -> str:
    """Write today's backup (one JSON line per note and a manifest line); refuses to replace history by nothing."""
    spark = notes.sparkSession
    now = now or datetime.now(timezone.utc)
    hadoop, fs = _file_system(spark, path)
    days = backups(spark, path)
    day, count = f"memory-{now:%Y-%m-%d}", notes.count()
    if not count:
        earlier = [d for d in days if d != day]
        if earlier and spark.read.json(f"{path}/{earlier[-1]}/notes", schema="id string").count():
            raise ValueError("there are no notes now, but the last backup has some; nothing was written")
    notes.write.mode("overwrite").json(f"{path}/{day}/notes")
    manifest = {"exported_at": now.isoformat(), "collection": "memory", "count": count}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{day}/manifest")
    for old in sorted({*days, day})[:-keep]:
        fs.delete(hadoop(f"{path}/{old}"), True)
    return f"{path}/{day}"


def import_notes(spark: SparkSession, path: str, schema, projects: DataFrame | None = None, check: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """Notes of a backup, and those of projects that aren't registered. ``check`` refuses backups of anything else."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()["value"])
    if check and manifest["collection"] != "memory":
        raise ValueError(f"a backup of {manifest['collection']} is no backup of notes")
    notes = spark.read.json(f"{path}/notes", schema=schema)
    orphans = None if projects is None else notes.join(projects.select("project").distinct(), "project", "left_anti")
    return notes, orphans


def with_schema_version(rows: DataFrame, version: int) -> DataFrame:
    return rows.withColumn("schema_version", F.lit(version))
