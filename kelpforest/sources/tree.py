"""A data source that walks source trees: ``spark.read.format("source_tree").option("root", ...)``.

Spark's own readers hide names that start with ``_`` or ``.``, which are wanted
here. A tree is read in two phases. The first lists it: each partition walks a
subtree, of which there are ``SUBTREES`` or more if the tree has so many folders, and ignore
files apply from the top down, the last verdict wins. No file but those is opened. The second (:func:`contents`) opens the
files that are still wanted after all rules of path and size, dealt over tasks by a hash of the path;
as the rules leave out large files, that gives tasks about equal bytes, whatever folders the files lie in.
"""

from __future__ import annotations

import hashlib
import os
import re
import subprocess
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from kelpforest.constants import IGNORED_DIRS

SCHEMA = "path string, size bigint, mtime timestamp, ignored boolean"
#: Subtrees to list side by side, at least.
SUBTREES = 64


def _glob(pattern: str) -> str:
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        elif pattern[i] == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            out, i = out + "[" + pattern[i + 1 : end].replace("!", "^", 1) + "]", end + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return out


class IgnoreRules:
    """The lines of one ignore file, for paths relative to its folder."""

    def __init__(self, text: str):
        self.rules = []
        for line in text.splitlines():
            line = line.rstrip()
            if not line or line.startswith("#"):
                continue
            negative, line = line.startswith("!"), line.removeprefix("!")
            folder_only, line = line.endswith("/"), line.rstrip("/")
            anchored, line = "/" in line, line.removeprefix("/")
            self.rules.append((re.compile(("" if anchored else "(?:.*/)?") + _glob(line) + r"\Z"), folder_only, not negative))

    def verdict(self, path: str, folder: bool) -> bool | None:
        out = None
        for rule, folder_only, ignores in self.rules:
            if (folder or not folder_only) and rule.match(path):
                out = ignores
        return out


def ignored(path: str, folder: bool, rules: dict[str, IgnoreRules]) -> bool:
    """Verdict for a path (relative to the root) from the files of all folders above it; an ignored folder hides what is in it."""
    parts = path.split("/")
    for depth in range(1, len(parts) + 1):
        here, is_folder = "/".join(parts[:depth]), depth < len(parts) or folder
        verdict = False
        for up in range(depth):
            base = "/".join(parts[:up])
            if base in rules:
                said = rules[base].verdict(here[len(base) + 1 if base else 0 :], is_folder)
                verdict = verdict if said is None else said
        if verdict:
            return True
    return False


def head_commit(root: str) -> str | None:
    """The commit that is checked out, or None outside a repository."""
    try:
        said = subprocess.run(["git", "-C", root, "rev-parse", "HEAD"], capture_output=True, text=True, timeout=10, check=True)
    except (OSError, subprocess.SubprocessError):
        return None
    return said.stdout.strip() or None


def walk(root: str, below: str = "", deep: bool = True) -> Iterator[tuple]:
    rules: dict[str, IgnoreRules] = {}

    def load(folder: str) -> None:
        try:
            with open(os.path.join(root, folder, ".gitignore"), encoding="utf-8", errors="replace") as f:
                rules[folder] = IgnoreRules(f.read())
        except OSError:
            pass

    parts = below.split("/") if below else []
    for depth in range(len(parts)):
        load("/".join(parts[:depth]))
    for folder, folders, names in os.walk(os.path.join(root, below)):
        here = os.path.relpath(folder, root).replace(os.sep, "/")
        here = "" if here == "." else here
        load(here)
        folders[:] = sorted(d for d in folders if deep and d not in IGNORED_DIRS and not ignored(f"{here}/{d}".lstrip("/"), True, rules))
        for name in sorted(names):
            path, full = f"{here}/{name}".lstrip("/"), os.path.join(folder, name)
            real = os.path.realpath(full)
            if not real.startswith(os.path.realpath(root) + os.sep):
                continue
            try:
                stat = os.stat(full)
                yield path, stat.st_size, datetime.fromtimestamp(stat.st_mtime, timezone.utc), ignored(path, False, rules)
            except OSError:
                yield path, None, None, False


def read_file(path: str) -> bytes | None:
    """A file's bytes; None if it can't be read any more."""
    try:
        with open(path, "rb") as f:
            return f.read()
    except OSError:
        return None


def contents(listed: DataFrame, root: str) -> DataFrame:
    """Listed files with ``hash`` and ``content``; ``size`` is null for those that can't be read. A task holds a few files at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                some = batch.slice(at, 16)
                found = [read_file(os.path.join(root, p)) for p in some.column("path").to_pylist()]
                size = pa.array([None if x is None else n for x, n in zip(found, some.column("size").to_pylist(), strict=True)], pa.int64())
                rest = [size if c == "size" else some.column(c) for c in some.schema.names]
                hashes = pa.array([None if x is None else hashlib.sha256(x).hexdigest() for x in found], pa.string())
                yield pa.record_batch([*rest, hashes, pa.array(found, pa.binary())], names=[*some.schema.names, "hash", "content"])

    dealt = listed.repartition(4 * listed.sparkSession.sparkContext.defaultParallelism, "path")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in listed.schema)
    return dealt.mapInArrow(run, f"{schema}, hash string, content binary")


class _Subtree(InputPartition):
    def __init__(self, below: str, deep: bool):
        self.below, self.deep = below, deep


def _folders(path: str) -> list[str]:
    try:
        with os.scandir(path) as found:
            return sorted(d.name for d in found if d.is_dir(follow_symlinks=False) and d.name not in IGNORED_DIRS)
    except OSError:
        return []


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.root = options["root"]
        self.only = [p for p in (options.get("only") or "").split(",") if p]

    def partitions(self):
        roots = [p.strip("/") for p in self.only if os.path.isdir(os.path.join(self.root, p))] if self.only else [""]
        out, deep = [], list(dict.fromkeys(roots))
        # Folders are opened level by level until there are enough of them to walk side by side.
        while deep and len(deep) < SUBTREES:
            below = []
            for base in deep:
                out.append(_Subtree(base, False))
                below += [f"{base}/{name}".lstrip("/") for name in _folders(os.path.join(self.root, base))]
            deep = below
        return [*out, *(_Subtree(d, True) for d in deep)]

    def read(self, partition):
        yield from walk(self.root, partition.below, partition.deep)


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)
