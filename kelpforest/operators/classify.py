"""Why a file is skipped, and what it is: ordered predicates over path, size and content."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpforest import constants as C


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """The last suffix in lower case, with its dot; none for names that only start with one."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def _looked_up(key: Column, position: int) -> Column:
    pairs = [x for ext, row in C.LANGUAGES.items() for x in (F.lit(ext), F.lit(row[position]).cast("string"))]
    return F.try_element_at(F.create_map(*pairs), key)


def type_key(path: Column) -> Column:
    """Key of the language table: the extension, or what a bare name stands for."""
    name = F.lower(file_name(path))
    by_name = F.when(name.isin("dockerfile"), F.lit(".dockerfile")).when(name == ".env.sample", F.lit(".example")).when(name == "makefile", F.lit(".sh"))
    return F.when(F.array_contains(F.array(*map(F.lit, C.LANGUAGES)), extension(path)), extension(path)).otherwise(by_name)


def chunker(path: Column) -> Column:
    return _looked_up(type_key(path), 0)


def grammar(path: Column) -> Column:
    return _looked_up(type_key(path), 1)


def language(path: Column) -> Column:
    return _looked_up(type_key(path), 2)


def doc_type(path: Column) -> Column:
    """First matching rule, for files that the docs chunker takes; ``*`` crosses slashes."""
    out = None
    for pattern, kind in C.DOC_TYPES:
        target = F.lower(path if "/" in pattern else file_name(path))
        fits = target.rlike("^" + fnmatch.translate(pattern).removeprefix("(?s:").removesuffix(r")\z").removesuffix(r")\Z") + "$")
        out = F.when(fits, kind) if out is None else out.when(fits, kind)
    return F.when(chunker(path) == "docs", out.otherwise("guide"))


def collection(path: Column) -> Column:
    return F.when(chunker(path) == "docs", "docs").otherwise("code")


def skip_reason(path: Column, size: Column, content: Column | None = None, extra_dirs: tuple[str, ...] = (), ignored: Column | None = None) -> Column:
    """The first reason not to take a file, or null. ``ignored``: the verdict of ignore files, where known."""
    name, folders = file_name(path), F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    out = (
        F.when(F.arrays_overlap(folders, F.array(*map(F.lit, (*C.IGNORED_DIRS, *extra_dirs)))), "ignored directory")
        .when(F.lower(name).isin(*(x.lower() for x in C.IGNORED_FILES)), "ignored file")
        .when(F.exists(F.array(*map(F.lit, C.IGNORED_SUFFIXES)), lambda x: F.endswith(name, x)), "generated")
        .when(extension(path).isin(*C.IGNORED_EXTENSIONS), "binary extension")
    )
    if ignored is not None:
        out = out.when(ignored, "ignore rule")
    out = out.when(size.isNull(), "unreadable").when(size == 0, "empty").when(size > C.MAX_FILE, "too large").when(chunker(path).isNull(), "unknown type")
    if content is not None:
        probe = F.substring(content, 1, C.PROBE)
        out = out.when((F.instr(F.hex(probe), "00") > 0) & F.hex(probe).rlike("^(?:..)*?00"), "binary").when(
            F.try_validate_utf8(content.cast("string")).isNull() & F.try_validate_utf8(probe.cast("string")).isNull(), "binary"
        )
    return out


def owning_project(paths: DataFrame, projects: DataFrame) -> DataFrame:
    """(path, project): the first project, in order of registration, whose root is the path or above it.

    A path joins on each of its ancestors, so no pair is made that doesn't match.
    """
    parts = F.split("path", "/")
    roots = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    above = paths.select("path").distinct().select("path", F.explode(roots).alias("root"))
    return above.join(projects, "root").groupBy("path").agg(F.min_by("project", "ordinal").alias("project"))
