"""Notes: an append-only log of versions; status and links are derived, so a supersede is one atomic append."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kelpforest.constants import MAX_NOTE, MIN_NOTE, NOTE_TYPES, STALE_DAYS, STALE_TYPES
from kelpforest.functions.text import preview
from kelpforest.sources.folders import forget, stored


def reject_reason(project: Column, kind: Column, title: Column, content: Column, projects: list[str] | None = None) -> Column:
    """The first rule that a note breaks, or null."""
    size = F.length(F.coalesce(content, F.lit("")))
    known = project.isin(*projects) if projects is not None else project.isNotNull()
    return (
        F.when(~F.coalesce(known, F.lit(False)), "unknown project")
        .when(~F.coalesce(kind.isin(*NOTE_TYPES), F.lit(False)), "unknown type")
        .when(F.trim(F.coalesce(title, F.lit(""))) == "", "no title")
        .when(size < MIN_NOTE, "too short")
        .when(size > MAX_NOTE, "too long")
    )


def tags(values: Column) -> Column:
    return F.array_sort(F.array_distinct(F.coalesce(values, F.array().cast("array<string>"))))


def note_path(kind: Column, note_id: Column) -> Column:
    return F.concat_ws("/", F.lit("memory"), kind, F.substring(note_id, 1, 8))


def current(log: DataFrame) -> DataFrame:
    """Notes as they are: last version by id without tombstones; superseded where another note says so.

    Log: (id, version, op, project, memory_type, title, content, tags, created_at, supersedes, links). A session's
    successor doesn't link back, which ``links`` = false tells.
    """
    last = F.row_number().over(W.partitionBy("id").orderBy(F.desc("version")))
    rows = log.withColumn("_r", last).where("_r = 1 AND op != 'delete'").drop("_r")
    by = log.where("supersedes IS NOT NULL AND op != 'delete'").groupBy("supersedes").agg(
        F.max_by("id", "created_at").alias("successor"), F.max("created_at").alias("since"), F.max_by("links", "created_at").alias("_links")
    )
    out = rows.join(by.withColumnRenamed("supersedes", "_of"), F.col("id") == F.col("_of"), "left").drop("_of")
    return out.select(
        *rows.columns,
        F.when(F.col("successor").isNull(), "active").otherwise("superseded").alias("status"),
        F.coalesce("since", "created_at").alias("updated_at"),
        F.when(F.col("_links"), F.col("successor")).alias("superseded_by"),
    )


def updated(old: DataFrame, new_id: Column, now: Column, title: str | None = None, content: str | None = None, new_tags: list[str] | None = None) -> DataFrame:
    """The log row that updates an active note: null fields carry over, as do tags if the new ones are empty."""
    kept = F.when(F.col("status") == "superseded", F.raise_error(F.lit("this note is superseded already"))).otherwise(F.col("id"))
    pick = lambda value, c: F.col(c) if value is None else F.lit(value)
    return old.select(
        new_id.alias("id"),
        F.lit(1).alias("version"),
        F.lit("put").alias("op"),
        "project",
        "memory_type",
        pick(title, "title").alias("title"),
        pick(content, "content").alias("content"),
        (tags(F.array(*map(F.lit, new_tags))) if new_tags else F.col("tags")).alias("tags"),
        now.alias("created_at"),
        kept.alias("supersedes"),
        F.lit(True).alias("links"),
    )


def newest_active(notes: DataFrame, by: list[str], newest: str, key: str = "id") -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc(newest), key))
    return notes.withColumn("_r", rank).where("_r = 1").drop("_r")


def chains(links: DataFrame) -> DataFrame:
    """(id, head, hops, cyclic): the last successor of every note; links (id, next).

    Of several successors the greatest id counts. Steps double each round, and
    rounds are written. Who still goes on when a round has brought nobody to an end goes round a cycle or leads
    to one, since ends are reached from all distances up to the longest; those get
    the cycle's least id as head and no hops.
    """
    state = links.where("id IS NOT NULL AND next IS NOT NULL").groupBy("id").agg(F.max("next").alias("head"))
    state = state.select("id", "head", F.lit(1).cast("long").alias("hops"), F.col("head").alias("least"), F.lit(True).alias("open"))
    before, going, steps = None, None, 1
    while True:
        on = state.select(F.col("id").alias("head"), F.col("head").alias("_head"), F.col("hops").alias("_hops"), F.col("least").alias("_least"))
        # Saturated far below what a long holds.
        more = F.least(F.col("hops") + F.coalesce("_hops", F.lit(0)), F.lit(1 << 61))
        stepped = state.join(on, "head", "left").select(
            "id", F.coalesce("_head", "head").alias("head"), more.alias("hops"), F.least("least", "_least").alias("least"), F.col("_head").isNotNull().alias("open")
        )
        after = stored(stepped, "chains")
        forget(before)
        before, state, steps = after, after, 2 * steps
        left = after.where("open").count()
        if left == 0 or left == going and steps >= left:
            break
        going = left
    ends = state.where("NOT open").select("id", "head", F.col("hops").cast("int").alias("hops"), F.lit(False).alias("cyclic"))
    if not left:
        return ends
    # A head is on its cycle by now, and the least id on its way is the cycle's.
    on = state.where("open").select(F.col("id").alias("head"), F.col("least").alias("_least"))
    loops = state.where("open").join(on, "head").select("id", F.col("_least").alias("head"), F.lit(None).cast("int").alias("hops"), F.lit(True).alias("cyclic"))
    return ends.unionByName(loops)


def briefing(notes: DataFrame, now: Column) -> DataFrame:
    """Per project: counts, and what there is to read, in order: the newest session and all decisions in full, the ten newest others by
    preview, with a mark on those that may be stale. Each of ``session``, ``decision``, ``other`` is array<struct<r, line>>."""
    age = F.floor((F.unix_timestamp(now) - F.unix_timestamp("created_at")) / 86400)
    active = notes.where("status = 'active'")
    newest = F.row_number().over(W.partitionBy("project").orderBy(F.desc("created_at"), "id"))
    recent = active.withColumn("_n", newest).where("_n <= 100")
    kind = F.when(F.col("memory_type").isin("session", "decision"), F.col("memory_type")).otherwise("other")
    nth = F.row_number().over(W.partitionBy("project", "_k").orderBy(F.desc("created_at"), "id"))
    shown = recent.withColumn("_k", kind).withColumn("_r", nth)
    shown = shown.where("(_k = 'session' AND _r = 1) OR _k = 'decision' OR (_k = 'other' AND _r <= 10)")
    stale = F.when((age > STALE_DAYS) & F.col("memory_type").isin(*STALE_TYPES), F.lit(f" [over {STALE_DAYS} days old, check it]")).otherwise(F.lit(""))
    short = F.substring(F.col("id").cast("string"), 1, 8)
    line = (
        F.when(F.col("_k") == "session", F.col("content"))
        .when(F.col("_k") == "decision", F.concat(F.lit("### "), "title", F.lit("\n"), "content"))
        .otherwise(F.concat(F.lit("- ["), "memory_type", F.lit("] "), "title", F.lit(" ("), short, F.lit(")"), stale, F.lit("\n  "), preview(F.col("content"))))
    )
    listed = shown.groupBy("project").agg(
        *(F.sort_array(F.collect_list(F.when(F.col("_k") == k, F.struct(F.col("_r").alias("r"), line.alias("line"))))).alias(k) for k in ("session", "decision", "other"))
    )
    counts = notes.groupBy("project").agg(F.count("*").alias("n"), F.count(F.when(F.col("status") == "active", 1)).alias("n_active"))
    return counts.join(listed, "project", "left")
