"""From a source tree to chunk tables: discover, classify, redact, compare with the ledger, chunk, embed, commit the difference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpforest.functions import text as T
from kelpforest.operators import chunking, classify, sync
from kelpforest.plans.models import Embedder
from kelpforest.sources.folders import forget, stored
from kelpforest.sources.snapshots import Change, Layout, Snapshots
from kelpforest.sources.tree import SourceTree, contents, head_commit

SCHEMA_VERSION = 1
#: Ranges of the postings by token, so that a query reads those of its tokens only.
BUCKETS = 64
#: Messages of files that couldn't be cut that a run tells; all of them are counted.
TOLD = 100
#: Chunks and their postings lie by project. Frequencies (chunks of a collection with a token) and sizes (chunks by project and by when
#: they were indexed) are signed amounts, so a commit adds what it changes and nothing is counted again.
LAYOUTS = {
    "chunks": Layout(("project", "collection", "source_path"), ("project", "collection", "source_path", "chunk_index")),
    "postings": Layout(("project", "collection", "id"), ("project", "bucket", "token")),
    "frequencies": Layout(("collection", "bucket", "token"), ("bucket", "token"), "df"),
    "sizes": Layout(("project", "collection", "indexed_at"), ("project",), "n"),
}


def listed(spark: SparkSession, root: str, project: str, only: str = "", extra_dirs: tuple[str, ...] = ()) -> DataFrame:
    """Every file of a tree with the reason to skip it that path and size give; none is opened."""
    spark.dataSource.register(SourceTree)
    found = spark.read.format("source_tree").option("root", root).option("only", only).load()
    path = F.col("path")
    return found.select(
        F.lit(project).alias("project"), "path", "size", "mtime", classify.skip_reason(path, F.col("size"), None, extra_dirs, F.col("ignored")).alias("skip_reason"),
        classify.chunker(path).alias("chunker"), classify.grammar(path).alias("grammar"), classify.language(path).alias("language"), classify.doc_type(path).alias("doc_type"),
        classify.collection(path).alias("collection"),
    )


def files(spark: SparkSession, root: str, project: str, only: str = "", extra_dirs: tuple[str, ...] = (), every: bool = True) -> DataFrame:
    """Files of a tree with ``skip_reason``, which is null for those to index, and the text of those that were opened; ``every``: also those that weren't."""
    all_ = listed(spark, root, project, only, extra_dirs)
    opened = contents(all_.where("skip_reason IS NULL"), root)
    reason = classify.skip_reason(F.col("path"), F.col("size"), F.col("content"), extra_dirs)
    opened = opened.withColumns({"skip_reason": reason, "text": F.col("content").cast("string")}).drop("content")
    if not every:
        return opened
    shut = all_.where("skip_reason IS NOT NULL").withColumns({"hash": F.lit(None).cast("string"), "text": F.lit(None).cast("string")})
    return opened.unionByName(shut)


def explain(found: DataFrame) -> DataFrame:
    """Files by reason of being skipped."""
    return found.groupBy(F.coalesce("skip_reason", F.lit("indexed")).alias("reason")).agg(F.count("*").alias("n"))


def chunks_of(found: DataFrame, now=None, embedder: Embedder | None = None) -> DataFrame:
    """Chunk rows of files, which are redacted before they are cut, with a header that is only embedded. Files that can't be cut are rows with ``error``."""
    embedder = embedder or Embedder()
    clean = found if "n_redacted" in found.columns else T.redacted(found)
    clean = clean.withColumn("key", F.col("path")).drop("skip_reason", "path", "n_redacted")
    carry = tuple(c for c in clean.columns if c not in ("key", "text"))
    cut = chunking.chunk(clean, carry, catch=True).withColumnRenamed("key", "path")
    head = T.header(F.col("path"), F.col("heading_path"), F.col("symbol_type"), F.col("symbol_name"))
    rows = cut.withColumns(
        {
            "id": T.chunk_id(F.col("project"), F.col("path"), F.coalesce("chunk_index", F.lit(0))),
            "indexed_at": F.current_timestamp() if now is None else now,
            "schema_version": F.lit(SCHEMA_VERSION),
            "embed_text": F.when(F.col("error").isNull(), T.embed_text(head, F.col("content"))),
        }
    ).withColumnRenamed("path", "source_path")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "embed_text")
    return rows.mapInArrow(embedder.column("embed_text", "dense"), f"{schema}, dense array<float>")


def postings_of(chunks: DataFrame) -> DataFrame:
    """(bucket, project, collection, id, token, tf): the lexical side of chunks, as it is stored."""
    # A chunk's names go with its text, so that no posting is shuffled to meet them.
    posts = T.postings(chunks.select(F.struct("project", "collection", "id").alias("chunk"), "content"), "chunk", "content")
    return posts.select(token_bucket(F.col("token")).alias("bucket"), "chunk.project", "chunk.collection", "chunk.id", "token", "tf")


def token_bucket(token: Column) -> Column:
    return F.pmod(F.crc32(F.encode(token, "UTF-8")), F.lit(BUCKETS)).cast("int")


def _frequencies(posts: DataFrame, sign: int) -> DataFrame:
    return posts.groupBy("collection", "bucket", "token").agg((sign * F.count("*")).alias("df"))


def _sizes(chunks: DataFrame, sign: int) -> DataFrame:
    return chunks.groupBy("project", "collection", "indexed_at").agg((sign * F.count("*")).alias("n"))


def commit(store: Snapshots, fresh: DataFrame | None, lost: DataFrame | None, base: int | None = None, embedder: Embedder | None = None) -> int:
    """Publish ``fresh`` chunks in place of ``lost`` ones, which are stored rows (project, collection, source_path, id, indexed_at).

    Postings, frequencies and sizes follow in the same version. What is written is
    in proportion to the rows of the two; only the postings of the lost ones' projects are read.
    """
    made = None if fresh is None else stored(postings_of(fresh), "postings-fresh")
    df, n, gone, gone_posts = [], [], None, None
    if fresh is not None:
        df.append(_frequencies(made, 1))
        n.append(_sizes(fresh, 1))
    if lost is not None and (projects := [r["project"] for r in lost.select("project").distinct().collect()]):
        ids = lost.select("project", "collection", "id")
        df.append(_frequencies(store.read("postings", project=projects).join(ids, ["project", "collection", "id"], "left_semi"), -1))
        n.append(_sizes(lost, -1))
        gone, gone_posts = lost.select("project", "collection", "source_path"), ids
    keys, layouts = LAYOUTS["frequencies"].keys, LAYOUTS
    changes = {
        "chunks": Change(fresh, gone, layouts["chunks"], embedder.dim if embedder else None, SCHEMA_VERSION),
        "postings": Change(made, gone_posts, layouts["postings"]),
        "frequencies": Change(_union(df).groupBy(*keys).agg(F.sum("df").alias("df")).where("df != 0") if df else None, None, layouts["frequencies"]),
        "sizes": Change(_union(n) if n else None, None, layouts["sizes"]),
    }
    number = store.apply(changes, base)
    forget(made)
    for table in changes:
        while store.compact(table):
            pass
    return number


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def remove(store: Snapshots, project: str) -> None:
    """Take away all chunks of a project."""
    old = store.read("chunks", project=project)
    if old is not None:
        lost = stored(old.select("project", "collection", "source_path", "id", "indexed_at"), "lost")
        if lost.first():
            commit(store, None, lost)
        forget(lost)


def index_project(
    spark: SparkSession,
    store: Snapshots,
    root: str,
    project: str,
    only_changed: bool = True,
    only: str = "",
    limit: int | None = None,
    embedder: Embedder | None = None,
    beat=lambda: None,
    reset: bool = False,
) -> DataFrame:
    """Bring a project's chunks up to date; gives the counts of what was done.

    Texts are redacted in the plan that reads them, so no secret is written
    anywhere, and what is stored between steps is deleted in the end. A file that can't be cut keeps the chunks it had
    (but with ``reset``, which makes all anew, in one version) and is told of in ``errors``, the first ``TOLD`` of ``n_errors``. With
    ``limit`` only the first files are looked at, and nothing is deleted. ``beat`` is called between steps, for those who hold a lock.
    """
    embedder = embedder or Embedder()
    base, _ = store.current()
    found = T.redacted(files(spark, root, project, only, (), False).where("skip_reason IS NULL")).withColumn("git_commit", F.lit(head_commit(root)).cast("string"))
    kept: list[DataFrame] = []

    def keep(rows: DataFrame, name: str) -> DataFrame:
        kept.append(stored(rows, name))
        beat()
        return kept[-1]

    try:
        found = keep(found if limit is None else found.orderBy("path").limit(limit), "files")
        old = store.read("chunks", project=project)
        disk = found.select("collection", "path", "hash")
        if old is None:
            changes = disk.withColumn("action", F.lit("index"))
        else:
            mine = old.select("collection", F.col("source_path").alias("path"), "hash", "chunk_index")
            changes = sync.diff(disk, sync.ledger(mine))
            if not only_changed or reset:
                changes = changes.withColumn("action", F.when(F.col("action") == "unchanged", "index").otherwise(F.col("action")))
            if limit is not None:
                changes = changes.where("action != 'delete'")
        changes = keep(changes, "changes")
        due = found.join(changes.where("action = 'index'").select("collection", "path"), ["collection", "path"], "left_semi")
        cut = keep(chunks_of(due, embedder=embedder), "chunks-cut")
        bad = cut.where("error IS NOT NULL")
        fresh = cut.where("error IS NULL").drop("error")
        lost = None
        if old is not None:
            gone = changes.where("action != 'unchanged'").select("collection", F.col("path").alias("source_path"))
            if not reset:
                gone = gone.join(bad.select("collection", "source_path"), ["collection", "source_path"], "left_anti")
            lost = keep(old.join(gone, ["collection", "source_path"], "left_semi").select("project", "collection", "source_path", "id", "indexed_at"), "lost")
        counts = _counts(changes, disk, fresh, bad)
        if old is None or changes.where("action != 'unchanged'").first():
            commit(store, fresh, lost, base, embedder)
        return counts
    finally:
        forget(*kept)


def _counts(changes: DataFrame, disk: DataFrame, fresh: DataFrame, bad: DataFrame) -> DataFrame:
    """A run's counts as a row of its own, which outlives the tables that it was made from."""
    fallback = F.countDistinct(F.when((F.col("chunker") == "code") & F.col("symbol_type").isNull(), F.col("source_path")))
    sums = fresh.agg(F.count("*").alias("n_chunks"), F.count(F.when(F.col("collection") == "docs", 1)).alias("n_docs"), fallback.alias("fallback"))
    failed = bad.agg(F.count("*").alias("n_errors"))
    told = [r["told"] for r in bad.select(F.concat_ws(": ", "source_path", "error").alias("told")).orderBy("told").limit(TOLD).collect()]
    rows = sync.statistics(changes, disk).crossJoin(F.broadcast(sums)).crossJoin(F.broadcast(failed)).withColumn("errors", F.array(*map(F.lit, told)).cast("array<string>"))
    return rows.sparkSession.createDataFrame([tuple(rows.first())], rows.schema)
