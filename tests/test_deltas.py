"""Delta commits: merge on read, kept counts, what is written, compaction, publication."""

import os
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from kelpforest.functions import text as T
from kelpforest.operators import ranking as R
from kelpforest.plans import index, models
from kelpforest.plans.search import Searcher
from kelpforest.sources import snapshots
from kelpforest.sources.folders import shared_folder
from kelpforest.sources.snapshots import Change, Layout

CHUNK = "project string, collection string, source_path string, chunk_index int, id string, content string, hash string, indexed_at timestamp, schema_version int, dense array<float>"
WORDS = "scheduler retry queue ledger chunk token index vector cache shard merge commit fooBar snake_case".split()


def _chunk(project, path, i, content, day=1):
    return (project, "docs" if path.endswith(".md") else "code", path, i, f"{project}:{path}:{i}", content, f"h{content}", datetime(2024, 1, day), 1, [1.0, 0.0])


def _rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def _files(path):
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names}


def _recounted(store):
    """(collection, token, df) and (project, collection, n), counted from the chunks."""
    chunks = store.read("chunks")
    posts = T.postings(chunks, "id", "content").join(chunks.select("id", "collection", "project"), "id")
    return _rows(posts.groupBy("collection", "token").count(), "collection", "token", "count"), _rows(chunks.groupBy("project", "collection").count(), "project", "collection", "count"), _rows(posts, "project", "id", "token", "tf")


def _kept(store):
    sizes = store.read("sizes").groupBy("project", "collection").agg(F.sum("n").alias("n"))
    return _rows(store.read("frequencies"), "collection", "token", "df"), _rows(sizes, "project", "collection", "n"), _rows(store.read("postings"), "project", "id", "token", "tf")


def test_kept_counts_equal_a_recount(spark, tmp_path, monkeypatch):
    """Random commits of about 25 adds and deletes, with compactions among them; the model is a dict."""
    monkeypatch.setattr(snapshots, "FANOUT", 3)
    rng = random.Random(7)
    store = snapshots.Snapshots(spark, f"file://{tmp_path}/s")
    model = {}
    for step in range(9):
        project = rng.choice(["a", "b", "c"])
        paths = [f"{i}.{rng.choice(['md', 'py'])}" for i in rng.sample(range(6), rng.randint(1, 3))]
        fresh = [_chunk(project, p, i, " ".join(rng.choices(WORDS, k=5)), 1 + step) for p in paths for i in range(rng.randint(1, 3))]
        also = [k for k in model if k[0] == project and rng.random() < 0.3]
        lost = {k for k in model if k[0] == project and (k[1] in paths or k in also)}
        keys = {k[:2] for k in lost}
        gone = [r for k, rows in model.items() if k in lost for r in rows]
        base = store.current()[0]
        index.commit(store, spark.createDataFrame(fresh, CHUNK) if fresh else None, spark.createDataFrame(gone, CHUNK) if gone else None, base)
        model = {k: v for k, v in model.items() if k[:2] not in keys}
        for r in fresh:
            model.setdefault((project, r[2]), []).append(r)
    assert _rows(store.read("chunks"), "id", "content") == sorted((r[4], r[5]) for rows in model.values() for r in rows)
    for p in ("a", "b", "c"):
        assert _rows(store.read("chunks", project=p), "id") == sorted((r[4],) for k, rows in model.items() if k[0] == p for r in rows)
    recounted = _recounted(store)
    assert _kept(store) == recounted and recounted[0]
    assert max(len(e["segments"]) for e in store.current()[1].values()) < 9
    for table in store.current()[1]:
        store.compact(table, everything=True)
        entry = store.current()[1][table]
        assert len(entry["segments"]) <= 1 and not any(s["gone"] for s in entry["segments"])
    store.expire(1)
    assert _kept(store) == recounted
    # Only what the last version names is left.
    assert len(list((tmp_path / "s" / "chunks").iterdir())) == len(store.current()[1]["chunks"]["segments"])


def test_a_file_is_written_in_proportion(spark, tmp_path):
    """One file of a store of 100,000 chunks: what is written is a ten-thousandth of it."""
    store = snapshots.Snapshots(spark, f"file://{tmp_path}/s")
    many = spark.range(100_000).select(
        F.concat(F.lit("p"), (F.col("id") % 20).cast("string")).alias("project"), F.lit("code").alias("collection"), F.concat("id", F.lit(".py")).alias("source_path"), F.lit(0).alias("chunk_index"),
        F.col("id").cast("string").alias("id"), F.concat_ws(" ", F.sha2(F.col("id").cast("string"), 256), F.sha2((-F.col("id")).cast("string"), 512)).alias("content"), F.lit("h").alias("hash"),
        F.lit(datetime(2024, 1, 1)).alias("indexed_at"), F.lit(1).alias("schema_version"), F.array(F.lit(1.0).cast("float")).alias("dense"),
    )
    index.commit(store, many, None)
    before = _files(tmp_path / "s")
    old = store.read("chunks", project="p7").where("source_path = '7.py'")
    assert old.count() == 1
    number, _ = store.current()
    index.commit(store, spark.createDataFrame([_chunk("p7", "7.py", 0, "fresh words of it")], CHUNK), old.select("project", "collection", "source_path", "id", "indexed_at"), number)
    after = _files(tmp_path / "s")
    assert {k: v for k, v in after.items() if k in before} == before
    written = sum(v for k, v in after.items() if k not in before)
    assert written < 60_000 < 20_000_000 < sum(before.values()), written
    assert store.read("chunks").count() == 100_000 and _rows(store.read("chunks", project="p7").where("source_path = '7.py'"), "content") == [("fresh words of it",)]
    # Equal to a store that was built at once.
    whole = snapshots.Snapshots(spark, f"file://{tmp_path}/w")
    index.commit(whole, store.read("chunks"), None)
    for table in ("postings", "frequencies", "sizes"):
        a, b = store.read(table), whole.read(table)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    # A tenant's read opens the files of its range only; the plan of another one has no join with tombstones.
    plan = store.read("chunks", project="p3")._jdf.queryExecution().toString()
    assert "Join" not in plan and "Join" in store.read("chunks", project="p7")._jdf.queryExecution().toString()


def test_counts_are_read_without_chunks(spark, tmp_path):
    store = snapshots.Snapshots(spark, f"file://{tmp_path}/s")
    rows = [_chunk("p", f"{i}.py", 0, " ".join(WORDS[i % 7 : i % 7 + 4])) for i in range(30)] + [_chunk("q", "x.py", 0, "retry queue")]
    index.commit(store, spark.createDataFrame(rows, CHUNK), None)
    chunks, posts = store.read("chunks", project="p"), store.read("postings", project="p")
    frequencies = store.read("frequencies", collection="code")
    kept = Searcher(chunks, posts, bucketed=True, frequencies=frequencies, size=store.read("sizes", collection="code").agg(F.sum("n").alias("n")))
    plain = Searcher(store.read("chunks"), store.read("postings"))
    columns = ("rank", "id", "score")
    assert _rows(kept.search("retry queue scheduler", "p", rerank=False), *columns) == _rows(plain.search("retry queue scheduler", "p", rerank=False), *columns)
    for f in _files(tmp_path / "s" / "chunks"):
        os.unlink(f)
    assert kept._lexical("retry queue", kept.table, 5, "p", filtered=False).count() == 5


def test_failing_postings_leave_the_dense_branch(spark):
    table = spark.createDataFrame([("1", "p", "a", "words here", [1.0, 0.0])], "id string, project string, source_path string, content string, dense array<double>")
    broken = table.select("id", F.raise_error(F.lit("torn")).cast("string").alias("token"), F.lit(1.0).alias("tf"))
    assert Searcher(table, broken, lambda _: [1.0, 0.0]).search("words", "p").count() == 1
    with pytest.raises(Exception, match="torn"):
        Searcher(table, broken).search("words", "p").collect()


def test_layouts(spark, tmp_path, monkeypatch):
    """Null keys, new columns, sums that come to nothing, listings left out."""
    store = snapshots.Snapshots(spark, f"file://{tmp_path}/s")
    layout = Layout(("k",), ("k",))
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v int")
    store.apply({"t": Change(rows(("a", 1), ("b", 1), (None, 1)), None, layout), "n": Change(rows(("a", 2), ("b", 1)), None, Layout(("k",), ("k",), "v"))})
    store.apply({"t": Change(rows(("b", 2)).withColumn("w", F.lit("new")), rows(("a", 0), ("b", 0)), layout), "n": Change(rows(("a", -2), ("b", 1)))})
    assert sorted(map(str, store.read("t").collect())) == ["Row(k='b', v=2, w='new')", "Row(k=None, v=1, w=None)"]
    assert list(map(tuple, store.read("n").collect())) == [("b", 2)]
    assert _rows(store.read("t", k=["a", "b"]), "v") == [(2,)] and store.read("t", k="a").count() == 0 and store.read("none") is None
    # A key that is gone stays so when segments after it are merged, and comes back with a later row.
    monkeypatch.setattr(snapshots, "FANOUT", 2)
    monkeypatch.setattr(snapshots, "LISTED", 0)
    store.apply({"t": Change(rows(("c", 3)).withColumn("w", F.lit("x")), rows(("b", 0)), layout)})
    store.apply({"t": Change(rows(("a", 4)).withColumn("w", F.lit("y")), rows(("c", 0)), layout)})
    assert store.compact("t", everything=False)
    assert sorted(map(str, store.read("t").select("k", "v").collect())) == ["Row(k='a', v=4)", "Row(k=None, v=1)"]
    store.apply({"t": Change(None, rows(("a", 0)))})
    assert store.read("t", k="a").count() == 0 and store.read("t").count() == 1
    assert store.read("t").where("k IS NULL").count() == 1


def test_unfinished_manifests_are_passed_over(spark, tmp_path):
    store = snapshots.Snapshots(spark, f"file://{tmp_path}/s")
    rows = spark.createDataFrame([("p", 1)], "project string, v int")
    store.commit("chunks", rows)
    folder = tmp_path / "s" / "_manifests"
    (folder / "2.json").write_text("")
    (folder / "3.json").write_text('{"chunks": {"pa')
    (folder / ".4-aside").write_text("")
    assert store.current()[0] == 1 and store.read("chunks").count() == 1
    base = store.current()[0]
    assert store.apply({"chunks": Change(rows)}, base) == 4 and store.read("chunks").count() == 2
    with pytest.raises(snapshots.Conflict):
        store.apply({"chunks": Change(rows)}, base)
    left = len(list((tmp_path / "s" / "chunks").iterdir()))
    # A writer that dies before it publishes leaves the store as it was.
    with pytest.MonkeyPatch.context() as m:
        m.setattr(snapshots.Snapshots, "_publish", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            store.apply({"chunks": Change(rows)})
    assert store.read("chunks").count() == 2 and len(list((tmp_path / "s" / "chunks").iterdir())) == left
    store.expire(1)
    assert store.read("chunks").count() == 2 and store.numbers() == [4]


def test_no_secret_is_written(spark, tmp_path):
    """Neither under the store nor in the folder of tables between steps, which is as empty as before."""
    root = tmp_path / "repo"
    root.mkdir()
    secret = "hunter2-of-the-deep-9431"
    (root / "settings.py").write_text(f'DB_PASSWORD = "{secret}"\n' + "def connect(settings):\n    return open_database(settings)\n" * 10)
    (root / "README.md").write_text("# Guide\n\n" + f'password: "{secret}"\n' + "How the scheduler retries a failed job. " * 10)
    between = shared_folder(spark).removeprefix("file://")
    before = set(_files(between))
    store = snapshots.Snapshots(spark, f"file://{tmp_path}/store")
    row = index.index_project(spark, store, str(root), "p").first()
    assert row["index"] == 2 and row["n_errors"] == 0
    (root / "README.md").write_text("# Other\n\n" + f'password: "{secret}"\n' + "How the scheduler retries a failed job. " * 10)
    assert index.index_project(spark, store, str(root), "p").first()["index"] == 1
    Searcher(store.read("chunks"), store.read("postings"), models.Embedder().query).search("scheduler", "p").collect()
    assert "REDACTED" in "".join(r["content"] for r in store.read("chunks").collect())
    assert set(_files(between)) == before
    for f in _files(tmp_path / "store"):
        with open(f, "rb") as x:
            assert secret.encode() not in x.read()
    # Snappy keeps literals whole, so look at the rows, too.
    assert store.read("chunks").where(F.contains("content", F.lit(secret))).count() == 0
    # All anew in one version; a failure in between would leave the old one.
    n = store.current()[0]
    assert index.index_project(spark, store, str(root), "p", reset=True).first()["index"] == 2
    assert store.read("chunks").select("source_path").distinct().count() == 2 and store.current()[0] > n
    assert _kept(store) == _recounted(store)
    # Nothing to do, nothing to publish.
    n = store.current()[0]
    assert index.index_project(spark, store, str(root), "p").first()["unchanged"] == 2 and store.current()[0] == n
    index.remove(store, "p")
    assert store.read("chunks").count() == 0 and store.read("frequencies").count() == 0 and store.read("sizes").count() == 0
    assert R.idf_of(store.read("frequencies"), store.read("sizes").agg(F.lit(0).alias("n"))).count() == 0


def test_postings_meet_no_chunks_again(spark):
    """A chunk's names travel with its text: one exchange, of the texts, and no join; the rows are those of a join."""
    chunks = spark.createDataFrame([_chunk("p", "a.py", i, f"{w} retry {w} fooBar") for i, w in enumerate(WORDS)] + [_chunk("q", "b.md", 0, None)], CHUNK)
    made = index.postings_of(chunks)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    joined = T.postings(chunks, "id", "content").join(chunks.select("id", "project", "collection"), "id")
    assert _rows(made, "project", "collection", "id", "token", "tf") == _rows(joined, "project", "collection", "id", "token", "tf") != []
