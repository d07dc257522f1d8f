import os
import threading
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from kelpforest.plans import evaluate
from kelpforest.plans.memory import Notes, to_json
from kelpforest.plans.registry import Registry, check_versions, status, writer_lock
from kelpforest.plans.tools import Tools
from kelpforest.sources.snapshots import export_notes

BODY = "We keep the ledger in one table since readers need one version of it. "


def test_note_lifecycle(spark, tmp_path):
    embed = lambda text: [float(text.count(c)) for c in "abcdefghijklmnopqrstuvwxyz"]
    store = Notes(spark, f"file://{tmp_path}/log", lambda: ["p"], embed)
    with pytest.raises(ValueError, match="too short"):
        store.store("p", "decision", "t", "abc")
    with pytest.raises(ValueError, match="unknown project"):
        store.store("q", "decision", "t", BODY)
    first = store.store("p", "decision", "One ledger", BODY, ["b", "a", "a"])
    with pytest.raises(ValueError, match="too close"):
        store.store("p", "bug", "One ledger", BODY + "Still.")
    second = store.update(first, content=BODY + "Now two versions.")
    old, new = store.get(first), store.get(second)
    assert (old["status"], old["superseded_by"], old["content"]) == ("superseded", second, BODY)
    assert (new["status"], new["tags"], new["title"], new["supersedes"]) == ("active", ["a", "b"], "One ledger", first)
    with pytest.raises(ValueError, match="superseded already"):
        store.update(first, content=BODY)
    page = store.listed("p").collect()
    assert [r["id"] for r in page] == [second] and page[0]["total"] == 1 and not page[0]["has_more"]
    s1 = store.save_session("p", BODY, "write tests", ["a.py"])
    s2 = store.save_session("p", BODY)
    assert store.get(s1)["status"] == "superseded" and store.get(s1)["superseded_by"] is None and store.get(s2)["status"] == "active"
    with pytest.raises(ValueError, match="there already"):
        store.seed("p", [{"memory_type": "bug", "title": "One ledger", "content": BODY}])
    store.delete(second)
    with pytest.raises(KeyError):
        store.get(second)
    assert "One ledger" not in to_json(store.listed("p"))
    assert store.briefing().first()["n_active"] == 1
    n = len(store.log().inputFiles())
    before = sorted(map(str, store.current().collect()))
    store.compact()
    assert len(store.log().inputFiles()) < n and sorted(map(str, store.current().collect())) == before


def test_restore(spark, tmp_path):
    embed = lambda text: [float(text.count(c)) for c in "abc"]
    store = Notes(spark, f"file://{tmp_path}/log", lambda: ["p"], embed, lock=str(tmp_path / "notes.lock"))
    kept = store.store("p", "decision", "One ledger", BODY, ["b"])
    gone = store.store("p", "bug", "Retries", "The job retries without end when the queue is empty and the lock is held.", allow_duplicate=True)
    folder = f"file://{tmp_path}/backups"
    for day in (1, 2):
        export_notes(store.log().drop("dense"), folder, datetime(2024, 1, day))
    store.delete(gone)
    listed = store.import_backup(folder, dry_run=True)
    assert listed["titles"] == ["One ledger", "Retries"] and listed["backup"].endswith("memory-2024-01-02") and store.current().count() == 1
    store.projects = lambda: []
    told = store.import_backup(folder, "memory-2024-01-01")
    assert (told["restored"], told["orphans"]) == (2, ["p"])
    back = store.get(gone)
    assert back["status"] == "active" and back["dense"] == embed("Retries\n\n" + back["content"]) and back["schema_version"] == 1
    assert store.get(kept)["content"] == BODY
    (tmp_path / "backups" / "memory-2024-01-02" / "manifest").joinpath("x.txt").write_text("")
    spark.createDataFrame([('{"collection": "code"}',)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/memory-2024-01-02/manifest")
    with pytest.raises(ValueError, match="backup of code"):
        store.import_backup(folder)
    assert store.import_backup(folder, dry_run=True)["notes"] == 2


def test_tools(spark, tmp_path):
    root = tmp_path / "repo"
    root.mkdir()
    (root / "jobs.py").write_text("def retry_failed_job(queue):\n" + "    queue.wait()\n" * 10)
    (root / "README.md").write_text("# Guide\n\n" + "How the scheduler retries a failed job. " * 10)
    (tmp_path / "home").mkdir()
    tools = Tools(spark, f"file://{tmp_path}/home")
    with pytest.raises(ValueError, match="nothing is indexed"):
        tools.search_code("retry", "p")
    said = tools.register("p", str(root), "Jobs and queues")
    said = tools.sync("p", grace=300) if said["state"] == "running" else said
    assert said["state"] == "done" and said["errors"] == []
    assert tools.search_code("retry_failed_job", "p", language="python", expand=True).first()["symbol"] == "retry_failed_job"
    assert tools.search_code("retry_failed_job", "p", symbol_type="class").count() == 0
    assert tools.search_docs("scheduler", "p", doc_type="readme").first()["doc_type"] == "readme"
    with pytest.raises(ValueError, match="no project"):
        tools.search_docs("scheduler", "q")
    old = tools.notes.store("p", "decision", "Ledger", BODY)
    new = tools.notes.update(old, content=BODY + "Now two versions.")
    tools.notes.store("p", "bug", "Queue", "The queue stalls when all of its workers have lost their leases at once.")
    assert [r["id"] for r in tools.search_memory("ledger table", "p", memory_type="decision").collect()] == [new]
    assert {r["id"] for r in tools.search_memory("ledger table", include_superseded=True, memory_type="decision").collect()} == {old, new}
    assert tools.browse().count() == 2 and tools.browse("stalls").first()["title"] == "Queue"
    text = tools.briefing("p")
    assert "Jobs and queues" in text and BODY + "Now two versions." in text and "[bug] Queue" in text and "1 code chunks, 1 doc chunks, 3 notes" in text
    assert {r["model"] for r in tools.status().collect()} == {"hashed"}
    # A golden set, by what a path holds, with and without rerank; the command says no below the floor.
    asked = [("p", "code", "retry_failed_job", "jobs.py"), ("p", "docs", "scheduler retries", "README"), ("p", "docs", "scheduler", "nowhere"), ("p", "memory", "queue stalls workers", "memory/bug")]
    got = evaluate.evaluate(tools, spark.createDataFrame(asked, evaluate.SCHEMA)).collect()
    assert [(r["rerank"], r["n"], r["r1"], r["mrr"]) for r in got] == [(False, 4, 0.75, 0.75), (True, 4, 0.75, 0.75)]
    assert tools.browse("stalls", limit=100).count() == 2
    # Newer notes come first among equals.
    later = F.current_timestamp() + F.expr("INTERVAL 400 DAYS")
    assert tools.search_memory("queue", "p", now=later).first()["title"] == "Queue"
    # One job a project, which runs on in the background.
    wait = threading.Event()
    assert tools.sync("p", grace=0.05, run=lambda project, said: (wait.wait(10), said.update(state="done"))) == {"state": "running"}
    job = tools._jobs["p"][0]
    assert tools.sync("p", grace=0.05) == {"state": "running"} and tools._jobs["p"][0] is job
    wait.set()
    job.join()
    tools.registry.unregister("p", tools.store)
    assert tools.store.read("chunks").count() == 0 and tools.store.read("postings").count() == 0 and tools.notes.current().count() == 3


def test_registry(spark, tmp_path):
    registry = Registry(str(tmp_path / "projects.json"))
    (tmp_path / "a" / "b").mkdir(parents=True)
    for bad in (("A", str(tmp_path / "a"), "d"), ("a", "relative", "d"), ("a", str(tmp_path / "a"), " ")):
        with pytest.raises(ValueError):
            registry.register(*bad)
    registry.register("a", str(tmp_path / "a"), "first")
    registry.register("b", str(tmp_path / "a" / "b"), "second")
    with pytest.raises(ValueError, match="another name"):
        registry.register("c", str(tmp_path / "a"), "d")
    assert registry.find(spark, str(tmp_path / "a" / "b" / "x.py")) == "a"
    assert registry.find(spark, "/elsewhere") is None
    chunks = spark.createDataFrame([("a", "code", 1, 1)], "project string, collection string, indexed_at int, schema_version int")
    assert {r["project"]: r["n"] for r in status(registry.frame(spark), chunks).collect()} == {"a": 1, "b": 0}
    with pytest.raises(ValueError):
        check_versions(chunks, 2)
    registry.unregister("a")
    assert registry.names() == ["b"]


def test_lock(tmp_path):
    path = str(tmp_path / "lock")
    with writer_lock(path) as mine:
        assert mine
        with writer_lock(path) as other:
            assert other is None
        os.utime(path, (0, 0))
        with writer_lock(path) as taken:
            assert taken
            # The first has lost it, sees that, and leaves the other's lock alone.
            with pytest.raises(RuntimeError):
                mine.beat()
            mine.drop()
            assert os.path.exists(path)
    assert not os.path.exists(path)


def test_lock_is_kept_while_work_lasts(tmp_path):
    path = str(tmp_path / "lock")
    with writer_lock(path, stale=0.4) as mine:
        time.sleep(1)
        assert mine
        with writer_lock(path, stale=0.4) as other:
            assert other is None
