"""The driver's contract, also where the training-data subpackage and its pipeline are gone."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]


def test_every_query_is_registered():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 50


def test_the_rest_stands_alone(tmp_path):
    for name in ("kelpforest", "__spark_entry__.py", "bench.py"):
        source, target = ROOT / name, tmp_path / name
        if source.is_dir():
            shutil.copytree(source, target, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, target)
    code = "import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); assert set(s) <= set(q); print(sorted(q))"
    env = {**os.environ, "PYTHONPATH": str(tmp_path)}
    # With the pipeline's file still there, it is left out as well.
    for with_pipeline in (False, True):
        if with_pipeline and (ROOT / "corpus_pipeline.py").exists():
            shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
        found = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
        assert found.returncode == 0, found.stderr
        assert "lexical_topk" in found.stdout and "op1_" not in found.stdout and "pipeline" not in found.stdout
