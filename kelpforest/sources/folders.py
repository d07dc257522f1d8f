"""The folder that a cluster shares, and where tables between steps go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares, from ``spark.checkpoint.dir``.

    Only where that setting is absent and all runs on this machine (as in tests)
    a temporary folder stands in for it; on a cluster its absence is an error,
    as every executor would write to its own disk.
    """
    global _own_folder
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _own_folder is None:
        _own_folder = f"file://{tempfile.mkdtemp(prefix='kelpforest-')}"
    return _own_folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(rows: DataFrame, name: str) -> DataFrame:
    """Write ``rows`` to the shared folder and read them back, which cuts their lineage; :func:`forget` deletes them again."""
    path = new_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def forget(*tables: DataFrame | None) -> None:
    """Delete tables that :func:`stored` wrote and that no later plan reads."""
    for rows in tables:
        spark = rows.sparkSession if rows is not None else None
        for folder in {name.rsplit("/", 1)[0] for name in rows.inputFiles()} if spark else ():
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
