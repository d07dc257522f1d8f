"""Shared pieces of the training-data operators."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpforest.sources.folders import new_path, shared_folder

#: White space that separates words: space and \t \n \v \f \r.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

__all__ = ["LOWER", "SPACE", "UPPER", "WORD", "all_of", "ascii_lower", "forget", "n_words", "new_path", "release", "shared_folder", "stored", "table", "unused"]

def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a short lineage that outlives executors."""
    spark, schema = df.sparkSession, df.schema
    path = new_path(spark, name)
    df.write.parquet(path)
    del df
    release(spark)
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of plans that are over, which it does as the driver collects garbage."""
    gc.collect()
    spark._jvm.System.gc()


def forget(df: DataFrame) -> None:
    """Delete a table that :func:`stored` wrote and that no later plan reads."""
    spark = df.sparkSession
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(columns: list[str]) -> str:
    """A prefix that no column's name begins with, in any case, for columns that come and go within an operator."""
    prefix = "_"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


def all_of(df: DataFrame, *but: str) -> list[Column]:
    """The columns, whatever characters their names hold."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns if c not in but]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def n_words(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))), F.lit(0)).cast("long")
