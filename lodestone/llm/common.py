"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.shared import partitions, scratch, shared_dir, stored

__all__ = ["BATCH_ROWS", "hot_join", "partitions", "scratch", "shared_dir", "small_batches", "stored", "table", "unused"]

#: Rows per Arrow batch handed to Python; texts are long, so the Spark default of 10,000 is too many.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Lower the Arrow batch size unless the user has chosen one."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def unused(columns: list[str], name: str) -> str:
    """The name, with underscores before it until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def hot_join(rows: DataFrame, facts: DataFrame, keys: list[str], n_col: str, n_rows: int, least: int = 4096, most_hot: int = 1 << 16) -> DataFrame:
    """rows joined with facts (one row per key, n_col: how many of rows have it), keys of many rows apart.

    Keys of more than max(least, n_rows / most_hot) rows are at most most_hot:
    they are broadcast, so that their rows stay where they are.  The others are
    joined by a shuffle in which no key is large.
    """
    bound = max(least, n_rows // most_hot)
    hot = F.broadcast(facts.where(F.col(n_col) > bound))
    rest = rows.join(F.broadcast(facts.where(F.col(n_col) > bound).select(*keys)), keys, "left_anti")
    return rows.join(hot, keys).unionByName(rest.join(facts.where(F.col(n_col) <= bound), keys))
