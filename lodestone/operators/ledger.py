"""The done-ledger: a merge that does not depend on order, shape checks, and what is left to scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["tenant_id", "policy_hash", "ovid_hash"]
RETRYABLE, PERMANENT, SKIPPED, CLEAN, WITH_FINDINGS = 1, 2, 3, 10, 11
SCANNED = (CLEAN, WITH_FINDINGS)
TERMINAL = (PERMANENT, SKIPPED, CLEAN, WITH_FINDINGS)


def is_terminal(status: Column) -> Column:
    return status.isin(*TERMINAL)


def is_scanned(status: Column) -> Column:
    return status.isin(*SCANNED)


def merge(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One entry per key: greatest status and bytes, provenance of the greatest record; one aggregate."""
    error = F.coalesce(F.encode("error_code", "UTF-8"), F.lit("").cast("binary"))
    order = F.struct("status", "finished_at", "started_at", "fence_epoch", "run_id", "shard_id", error.alias("e"))
    win = F.struct("run_id", "shard_id", "fence_epoch", "started_at", "finished_at", "error_code")
    some_error = F.col("error_code").isNotNull()
    out = rows.groupBy(*(keys or KEYS)).agg(
        F.max("status").alias("status"), F.max("bytes_scanned").alias("bytes_scanned"),
        F.max(F.when(F.col("status") == WITH_FINDINGS, F.col("findings_count")).otherwise(0)).alias("_with"), F.max("findings_count").alias("_any"),
        F.max_by(win, order).alias("w"), F.max_by(F.when(some_error, F.col("error_code")), F.when(some_error, order)).alias("_error"),
    )
    count = F.when(F.col("status") == CLEAN, 0).when(F.col("status") == WITH_FINDINGS, F.greatest("_with", F.lit(1))).otherwise(F.col("_any"))
    code = F.when(~is_scanned(F.col("status")), F.coalesce("w.error_code", "_error"))
    return out.select(*(keys or KEYS), "status", "bytes_scanned", count.cast("int").alias("findings_count"), "w.run_id", "w.shard_id", "w.fence_epoch", "w.started_at", "w.finished_at", code.alias("error_code"))


def shape_errors(rows: DataFrame) -> DataFrame:
    """Entries with what is wrong about them, if anything."""
    status = F.col("status")
    problem = (
        F.when(~status.isin(1, 2, 3, 10, 11), "unknown status")
        .when((status == CLEAN) & (F.col("findings_count") != 0), "clean with findings")
        .when((status == WITH_FINDINGS) & (F.col("findings_count") < 1), "findings without count")
        .when(is_scanned(status) & F.col("error_code").isNotNull(), "scanned with error")
        .when(~is_scanned(status) & (F.col("findings_count") != 0), "unscanned with findings")
        .when(F.col("finished_at") < F.col("started_at"), "finished before start")
    )
    return rows.withColumn("problem", problem).where(F.col("problem").isNotNull())


def done_hashes(ledger: DataFrame, tenant: str, policy: str) -> DataFrame:
    return ledger.where((F.col("tenant_id") == tenant) & (F.col("policy_hash") == policy) & is_terminal(F.col("status"))).select("ovid_hash")


def left_to_scan(items: DataFrame, ledger: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Items without a terminal entry."""
    return items.join(ledger.where(is_terminal(F.col("status"))).select(*(keys or KEYS)), keys or KEYS, "left_anti")


def history(ledger: DataFrame) -> DataFrame:
    return ledger.orderBy("tenant_id", "policy_hash", F.desc("finished_at"), "ovid_hash")
