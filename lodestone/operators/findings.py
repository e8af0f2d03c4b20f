"""Findings, occurrences and observations: keyed merges and read queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.detect import best_of

PROVENANCE = ["run_id", "shard_id", "fence_epoch"]


def batch_conflicts(batch: DataFrame, keys: list[str], identity: list[str]) -> DataFrame:
    """Keys that come with more than one identity in a batch."""
    return batch.groupBy(*keys).agg(F.count_distinct(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in identity])).alias("identities")).where("identities > 1")


def insert_or_verify(existing: DataFrame, batch: DataFrame, keys: list[str], identity: list[str]) -> DataFrame:
    """All rows of both with an outcome: existing, inserted, verified or conflict.

    A repeated key with the same identity changes nothing.
    """
    new = batch.select(*keys, *identity).dropDuplicates()
    old = existing.select(*keys, *[F.col(c).alias(f"_{c}") for c in identity], F.lit(True).alias("_old"))
    counted = new.withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    same = F.lit(True)
    for c in identity:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    rows = counted.withColumn("_new", F.lit(True)).join(old, keys, "full")
    outcome = F.when(F.col("_new").isNull(), "existing").when((F.col("_n") > 1) | (F.col("_old").isNotNull() & ~same), "conflict").when(F.col("_old").isNull(), "inserted").otherwise("verified")
    return rows.select(*keys, *[F.when(F.col("_old").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in identity], outcome.alias("outcome"))


def merge_observations(rows: DataFrame, keys: list[str], arrival: str = "arrival") -> DataFrame:
    """Observations of equal keys folded in the order of arrival, in one aggregate.

    Provenance comes from the latest seen_at; among equals from the first
    with a location, else from the first.  A location follows its record; if
    the winner has none, the latest seen record that has one gives it.
    """
    has = F.col("location_display").isNotNull()
    order = F.struct(F.col("seen_at"), has.alias("has"), (-F.col(arrival)).alias("first"))
    located = F.struct(F.col("seen_at"), (-F.col(arrival)).alias("first"))
    place = F.struct("location_display", "location_url")
    out = rows.groupBy(*keys).agg(F.max_by(F.struct(*PROVENANCE), order).alias("w"), F.max("seen_at").alias("seen_at"), F.max_by(F.when(has, place), F.when(has, located)).alias("l"))
    return out.select(*keys, "w.*", "seen_at", F.col("l.location_display").alias("location_display"), F.col("l.location_url").alias("location_url"))


def orphans(child: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    return child.join(parent.select(*keys).distinct(), keys, "left_anti")


def batch_get(ledger: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    return ledger.join(wanted.select(*keys).distinct(), keys, "left_semi")


def layer_counts(findings: DataFrame, occurrences: DataFrame, observations: DataFrame) -> DataFrame:
    """One row with the three tables' sizes: one grouped union, no cross join."""
    named = [t.select(F.lit(n).alias("t")) for t, n in ((findings, "f"), (occurrences, "o"), (observations, "b"))]
    rows = named[0].unionAll(named[1]).unionAll(named[2])
    return rows.agg(*[F.count_if(F.col("t") == n).alias(name) for n, name in (("f", "findings"), ("o", "occurrences"), ("b", "observations"))])


def by_policy(observations: DataFrame) -> DataFrame:
    return observations.groupBy("policy_hash").agg(F.count("*").alias("n")).orderBy("policy_hash")


def needing_triage(findings: DataFrame, occurrences: DataFrame, observations: DataFrame, limit: int) -> DataFrame:
    """The latest observation of each finding, newest findings first."""
    rows = findings.join(occurrences, "finding_id").join(observations, "occurrence_id")
    latest = best_of(rows, ["finding_id"], F.desc("seen_at"), F.desc("observation_id"))
    return latest.orderBy(F.desc("seen_at"), F.desc("observation_id")).limit(limit)


def kv_upsert(puts: DataFrame) -> DataFrame:
    """Last write (seq) of each key."""
    return puts.groupBy("key").agg(F.max_by("value", "seq").alias("value"))
