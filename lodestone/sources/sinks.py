"""Sinks: findings as JSON lines, text, one JSON array, SARIF, and keyed tables."""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT = ["path", "rule", "start", "end", "confidence"]


def event_json(source: str = "fs") -> Column:
    return F.to_json(F.struct(F.lit("finding").alias("type"), "path", "start", "end", "rule", F.col("confidence").alias("confidence_score"), F.lit(source).alias("source")))


def write_jsonl(findings: DataFrame, path: str, source: str = "fs") -> None:
    findings.select(event_json(source).alias("value")).write.mode("overwrite").text(path)


def event_text() -> Column:
    return F.format_string("%s:%d-%d %s (confidence %d)", "path", "start", "end", "rule", "confidence")


def write_text(findings: DataFrame, path: str) -> None:
    findings.select(event_text().alias("value")).write.mode("overwrite").text(path)


def json_parts(findings: DataFrame, source: str = "fs") -> DataFrame:
    """One JSON array per file (a path): (path, events), so that no one task holds all findings."""
    event = F.struct("start", "end", "rule", F.col("confidence").alias("confidence_score"))
    return findings.groupBy("path").agg(F.to_json(F.array_sort(F.collect_list(event))).alias("events"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """SARIF results, one JSON object per finding; ``sarif_log`` frames them."""
    region = F.struct(F.col("start").alias("byteOffset"), (F.col("end") - F.col("start")).alias("byteLength"))
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    level = F.when(F.col("confidence") >= 7, "error").when(F.col("confidence") >= 4, "warning").otherwise("note")
    result = F.struct(F.col("rule").alias("ruleId"), level.alias("level"), F.struct(F.concat(F.lit("possible secret: "), F.col("rule")).alias("text")).alias("message"), F.array(place).alias("locations"))
    return findings.select("path", "start", F.to_json(result).alias("result"))


def write_sarif(findings: DataFrame, path: str, tool: str = "lodestone") -> None:
    """Part files of one SARIF log each, with all results of their partition, written as they come."""
    head = '{"version":"2.1.0","runs":[{"tool":{"driver":{"name":"' + tool + '"}},"results":['
    body = sarif_results(findings).select("result")

    def logs(parts):
        first = True
        for pdf in parts:
            lines = [("" if first and i == 0 else ",") + r for i, r in enumerate(pdf["result"])]
            if first and lines:
                lines[0] = head + lines[0]
                first = False
            yield pd.DataFrame({"value": lines})
        if not first:
            yield pd.DataFrame({"value": ["]}]}"]})

    body.mapInPandas(logs, "value string").write.mode("overwrite").text(path)


# -- keyed tables ----------------------------------------------------------------------------------
#
# A table is a folder of bucket folders by version, and one manifest per version that names the folder of each
# bucket.  The manifest with the highest number is the table: it is renamed into place after its data are written, so
# that a crash at any point leaves the version before it, and a retry merges into that one.


def _fs(spark, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def manifests(spark, path: str) -> list[int]:
    """The numbers of a table's versions that are there, oldest first."""
    fs, at = _fs(spark, path)
    if not fs.exists(at(path)):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(at(path))]
    return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))


def manifest(spark, path: str, version: int) -> dict:
    return json.loads("".join(r["value"] for r in spark.read.text(f"{path}/manifest-{version}.json").collect()))


def _publish(spark, path: str, version: int, content: dict) -> None:
    fs, at = _fs(spark, path)
    draft = f"{path}/_draft-{uuid.uuid4().hex}"
    out = fs.create(at(draft), True)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    if not fs.rename(at(draft), at(f"{path}/manifest-{version}.json")):
        raise OSError(f"version {version} of {path} exists: the table has another writer")


def _clean(spark, path: str, keep: list[dict], old: list[int]) -> None:
    """Remove manifests before the last two, and data that no kept manifest names."""
    fs, at = _fs(spark, path)
    for version in old:
        fs.delete(at(f"{path}/manifest-{version}.json"), False)
    named = {d.split("/")[0] for m in keep for d in m["buckets"].values()}
    for f in fs.listStatus(at(path)):
        name = f.getPath().getName()
        if (f.isDirectory() and name.startswith("data-") and name not in named) or name.startswith("_draft-"):
            fs.delete(f.getPath(), True)


def read_table(spark, path: str) -> DataFrame | None:
    """The rows of a keyed table; None before its first merge."""
    found = manifests(spark, path)
    if not found:
        return None
    now = manifest(spark, path, found[-1])
    schema = T.StructType.fromJson(now["schema"])
    if not now["buckets"]:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/{d}" for d in now["buckets"].values()])


def merge_into(path: str, batch: DataFrame, merge, keys: list[str], buckets: int = 32) -> None:
    """Merge a batch into the keyed table at path; merge takes the union of old and new rows of the touched buckets.

    Rows are dealt to buckets by their keys: a small batch rewrites only the
    buckets that its keys fall into.  The number of buckets is fixed by the
    first merge: choose it for the table's size.  One writer at a time.
    """
    spark = batch.sparkSession
    found = manifests(spark, path)
    now = manifest(spark, path, found[-1]) if found else {"n": buckets, "buckets": {}}
    bucket = F.pmod(F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]), F.lit(now["n"])).cast("int")
    touched = sorted(r["_bucket"] for r in batch.select(bucket.alias("_bucket")).distinct().collect())
    old = [f"{path}/{now['buckets'][str(b)]}" for b in touched if str(b) in now["buckets"]]
    rows = spark.read.schema(batch.schema).parquet(*old).unionByName(batch) if old else batch
    out = merge(rows)
    folder = f"data-{uuid.uuid4().hex}"
    out.withColumn("_bucket", bucket).repartition(F.col("_bucket")).write.partitionBy("_bucket").parquet(f"{path}/{folder}")
    version = found[-1] + 1 if found else 0
    fs, at = _fs(spark, path)
    written = {b: f"{folder}/_bucket={b}" for b in touched if fs.exists(at(f"{path}/{folder}/_bucket={b}"))}
    kept = {b: d for b, d in now["buckets"].items() if int(b) not in touched}
    new = {"n": now["n"], "schema": out.schema.jsonValue(), "buckets": {**kept, **{str(b): d for b, d in written.items()}}}
    _publish(spark, path, version, new)
    _clean(spark, path, [now, new], found[:-1])
