"""Sources: objects from files and remote stores, findings, and truth sets."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FINDING_JSON = "type string, path string, start long, end long, rule string, confidence_score int, _corrupt string"
TRUTH_JSON = "path string, line_start long, line_end long, label string, rule string"
CREDDATA_CSV = "Id string, FileID string, Domain string, RepoName string, FilePath string, LineStart string, LineEnd string, GroundTruth string, ValueStart string, ValueEnd string, CryptographyKey string, PredefinedPattern string, Category string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, path: str, start: str = "", end: str = "", glob: str | None = None, ignore: list[str] | None = None, max_bytes: int | None = None) -> DataFrame:
    """Objects (path, content, length, modificationTime) below a folder with start <= path < end, '' being open."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    rows = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    rows = rows.where(F.col("path") >= start) if start else rows
    rows = rows.where(F.col("path") < end) if end else rows
    rows = rows.where(F.col("length") <= max_bytes) if max_bytes is not None else rows
    for pattern in ignore or []:
        rows = rows.where(~F.col("path").rlike(ignore_regex(pattern)))
    return rows


def files_stream(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(path)


def ignore_regex(pattern: str) -> str:
    """A gitignore line as a regular expression over whole paths."""
    anchored = pattern.startswith("/")
    body = pattern.strip("/")
    out, i = "", 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = body[i]
            out += {"*": "[^/]*", "?": "[^/]"}.get(c, c if c.isalnum() or c in "_/" else "\\" + c)
            i += 1
    return ("^" if anchored and "://" not in pattern else "(?:^|/)") + out + ("/" if pattern.endswith("/") else r"(?:/|\z)")


def memory(spark: SparkSession, items: list[tuple[str, bytes]]) -> DataFrame:
    return spark.createDataFrame(items, "path string, content binary")


def findings_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Finding events; lines that are none have ok = false."""
    rows = spark.read.schema(FINDING_JSON).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.withColumn("ok", F.col("_corrupt").isNull() & (F.col("type") == "finding") & F.col("path").isNotNull() & F.col("start").isNotNull() & F.col("end").isNotNull() & F.col("rule").isNotNull())


def truth_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRUTH_JSON).option("multiLine", "true").json(path)


def creddata(spark: SparkSession, path: str) -> DataFrame:
    """Truth items, with the reason why a row is skipped, if it is."""
    rows = spark.read.schema(CREDDATA_CSV).option("header", "true").csv(path)
    label = F.when(F.col("GroundTruth") == "T", "positive").when(F.col("GroundTruth") == "F", "negative").when(F.col("GroundTruth") == "X", "placeholder")
    a, b = F.expr("try_cast(LineStart as bigint)"), F.expr("try_cast(LineEnd as bigint)")
    skipped = F.when(label.isNull(), "unknown label").when(a.isNull() | b.isNull(), "bad line").when((a < 1) | (b < a), "bad range").when(F.col("FilePath").isNull(), "no path")
    return rows.select(F.col("FilePath").alias("path"), a.alias("line_start"), b.alias("line_end"), label.alias("label"), F.col("Category").alias("rule"), skipped.alias("skipped"))


def leaky_repo(spark: SparkSession, path: str) -> DataFrame:
    """(path, expected) of a file of counts; # comments and a byte order mark are passed over."""
    rows = spark.read.option("header", "true").option("comment", "#").csv(path)
    name, risk, info = rows.columns[:3]
    return rows.select(F.regexp_replace(F.col(name), "^﻿", "").alias("path"), (F.col(risk).cast("int") + F.col(info).cast("int")).alias("expected"))


class RemoteSource(DataSource):
    """Objects of a remote store, by a backend: list_keys(options) and fetch(key, options).

    Register it, then ``spark.read.format("remote_objects")`` with the option
    ``backend`` as module:class; transient errors are tried ``retries`` times.
    """

    @classmethod
    def name(cls) -> str:
        return "remote_objects"

    def schema(self) -> str:
        return "path string, content binary, error string"

    def reader(self, schema) -> DataSourceReader:
        return RemoteReader(dict(self.options))


class KeyRange(InputPartition):
    def __init__(self, keys: list[str]):
        self.keys = keys


class RemoteReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def _backend(self):
        import importlib

        module, name = self.options["backend"].split(":")
        return getattr(importlib.import_module(module), name)(self.options)

    def partitions(self) -> list[KeyRange]:
        keys, size = sorted(self._backend().list_keys()), int(self.options.get("keys_per_task", "1000"))
        return [KeyRange(keys[i : i + size]) for i in range(0, len(keys), size)]

    def read(self, partition: KeyRange) -> Iterator[tuple]:
        backend = self._backend()
        for key in partition.keys:
            yield (key, *attempt(lambda k=key: backend.fetch(k), int(self.options.get("retries", "3"))))


def attempt(f: Callable[[], bytes], retries: int, pause: float = 0.05) -> tuple[bytes | None, str | None]:
    """The content, or why there is none: errors other than OSError are permanent."""
    for n in range(retries + 1):
        try:
            return f(), None
        except OSError as e:
            error = f"retryable: {e}"
            time.sleep(pause * 2**n)
        except Exception as e:  # noqa: BLE001  a store's own errors: the row says what happened
            return None, f"permanent: {e}"
    return None, error
