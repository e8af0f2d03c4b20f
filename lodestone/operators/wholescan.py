"""A whole scan: files -> path policy -> archives and extraction -> detection -> ids of all layers -> findings and ledger."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators import content as C
from lodestone.operators import detect as D
from lodestone.operators import identity as I
from lodestone.operators import ledger as L
from lodestone.shared import byte_batches, spread, stored
from lodestone.sources.rules import load

#: What a row of a file carries along: the file, the digest and the size of its content.
FILE = [("object_id", pa.string()), ("version", pa.string()), ("bytes", pa.int32())]
OPENED = pa.schema([*FILE, ("path", pa.string()), ("content", pa.binary()), ("outcome", pa.string())])
PART = T.StructType([T.StructField("object_id", T.StringType()), T.StructField("version", T.StringType()), T.StructField("bytes", T.IntegerType()), T.StructField("path", T.StringType()), T.StructField("outcome", T.StringType()), T.StructField("read", T.BooleanType())])


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of files (FILE, content, archive): archives as their entries, others as they are."""

    def rows() -> Iterator[tuple]:
        for b in batches:
            for *file, content, archive in zip(*b.columns, strict=True):
                file, body = [x.as_py() for x in file], content.as_py()
                for row in C.expand_one(file[0], body, C.BUDGET) if archive.as_py() else [(file[0], body, "ok")]:
                    yield (*file, *row)

    return C.in_batches(rows(), OPENED, len(FILE) + 1)


def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (FILE, path, content, outcome, kind): the text in place of the content where it is extracted, no content where nothing is scanned."""
    for b in batches:
        *file, path, content, outcome, kind = b.columns
        bodies, outcomes = [], []
        for body, why, form in zip(content, outcome.to_pylist(), kind.to_pylist(), strict=True):
            body = body.as_py() if form == "text" or form.startswith("extract:") else None
            if form.startswith("extract:"):
                text = C.extract_text(form.removeprefix("extract:"), body)
                body, why = None if text is None else text.encode("utf-8", "surrogatepass"), "broken" if text is None else "ok"
            bodies.append(body)
            outcomes.append(form if form in ("not_scannable", "binary") else why)
        yield pa.RecordBatch.from_arrays([*file, path, pa.array(bodies, pa.binary()), pa.array(outcomes, pa.string())], schema=OPENED)


def readable(files: DataFrame) -> DataFrame:
    """FILE, path (with the way into archives), content, outcome, kind: one row per file or entry.

    Every file is read once, every archive is opened once.  kind is text,
    extract:<format>, or why nothing is scanned: not_scannable, binary, none.
    """
    byte_batches(files.sparkSession)
    archive = C.archive_kind("path", F.hex(F.substring("content", 1, 4)), F.hex(F.substring("content", 258, 5))).isNotNull()
    named = spread(files).select(F.col("path").alias("object_id"), F.sha2("content", 256).alias("version"), F.length("content").alias("bytes"), F.coalesce("content", F.lit(b"")).alias("content"), archive.alias("archive"))
    rows = named.mapInArrow(opened, "object_id string, version string, bytes int, path string, content binary, outcome string")
    head = F.decode(F.substring("content", 1, C.CHECK_BYTES), "ISO-8859-1")
    kind = F.when(F.col("content").isNull(), "none").when(~C.scannable("path") & C.extractable("path").isNull(), "not_scannable").otherwise(C.classify("path", head))
    return rows.withColumn("kind", kind)


def part_matches(files: DataFrame, rules: list[dict], depth: int) -> DataFrame:
    """object_id (object_id, version and bytes of the file, path, outcome, read), found, dropped of every file, entry or extracted text.

    read is whether there was content to scan; else outcome says why there was none:
    not_scannable, binary, an archive's or entry's outcome code, broken.
    """
    run = D.matcher(rules, True, depth)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in extracted(batches):
            *file, path, content, outcome = b.columns
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([*file, path, outcome, content.is_valid()], names=PART.fieldNames()), content], names=["object_id", "text"])

    return readable(files).mapInArrow(lambda batches: run(parts(batches)), D.matches_schema(T.StructField("object_id", PART)))


def versions(files: DataFrame, parts: DataFrame) -> DataFrame:
    """object_id, version, bytes: the digest of a file's content; of a path with several contents, that of the last in byte order."""
    once = parts.groupBy("object_id").agg(F.min("version").alias("_low"), F.max("version").alias("version"), F.max("bytes").alias("bytes"))
    twice = once.where(F.col("_low") < F.col("version")).select("object_id")
    once = once.select("object_id", F.coalesce("version", F.sha2(F.lit(b""), 256)).alias("version"), "bytes")
    if twice.isEmpty():
        return once
    # Contents are compared for those paths alone.
    last = files.withColumnRenamed("path", "object_id").join(twice, "object_id", "left_semi").groupBy("object_id").agg(F.sha2(F.max("content"), 256).alias("_last"))
    return once.join(last, "object_id", "left").select("object_id", F.coalesce("_last", "version").alias("version"), "bytes")


def scan_files(files: DataFrame, rules: list[dict] | None = None, depth: int = 3, tenant: str = "default", tenant_key: str = "", policy: str = "default", connector: str = "fs", instance: str = "main", run_id: int = 0, shard_id: int = 0, now: int = 0) -> tuple[DataFrame, DataFrame]:
    """Findings with ids of all layers, and ledger entries, of files (path, content).

    A file's entry is scanned with or without findings if any part of it was
    read, permanent if a part is broken and none was read, else skipped.  The version of
    a file is the digest of its content.  One pass over the contents leaves the
    matches of every part in the shared folder; both tables are made of these.
    """
    rules = rules or load()
    matches = stored(part_matches(files, rules, depth), "matches")
    parts = matches.select("object_id.*")
    digests = versions(files, parts)
    found = D.findings(matches.withColumn("object_id", F.struct("object_id.object_id", "object_id.path")), rules)
    rows = found.select(F.col("object_id.object_id").alias("file"), F.col("object_id.path").alias("path"), *[c for c in found.columns if c != "object_id"]).withColumnRenamed("file", "object_id")
    rows = stored(rows.join(digests.select("object_id", "version"), "object_id"), "found")
    rows = rows.withColumns({"run_id": F.lit(run_id).cast("long"), "shard_id": F.lit(shard_id).cast("long"), "seen_at": F.lit(now).cast("long")})
    findings = I.translate(rows, tenant, tenant_key, policy, connector, instance)
    counts = rows.groupBy("object_id").agg(F.count("*").cast("int").alias("findings_count"))
    states = parts.groupBy("object_id").agg(F.count(F.when(F.col("read"), 1)).alias("_read"), F.max(F.when(~F.col("read"), F.col("outcome"))).alias("_why"), F.max(F.col("outcome").isin("corrupt", "broken")).alias("_broken"))
    entries = states.join(digests, "object_id").join(counts, "object_id", "left")
    status = F.when(F.col("findings_count") > 0, L.WITH_FINDINGS).when(F.col("_read") > 0, L.CLEAN).when(F.col("_broken"), L.PERMANENT).otherwise(L.SKIPPED)
    item = I.stable_item_id(F.lit(connector), F.lit(instance), F.col("object_id"))
    long = lambda x, name: F.lit(x).cast("long").alias(name)
    ledger = entries.select(
        F.lit(tenant).alias("tenant_id"), F.lit(policy).alias("policy_hash"), I.ovid_hash(item, I.object_version_id("version")).alias("ovid_hash"), status.alias("status"),
        F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes_scanned"), F.coalesce("findings_count", F.lit(0)).alias("findings_count"), long(run_id, "run_id"), long(shard_id, "shard_id"),
        long(0, "fence_epoch"), long(now, "started_at"), long(now, "finished_at"), F.when(~status.isin(*L.SCANNED), F.col("_why")).alias("error_code"),
    )
    return findings, ledger
