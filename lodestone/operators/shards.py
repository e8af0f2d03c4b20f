"""Sharded runs as tables: key ranges, progress, claims, checkpoints, and lease logs."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.shared import partitions, stored

ACTIVE, SPLIT, DONE, PARKED = 0, 1, 2, 3
OP_LOG = 16


def coverage_errors(children: DataFrame, parent_start: str = "parent_start", parent_end: str = "parent_end") -> DataFrame:
    """Per parent: what keeps its children's half-open ranges from tiling it; '' is an open bound."""
    w = Window.partitionBy("parent_id").orderBy("start", "end")
    rows = children.withColumns({"_next": F.lead("start").over(w), "_n": F.row_number().over(w)})
    last = F.col("_next").isNull()
    problem = (
        F.when((F.col("end") != "") & (F.col("end") <= F.col("start")), "inverted")
        .when((F.col("_n") == 1) & (F.col("start") != F.col(parent_start)), "starts elsewhere")
        .when(last & (F.col("end") != F.col(parent_end)), "ends elsewhere")
        .when(~last & (F.col("end") == ""), "open inside")
        .when(~last & (F.col("end") < F.col("_next")), "gap")
        .when(~last & (F.col("end") > F.col("_next")), "overlap")
    )
    return rows.groupBy("parent_id").agg(F.count("*").alias("n_children"), F.min(problem).alias("problem"))


def in_range(key: Column, start: Column, end: Column) -> Column:
    return ((start == "") | (key >= start)) & ((end == "") | (key < end))


def by_key_range(rows: DataFrame, key: str, name: str) -> DataFrame:
    """rows dealt to ranges of whole keys of even size, with the range's number as _p, in the shared folder: ranges stay as they are."""
    dealt = rows.repartitionByRange(4 * partitions(rows.sparkSession), F.col(key)).withColumn("_p", F.spark_partition_id())
    return stored(dealt, name)


def route(objects: DataFrame, shards: DataFrame, key: str = "key") -> DataFrame:
    """Each object with the shard whose range holds its key.

    Shard starts and object keys are dealt to ranges of keys together and
    sorted; the last start before a key, in its range or one before it, is its
    shard.  No range join, no window over more than a range.
    """
    starts = shards.select(F.col("start").alias("_k"), F.lit(0).alias("_kind"), F.struct("shard_id", "start", "end").alias("_s"), F.lit(None).cast(objects.select(F.struct("*")).schema[0].dataType).alias("_o"))
    rows = objects.select(F.col(key).alias("_k"), F.lit(1).alias("_kind"), F.lit(None).cast(starts.schema["_s"].dataType).alias("_s"), F.struct("*").alias("_o"))
    both = by_key_range(starts.unionAll(rows), "_k", "routed")
    near = both.withColumn("_s", F.last("_s", True).over(Window.partitionBy("_p").orderBy("_k", "_kind")))
    # The last start of the ranges before: one row per range.
    ends = both.groupBy("_p").agg(F.max_by("_s", F.when(F.col("_kind") == 0, F.col("_k"))).alias("_c"))
    carry = ends.select("_p", F.last("_c", True).over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)).alias("_c"))
    out = near.where(F.col("_kind") == 1).join(F.broadcast(carry), "_p", "left").withColumn("_s", F.coalesce("_s", "_c"))
    return out.where(in_range(F.col("_k"), F.col("_s.start"), F.col("_s.end"))).select("_o.*", F.col("_s.shard_id").alias("shard_id"))


def split_point(items: DataFrame, group: str, key: str, weight: str) -> DataFrame:
    """The key at which the weight before it is nearest to half, never the first or last."""
    w = Window.partitionBy(group).orderBy(key)
    rows = items.withColumns({"_before": F.sum(weight).over(w) - F.col(weight), "_total": F.sum(weight).over(Window.partitionBy(group)), "_n": F.row_number().over(w), "_all": F.count("*").over(Window.partitionBy(group))})
    inner = rows.where((F.col("_n") > 1) & (F.col("_n") < F.col("_all")))
    return inner.groupBy(group).agg(F.min_by(key, F.struct(F.abs(F.col("_before") - F.col("_total") / 2), F.col(key))).alias("split_key"))


def split_residual(shards: DataFrame, points: DataFrame) -> DataFrame:
    """Each shard cut at its point (shard_id, point): the parent keeps what lies before, the residual takes the rest.

    Points outside the range, or at its start, are refused.
    """
    rows = shards.join(points, "shard_id")
    ok = (F.col("point") > F.col("start")) & ((F.col("end") == "") | (F.col("point") < F.col("end")))
    kept = F.struct(F.col("shard_id"), F.lit("kept").alias("part"), F.col("start"), F.col("point").alias("end"))
    rest = F.struct(F.col("shard_id"), F.lit("residual").alias("part"), F.col("point").alias("start"), F.col("end"))
    return rows.where(ok).select(F.explode(F.array(kept, rest)).alias("s")).select("s.*")


def plan_shards(items: DataFrame, key: str, weight: str, n: int) -> DataFrame:
    """About n ranges of even weight that tile all keys, cut between any two keys.

    A key belongs to the range that its weight begins in, counted from the
    least key.  Running sums are over ranges of keys, then inside each.
    """
    sums = items.groupBy(F.col(key).alias("k")).agg(F.sum(weight).alias("w"))
    rows = by_key_range(sums, "k", "planned")
    parts = rows.groupBy("_p").agg(F.sum("w").alias("w"))
    base = parts.select("_p", (F.sum("w").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("w")).alias("_base"), F.sum("w").over(Window.partitionBy(F.lit(1))).alias("_total"))
    before = F.col("_base") + F.sum("w").over(Window.partitionBy("_p").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)) - F.col("w")
    cut = rows.join(F.broadcast(base), "_p").withColumn("bucket", F.floor(before * n / F.col("_total"))).groupBy("bucket").agg(F.min("k").alias("start"), F.sum("w").alias("weight"))
    order = Window.orderBy("start")
    out = cut.withColumns({"shard_id": F.row_number().over(order), "end": F.coalesce(F.lead("start").over(order), F.lit(""))})
    return out.select("shard_id", F.when(F.col("shard_id") == 1, "").otherwise(F.col("start")).alias("start"), "end", "weight")


def list_shards(shards: DataFrame, now: int, status: int | None = None, leased: bool | None = None) -> DataFrame:
    """Shards of a status, leased or free at a time; a lease whose deadline has passed is none."""
    held = (F.col("status") == ACTIVE) & (F.coalesce("deadline", F.lit(0)) > now)
    rows = shards.withColumn("is_leased", held)
    rows = rows if status is None else rows.where(F.col("status") == status)
    return rows if leased is None else rows.where(F.col("is_leased") == leased)


def claim_cooldown(claims: DataFrame, now: int, cooldown: int) -> DataFrame:
    """Workers (worker, at, succeeded) with whether they may claim now, and when they may: a successful claim bars the next for a while."""
    last = claims.groupBy("worker").agg(F.max(F.when(F.col("succeeded"), F.col("at"))).alias("_last"))
    retry = F.coalesce(F.col("_last") + cooldown, F.lit(0))
    return last.select("worker", (retry <= now).alias("may_claim"), retry.cast("long").alias("retry_at"))


def hint(kind: Column, prefix: Column, manifest: Column, first: Column, end: Column) -> Column:
    """A shard's routing hint in hex: range, prefix with its length, or rows of a manifest; null for rows that run backwards."""
    wide = lambda c, n: F.lpad(F.hex(c), n, "0")
    return (
        F.when(kind == "range", F.lit("00"))
        .when(kind == "prefix", F.concat(F.lit("01"), wide(F.octet_length(prefix), 8), F.hex(prefix)))
        .when((kind == "manifest") & (first < end), F.concat(F.lit("02"), wide(manifest, 16), wide(first, 16), wide(end, 16)))
    )


def hint_parts(code: Column) -> Column:
    """A hint read back: kind, prefix, manifest, first, end, error."""
    number = lambda at: F.conv(F.substring(code, at, 16), 16, -10).cast("long")
    tag, size = F.substring(code, 1, 2), F.conv(F.substring(code, 3, 8), 16, 10).cast("long")
    error = (
        F.when(F.coalesce(F.length(code), F.lit(0)) == 0, "empty").when(~tag.isin("00", "01", "02"), "unknown tag")
        .when((tag == "01") & ((F.length(code) < 10) | (F.length(code) < 10 + 2 * size)), "truncated prefix")
        .when((tag == "02") & (F.length(code) < 50), "truncated manifest").when((tag == "02") & (number(19) >= number(35)), "rows inverted")
    )
    ok = error.isNull()
    kind = F.when(ok, F.element_at(F.array(F.lit("range"), F.lit("prefix"), F.lit("manifest")), (F.conv(tag, 16, 10) + 1).cast("int")))
    prefix = F.when(ok & (tag == "01"), F.decode(F.unhex(F.substring(code, F.lit(11), (2 * size).cast("int"))), "UTF-8"))
    rows = lambda at: F.when(ok & (tag == "02"), number(at))
    return F.struct(kind.alias("kind"), prefix.alias("prefix"), rows(3).alias("manifest"), rows(19).alias("first"), rows(35).alias("end"), error.alias("error"))


def byte_midpoint(low: Column, high: Column) -> Column:
    """A hex key half way between two hex keys: their mean as fractions of one byte more than the longer; null unless low < high."""

    def half(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            n = max(len(x or ""), len(y or "")) + 2
            mid = (int((x or "").ljust(n, "0"), 16) + int((y or "").ljust(n, "0"), 16)) // 2 if x is not None and y is not None and x < y else None
            out.append(None if mid is None else re.sub("(?:00)+$", "", f"{mid:0{n}X}"))
        return pd.Series(out, dtype=object)

    return F.pandas_udf(half, "string")(F.upper(low), F.upper(high))


def run_progress(shards: DataFrame, now: int) -> DataFrame:
    """Counts by status, leased shards, watermark (least cursor of active shards) and the verdict of each run."""
    active = F.col("status") == ACTIVE
    out = shards.groupBy("run_id").agg(
        F.count("*").alias("total"), F.count_if(active).alias("active"), F.count_if(F.col("status") == SPLIT).alias("split"), F.count_if(F.col("status") == DONE).alias("done"),
        F.count_if(F.col("status") == PARKED).alias("parked"), F.count_if(active & (F.col("deadline") > now)).alias("leased"), F.min(F.when(active, F.col("cursor"))).alias("watermark"),
    )
    return out.withColumn("verdict", F.when(F.col("active") > 0, "still_active").when(F.col("parked") > 0, "has_failures").otherwise("all_done"))


def claim_order(shards: DataFrame, now: int, worker: int) -> DataFrame:
    """Free active shards of each run, in the order in which a worker tries them."""
    free = shards.where((F.col("status") == ACTIVE) & (F.coalesce("deadline", F.lit(0)) <= now))
    w = Window.partitionBy("run_id")
    n = F.count("*").over(w)
    rows = free.withColumns({"_n": n, "_r": F.row_number().over(w.orderBy("shard_id")) - 1})
    return rows.select("run_id", "shard_id", F.pmod(F.col("_r") - F.lit(worker) % F.col("_n"), F.col("_n")).cast("int").alias("attempt"))


def contiguous_prefix(receipts: DataFrame, group: str, seq: str) -> DataFrame:
    """The last sequence number (from 0) up to which every receipt is there; -1 if the first is missing."""
    rows = receipts.select(group, seq).distinct().withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(seq)) - 1)
    return rows.groupBy(group).agg(F.coalesce(F.max(F.when(F.col(seq) == F.col("_r"), F.col(seq))), F.lit(-1)).alias("prefix"), F.count("*").alias("receipts"))


def op_conflicts(log: DataFrame) -> DataFrame:
    """Operations repeated with another payload."""
    return log.groupBy("shard_id", "op_id").agg(F.count_distinct("payload_hash").alias("payloads")).where("payloads > 1")


LEASE_SCHEMA = "shard_id long, seq long, op string, outcome string, fence long, owner long, deadline long, status int, cursor string"


@dataclass
class Lease:
    """A shard's state between two operations."""

    status: int = ACTIVE
    fence: int = 0
    owner: int | None = None
    deadline: int = 0
    cursor: str | None = None

    def refusal(self, r) -> str | None:
        """Why an operation is refused, if it is."""
        if r.op == "unpark":
            return None if self.status == PARKED else "not_parked"
        if self.status != ACTIVE:
            return "terminal"
        if r.op == "acquire":
            return "leased" if self.deadline > r.now else None
        if r.fence != self.fence:
            return "stale_fence"
        if self.deadline <= r.now:
            return "expired"
        if self.owner != r.worker:
            return "not_owner"
        return "cursor_back" if r.op == "checkpoint" and self.cursor is not None and r.cursor < self.cursor else None

    def apply(self, r) -> str:
        if (refused := self.refusal(r)) is not None:
            return refused
        if r.op == "acquire":
            self.fence, self.owner, self.deadline = self.fence + 1, r.worker, r.now + r.ttl
        elif r.op == "renew":
            self.deadline = max(self.deadline, r.now + r.ttl)
        elif r.op == "checkpoint":
            self.cursor = r.cursor
        else:
            self.status = {"unpark": ACTIVE, "complete": DONE}.get(r.op, PARKED)
            self.owner, self.deadline = None, 0
        return "ok"


def replay(log: DataFrame) -> DataFrame:
    """Each operation of each shard's ordered log with its outcome and the shard's state after it.

    log: shard_id, seq, now, op (acquire, renew, checkpoint, complete, park,
    unpark), worker, fence, ttl, cursor, op_id, payload_hash.  A shard's state
    depends on its own log only; a log is as long as its shard's life.
    """

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, lease, seen = None, Lease(), {}
        for rows in parts:
            out = []
            for r in rows.itertuples(index=False):
                if r.shard_id != shard:
                    shard, lease, seen = r.shard_id, Lease(), {}
                if r.op_id in seen:
                    outcome = "replayed" if seen[r.op_id] == r.payload_hash else "op_conflict"
                else:
                    outcome = lease.apply(r)
                    if outcome == "ok":
                        seen[r.op_id] = r.payload_hash
                        if len(seen) > OP_LOG:
                            seen.pop(next(iter(seen)))
                out.append((r.shard_id, r.seq, r.op, outcome, lease.fence, lease.owner, lease.deadline, lease.status, lease.cursor))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in LEASE_SCHEMA.split(", ")]).astype({"owner": "Int64"})

    # Logs pass through in order; what is kept of them is one lease and the last operations, whatever their length.
    dealt = log.repartition(partitions(log.sparkSession), "shard_id").sortWithinPartitions("shard_id", "seq")
    return dealt.select("shard_id", "seq", "now", "op", "worker", "fence", "ttl", "cursor", "op_id", "payload_hash").mapInPandas(fold, LEASE_SCHEMA)


def child_id(parent: Column, op: Column, index: Column) -> Column:
    return F.sha2(F.concat_ws("/", F.lit("shard-child"), parent.cast("string"), op.cast("string"), index.cast("string")), 256)


def manifest_key(major: Column, minor: Column) -> Column:
    """A 16-byte key of two big-endian numbers that sorts as they do."""
    return F.unhex(F.concat(F.lpad(F.hex(major), 16, "0"), F.lpad(F.hex(minor), 16, "0")))


def prefix_successor(prefix: Column) -> Column:
    """The least hex key above all keys with a hex prefix; null if there is none."""
    cut = F.regexp_replace(prefix, "(?i)(?:FF)+$", "")
    last = F.conv(F.substring(cut, -2, 2), 16, 10).cast("int") + 1
    return F.when(F.length(cut) >= 2, F.concat(F.substring(cut, F.lit(1), F.length(cut) - 2), F.lpad(F.hex(last), 2, "0")))


def key_successor(key: Column) -> Column:
    return F.concat(key, F.lit("00"))


