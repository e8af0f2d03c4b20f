"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in an order drawn from a hash of their ids, are cut
into blocks of ``block_size`` characters.  With weight w (an exact fraction of
the sum of all weights), block j (from 0) may be released at slot floor(j / w)
and is due by slot ceil((j + 1) / w).  In every slot the earliest deadline
among the released blocks goes first.  As long as no source has run out, no
source is a whole block ahead of or behind its weight; slots that would be those
of a source that has run out stay empty where nothing else is released, and every row keeps its
place within its block's release and deadline.

The schedule is worked out once, block by block, from the sources' sizes: the
blocks are at most ``max_slots`` and one for each source, since larger tables
get larger blocks.  Sources are named by one row each on the driver: more than
``MAX_SOURCES`` are refused, for so many a weight of their own says nothing.

Block numbers come from sums per (source, hash range) and a running sum
inside each range: no source is ever in one task.

A null or empty text has size 1, so that it still takes its place.  A null
source is the source "".  Rows with a null id are ordered by their text's
hash; repeated rows stand next to each other.  An empty table gives an empty
result.  Extra columns stay.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import partitions, stored, table

MIX = ("mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_offset")
#: Least characters of a block, most blocks of a schedule (it is broadcast: some 30 bytes each), most sources.
BLOCK_SIZE, MAX_SLOTS, RANGE_BITS, MAX_SOURCES = 1 << 16, 1 << 20, 12, 100_000


def fractions(weights: dict[str, float | Fraction]) -> dict[str, Fraction]:
    """Exact shares of the sum."""
    if any(not w > 0 or w == float("inf") for w in weights.values()):
        raise ValueError("weights must be positive and finite")
    exact = {n: Fraction(w) for n, w in weights.items()}
    total = sum(exact.values())
    return {n: w / total for n, w in exact.items()}


def release(j: int, w: Fraction) -> int:
    return j * w.denominator // w.numerator


def deadline(j: int, w: Fraction) -> int:
    return -(-(j + 1) * w.denominator // w.numerator)


def edf(blocks: dict[str, int], weights: dict[str, Fraction]) -> Iterator[tuple[str, int, int, int, int]]:
    """(source, block, release, deadline, slot) of all blocks: in each slot the earliest deadline among the released goes first."""
    waiting = [(0, n) for n, count in sorted(blocks.items()) if count]
    heapq.heapify(waiting)
    done, ready, slot = dict.fromkeys(blocks, 0), [], 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            _, n = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline(done[n], weights[n]), n))
        due, n = heapq.heappop(ready)
        j = done[n]
        yield n, j, release(j, weights[n]), due, slot
        done[n], slot = j + 1, slot + 1
        if j + 1 < blocks[n]:
            heapq.heappush(waiting, (release(j + 1, weights[n]), n))


def sizes_of(rows: DataFrame) -> dict[str, int]:
    """Characters of each source, from sums per (source, hash range); one number per source reaches the driver."""
    found = rows.groupBy("_src").agg(F.sum("_sum").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: name groups of them")
    return {r["_src"]: int(r["n"]) for r in found}


def schedule(docs: DataFrame, weights: dict[str, float | Fraction] | None = None, temperature: float = 0.7, block_size: int = BLOCK_SIZE, max_slots: int = MAX_SLOTS, seed: int = 7, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """docs with mix_block, mix_release, mix_deadline, mix_slot, mix_offset, in place of columns of these names.

    Weights default to the sources' sizes to the power of temperature; they
    may be Fractions.  A source without a weight gets the least weight given.
    mix_offset orders the rows of one block.
    """
    spark = docs.sparkSession
    docs = docs.drop(*MIX)
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), source.alias("_src"), F.greatest(F.length(text), F.lit(1)).cast("long").alias("_size"), F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.sha1(text.cast("binary"))), F.lit(seed)).alias("_h"), F.xxhash64(text).alias("_t"))
    rows = rows.withColumn("_range", F.shiftrightunsigned("_h", 64 - RANGE_BITS))
    sums = stored(rows.groupBy("_src", "_range").agg(F.sum("_size").alias("_sum")), "sizes")
    sizes = sizes_of(sums)
    if not sizes:
        return docs.select("*", *[F.lit(0).cast("long").alias(c) for c in MIX])
    given = dict(weights or {n: float(size) ** temperature for n, size in sizes.items()})
    least = min(given.values())
    shares = fractions({n: given.get(n, least) for n in sizes.keys() | given.keys()})
    block_size = max(block_size, -(-sum(sizes.values()) // max_slots))
    order = pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*edf({n: -(-size // block_size) for n, size in sizes.items()}, shares), strict=True), (pa.string(), *[pa.int64()] * 4), strict=True)], names=["_s", "_block", "mix_release", "mix_deadline", "mix_slot"])
    plan = stored(spark.createDataFrame(order), "slots")

    base = sums.select("_src", "_range", (F.sum("_sum").over(Window.partitionBy("_src").orderBy("_range")) - F.col("_sum")).alias("_base"))
    run = Window.partitionBy("_src", "_range").orderBy("_h", "_t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # One row per source and hash range, and one per block: both sizes are bounded by parameters.
    rows = rows.join(F.broadcast(base) if len(sizes) <= 256 else base, ["_src", "_range"]).withColumn("_at", F.col("_base") + F.sum("_size").over(run) - F.col("_size"))
    rows = rows.withColumn("mix_block", F.floor(F.col("_at") / block_size))
    rows = rows.join(F.broadcast(plan), (F.col("_src") == F.col("_s")) & (F.col("mix_block") == F.col("_block")))
    return rows.select("_row.*", "mix_block", "mix_release", "mix_deadline", "mix_slot", (F.col("_at") - F.col("mix_block") * block_size).alias("mix_offset"))


def interleave(docs: DataFrame, **options) -> DataFrame:
    """All rows of docs, dealt to range partitions and sorted in the order of the mix."""
    rows = schedule(docs, **options)
    order = ["mix_slot", "mix_offset"]
    return rows.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order).drop(*MIX)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return schedule(docs).select("doc_id", "source", "mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_offset")
