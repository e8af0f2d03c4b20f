"""Exact top-k by inner product: the three-phase uniform threshold algorithm.

A vector's dimensions are cut into ``lists`` groups; for a query each group is
a list of partial scores, kept by other tasks than the other groups.
Phase 1 gathers the ``depth`` best entries of every list and each list's least
score; the totals of those rows bound the k-th best total from below.  Phase 2 sends that bound out
with the query and collects every entry that reaches its even share of it: a
row below the share in all lists cannot be among the best.  Phase 3 sharpens
the bound, drops rows whose upper bound misses it and resolves the others'
scores exactly.

Queries meet all rows in blocks (at most ``BLOCK_QUERIES`` x ``BLOCK_ROWS``);
only entries that pass a cutoff leave a task.

Components are ``floor(scale * x)``.  Rows with a component of more than LIMIT
in size go another way, since sums of their products may pass what a double
holds exactly: they meet all rows, as queries and as candidates, in blocks of
Python integers, and the best of both ways are ranked together.  Scores that do
not fit a long are given as its nearest end; their ranks are exact up to 38
digits.  Vectors that are null, empty or hold null or non-finite
components take no part, nor do rows with a null id; shorter vectors are
filled with zeros; rows that repeat an id count once (the greatest vector).
Ties go to the smaller id.  Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.llm.ann import usable
from lodestone.llm.common import stored, table

BLOCK_ROWS, BLOCK_QUERIES, BLOCK_LARGE = 4096, 512, 1024
#: Components up to this size are multiplied as doubles: up to 2,048 products of them sum up exactly.
LIMIT = 1 << 21


def integers(vectors: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """vec_id, v (whole numbers as doubles), large (whether any passes LIMIT)."""
    scaled = F.transform("v", lambda x: x * F.lit(scale))
    # From 2^53 on doubles are whole numbers.
    whole = F.transform(scaled, lambda y: F.when(F.abs(y) < F.lit(2.0**53), F.floor(y).cast("double")).otherwise(y))
    rows = usable(vectors, id_col, vec_col).select("vec_id", whole.alias("v"))
    return rows.withColumn("large", F.exists("v", lambda x: F.abs(x) > F.lit(float(LIMIT))) | (F.size("v") > 2048))


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    column = column.combine_chunks()
    flat, lengths = np.asarray(column.flatten(), dtype=np.float64), np.diff(np.asarray(column.offsets))
    if len(lengths) and (lengths == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(lengths), dims))
    out[np.arange(dims)[None, :] < lengths[:, None]] = flat
    return out


def partials(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer products of rows that are not large."""
    return np.rint(q @ x.T).astype(np.int64)


def large_pairs(rows: DataFrame, queries: Column, k: int, n: int, n_large: int) -> DataFrame:
    """query_id, vec_id, exact (decimal): the k best of each query among the pairs with a large row, by block."""
    scale = lambda x: max(1, -(-x // BLOCK_LARGE))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))

    def paired(candidates: DataFrame, asked: DataFrame, nb: int, nq: int) -> DataFrame:
        c = candidates.select(F.pmod(F.xxhash64("vec_id"), F.lit(nb)).cast("int").alias("b"), every(nq).alias("qb"), "vec_id", "v")
        q = asked.select(every(nb).alias("b"), F.pmod(F.xxhash64("vec_id"), F.lit(nq)).cast("int").alias("qb"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
        return c.groupBy("b", "qb").cogroup(q.groupBy("b", "qb")).applyInArrow(exact, "query_id long, vec_id long, exact decimal(38,0)")

    def exact(left: pa.Table, right: pa.Table) -> pa.Table:
        most = 10**38 - 1
        whole = lambda column: [[int(x) for x in v] for v in column.to_pylist()]
        ids, x = left["vec_id"].to_pylist(), whole(left["v"])
        out: list[tuple[int, int, Decimal]] = []
        for name, q in zip(right["query_id"].to_pylist(), whole(right["q"]), strict=True):
            scores = ((sum(a * b for a, b in zip(q, v, strict=False)), i) for i, v in zip(ids, x, strict=True) if i != name)
            out += [(name, i, Decimal(max(-most, min(most, s)))) for s, i in heapq.nsmallest(k, scores, key=lambda t: (-t[0], t[1]))]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[], [], []], (pa.int64(), pa.int64(), pa.decimal128(38, 0)), strict=True)], names=["query_id", "vec_id", "exact"])

    big, asked = rows.where("large"), rows.where(queries)
    small = paired(big, asked.where(~F.col("large")), scale(n_large), scale(n))
    return small.unionAll(paired(rows, asked.where("large"), scale(n), scale(n_large)))


ENTRY = "query_id long, list int, vec_id long, partial long, low long"
_ENTRY = pa.schema([("query_id", pa.int64()), ("list", pa.int32()), ("vec_id", pa.int64()), ("partial", pa.int64()), ("low", pa.int64())])


def search(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 256.0, lists: int = 2, depth: int = 0) -> DataFrame:
    """The k rows of largest integer inner product for each row that meets ``queries`` (a condition on vec_id).

    depth entries (4k unless given) of each list are gathered in phase 1: no
    limit on the result, only on how close the first bound is.
    Result: query_id, rank, vec_id, score.  A query is not its own candidate.
    """
    spark = vectors.sparkSession
    depth = max(k, depth or 4 * k)
    rows = stored(integers(vectors, id_col, vec_col, scale), "integers")
    schema = "query_id long, rank int, vec_id long, score long"
    total = rows.agg(F.count("*").alias("n"), F.count_if("large").alias("large")).first()
    found = small_pairs(rows.where(~F.col("large")).drop("large"), queries, k, lists, depth).withColumn("exact", F.col("score").cast("decimal(38,0)"))
    if total["large"]:
        both = found.select("query_id", "vec_id", "exact").unionAll(large_pairs(rows, queries, k, total["n"], total["large"]))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("exact"), "vec_id"))
        clamped = F.least(F.greatest(F.col("exact"), F.lit(-(1 << 63)).cast("decimal(38,0)")), F.lit((1 << 63) - 1).cast("decimal(38,0)"))
        found = both.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("score", clamped.cast("long"))
    return found.select("query_id", "rank", "vec_id", "score").to(StructType.fromDDL(schema))


def small_pairs(rows: DataFrame, queries: Column, k: int, lists: int, depth: int) -> DataFrame:
    """query_id, rank, vec_id, score of rows that are not large, in three phases."""
    spark = rows.sparkSession
    size = rows.agg(F.count("*").alias("n"), F.count_if(queries).alias("q"), F.max(F.size("v")).alias("dims")).first()
    if not size["q"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = -(-size["dims"] // lists)
    nb, nq = -(-size["n"] // BLOCK_ROWS), -(-size["q"] // BLOCK_QUERIES)
    cut = F.explode(F.array(*[F.struct(F.lit(g).alias("list"), F.slice("v", g * width + 1, width).alias("part")) for g in range(lists)]))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    data = rows.select("vec_id", cut.alias("c"), F.pmod(F.xxhash64("vec_id"), F.lit(nb)).cast("int").alias("b")).select("vec_id", "c.list", "c.part", "b", every(nq).alias("qb"))
    asked = rows.where(queries).withColumnRenamed("vec_id", "query_id")

    def sides(cutoffs: DataFrame | None):
        q = asked if cutoffs is None else asked.join(cutoffs, "query_id")
        more = [] if cutoffs is None else ["cutoff"]
        q = q.select("query_id", cut.alias("c"), F.pmod(F.xxhash64("query_id"), F.lit(nq)).cast("int").alias("qb"), *more).select("query_id", "c.list", "c.part", "qb", every(nb).alias("b"), *[F.element_at(x, F.col("c.list") + 1).alias(x) for x in more])
        keys = ("qb", "b", "list")
        return data.groupBy(*keys).cogroup(q.groupBy(*keys))

    def scored(left: pa.Table, right: pa.Table):
        ids, names = np.asarray(left["vec_id"].combine_chunks()), np.asarray(right["query_id"].combine_chunks())
        return ids, names, partials(_matrix(right["part"], width), _matrix(left["part"], width)), names[:, None] == ids[None, :]

    def table_of(names, g, ids, partial, low) -> pa.Table:
        n = len(names)
        cols = [names, np.full(n, g, dtype=np.int32), ids, partial, low]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ENTRY, strict=True)], schema=_ENTRY)

    def first_phase(left: pa.Table, right: pa.Table) -> pa.Table:
        """The best entries of each query in this block of the list, with the block's least score."""
        if not left.num_rows or not right.num_rows:
            return _ENTRY.empty_table()
        ids, names, s, own = scored(left, right)
        low = s.min(axis=1)
        s[own] = np.iinfo(np.int64).min
        n = min(depth, len(ids))
        top = np.argpartition(s, len(ids) - n, axis=1)[:, len(ids) - n :]
        best = np.take_along_axis(s, top, axis=1)
        seen = best > np.iinfo(np.int64).min
        return table_of(np.repeat(names, n)[seen.ravel()], right["list"][0].as_py(), ids[top][seen], best[seen], np.repeat(low, n)[seen.ravel()])

    def second_phase(left: pa.Table, right: pa.Table) -> pa.Table:
        """Every entry that reaches its query's cutoff for this list."""
        if not left.num_rows or not right.num_rows:
            return _ENTRY.empty_table()
        ids, names, s, own = scored(left, right)
        q, v = np.nonzero((s >= np.asarray(right["cutoff"].combine_chunks())[:, None]) & ~own)
        return table_of(names[q], right["list"][0].as_py(), ids[v], s[q, v], np.zeros(len(q), dtype=np.int64))

    def by_list(column: str, f) -> Column:
        return F.array(*[f(F.when(F.col("list") == g, F.col(column))) for g in range(lists)])

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)

    def lower(partial: str = "p", low: str = "low") -> Column:
        return total(F.zip_with(partial, low, lambda p, x: F.coalesce(p, x)))

    def kth(df: DataFrame, by: str) -> DataFrame:
        """The k-th largest value of each query that has so many."""
        ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(by), "vec_id")))
        return ranked.where(F.col("_r") <= k).groupBy("query_id").agg(F.max(F.when(F.col("_r") == k, F.col(by))).alias("bound"))

    def resolved(pairs: DataFrame) -> DataFrame:
        """The exact scores of (query_id, vec_id)."""
        both = pairs.join(rows, "vec_id").join(asked.select("query_id", F.col("v").alias("q")), "query_id")
        product = F.zip_with("v", "q", lambda a, b: F.coalesce((a * b).cast("long"), F.lit(0).cast("long")))
        return both.select("query_id", "vec_id", total(product).alias("score"))

    one = stored(sides(None).applyInArrow(first_phase, ENTRY), "topk1")
    lows = one.groupBy("query_id").agg(by_list("low", F.min).alias("low"))
    head = one.withColumn("_r", F.row_number().over(Window.partitionBy("query_id", "list").orderBy(F.desc("partial"), "vec_id"))).where(F.col("_r") <= depth)
    sums = resolved(head.select("query_id", "vec_id").distinct()).withColumnRenamed("score", "least")
    floor = total(F.col("low"))
    share = F.ceil((F.coalesce("bound", floor) - floor) / F.lit(float(lists))).cast("long") - 1
    cutoffs = lows.join(kth(sums, "least"), "query_id", "left").select("query_id", "low", F.transform("low", lambda x: x + share).alias("cutoff"))
    cutoffs = stored(cutoffs, "cutoffs")

    two = sides(cutoffs.select("query_id", "cutoff")).applyInArrow(second_phase, ENTRY)
    sent = two.groupBy("query_id", "vec_id").agg(by_list("partial", F.max).alias("p")).join(cutoffs, "query_id")
    sent = stored(sent.select("query_id", "vec_id", "p", lower().alias("least"), lower("p", "cutoff").alias("most")), "topk2")
    left = sent.join(kth(sent, "least"), "query_id").where(F.col("bound").isNull() | (F.col("most") >= F.col("bound")))

    known = F.forall("p", lambda x: x.isNotNull())
    scores = left.where(known).select("query_id", "vec_id", F.col("least").alias("score")).unionByName(resolved(left.where(~known).select("query_id", "vec_id")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
