"""Approximate nearest neighbours by cross-polytope hashing.

Unit vectors are turned by fast pseudo-rotations (three rounds of random signs
and a Hadamard transform); the nearest signed axis is the bucket.  Each of
``tables`` independent rotations indexes every row; a query probes the
``probes`` nearest signed axes of each table and reranks all rows found there
by their exact inner product on the original vectors.  Vectors are hashed by
their direction alone, so that one long vector does not move the others; where
lengths differ, long vectors count at wider angles and half as many axes again
are probed.  Queries that meet fewer than k rows are answered by an exact
search over all rows.

Buckets and query lists are split into blocks of bounded size from counts of
at most tables x 2 x dimensions numbers; nothing is capped or sampled.

Vectors that are null, empty, zero or hold null or non-finite components take
no part, nor do rows with a null id.  Shorter vectors are filled with zeros.
Rows that repeat an id count once (the greatest vector).  Equal scores go to
the smaller id.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import stored, table

TABLES, PROBES = 8, 16
BLOCK_ROWS, BLOCK_QUERIES = 4096, 1024


def finite(col: Column) -> Column:
    """The vector is there, holds no null and no non-finite component."""
    return col.isNotNull() & (F.size(col) > 0) & F.forall(col, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v): one row per id, v an array of doubles."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v")).where(F.col("vec_id").isNotNull() & finite(F.col("v")))
    return rows.groupBy("vec_id").agg(F.max("v").alias("v")).select("vec_id", F.col("v").cast("array<double>").alias("v"))


class Rotations:
    """Pseudo-rotations of all tables; the same for one seed, dimension and number of tables."""

    def __init__(self, dims: int, tables: int, seed: int):
        self.dims = 1 << max(1, (dims - 1).bit_length())
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, 3, self.dims))

    def turn(self, x: np.ndarray, t: int) -> np.ndarray:
        for signs in self.signs[t]:
            x = x * signs
            h = 1
            while h < self.dims:
                pair = x.reshape(len(x), -1, 2, h)
                x = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(len(x), self.dims)
                h *= 2
            x = x / np.sqrt(self.dims)
        return x

    def buckets(self, x: np.ndarray, probes: int) -> np.ndarray:
        """(rows, tables, probes) bucket numbers, nearest signed axis first; no two tables share numbers."""
        out = np.empty((len(x), len(self.signs), probes), dtype=np.int32)
        for t in range(len(self.signs)):
            y = self.turn(x, t)
            near = np.concatenate([y, -y], axis=1)
            out[:, t] = np.argsort(-near, axis=1, kind="stable")[:, :probes] + t * 2 * self.dims
        return out


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The rows of a list column, filled with zeros to dims."""
    flat = np.asarray(column.flatten(), dtype=np.float64)
    lengths = np.diff(np.asarray(column.offsets))
    if len(lengths) and (lengths == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(lengths), dims))
    out[np.arange(dims)[None, :] < lengths[:, None]] = flat
    return out


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id."""
    if len(scores) > k:
        keep = np.nonzero(scores >= np.partition(scores, -k)[-k])[0]
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))][:k]


def search(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", tables: int = TABLES, probes: int = PROBES, seed: int = 11) -> DataFrame:
    """The k nearest found for each row that meets ``queries`` (a condition on vec_id).

    Result: query_id, rank, vec_id, score.  A query is not its own candidate.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col)
    # Squares of very small or large components leave the doubles' range: the norm is taken of components over the largest.
    most = F.array_max(F.transform("v", F.abs))
    norm = F.col("most") * F.sqrt(F.aggregate(F.transform("v", lambda x: x / F.col("most")), F.lit(0.0), lambda a, x: a + x * x))
    rows = stored(rows.withColumn("most", most).where(F.col("most") > 0).withColumn("norm", norm).drop("most"), "vectors")
    size = rows.agg(F.max(F.size("v")).alias("dims"), F.max("norm").alias("norm"), F.min("norm").alias("least"), F.count("*").alias("n")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if size["dims"] is None:
        return spark.createDataFrame([], schema)
    dims, most = size["dims"], size["norm"]
    uneven = size["least"] < most * (1 - 1e-6)
    turns = Rotations(dims, tables, seed)
    probes = min(probes + (probes + 1) // 2 * uneven, 2 * turns.dims)

    def hashed(n: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = np.zeros((batch.num_rows, turns.dims))
                x[:, :dims] = matrix(batch.column(1), dims)
                if batch.num_rows:
                    x /= np.abs(x).max(axis=1, keepdims=True)
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                found = turns.buckets(x, n).reshape(batch.num_rows, -1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * found.shape[1]), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["vec_id", "v", "buckets"])

        return run

    plain = rows.select("vec_id", "v")
    asked = plain.where(queries)
    hashes = "vec_id long, v array<double>, buckets array<int>"
    entry = plain.mapInArrow(hashed(1), hashes).select("vec_id", "v", F.explode("buckets").alias("bucket"))
    probe = asked.mapInArrow(hashed(probes), hashes).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.explode("buckets").alias("bucket"))
    entry, probe = stored(entry, "entries"), stored(probe, "probes")

    # At most tables x 2 x dims rows on either side: the size of a broadcast is known.
    blocks = entry.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("n")).join(probe.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("m")), "bucket")
    blocks = F.broadcast(blocks)
    entry = entry.join(blocks, "bucket").select("bucket", F.pmod(F.xxhash64("vec_id"), "n").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("j"), "vec_id", "v")
    probe = probe.join(blocks, "bucket").select("bucket", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"), F.pmod(F.xxhash64("query_id"), "m").cast("int").alias("j"), "query_id", "q")
    packed = pa.schema([("query_id", pa.int64()), ("ids", pa.binary()), ("scores", pa.binary())])

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            ids, x = np.asarray(left["vec_id"]), matrix(left["v"].chunk(0), dims)
            names, q = np.asarray(right["query_id"]), matrix(right["q"].chunk(0), dims)
            rough = q @ x.T
            rough[names[:, None] == ids[None, :]] = -np.inf
            slack = 1e-9 * (1.0 + np.abs(rough, where=np.isfinite(rough), out=np.zeros_like(rough)).max())
            for name, row, near in zip(names, q, rough, strict=True):
                cut = np.partition(near, -k)[-k] - slack if len(near) > k else -np.inf
                keep = np.nonzero((near >= cut) & (near > -np.inf))[0]
                # One product after the other: equal vectors get equal scores wherever they lie.
                scores = (x[keep] * row).sum(axis=1)
                keep, scores = (lambda o: (keep[o], scores[o]))(best(ids[keep], scores, k))
                out.append((name, ids[keep].tobytes(), scores.tobytes()))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[], [], []], packed, strict=True)], schema=packed)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(b"".join(f["ids"] for f in found), dtype=np.int64)
                scores = np.frombuffer(b"".join(f["scores"] for f in found))
                ids, first = np.unique(ids, return_index=True)
                order = best(ids, scores[first], k)
                n = len(order)
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.int64()), pa.array(range(1, n + 1), pa.int32()), pa.array(ids[order]), pa.array(scores[first][order])], names=["query_id", "rank", "vec_id", "score"])

    def ranked(entry: DataFrame, probe: DataFrame) -> DataFrame:
        keys = ["bucket", "i", "j"]
        lists = entry.groupBy(*keys).cogroup(probe.groupBy(*keys)).applyInArrow(rerank, "query_id long, ids binary, scores binary")
        # One short list per probe and block; k entries each.
        gathered = lists.groupBy("query_id").agg(F.collect_list(F.struct("ids", "scores")).alias("found"))
        return gathered.mapInArrow(merge, schema)

    found = stored(ranked(entry, probe), "found")
    full = found.groupBy("query_id").count().where(F.col("count") >= min(k, size["n"] - 1)).select("query_id")
    short = stored(asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")).join(full, "query_id", "left_anti"), "short")
    few = short.count() if size["n"] > 1 else 0
    if not few:
        return found
    n, m = -(-size["n"] // BLOCK_ROWS), -(-few // BLOCK_QUERIES)
    number = lambda x: F.sequence(F.lit(0), F.lit(x - 1))
    every = rows.select(F.lit(0).alias("bucket"), F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias("i"), F.explode(number(m)).alias("j"), "vec_id", "v")
    again = short.select(F.lit(0).alias("bucket"), F.explode(number(n)).alias("i"), F.pmod(F.xxhash64("query_id"), F.lit(m)).cast("int").alias("j"), "query_id", "q")
    return found.join(short, "query_id", "left_anti").unionAll(ranked(every, again))


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
