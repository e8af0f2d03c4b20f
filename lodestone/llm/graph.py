"""Connected components as DataFrame iterations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import stored

#: Edges that one task joins into a forest at most.
CHUNK_EDGES = 1 << 20


def forest(edges: DataFrame, chunk: int = CHUNK_EDGES) -> DataFrame:
    """Fewer edges (a, b) with the same components: each chunk of edges becomes a spanning forest of its own.

    A dense cluster's many edges shrink to its vertices before any join sees them.
    """
    rows = stored(edges.where(F.col("a") != F.col("b")).select("a", "b"), "links")
    parts = -(-rows.count() // chunk)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while (up := parent.get(top, top)) != top:
                top = up
            while (up := parent.get(x, x)) != top:
                parent[x], x = top, up
            return top

        for batch in batches:
            for a, b in zip(*(np.asarray(c).tolist() for c in batch.columns), strict=True):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        leaves = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array([root(x) for x in leaves], pa.int64()), pa.array(leaves, pa.int64())], names=["a", "b"])

    return rows.repartition(max(1, parts)).mapInArrow(run, "a long, b long").where(F.col("a") != F.col("b"))


def components(edges: DataFrame) -> DataFrame:
    """(v, c): c is the least vertex reachable from v, for every vertex of edges (a, b).

    Each round takes the least label among the neighbours and then the label's
    own label, so that chains shrink by halves; labels are written to the
    shared folder after each round.  Only counts reach the driver.
    """
    pairs = edges.where(F.col("a") != F.col("b"))
    both = stored(pairs.select("a", "b").unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("a"), F.min("b")).alias("c")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("v")).groupBy("a").agg(F.min("c").alias("n"))
        step = labels.join(near, F.col("v") == F.col("a")).select("v", F.col("c").alias("was"), F.least("c", "n").alias("c"))
        own = labels.select(F.col("v").alias("_v"), F.col("c").alias("_c"))
        step = stored(step.join(own, F.col("c") == F.col("_v")).select("v", "was", F.least("c", "_c").alias("c")), "labels")
        labels = step.select("v", "c")
        if not step.where(F.col("was") != F.col("c")).limit(1).count():
            return labels
