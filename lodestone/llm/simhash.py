"""SimHash near-duplicates by the generalised pigeonhole principle.

A text's fingerprint has a bit set if more than half of its shingles' hashes
have it set.  Fingerprints link at ``max_bits`` or fewer differing bits.

Search: correlated bits are grouped into partitions; each partition gets a
threshold of its own, chosen by dynamic programming so that the thresholds
plus one sum up to max_bits + 1 (then two fingerprints that link differ by no
more than the threshold in one partition at least) and the estimated number of
candidates and probes is least; the number of partitions is the one of least
cost.  Estimates come from histograms of all fingerprints.  Every fingerprint
probes the keys around its own in each partition; those that meet under one
key are verified bit by bit.

Equal fingerprints are one vertex, so that copies send one row on.  A key
under which more than ``BLOCK`` fingerprints meet is cut into blocks, and each
pair of blocks is verified by a task of its own.  A task sends out a spanning
forest of the links that it finds, never all pairs: components stay whole.

``near_clusters`` finds near copies by their sets of shingles: ``PRINTS``
independent fingerprints of each set name candidates (any one may), and every
candidate pair is verified by its whole sets, so that no link is made up.
Fingerprints of sets of resemblance 0.8 differ in 9.7 bits on average; all pairs
up to NEAR_BITS meet, most of those up to WIDE_BITS do and are looked at too.
Pairs that meet in one fingerprint by chance, more and more of them as the table
grows, differ in half of the bits of the next one: probes carry that one along,
and a link has no more than OTHER_BITS there.

Null and empty texts have the fingerprint zero and link like any other.  Rows
with a null doc_id have a fingerprint and no component.  Rows that repeat a
doc_id are one document if their fingerprints are equal, else each links by
its own.  Extra columns are ignored (``dedup`` keeps them).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import partitions, small_batches, stored, table
from lodestone.llm.graph import components, forest
from lodestone.llm.substring_dedup import rolling, word_hashes, words_of

BITS, BLOCK, SUB_BITS = 64, 4096, 11
PARTS = (3, 4, 5)
#: Near copies: fingerprints of a set, bits in which all pairs are found, bits up to which pairs that meet are looked at, and the least resemblance.
PRINTS, NEAR_BITS, WIDE_BITS, SIMILAR = 2, 9, 13, (4, 5)
#: Bits in which the next fingerprints of near copies may differ: more at a resemblance of 0.8 for some 2 in 100,000 pairs, no more by chance for 1 in 110.
OTHER_BITS = 22
#: Sets and bytes of sets of a block that is compared in one task with another, and bits of the sketches that spare them most comparisons.
BLOCK_SETS, BLOCK_BYTES, ODD_BITS = 2048, 64 << 20, 2048
#: Costs of a probe row in the units of a candidate pair; those of near copies also have the next fingerprint and take most of the disk.
PROBE_COST, NEAR_PROBE_COST = 20.0, 500.0
#: Probe rows that one task sends out in the search for near copies: with many more it spills them.
PROBE_ROWS = 1 << 22


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of the text's words, A-Z in lower case."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(line, 42)], dtype=np.uint64)
    n = len(words) - shingle + 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)), dtype=np.uint64, count=n)


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    if not len(h):
        return 0
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(h), 1 << 15):
        part = h[i : i + (1 << 15)]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def remix(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th hash of hashed shingles."""
    x = (h ^ np.uint64(0xA0761D6478BD642F + 0x632BE59BD9B4E019 * k & (1 << 64) - 1)) * np.uint64(0xE7037ED1A0B428DB)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x8EBC6AF09C88C6E3)
    return x ^ (x >> np.uint64(29))


def texts_of(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, fp of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([majority(shingle_hashes(t, shingle)) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return texts_of(docs).mapInArrow(run, "doc_id long, fp long")


def _bits(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def correlations(nodes: DataFrame) -> np.ndarray:
    """Correlation of every two bits over all fingerprints; 64 x 64 counts reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((BITS, BITS))
        n = 0
        for batch in batches:
            bits = _bits(np.asarray(batch.column(0))).astype(np.float32)
            both += bits.T @ bits
            n += batch.num_rows
        i, j = np.indices((BITS, BITS))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(both.ravel().astype(np.int64)), pa.array(np.full(BITS * BITS, n))], names=["i", "j", "both", "n"])

    rows = nodes.select("fp").mapInArrow(run, "i int, j int, both long, n long").groupBy("i", "j").agg(F.sum("both").alias("both"), F.sum("n").alias("n")).collect()
    both, n = np.zeros((BITS, BITS)), 1
    for r in rows:
        both[r["i"], r["j"]], n = r["both"], r["n"]
    p = np.diag(both) / n
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    return (both / n - np.outer(p, p)) / np.outer(sd, sd)


def grouped_bits(corr: np.ndarray, parts: int) -> list[list[int]]:
    """Bits dealt to partitions of even size: each partition starts with the closest pair left and takes the bit closest to it."""
    close = np.abs(corr) - np.eye(BITS) * 2
    left, out = list(range(BITS)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        sub = close[np.ix_(left, left)]
        i, j = np.unravel_index(int(np.argmax(sub)), sub.shape)
        group = sorted({left[i], left[j]})
        while len(group) < size:
            rest = [b for b in left if b not in group]
            group.append(max(rest, key=lambda b: (close[b, group].mean(), -b)))
        out.append(sorted(group[:size]))
        left = [b for b in left if b not in out[-1]]
    return out


def part_key(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    key = np.zeros(len(fp), dtype=np.int64)
    for j, b in enumerate(bits):
        key |= ((fp >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << j
    return key


def ball(width: int, radius: int) -> np.ndarray:
    """Masks that change at most radius of width bits."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(width), r)], dtype=np.int64)


def distance_shares(nodes: DataFrame, groupings: list[list[list[int]]]) -> list[list[np.ndarray]]:
    """For each partition of each grouping the estimated share of pairs at each distance.

    Histograms of at most 2^SUB_BITS values, over all fingerprints, are taken
    of the partition's pieces; pieces count as independent of each other.
    """
    pieces = [(at, k, g[i : i + SUB_BITS]) for at, groups in enumerate(groupings) for k, g in enumerate(groups) for i in range(0, len(g), SUB_BITS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(1 << len(bits), dtype=np.int64) for *_, bits in pieces]
        for batch in batches:
            fp = np.asarray(batch.column(0)).view(np.uint64)
            for c, (*_, bits) in zip(counts, pieces, strict=True):
                c += np.bincount(part_key(fp, bits), minlength=len(c))
        for at, c in enumerate(counts):
            k = np.nonzero(c)[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), at, dtype=np.int32)), pa.array(k.astype(np.int32)), pa.array(c[k])], names=["piece", "k", "n"])

    counts = [np.zeros(1 << len(bits)) for *_, bits in pieces]
    for r in nodes.select("fp").mapInArrow(run, "piece int, k int, n long").groupBy("piece", "k").agg(F.sum("n").alias("n")).collect():
        counts[r["piece"]][r["k"]] = r["n"]
    shares = [[np.ones(1) for _ in groups] for groups in groupings]
    for (at, k, bits), c in zip(pieces, counts, strict=True):
        x = walsh(c / max(1.0, c.sum()))  # how often two values differ by each mask
        x = walsh(x * x)
        by_distance = np.bincount(np.bitwise_count(np.arange(len(x))), weights=np.maximum(x / len(x), 0), minlength=len(bits) + 1)
        shares[at][k] = np.convolve(shares[at][k], by_distance)
    return shares


def walsh(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform."""
    h = 1
    while h < len(x):
        y = x.reshape(-1, 2, h)
        x = np.stack([y[:, 0] + y[:, 1], y[:, 0] - y[:, 1]], axis=1).ravel()
        h *= 2
    return x


def thresholds(shares: list[np.ndarray], widths: list[int], n: int, max_bits: int, probe_cost: float = PROBE_COST) -> tuple[float, list[int]]:
    """The cost and the thresholds of least estimated cost whose sum with one added to each is max_bits + 1 or more.

    A threshold of -1 leaves a partition out.  Both sides of a pair probe half
    of the threshold, so that even thresholds are the useful ones.
    """
    options = []
    for share, width in zip(shares, widths, strict=True):
        costs = {-1: 0.0}
        for t in range(0, min(max_bits, width) + 2, 2):
            probes = sum(math.comb(width, r) for r in range(t // 2 + 1))
            costs[t] = float(share[: t + 1].sum()) * n * n / 2 + probe_cost * probes * n
        options.append(costs)
    need = max_bits + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for costs in options:
        after: dict[int, tuple[float, list[int]]] = {}
        for got, (cost, chosen) in best.items():
            for t, c in costs.items():
                total = min(need, got + t + 1)
                if total not in after or cost + c < after[total][0]:
                    after[total] = (cost + c, [*chosen, t])
        best = after
    return best[need]


def linked(fp: np.ndarray, max_bits: int, other: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """A spanning forest of the links among the fingerprints: (root, parent, child) as places; with other, the next fingerprints differ in OTHER_BITS or fewer."""
    met = np.zeros(len(fp), dtype=bool)
    for s in range(0, len(fp), 256):
        i, j = np.nonzero(np.bitwise_count(fp[s : s + 256, None] ^ fp[None, s:]) <= max_bits)
        i, j = i[i < j] + s, j[i < j] + s
        if other is not None:
            ok = np.bitwise_count(other[i] ^ other[j]) <= OTHER_BITS
            i, j = i[ok], j[ok]
        met[i] = met[j] = True
    edges, left = [], np.nonzero(met)[0]
    while len(left):
        root, left = int(left[0]), left[1:]
        todo = [root]
        while todo and len(left):
            at = todo.pop()
            hit = np.bitwise_count(fp[left] ^ fp[at]) <= max_bits
            if other is not None:
                hit &= np.bitwise_count(other[left] ^ other[at]) <= OTHER_BITS
            for x in left[hit].tolist():
                edges.append((root, at, x))
                todo.append(x)
            left = left[~hit]
    return edges


def keyed_groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[list[np.ndarray]]:
    """The columns of each run of rows with equal first n_keys columns that has two rows or more; rows are sorted by them."""
    held: list[np.ndarray] | None = None

    def cut(cols: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
        new = np.zeros(len(cols[0]), dtype=bool)
        for c in cols[:n_keys]:
            new[1:] |= c[1:] != c[:-1]
        starts = np.r_[0, np.nonzero(new)[0]]
        ends = np.r_[starts[1:], len(cols[0])]
        for s, e in zip(*(v[ends - starts > 1].tolist() for v in (starts, ends)), strict=True):
            yield [c[s:e] for c in cols]

    for batch in batches:
        cols = [np.asarray(c) for c in batch.columns]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        if not len(cols[0]):
            continue
        # The last key may go on in the next batch.
        other = np.zeros(len(cols[0]), dtype=bool)
        for c in cols[:n_keys]:
            other |= c != c[-1]
        at = np.nonzero(other)[0]
        end = int(at[-1]) + 1 if len(at) else 0
        held = [c[end:].copy() for c in cols]
        if end:
            yield from cut([c[:end] for c in cols])
    if held is not None and len(held[0]):
        yield from cut(held)


def block_pairs(rows: DataFrame, keys: list[str], counts: DataFrame, block: int, *by: str) -> DataFrame:
    """rows dealt and sorted by keys and the pair of blocks: a key of more than block rows (counts: keys, m) is cut into m blocks, each pair of which is a group."""
    spark = rows.sparkSession
    mine = F.pmod(F.xxhash64(*by), F.col("m")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda c: F.least(c, mine).cast("long") * (1 << 31) + F.greatest(c, mine))
    cut = rows.join(counts, keys, "left").withColumn("pair", F.explode(F.when(F.col("m") > 1, pair).otherwise(F.array(F.lit(0).cast("long"))))).drop("m")
    return cut.select(*keys, "pair", *[c for c in rows.columns if c not in keys]).repartition(partitions(spark), *keys, "pair").sortWithinPartitions(*keys, "pair", *by)


def plan(nodes: DataFrame, max_bits: int, parts: int | None = None, probe_cost: float = PROBE_COST) -> list[tuple[int, list[int], np.ndarray]]:
    """(number, bits, masks of its probes) of each partition in use; 64 x 64 counts and histograms reach the driver."""
    corr, n = correlations(nodes), nodes.count()
    groupings = [grouped_bits(corr, p) for p in ((parts,) if parts else PARTS)]
    costs = [(*thresholds(s, [len(g) for g in groups], n, max_bits, probe_cost), groups) for s, groups in zip(distance_shares(nodes, groupings), groupings, strict=True)]
    _, chosen, groups = min(costs, key=lambda c: c[0])
    return [(k, g, ball(len(g), t // 2)) for k, (g, t) in enumerate(zip(groups, chosen, strict=True)) if t >= 0]


def links(nodes: DataFrame, max_bits: int, parts: int | None = None, wide: int | None = None) -> DataFrame:
    """Links (k, root, a, b) between distinct fingerprints (k, fp) of one k that connect whatever links: a and b link, root is where their forest begins.

    All pairs of max_bits differing bits or fewer meet; with wide, pairs that
    meet link up to that many.  Nodes (k, fp, other) are distinct pairs of a
    fingerprint and the next one, which holds a link to OTHER_BITS; other_a and
    other_b come back with their links.
    """
    own = ["fp", *[c for c in nodes.columns if c == "other"]]
    probes = plan(nodes.where("k = 0").select("fp"), max_bits, parts, NEAR_PROBE_COST if len(own) > 1 else PROBE_COST)
    most = max_bits if wide is None else wide
    ends = ["root", "a", "b", "_", "other_a", "other_b"][: 3 * len(own)]

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, raw = np.asarray(batch.column(0)).astype(np.int64) << 60, [np.asarray(c) for c in batch.columns[1:]]
            for k, bits, masks in probes:
                keys = ((part_key(raw[0].view(np.uint64), bits) | one)[:, None] ^ masks[None, :]).ravel() | (k << 56)
                yield pa.RecordBatch.from_arrays([pa.array(keys), *[pa.array(np.repeat(c, len(masks))) for c in raw]], names=["bucket", *own])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[np.ndarray] = []
        rows = 0

        def flushed() -> pa.RecordBatch:
            cols = np.concatenate(out).T
            return pa.RecordBatch.from_arrays([pa.array(cols[0].astype(np.int32)), *[pa.array(c) for c in cols[1:]]], names=["k", *ends])

        for bucket, _, *prints in keyed_groups(batches, 2):
            found = linked(prints[0].view(np.uint64), most, *[x.view(np.uint64) for x in prints[1:]])
            if found:
                at = np.array(found)
                out.append(np.column_stack([np.full(len(found), bucket[0] >> 60), *[x[at] for x in prints]]))
                rows += len(found)
            if rows > 1 << 15:
                yield flushed()
                out, rows = [], 0
        if out:
            yield flushed()

    probed = lambda rows: rows.select("k", *own).mapInArrow(expand, ", ".join(f"{c} long" for c in ["bucket", *own]))
    rows = probed(nodes)
    hot = stored(rows.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("m")), "hot")
    if len(own) > 1:  # fingerprints are small: a few files of them hold all of a large table's
        tasks = -(-nodes.count() * sum(len(masks) for *_, masks in probes) // PROBE_ROWS)
        rows = probed(nodes.repartition(max(tasks, nodes.sparkSession.sparkContext.defaultParallelism)))
    return block_pairs(rows, ["bucket"], hot, BLOCK, *own).mapInArrow(verify, "k int, " + ", ".join(f"{c} long" for c in ends)).drop("_").distinct()


def clusters(docs: DataFrame, shingle: int = 3, max_bits: int = 2, parts: int | None = None) -> DataFrame:
    """doc_id, fp, component_id of every row: component_id is the least doc_id reachable by links."""
    fps = stored(fingerprints(docs, shingle), "fingerprints")
    nodes = stored(fps.where(F.col("doc_id").isNotNull()).groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    found = forest(links(nodes.withColumn("k", F.lit(0)), max_bits, parts).select("a", "b"))
    # From fingerprints to least doc_ids: a vertex is a document from here on, so that repeated ids join their links.
    edges = found.join(nodes.withColumnsRenamed({"fp": "a", "least": "x"}), "a").join(nodes.withColumnsRenamed({"fp": "b", "least": "y"}), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    rows = fps.join(nodes, "fp", "left")
    labels = components(edges)
    return rows.join(labels, rows["least"] == labels["v"], "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "least")).alias("component_id"))


# -- near copies by shingle sets ---------------------------------------------------------------------


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The distinct shingles of a text, A-Z in lower case, as sorted hashes of their words' hashes; the whole sequence if it is shorter."""
    words = words_of(text)
    h = word_hashes([w.lower() for w in words])
    return np.unique(rolling(h, min(shingle, len(h)), 0x9E3779B97F4A7C15)) if len(h) else h


def set_id(x: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(x.tobytes(), 7)).view(np.int64))


def sketches(docs: DataFrame, shingle: int, prints: int) -> DataFrame:
    """doc_id, id, n, odd, fps of every row with a doc_id: the set's digest, size, sketch and fingerprints."""
    schema = pa.schema([("doc_id", pa.int64()), ("id", pa.int64()), ("n", pa.int32()), ("odd", pa.binary()), ("fps", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, shingle) for t in batch.column(1).to_pylist()]
            fps = np.array([[majority(remix(x, k)) for k in range(prints)] for x in sets], dtype=np.uint64).reshape(len(sets), prints).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([set_id(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int32()), pa.array([odd_sketch(x).tobytes() for x in sets], pa.binary()), pa.array(list(fps), pa.list_(pa.int64()))], schema=schema)

    return texts_of(docs).where(F.col("doc_id").isNotNull()).mapInArrow(run, "doc_id long, id long, n int, odd binary, fps array<long>")


def near(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return SIMILAR[1] * both >= SIMILAR[0] * (len(x) + len(y) - both)


def sized(n: str, m: str):
    """Whether sets of these sizes can be near."""
    return SIMILAR[1] * F.least(n, m) >= SIMILAR[0] * F.greatest(n, m)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of ids whose sets are near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = lambda c: [np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in c]
            ok = [near(x, y) for x, y in zip(read(batch.column(2)), read(batch.column(3)), strict=True)]
            yield pa.RecordBatch.from_struct_array(batch.to_struct_array().filter(pa.array(ok, pa.bool_()))).select(["a", "b"])

    sides = pairs.join(sets.withColumnsRenamed({"id": "a", "shingles": "x"}), "a").join(sets.withColumnsRenamed({"id": "b", "shingles": "y"}), "b")
    return sides.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def part_pairs(members: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part of a group that chains of near copies connect: its least set, with that of the group's largest part."""
    rows = members.join(labels, F.col("id") == F.col("v"), "left").groupBy("grp", F.coalesce("c", "id").alias("c")).agg(F.min("id").alias("b"), F.count("*").alias("rows"))
    hub = rows.groupBy("grp").agg(F.max_by("b", F.struct("rows", "b")).alias("a"), F.count("*").alias("parts")).where("parts > 1")
    return rows.join(hub, "grp").select("a", "b")


def odd_sketch(x: np.ndarray) -> np.ndarray:
    """The parity of the set's members in each of ODD_BITS bins: two sketches differ in no more bits than their sets in members."""
    bins = np.bincount((x >> np.uint64(40)).astype(np.int64) & (ODD_BITS - 1), minlength=ODD_BITS)
    return np.packbits(bins & 1 == 1, bitorder="little").view(np.uint64)


def met_pairs(ids: np.ndarray, fp: np.ndarray, n: np.ndarray, label: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs of unlike labels whose fingerprints link and whose sizes may be near, some 16,000 at a time; label may change meanwhile."""
    p, q = SIMILAR
    for s in range(0, len(ids), 128):
        part = slice(s, s + 128)
        ok = np.bitwise_count(fp[part, None] ^ fp[None, :]) <= max_bits
        ok &= (label[part, None] != label[None, :]) & (ids[part, None] < ids[None, :])
        i, j = np.nonzero(ok)
        i += s
        sized = q * np.minimum(n[i], n[j]) >= p * np.maximum(n[i], n[j])
        i, j = i[sized], j[sized]
        for at in range(0, len(i), 1 << 14):
            yield i[at : at + (1 << 14)], j[at : at + (1 << 14)]


def plausible(x: np.ndarray, y: np.ndarray, n: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """Which pairs of places their sketches leave open; no near pair is left out."""
    p, q = SIMILAR
    return (q + p) * np.bitwise_count(odd[x] ^ odd[y]).sum(axis=1, dtype=np.int64) <= (q - p) * (n[x] + n[y])


def with_partner(ids: np.ndarray, fp: np.ndarray, n: np.ndarray, odd: np.ndarray, max_bits: int) -> np.ndarray:
    """Which sets have another one that their sketches may hold for near."""
    got = np.zeros(len(ids), dtype=bool)
    for x, y in met_pairs(ids, fp, n, np.arange(len(ids)), max_bits):
        new = ~(got[x] & got[y])
        x, y = x[new], y[new]
        may = plausible(x, y, n, odd)
        got[x[may]] = True
        got[y[may]] = True
    return got


def near_links(ids: np.ndarray, fp: np.ndarray, c: np.ndarray, sets: list[np.ndarray], max_bits: int) -> list[tuple[int, int]]:
    """Pairs of ids whose sets are near, no more than connect the labels c; fingerprints differ in max_bits bits or fewer."""
    n, odd = np.array([len(x) for x in sets]), np.array([odd_sketch(x) for x in sets])
    label = np.unique(c, return_inverse=True)[1]
    out = []
    for x, y in met_pairs(ids, fp, n, label, max_bits):
        may = label[x] != label[y]
        x, y = x[may], y[may]
        may = plausible(x, y, n, odd)
        for a, b in zip(x[may].tolist(), y[may].tolist(), strict=True):
            if label[a] != label[b] and near(sets[a], sets[b]):
                out.append((int(ids[a]), int(ids[b])))
                label[label == label[b]] = label[a]
    return out


def partnered(members: DataFrame, nodes: DataFrame, max_bits: int) -> DataFrame:
    """The ids of members (grp, id, fp) that another one of their group may be near to by fingerprint, size and sketch."""
    hot = stored(members.groupBy("grp").agg(F.count("*").alias("rows")).where(F.col("rows") > BLOCK).select("grp", F.ceil(F.col("rows") / BLOCK).cast("int").alias("m")), "hot")
    dealt = block_pairs(members.select("grp", "id", "fp").join(nodes.select("id", "n", "odd"), "id").select("grp", "id", "fp", "n", "odd"), ["grp"], hot, BLOCK, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, ids, fp, n, odd in keyed_groups(batches, 2):
            odd = np.frombuffer(b"".join(odd), dtype=np.uint64).reshape(len(ids), -1)
            got = with_partner(ids, fp.view(np.uint64), n.astype(np.int64), odd, max_bits)
            if got.any():
                yield pa.RecordBatch.from_arrays([pa.array(ids[got])], names=["id"])

    return dealt.mapInArrow(run, "id long").distinct()


def open_links(members: DataFrame, labels: DataFrame, sets: DataFrame, max_bits: int) -> DataFrame:
    """Near pairs (a, b) of one group that no chain of near copies connects yet, no more than connect what each pair of blocks holds.

    Whole sets go to the blocks of their group and are compared there; a block
    holds BLOCK_SETS sets or BLOCK_BYTES on average.
    """
    keys = ["grp"]
    rows = members.join(labels, F.col("id") == F.col("v"), "left").select(*keys, "id", "n", "fp", F.coalesce("c", "id").alias("c"))
    open_ = rows.groupBy(*keys).agg(F.count("*").alias("rows"), F.sum(F.col("n").cast("long")).alias("size"), F.min("c").alias("c1"), F.max("c").alias("c2")).where("c1 <> c2")
    blocks = F.greatest(F.ceil(F.col("rows") / BLOCK_SETS), F.ceil(8 * F.col("size") / BLOCK_BYTES)).cast("int")
    open_ = stored(open_.select(*keys, blocks.alias("m")), "open")
    dealt = block_pairs(rows.join(open_, keys, "left_semi").join(sets, "id").select(*keys, "id", "fp", "c", "shingles"), keys, open_, BLOCK_SETS, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, ids, fp, c, shingles in keyed_groups(batches, 2):
            found = near_links(ids, fp.view(np.uint64), c, [np.frombuffer(x, dtype=np.uint64) for x in shingles], max_bits)
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def near_clusters(docs: DataFrame, shingle: int = 5, prints: int = PRINTS, max_bits: int = NEAR_BITS, wide: int = WIDE_BITS) -> DataFrame:
    """doc_id, component_id of every row with a doc_id: component_id is the least doc_id reachable by near copies (resemblance SIMILAR or more).

    Equal sets are one vertex.  Sets are left out if no other one of their group
    is within ``wide`` bits and may be near by size and sketch; sketches alone
    leave out no near pair, fingerprints more than ``wide`` bits apart may.
    Groups hang together by links that hold in both fingerprints (OTHER_BITS):
    by one alone, chance would join most of a table of some million texts to
    one group, whose blocks meet each other.
    First each candidate is verified against one
    parent, then each part of a group that hangs together against its largest
    part; then candidates of one group that no chain connects yet against each
    other, in blocks that hold the sets and send out only what connects them.
    """
    rows = stored(sketches(docs, shingle, prints), "sketches")
    nodes = stored(rows.groupBy("id").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("odd").alias("odd"), F.first("fps").alias("fps")), "nodes")
    key = ["k", "fp", "other"]
    one = nodes.select("id", "n", "fps", F.posexplode("fps").alias("k", "fp")).withColumn("other", F.col("fps")[(F.col("k") + 1) % prints]).drop("fps")
    fps = stored(one.groupBy(*key).agg(F.min("id").alias("first"), F.count("*").alias("ids")), "prints")
    found = stored(links(fps, max_bits, None, wide), "links")
    # A group is a chain of linked fingerprints of one k: it only names candidates, so that a clash of two vertices does no harm.
    chains = components(forest(found.select(F.xxhash64("k", "a", "other_a").alias("a"), F.xxhash64("k", "b", "other_b").alias("b"))))
    grouped = fps.withColumn("_v", F.xxhash64(*key)).join(chains, F.col("_v") == F.col("v"), "left").where(F.col("c").isNotNull() | (F.col("ids") > 1)).select(*key, F.coalesce("c", "_v").alias("grp"))
    members = stored(one.join(grouped, key).select("grp", "id", "n", "fp"), "members")
    # The more texts, the more fingerprints link by chance: sketches leave those out before any whole set is read.
    alive = stored(partnered(members, nodes, wide), "alive")
    members = stored(members.join(alive, "id", "left_semi").select("grp", "id", "n", "fp"), "members")
    # One parent for each set: the first set of a fingerprint that its own links to, or the first of its own.
    same = fps.where("ids > 1").select(*key, F.col("fp").alias("up"), F.col("other").alias("other_up"))
    up = found.select("k", F.col("b").alias("fp"), F.col("other_b").alias("other"), F.col("a").alias("up"), F.col("other_a").alias("other_up")).unionAll(same)
    firsts = fps.select("k", F.col("fp").alias("up"), F.col("other").alias("other_up"), "first")
    ties = up.join(firsts, ["k", "up", "other_up"]).groupBy(*key).agg(F.min("first").alias("a")).join(one, key).groupBy(F.col("id").alias("b")).agg(F.min("a").alias("a"))
    ties = ties.join(alive.select(F.col("id").alias("a")), "a", "left_semi").join(alive.select(F.col("id").alias("b")), "b", "left_semi")
    met = alive.join(nodes, "id").select(F.col("least").alias("doc_id")).distinct()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, shingle) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([set_id(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["id", "shingles"])

    # Sets are larger than texts: only texts that met another one are turned into sets again.
    sets = stored(texts_of(docs).join(stored(met, "met"), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(read, "id long, shingles binary").dropDuplicates(["id"]), "sets")
    size = nodes.select("id", "n")

    def near_pairs(pairs: DataFrame) -> DataFrame:
        pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = pairs.join(size.withColumnsRenamed({"id": "a", "n": "na"}), "a").join(size.withColumnsRenamed({"id": "b", "n": "nb"}), "b").where(sized("na", "nb")).select("a", "b")
        return verified(pairs, sets)

    first = stored(near_pairs(ties), "near")
    # Then one set of each part of a group against one of its largest part: dense groups grow together before pairs are looked at.
    more = stored(near_pairs(part_pairs(members, components(first))), "near")
    first = first.unionAll(more)
    rest = open_links(members, components(first), sets, wide)
    found = forest(first.unionAll(rest))
    # From sets to least doc_ids: a vertex is a document from here on, so that repeated ids join their links.
    name = nodes.select("id", "least")
    edges = found.join(name.withColumnsRenamed({"id": "a", "least": "x"}), "a").join(name.withColumnsRenamed({"id": "b", "least": "y"}), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    labels = components(edges)
    return rows.select("doc_id", "id").join(name, "id").join(labels, F.col("least") == F.col("v"), "left").select("doc_id", F.coalesce("c", "least").alias("component_id"))


def dedup(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """docs without near copies of rows with a smaller doc_id; of rows that repeat a doc_id one stays."""
    rows = stored(near_clusters(docs, shingle), "clusters")
    lost = rows.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_lost")).distinct()
    out = docs.join(lost, docs["doc_id"].cast("long") == lost["_lost"], "left_anti")
    repeated = rows.groupBy("doc_id").count().where("count > 1").limit(1).count()
    if not repeated:
        return out
    named = out.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"])
    return named.unionAll(out.where(F.col("doc_id").isNull()))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clusters(table(spark, sf_dir, "documents"), shingle=3, max_bits=2)
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
