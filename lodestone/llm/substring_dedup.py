"""Substring deduplication with a log-structured fingerprint index.

A window is ``WINDOW`` consecutive words of one document.  Each window is
represented in the index by its least gram hash (a hash of ``GRAM``
consecutive words): equal windows have equal representatives, and neighbouring
windows mostly share theirs, so that the index holds some 5 % of all positions.

The index is a list of immutable runs (hash, doc_id, key), each sorted and
bucketed by hash.  A new batch becomes a run of its own; it is merge-joined
with every historical run bucket by bucket without moving those, and the
hashes that two documents share name the candidate documents.  ``fanout`` runs of
one level are compacted into one of the next.  An index with a path is lasting:
later calls go on with its history.  Candidates are then
verified: stretches of windows with one representative, and single windows
where stretches differ, are compared by 128-bit digests of all their words,
and each word covered by a window that also starts in a document with a smaller
doc_id goes.  Whole copies (equal word sequences of at least one window) are
found by a digest of the document before, so that a hot group of copies sends
one document on.

Words are runs of characters other than space and U+0009 to U+000D.  Null and
empty texts have no words and lose none; so do texts shorter than a window.
Rows with a null doc_id are kept whole and remove nothing.  Rows that repeat a
doc_id count as one document and do not remove each other's words.  Very long
texts are read whole.  Extra columns stay (``dedup``) or are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import hot_join, partitions, scratch, small_batches, stored, table
from lodestone.sources import sinks

WINDOW, GRAM = 50, 8
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads all bits over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Prefixes:
    """Polynomial hashes, modulo 2^64, of any range of a sequence from its prefix sums."""

    def __init__(self, h: np.ndarray, factor: int):
        n = len(h)
        power = np.full(n + 1, factor, dtype=np.uint64)
        inverse = np.full(n + 1, pow(factor, -1, 1 << 64), dtype=np.uint64)
        power[0] = inverse[0] = 1
        self.power, inverse = np.multiply.accumulate(power), np.multiply.accumulate(inverse)
        self.sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(h * inverse[:n], dtype=np.uint64)])

    def digest(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        length = (end - start).astype(np.uint64)
        return mix((self.sums[end] - self.sums[start]) * self.power[start] + length * _ODD)


def rolling(h: np.ndarray, width: int, factor: int) -> np.ndarray:
    """A hash of every width consecutive elements."""
    at = np.arange(len(h) - width + 1)
    return Prefixes(h, factor).digest(at, at + width)


def least(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every width consecutive elements."""
    step = 1
    while 2 * step <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[: len(x) - (width - step)], x[width - step :]) if width > step else x


def representatives(h: np.ndarray, window: int, gram: int) -> np.ndarray:
    """The least gram hash of every window."""
    if len(h) < window:
        return np.zeros(0, dtype=np.uint64)
    return least(rolling(h, gram, 0x9E3779B97F4A7C15), window - gram + 1)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, key, text; key tells rows apart that repeat a doc_id."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))


FACTS = "doc_id long, key long, n_words long, sha256 string, anchors array<long>"


def facts(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per row: words, digest of the word sequence, distinct window representatives."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n_words", pa.int64()), ("sha256", pa.string()), ("anchors", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of(text)
                found = [] if doc_id is None or len(words) < window else np.unique(representatives(word_hashes(words), window, gram)).view(np.int64)
                rows.append((doc_id, key, len(words), hashlib.sha256(b" ".join(words)).hexdigest(), found))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 5, schema, strict=True)], schema=schema)

    small_batches(docs.sparkSession)
    return keyed(docs).mapInArrow(run, FACTS)


class FingerprintIndex:
    """Sorted immutable runs of historical window hashes: columns h, doc_id, key.

    Without a path an index lives as long as its session uses it.  With one it
    is lasting: ``save`` writes a manifest of its runs, and of the facts and
    texts of the documents in them, beside them; opening the same path, in
    another session too, goes on from there.  A crash before ``save`` leaves
    the index as it was.
    """

    def __init__(self, spark: SparkSession, fanout: int = 2, buckets: int | None = None, path: str | None = None):
        self.spark, self.fanout, self.path = spark, fanout, path
        self.buckets = buckets or partitions(spark)
        self.runs: list[str] = []
        self.levels: dict[str, int] = {}
        self.places: dict[str, str] = {}
        self.documents: list[str] = []
        found = sinks.manifests(spark, path) if path else []
        if found:
            now = sinks.manifest(spark, path, found[-1])
            self.buckets, self.documents = now["buckets"], now["documents"]
            for name, place, level in now["runs"]:
                spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (h BIGINT, doc_id BIGINT, key BIGINT) USING parquet OPTIONS (path '{place}') CLUSTERED BY (h) SORTED BY (h) INTO {self.buckets} BUCKETS")
                self._known(name, place, level)

    def _known(self, name: str, place: str, level: int) -> None:
        self.runs.append(name)
        self.levels[name], self.places[name] = level, place

    def _write(self, rows: DataFrame) -> tuple[str, str]:
        name = f"run_{uuid.uuid4().hex}"
        place = f"{self.path}/{name}" if self.path else scratch(self.spark, name)
        (
            rows.repartition(self.buckets, "h").write.bucketBy(self.buckets, "h").sortBy("h")
            .option("path", place).saveAsTable(name)
        )
        return name, place

    def match(self, batch: DataFrame) -> DataFrame:
        """Add a batch (h, doc_id, key) as a run; return the rows, old and new, whose hash it shares with another document."""
        name, place = self._write(batch)
        new = self.spark.table(name)
        own = new.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
        olds = [self.spark.table(r) for r in self.runs]
        shared = own.where(F.col("lo") < F.col("hi")).select("h")
        for old in olds:  # a merge join per run, on its own buckets
            shared = shared.unionAll(own.join(old, "h", "left_semi").select("h"))
        shared = stored(shared.distinct(), "shared")
        rows = new.join(shared, "h", "left_semi")
        for old in olds:
            rows = rows.unionAll(old.join(shared, "h", "left_semi"))
        rows = stored(rows.select("h", "doc_id", "key"), "candidates")
        self._known(name, place, 0)
        return rows

    def compact(self) -> None:
        """Merge runs of one level into one of the next where there are fanout of them, so that a row is rewritten once a level."""
        while True:
            by_level: dict[int, list[str]] = {}
            for r in self.runs:
                by_level.setdefault(self.levels[r], []).append(r)
            full = sorted(level for level, runs in by_level.items() if len(runs) >= self.fanout)
            if not full:
                return
            old = by_level[full[0]]
            rows = self.spark.table(old[0])
            for r in old[1:]:
                rows = rows.unionAll(self.spark.table(r))
            name, place = self._write(rows.select("h", "doc_id", "key"))
            for r in old:
                self.spark.sql(f"DROP TABLE IF EXISTS {r}")
            self.runs = [r for r in self.runs if r not in old]
            self._known(name, place, full[0] + 1)

    def add_documents(self, rows: DataFrame) -> None:
        """Keep (doc_id, key, n_words, sha256, text) of what has been indexed, for later batches to be verified against."""
        place = f"{self.path}/documents-{uuid.uuid4().hex}"
        rows.write.parquet(place)
        self.documents.append(place)

    def history(self) -> DataFrame | None:
        schema = "doc_id long, key long, n_words long, sha256 string, text string"
        return self.spark.read.schema(schema).parquet(*self.documents) if self.documents else None

    def save(self) -> None:
        """Make what has been added part of the index."""
        found = sinks.manifests(self.spark, self.path)
        content = {"buckets": self.buckets, "documents": self.documents, "runs": [[r, self.places[r], self.levels[r]] for r in self.runs]}
        sinks._publish(self.spark, self.path, found[-1] + 1 if found else 0, content)

    def close(self) -> None:
        """Forget the runs; their files stay."""
        for r in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {r}")
        self.runs = []


def _id_bounds(rows: DataFrame, batches: int) -> list[int | None]:
    cuts = rows.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)]).alias("c")).first()["c"] if batches > 1 else None
    return [None, *sorted(set(cuts or [])), None]


def removals(docs: DataFrame, batches: int = 3, window: int = WINDOW, gram: int = GRAM, index_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Facts of every row, and the rows that lose words: doc_id, key, n_removed, kept_sha256, kept.

    With index_path docs are also held against the documents of the lasting
    index there, and then belong to it: calls with parts of a table give what
    one call with all of it gives, if each part's ids are greater than those
    before.
    """
    spark = docs.sparkSession
    all_facts = stored(facts(docs, window, gram), "facts")
    index = FingerprintIndex(spark, path=index_path)
    history = index.history()

    # Whole copies of a document with a smaller id lose every word; the smallest goes on.
    long_rows = all_facts.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= window))
    known = long_rows.select("doc_id", "sha256")
    if history is not None:
        known = known.unionAll(history.where(F.col("n_words") >= window).select("doc_id", "sha256"))
    first = known.groupBy("sha256").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where(F.col("first") < F.col("last")).select("sha256", "first")
    copies = stored(long_rows.select("doc_id", "key", "n_words", "sha256").join(first, "sha256").where(F.col("doc_id") > F.col("first")).select("doc_id", "key", F.col("n_words").alias("n_removed")).distinct(), "copies")
    alone = long_rows.select("doc_id", "key", "anchors").join(copies, ["doc_id", "key"], "left_anti")
    anchors = stored(alone.select(F.explode("anchors").alias("h"), "doc_id", "key"), "anchors")

    found = None
    bounds = _id_bounds(alone, batches)
    for low, high in zip(bounds, bounds[1:], strict=False):
        part = anchors
        part = part.where(F.col("doc_id") > low) if low is not None else part
        part = part.where(F.col("doc_id") <= high) if high is not None else part
        index.compact()
        hits = index.match(part)
        found = hits if found is None else found.unionAll(hits)
    wanted = found.groupBy("doc_id", "key").agg(F.collect_set("h").alias("hashes"))

    # Texts of candidate documents only go on.
    texts = keyed(docs) if history is None else keyed(docs).unionAll(history.select("doc_id", "key", "text")).dropDuplicates(["doc_id", "key"])
    cands = stored(texts.join(wanted, ["doc_id", "key"]).select("doc_id", "key", "text", "hashes"), "texts")
    if index_path:
        named = all_facts.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= window)).select("doc_id", "key", "n_words", "sha256").dropDuplicates(["doc_id", "key"])
        index.add_documents(named.join(keyed(docs).dropDuplicates(["doc_id", "key"]), ["doc_id", "key"]).select("doc_id", "key", "n_words", "sha256", "text"))
        index.save()
    index.close()

    # A stretch: neighbouring windows of a document with one representative.  Documents with equal stretches share
    # all windows in it, so that one document of each stretch stands for the others.
    row = [("doc_id", pa.int64()), ("key", pa.int64()), ("start", pa.int32())]
    stretch_schema = pa.schema([("h", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), *row, ("n", pa.int32())])
    window_schema = pa.schema([("d1", pa.int64()), ("d2", pa.int64()), *row])

    def digests(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[pa.Array]:
        both = (Prefixes(h, 0xD1342543DE82EF95), Prefixes(mix(h + _ODD), 0xAF251AF3B0F025B5))
        return [pa.array(p.digest(start, end).view(np.int64)) for p in both]

    def stretches(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            for doc_id, key, text, hashes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h = word_hashes(words_of(text))
                r = representatives(h, window, gram)
                start = np.concatenate([[0], np.nonzero(r[1:] != r[:-1])[0] + 1])
                end = np.append(start[1:], len(r))
                shared = np.isin(r[start], np.array(hashes, dtype=np.int64).view(np.uint64))
                start, end = start[shared], end[shared]
                n = len(start)
                yield pa.RecordBatch.from_arrays([pa.array(r[start].view(np.int64)), *digests(h, start, end + window - 1), pa.array(np.full(n, doc_id)), pa.array(np.full(n, key)), pa.array(start.astype(np.int32)), pa.array((end - start).astype(np.int32))], schema=stretch_schema)

    def windows(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            for doc_id, key, text, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h = word_hashes(words_of(text))
                at = np.concatenate([np.arange(p["start"], p["start"] + p["n"]) for p in parts])
                n = len(at)
                yield pa.RecordBatch.from_arrays([*digests(h, at, at + window), pa.array(np.full(n, doc_id)), pa.array(np.full(n, key)), pa.array(at.astype(np.int32))], schema=window_schema)

    found = stored(cands.mapInArrow(stretches, "h long, d1 long, d2 long, doc_id long, key long, start int, n int"), "stretches")
    kinds = stored(found.groupBy("h", "d1", "d2").agg(F.min("doc_id").alias("first"), F.count("*").alias("many")), "kinds")
    found = hot_join(found, kinds, ["h", "d1", "d2"], "many", found.count())
    sure = found.where(F.col("doc_id") > F.col("first")).select("doc_id", "key", "start", "n")
    # Windows one by one only where stretches differ that may overlap.
    several = kinds.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1").select("h")
    own = found.where(F.col("doc_id") == F.col("first")).join(several, "h", "left_semi").groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "n")).alias("parts"))
    seen = stored(cands.select("doc_id", "key", "text").join(own, ["doc_id", "key"]).mapInArrow(windows, "d1 long, d2 long, doc_id long, key long, start int"), "windows")
    firsts = seen.groupBy("d1", "d2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("many")).where(F.col("first") < F.col("last"))
    firsts = stored(firsts.select("d1", "d2", "first", "many"), "firsts")
    again = hot_join(seen, firsts, ["d1", "d2"], "many", seen.count()).where(F.col("doc_id") > F.col("first")).select("doc_id", "key", "start", F.lit(1).alias("n"))
    starts = sure.unionAll(again).groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "n")).alias("parts"))

    out_schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])

    def rewrite(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            rows = []
            for doc_id, key, text, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of(text)
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                for p in parts:
                    edge[p["start"]] += 1
                    edge[p["start"] + p["n"] + window - 1] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
                rows.append((doc_id, key, int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass")))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out_schema, strict=True)], schema=out_schema)

    changed = cands.select("doc_id", "key", "text").join(starts, ["doc_id", "key"]).mapInArrow(rewrite, "doc_id long, key long, n_removed long, kept_sha256 string, kept string").dropDuplicates(["doc_id", "key"])
    empty = hashlib.sha256(b"").hexdigest()
    lost = copies.select("doc_id", "key", "n_removed", F.lit(empty).alias("kept_sha256"), F.lit("").alias("kept")).unionAll(changed)
    if history is not None:
        lost = lost.join(all_facts.select("doc_id", "key").distinct(), ["doc_id", "key"], "left_semi")
    return all_facts, stored(lost, "removals")


def dedup(docs: DataFrame, batches: int = 3, drop_emptied: bool = True) -> DataFrame:
    """docs with the kept words as text; untouched rows keep their text as it is.

    Rows that lose every word go unless drop_emptied is false.  A column
    n_chars follows the text.
    """
    _, lost = removals(docs, batches)
    lost = lost.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), F.col("kept").alias("_kept"))
    key = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    kept, key = lost["_kept"], F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    out = docs.join(lost, (docs["doc_id"].cast("long") == lost["_id"]) & (key == lost["_key"]), "left")
    if drop_emptied:
        out = out.where(kept.isNull() | (kept != ""))
    new = {"text": F.coalesce(kept, docs["text"])}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(kept.isNotNull(), F.length(kept)).otherwise(docs["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return out.select(*[new[c].alias(c) if c in new else docs[c] for c in docs.columns])


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, lost = removals(table(spark, sf_dir, "documents"))
    lost = lost.drop("kept")
    return rows.select("doc_id", "key", "n_words", "sha256").join(lost, ["doc_id", "key"], "left").select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept_sha256", "sha256").alias("kept_sha256"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50
), h AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM s
), m AS (
  SELECT h, min(doc_id) AS first_id FROM h GROUP BY h
), r AS (
  SELECT DISTINCT h.doc_id, h.i + k.k AS i FROM h JOIN m USING (h) CROSS JOIN (SELECT unnest(range(0, 50)) AS k) k WHERE m.first_id < h.doc_id
), g AS (
  SELECT doc_id, list(i) AS gone FROM r GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(len(g.gone), 0) AS n_removed,
  sha256(array_to_string(CASE WHEN g.gone IS NULL THEN d.w ELSE list_transform(list_filter(list_zip(d.w, range(1, len(d.w) + 1)), lambda x: NOT list_contains(g.gone, x[2])), lambda x: x[1]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""
