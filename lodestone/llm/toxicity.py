"""Toxicity: a weighted lexicon matched by Aho-Corasick.

Texts are folded first: lower case, homoglyphs (Cyrillic, Greek, full-width)
to Latin letters, digit and sign substitutions (``1d10t``, ``$cum``) in words
that hold a letter to the letters that they stand for (but ``!`` and ``|`` after
the last letter are punctuation), everything else that is no letter to one
space.
Lexicon entries are whole words or word beginnings; at each word the strongest
entry counts, entries inside an exception phrase do not count; exceptions are
fixed phrases and word pairs that labelled rows show to be harmless.  The summed
weight, its share of the text's length, the strongest entry and their logs go
into a logistic score.

Weights and the logistic score are learned from a bounded sample of labelled
rows (``max_labels``, chosen by a hash of the id): document frequencies by
label in one part of them give the entries' log-odds (an entry needs support and
weight; their number follows from the sample's bound), the other part fits the
score.  Scoring covers every row and whole texts in one narrow pass.

Null and empty texts have no entries and get the score of a text without any.
With no labelled rows, or only one label among them, every row gets the share
of label 1 among the sampled rows (0 if there are none).  Labels that are null
are skipped; of repeated labels of one id the largest counts, of its repeated
texts the greatest.  Repeated rows
give repeated results; extra columns stay or are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lodestone.llm.common import small_batches, table, unused

#: Labelled rows that are read at most; the bound on what is joined by broadcast.
MAX_LABELS = 20_000
MIN_STEM, MAX_STEM = 4, 8
#: A word pair with an entry is an exception if so many rows of label 0 and none of label 1 have it.
SAFE_DOCS = 4

# Letters that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "ո": "n", "ѵ": "v", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i",
}
# Digits and signs written for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i"}
# Phrases in which an entry is meant otherwise.
EXCEPTIONS = (
    "trash can", "trash bin", "trash collection", "take out the trash", "white trash can", "clown fish", "class clown",
    "circus clown", "the idiot by dostoevsky", "sore loser rule", "pond scum", "soap scum",
)

_FULL = {chr(0xFF41 + i): chr(97 + i) for i in range(26)} | {chr(0xFF10 + i): chr(48 + i) for i in range(10)}
_ODD = str.maketrans(HOMOGLYPHS | _FULL)
#: Letters stay, everything else becomes a space; and the same with substitutes read as letters.
_PLAIN = bytes(c if 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_AS_LETTERS = bytes(ord(SUBSTITUTES[chr(c)]) if chr(c) in SUBSTITUTES else x for c, x in enumerate(_PLAIN))
_SIGNS = "".join(SUBSTITUTES).encode()
_RUN = re.compile(rb"[a-z\x80-\xff" + re.escape(_SIGNS) + rb"]*[" + re.escape(_SIGNS) + rb"][a-z\x80-\xff" + re.escape(_SIGNS) + rb"]*")
_LETTER = re.compile(rb"[a-z\x80-\xff]")
#: Lead bytes of the letters above: IPA, Greek, Cyrillic, Armenian, dotless i, full width; and general punctuation.
_ODD_LEADS = [bytes([x]) for x in (0xC4, 0xC9, 0xCA, 0xCD, 0xCE, 0xCF, 0xD0, 0xD1, 0xD2, 0xD3, 0xD4, 0xD5, 0xD6, 0xEF)]
_MARKS = str.maketrans(dict.fromkeys("\u2010\u2011\u2012\u2013\u2014\u2018\u2019\u201c\u201d\u2026\u00a0\u00ab\u00bb", " ") | dict.fromkeys("\u200b\u200c\u200d\u2060\u00ad", ""))
_MARK_LEADS = (b"\xe2\x80", b"\xe2\x81", b"\xc2")


def _substituted(m: re.Match) -> bytes:
    """A run of letters and substitutes: no word without a letter; ! and | after the last letter are punctuation."""
    run = m[0]
    return run.rstrip(b"!|").translate(_AS_LETTERS) + b" " if _LETTER.search(run) else b" "


def fold(text: str | None) -> str:
    """The folded words, each after one space, and a last space; one char per UTF-8 byte."""
    low = (text or "").lower()
    raw = low.encode("utf-8", "surrogatepass")
    if not low.isascii():
        if any(x in raw for x in _ODD_LEADS):
            low = low.translate(_ODD)
            raw = low.encode("utf-8", "surrogatepass")
        if any(x in raw for x in _MARK_LEADS):
            raw = low.translate(_MARKS).encode("utf-8", "surrogatepass")
    return (b" " + b" ".join(_RUN.sub(_substituted, raw).translate(_PLAIN).split()) + b" ").decode("latin-1")


def word_features(word: str) -> list[str]:
    """The whole word, and its beginnings of MIN_STEM to MAX_STEM characters, that can be entries."""
    if word.isascii():
        return [f" {word} ", *(f" {word[:n]}" for n in range(MIN_STEM, min(MAX_STEM, len(word)) + 1))]
    chars = word.encode("latin-1").decode("utf-8", "replace")
    return [f" {word} ", *(" " + chars[:n].encode("utf-8").decode("latin-1") for n in range(MIN_STEM, min(MAX_STEM, len(chars)) + 1))]


def outside(places: list[int], spans: list[tuple[int, int]]) -> set[int]:
    """The places that lie in none of the spans; one walk over both."""
    spans, out, at, reach = sorted(spans), set(), 0, -1
    for x in sorted(places):
        while at < len(spans) and spans[at][0] <= x:
            reach, at = max(reach, spans[at][1]), at + 1
        if x >= reach:
            out.add(x)
    return out


@dataclass
class Model:
    """entries: weight of each folded pattern; coef: logistic score's terms, the constant first."""

    entries: dict[str, float] = field(default_factory=dict)
    coef: list[float] = field(default_factory=list)
    prior: float = 0.0
    exceptions: tuple[str, ...] = EXCEPTIONS
    #: Word pairs with an entry that labelled rows show to be harmless.
    learned: tuple[str, ...] = ()

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for pattern, weight in self.entries.items():
            found.add_word(pattern, (len(pattern), weight))
        for phrase in (*self.exceptions, *self.learned):
            if fold(phrase) not in self.entries:
                found.add_word(fold(phrase), (len(fold(phrase)), None))
        if len(found):
            found.make_automaton()
        return found

    def features(self, automaton, text: str | None) -> list[float]:
        line = fold(text)
        best: dict[int, float] = {}
        spans = []
        for end, (n, weight) in automaton.iter(line) if len(automaton) else ():
            start = end - n + 1
            if weight is None:
                spans.append((start, end))
            elif weight > best.get(start, 0.0):
                best[start] = weight
        hits = [best[at] for at in sorted(outside(list(best), spans))]
        words = line.count(" ") - 1
        total = sum(hits)
        return [1.0, math.log1p(total), max(hits, default=0.0), 10.0 * total / (words + 20.0)]

    def scores(self, texts: list[str | None], automaton) -> np.ndarray:
        if not self.coef:
            return np.full(len(texts), self.prior)
        x = np.array([self.features(automaton, t) for t in texts], dtype=np.float64).reshape(len(texts), -1)
        return 1.0 / (1.0 + np.exp(-np.clip(x @ np.array(self.coef), -30, 30)))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_labels: int) -> DataFrame:
    """At most max_labels labelled rows outside the held-out fold with their texts."""
    one = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_y"))
    picked = one.where(~held_out(F.col("_id"))).orderBy(F.xxhash64("_id"), "_id").limit(max_labels)
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    # An id that repeats is one row, the greatest text: the bound holds for rows too.
    texts = texts.join(F.broadcast(picked), "_id").groupBy("_id", "_y").agg(F.max("_text").alias("_text"))
    return texts.select("_id", "_text", "_y", (F.crc32(F.col("_id").cast("string").cast("binary")) % 5 == 4).alias("_fit"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labels: int = MAX_LABELS, min_docs: int = 3, exceptions: tuple[str, ...] = EXCEPTIONS) -> Model:
    """Learn the lexicon from document frequencies, then fit the score on other rows."""
    rows = labelled(docs, labels, id_col, text_col, label_col, max_labels).cache()
    try:
        totals = {bool(r["_y"]): r["n"] for r in rows.where(~F.col("_fit")).groupBy("_y").agg(F.count("*").alias("n")).collect()}
        share = rows.agg(F.avg("_y").alias("p")).first()["p"]
        model = Model(prior=float(share or 0.0), exceptions=exceptions)
        n1, n0 = totals.get(True, 0), totals.get(False, 0)
        if not n1 or not n0:
            return model

        def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pos: Counter[str] = Counter()
            neg: Counter[str] = Counter()
            for batch in batches:
                for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    (pos if y else neg).update({f for w in set(fold(text).split()) for f in word_features(w)})
            keys = list(pos.keys() | neg.keys())
            for i in range(0, len(keys), 20_000):
                part = keys[i : i + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([pos[k] for k in part], pa.int64()), pa.array([neg[k] for k in part], pa.int64())], names=["entry", "pos", "neg"])

        small_batches(docs.sparkSession)
        weight = F.log((F.col("pos") + 0.1) / (n1 + 0.2)) - F.log((F.col("neg") + 0.1) / (n0 + 0.2))
        found = (
            rows.where(~F.col("_fit")).select("_text", "_y").mapInArrow(counts, "entry string, pos long, neg long")
            .groupBy("entry").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
            .where((F.col("pos") >= min_docs) & (F.col("neg") * n1 * 20 <= F.col("pos") * n0))
            .select("entry", weight.alias("w")).collect()
        )
        model.entries = {r["entry"]: float(r["w"]) for r in found}
        model.learned = safe_pairs(rows.where(~F.col("_fit")).select("_text", "_y"), model)

        def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = model.automaton()
            for batch in batches:
                x = [model.features(automaton, t) for t in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

        fit = rows.where("_fit").select("_text", "_y").mapInArrow(features, "x array<double>, y int").collect()
        y = np.array([r["y"] for r in fit], dtype=np.float64)
        if len(fit) and 0 < y.mean() < 1:
            model.coef = fit_logistic(np.array([r["x"] for r in fit]), y)
        return model
    finally:
        rows.unpersist()


def safe_pairs(rows: DataFrame, model: Model) -> tuple[str, ...]:
    """Pairs of an entry's word and the word before or after it that SAFE_DOCS rows of label 0 have and none of label 1."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Model(entries=model.entries, exceptions=()).automaton()
        for batch in batches:
            out = []
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                line, seen = fold(text), set()
                for end, (n, _) in automaton.iter(line) if len(automaton) else ():
                    at = end - n + 1
                    last = line.index(" ", at + 1)
                    before, after = line.rfind(" ", 0, at), line.find(" ", last + 1)
                    seen |= {line[before:last + 1]} if before >= 0 else set()
                    seen |= {line[at:after + 1]} if after >= 0 else set()
                out += [(x, int(not y), int(bool(y))) for x in seen]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[], [], []], (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["pair", "neg", "pos"])

    found = rows.mapInArrow(pairs, "pair string, neg long, pos long").groupBy("pair").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos")).where((F.col("neg") >= SAFE_DOCS) & (F.col("pos") == 0))
    return tuple(sorted(r["pair"].encode("latin-1").decode("utf-8", "replace") for r in found.select("pair").collect()))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02, steps: int = 40) -> list[float]:
    """Newton's method with a small ridge, which keeps separable data finite."""
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1)) * len(y) / 100
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "toxicity") -> DataFrame:
    """docs with its score as a further column, in place of one of that name: one narrow pass."""
    docs = docs.drop(out_col)
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    schema = StructType([*docs.schema.fields, StructField(out_col, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for batch in batches:
            scores = model.scores(batch.column(at).to_pylist(), automaton)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, out_col])

    return docs.mapInArrow(run, schema)


def filter_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score below the threshold, with their own columns."""
    name = unused(docs.columns, "toxicity")
    return score(docs, train(docs, labels), out_col=name).where(F.col(name) < threshold).drop(name)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(docs, labels), out_col="score")
    return rows.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
