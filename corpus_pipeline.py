"""A training corpus from ``documents`` in five stages.

Each stage takes (spark, docs, sf_dir), works on every row that the stage
before it kept, and returns a DataFrame that is written as Parquet and read
again as the next stage's docs.  All but the last return the columns of
``documents``:

1. toxicity: rows that score as toxic go;
2. near duplicates: of each group of near copies (five-word shingles, an
   exact resemblance of 0.8 or more) the row with the smallest doc_id stays;
3. substrings: words in windows of 50 words that a document with a smaller
   doc_id also has are cut out; rows left without a word go;
4. mixing: all rows stay, dealt and sorted in the order in which sources
   interleave at their target weights;
5. pieces: sampled piece ids of each text (piece_ids), their number and
   whether decoding gives the text back.

Null and empty texts score as texts without any entry, count as one group of
copies, and have no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import mixing, sentence_pieces, simhash, substring_dedup, toxicity
from lodestone.llm.common import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.filter_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.dedup(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.interleave(docs)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentence_pieces.encode(docs, add=("piece_ids", "n_pieces", "lossless"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("pieces", to_pieces),
]

#: A learned score, random numbers and hashes that SQL lacks: tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
