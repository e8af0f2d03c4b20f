"""Small tables with the awkward cases that every operator must take."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 8))) for _ in range(n))


def awkward_docs(spark):
    """Nulls in every column, empty and blank texts, one very long text, copies, repeated rows, a hot source, odd characters."""
    long_text, passage = words(1, 30_000), words(2, 60)
    rows = [(i, words(100 + i, 80), "en", "hot") for i in range(20, 40)]
    rows += [
        (1, passage + " " + words(3, 40), "en", "a"), (2, words(4, 30) + "\n" + passage, None, "b"), (3, long_text, "en", "a"), (4, long_text, "en", "c"),
        (5, None, "en", "a"), (6, "", "en", None), (7, " \t\n ", "de", "b"), (8, "one", "en", "a"), (None, passage, "en", "a"), (9, passage, "en", "hot"),
        (10, "x y ▁ 日本 😀\r\nz\u0000w", "ja", "c"), (10, "x y ▁ 日本 😀\r\nz\u0000w", "ja", "c"), (11, passage, "en", "a"), (11, words(5, 70), "en", "b"),
    ]
    return spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in rows], DOCS)


def clashing(docs):
    """docs with extra columns whose names operators might use themselves."""
    from pyspark.sql import functions as F

    names = ("key", "start", "score", "toxicity", "_toxicity", "mix_slot", "piece_ids", "decoded", "_kept", "_id", "_lost", "c", "v", "h", "fp", "n", "labels", "first")
    return docs.select("*", *[F.lit("x").alias(n) for n in names])
