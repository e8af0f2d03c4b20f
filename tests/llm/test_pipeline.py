"""The corpus pipeline, stage by stage, on planted cases."""

from __future__ import annotations

import random

import corpus_pipeline
from lodestone.llm import sentence_pieces
from tests.llm.helpers import awkward_docs, words
from tests.llm.test_duplicates import brute_removals


def test_stages_on_planted_cases(spark, tmp_path):
    rng, passage = random.Random(3), words(900, 80)
    rows, labels = [], []
    for i in range(240):
        text, toxic = words(i, 120), int(i % 6 == 0)
        if toxic:
            w = text.split()
            w[rng.randrange(100)] = "vilest"
            text = " ".join(w)
        rows.append((i, text, "en", "hot" if i % 3 else f"s{i % 5}", len(text)))
        labels.append((i, 1, toxic))
    near = rows[1][1].split()
    near[60] = "edited"
    rows += [(500, rows[1][1], "en", "a", 1), (501, " ".join(near), "en", "a", 1), (502, words(700, 90) + " " + passage, "en", "a", 1), (503, words(701, 90) + " " + passage + " " + words(702, 30), "en", "b", 1)]
    docs = spark.createDataFrame(rows, awkward_docs(spark).schema)
    base = str(tmp_path)
    docs.write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    out = corpus_pipeline.run(spark, base)
    got = {r.doc_id: r for r in out.collect()}
    assert set(got) == {i for i in range(240) if i % 6} | {502, 503}
    kept = {i: t for i, t, *_ in rows if i in got}
    want = {i: n for i, _, n in brute_removals(list(kept.items()))}
    assert all(len(got[i].text.split()) == len(t.split()) - want[i] for i, t in kept.items()) and want[503] == 80
    assert all(r.lossless and r.n_pieces == len(r.piece_ids) for r in got.values())
    sampler = sentence_pieces.Sampler(sentence_pieces.Vocabulary.load(), 1.0, 1)
    assert all(sampler.decode(r.piece_ids) == r.text for r in got.values())


def test_stages_keep_columns_and_take_awkward_rows(spark, tmp_path):
    docs = awkward_docs(spark)
    spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for start in (docs, docs.limit(0)):
        rows = start
        for name, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, str(tmp_path))
            path = f"{tmp_path}/{name}-{start is docs}"
            rows.write.parquet(path)
            rows = spark.read.parquet(path)
            assert name == "pieces" or rows.columns == docs.columns
        assert (rows.count() > 0) == (start is docs)
