"""License scan, toxicity, SentencePiece and mixing against plain Python and awkward rows."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import license_scan, mixing, sentence_pieces, toxicity
from tests.llm.helpers import awkward_docs, clashing


def test_license_scan_places_and_labels(spark):
    rows = [
        (1, "Licensed under CC BY-NC 4.0."), (2, "the GNU General Public License, general PUBLIC license"), (3, None), (4, ""),
        (5, "Copyright (c) 2020 Jane Roe and others. All rights reserved."), (6, "cc by cc by cc"), (7, "generalpublic license"),
        (8, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files to deal in the Software without restriction"),
        (9, "CCé by é cc-by"), (9, "all rights all rights reserved"),
    ]
    found = [r.asDict() for r in license_scan.scan(clashing(spark.createDataFrame(rows, "doc_id long, text string"))).orderBy("doc_id", "n_words").collect()]
    for (doc_id, text), r in zip(sorted(rows, key=lambda x: (x[0], len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", x[1] or "")))), found, strict=True):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        places = sorted(i for p in license_scan.BASE_PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        assert (r["n_words"], r["n_base"]) == (len(w), len(places))
        assert (r["first_word"], r["last_word"]) == ((places[0], places[-1]) if places else (None, None))
    labels = {(r["doc_id"], r["n_words"]): r["labels"] for r in found}
    assert "cc-by,cc-by-nc-4.0" in labels.values() and "copyright-notice,reserved" in labels.values() and "mit-text" in labels.values()
    assert {r["score"] for r in found} == {0.0, 0.5, 1.0}


def test_license_texts_of_each_kind():
    """Every template's wording, its replaceable parts filled and its optional ones left out, is found as itself; clauses are told apart; long texts in linear time."""
    import time

    marked = tuple(sorted(license_scan.TEMPLATES.items()))
    labels = lambda t: set(license_scan.scan_text(t, license_scan.BASE_PHRASES, marked)[5].split(","))
    for label, markup in license_scan.TEMPLATES.items():
        text = re.sub(r"<<var[^>]*>>", "Jane", re.sub(r"<<beginOptional>>.*?<<endOptional>>", " ", markup))
        assert label in labels(f"x y {text} z")
        assert label not in labels(" ".join(text.split()[:-1] + ["other"]))
        assert re.search(license_scan.sql_pattern(markup), " " + " ".join(w.decode() for w in license_scan.words_of(text)) + " ")
    three = re.sub(r"<<var[^>]*>>", "3.", license_scan.TEMPLATES["bsd-3-clause"])
    assert "bsd-3-clause" in labels(three) and not {"bsd-2-clause", "bsd-4-clause"} & labels(three)
    began = time.time()
    found = license_scan.scan_text("cc by " * 1_600_000, license_scan.BASE_PHRASES, marked)
    assert found[1:4] == (1_600_000, 0, 3_199_998) and time.time() - began < 60


def test_template_markup():
    a = license_scan.TemplateAutomaton('use <<beginOptional>> of this <<endOptional>> software by <<var;name="who";max=2>> is free')
    ok = ["use software by is free", "use of this software by A B is free", "x use software by a is free y"]
    bad = ["use of software by a is free", "use software by a b c is free", "use software is free"]
    assert [a.found_in(license_scan.words_of(t)) for t in ok + bad] == [True] * 3 + [False] * 3


def test_license_scan_empty_table(spark):
    assert license_scan.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_fold():
    assert toxicity.fold("An 1D10T, іdiot! $cum ｉｄｉｏｔ") == " an idiot idiot scum idiot "
    assert toxicity.fold("ass! a$$, !diot|| 1984 covid19 (5!)") == " ass ass idiot covidi9 ".replace("i9", "i")
    assert toxicity.fold(None).strip() == toxicity.fold(" ..").strip() == ""


def test_toxicity_learns_and_excepts(spark):
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        rows.append((i, f"word{i % 7} calm text of number {'you stupiddo' + 'abcdefgh'[i % 8] if bad else 'kind'} more words here", "l", "s", 1))
        labels.append((i, 1, int(bad)))
    rows += [(1000, None, None, None, None), (1001, "", "", "", 0), (1002, "a " * 50_000 + "5tupidd0x", "l", "s", 1), (1002, "a", "l", "s", 1)]
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame([*labels, (1, None, None), (None, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, lab)
    scored = {(r.doc_id, len(r.text or "")): r.s for r in toxicity.score(docs, model, out_col="s").collect()}
    assert len(scored) == 604 and all(0 <= s <= 1 for s in scored.values())
    assert all((s >= 0.5) == (i % 4 == 0) for (i, _), s in scored.items() if i < 600)
    assert scored[1000, 0] < 0.5 and scored[1001, 0] < 0.5 and scored[1002, 100_009] >= 0.5
    model.exceptions = ("stupiddoa game",)
    assert model.scores(["a stupiddoa game"], model.automaton())[0] < 0.5 <= model.scores(["a stupiddoa name"], model.automaton())[0]
    kept = toxicity.filter_toxic(clashing(docs), lab)
    assert kept.columns == clashing(docs).columns and kept.where("doc_id < 600").count() == 450


def test_features_equal_naive_matching():
    """Entries, beginnings and exceptions by Aho-Corasick against a loop over words; long texts of exceptions in linear time."""
    import math
    import random
    import time

    rng = random.Random(3)
    stems = ["bad", "badd", "trash", "idio", "scum", "ärg"]
    entries = {f" {toxicity.fold(w).strip()} ": 1.0 + i for i, w in enumerate(stems)} | {" " + toxicity.fold("idio").strip(): 2.5, " badd": 0.5}
    model = toxicity.Model(entries=entries, exceptions=("trash can", "bad idea", "very bad idea indeed"))
    automaton = model.automaton()
    pool = ["bad", "baddest", "trash", "can", "idiot", "1d10t", "idea", "very", "indeed", "scum!", "calm", "ärg", "b@d", "x"]
    for _ in range(300):
        text = " ".join(rng.choices(pool, k=rng.randrange(0, 30)))
        words = toxicity.fold(text).split()
        hits = []
        for i, w in enumerate(words):
            best = max([v for e, v in entries.items() if (w == e.strip() if e.endswith(" ") else w.startswith(e.strip()))], default=0.0)
            covered = any(words[s : s + len(p.split())] == p.split() and s <= i < s + len(p.split()) for p in model.exceptions for s in range(len(words)))
            if best and not covered:
                hits.append(best)
        want = [1.0, math.log1p(sum(hits)), max(hits, default=0.0), 10.0 * sum(hits) / (len(words) + 20.0)]
        assert np.allclose(model.features(automaton, text), want), text
    began = time.time()
    model.features(automaton, "trash can " * 1_000_000)
    assert time.time() - began < 20


def test_safe_pairs_are_learned(spark):
    """A word that is toxic alone and harmless in one pair."""
    rows = [(i, f"filler {i} " + ("you vilest thing" if i % 4 == 0 else "the vilest cheese of town" if i % 40 == 1 else "quite calm"), "l", "s", 1) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    model = toxicity.train(docs, spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(2000)], "doc_id long, quality int, toxic int"))
    assert any("cheese" in p for p in model.learned)
    s = model.scores(["you vilest thing", "the vilest cheese of town"], model.automaton())
    assert s[1] < 0.5 <= s[0]


def test_toxicity_without_labels(spark):
    docs = awkward_docs(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.s for r in toxicity.score(docs, toxicity.train(docs, none), out_col="s").collect()} == {0.0}
    assert toxicity.filter_toxic(docs.limit(0), none).count() == 0


def test_pieces_are_lossless_and_reproducible(spark):
    docs = clashing(awkward_docs(spark))
    first = sentence_pieces.decode(sentence_pieces.encode(docs))
    assert first.where(F.col("decoded") != F.coalesce("text", F.lit(""))).count() == 0
    again = sentence_pieces.encode(docs.repartition(3))
    key = lambda df: Counter((r.doc_id, r.text, tuple(r.piece_ids)) for r in df.select("doc_id", "text", "piece_ids").collect())
    assert key(first) == key(again)
    assert key(sentence_pieces.encode(docs, seed=2)) != key(first)
    assert sentence_pieces.encode(docs.limit(0)).count() == 0
    facts = sentence_pieces.encode(docs, add=("n_pieces", "piece_ids", "lossless", "ids_sha256")).collect()
    assert all(r.lossless and r.n_pieces == len(r.piece_ids) and r.ids_sha256 == hashlib.sha256(np.array(r.piece_ids, dtype="<i4").tobytes()).hexdigest() for r in facts)


def test_pieces_follow_the_lattice():
    """Sampled segmentations of a word come as often as all its segmentations' weights say."""
    v = sentence_pieces.Vocabulary.load()
    s = sentence_pieces.Sampler(v, 0.7, 3)
    word, weights = " hello", {}

    def walk(at: int, ids: tuple[int, ...], log: float) -> None:
        if at == len(word):
            weights[ids] = np.exp(log)
        for end in range(at + 1, len(word) + 1):
            i = v.pieces.get(word[at:end])
            if i is not None:
                walk(end, (*ids, i), log + 0.7 * v.weights[i])

    walk(0, (), 0.0)
    n = 20_000
    got = Counter(tuple(x.tolist()) for x in s.encode(["hello"] * n, [str(i) for i in range(n)]))
    total = sum(weights.values())
    assert set(got) <= set(weights)
    for ids, w in weights.items():
        p = w / total
        assert abs(got[ids] / n - p) < 5 * np.sqrt(p * (1 - p) / n) + 1e-4


def test_long_chunks_follow_the_lattice(monkeypatch):
    """Cuts lie where no piece does; chunks in stretches and segments are sampled as whole ones are; long texts without spaces in linear time."""
    import random
    import time

    v = sentence_pieces.Vocabulary.load()
    s = sentence_pieces.Sampler(v, 0.7, 3)
    rng = random.Random(5)
    base64_like = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", k=n))
    texts = ["aaaa" * 700, base64_like(3000), "donaudampfschifffahrt" * 150, "日本語😀の文" * 400, "x" * 257, "the end " * 50 + base64_like(900) + " z"]
    for chunk in (" " + texts[1], " " + texts[2][:700]):
        lies = {p for a in range(len(chunk)) for b in range(a + 2, min(len(chunk), a + s.longest) + 1) if chunk[a:b] in v.pieces for p in range(a + 1, b)}
        assert s._cuts(chunk) == [p for p in range(1, len(chunk)) if p not in lies]
    keys = [str(i) for i in range(len(texts))]
    want = [x.tolist() for x in s.encode(texts, keys)]
    assert all(s.decode(x) == t for x, t in zip(want, texts, strict=True))
    monkeypatch.setattr(sentence_pieces, "LONG", 10**9)  # every chunk whole, side by side
    assert [x.tolist() for x in s.encode(texts, keys)] == want
    monkeypatch.setattr(sentence_pieces, "LONG", 40)
    monkeypatch.setattr(sentence_pieces, "STRETCH", 96)
    monkeypatch.setattr(sentence_pieces, "SEGMENT", 16)
    monkeypatch.setattr(sentence_pieces, "PASS_CHARS", 500)
    same = sum(x.tolist() == w for x, w in zip(s.encode(texts, keys), want, strict=True))
    assert same >= len(texts) - 1  # a chance may fall between two roundings
    monkeypatch.undo()
    began = time.time()
    for text in (base64_like(500_000), "a" * 500_000):
        assert s.decode(s.encode([text], ["k"])[0].tolist()) == text
    assert time.time() - began < 60


def test_mixing_stays_within_a_block(spark):
    """Exact weights, thirds and small ones among them: over 10,000 slots no source is a block off, and every block keeps its bounds."""
    from fractions import Fraction

    for weights in ({"a": 0.5, "b": 0.3, "c": 0.2}, {"a": Fraction(1, 3), "b": Fraction(1, 3), "c": Fraction(1, 3)}, {"a": 0.0005, "b": 0.3332, "c": 2 / 3, "d": 0.01}, {n: 1 / (i + 1) for i, n in enumerate("abcdefgh")}):
        w = mixing.fractions(weights)
        order = sorted(mixing.edf({n: int(10_000 * x) + 1 for n, x in w.items()}, w), key=lambda r: r[4])
        done = Counter()
        for t, (name, j, free, due, slot) in enumerate(order[:9_990]):
            assert slot == t and j == done[name] and free <= slot < due
            done[name] += 1
            assert all(abs(done[n] - x * (t + 1)) < 1 for n, x in w.items())
    rows = spark.createDataFrame([(i, "x" * 100, "en", "abc"[i % 3], 100) for i in range(900)], "doc_id long, text string, lang string, source string, n_chars long")
    got = mixing.schedule(clashing(rows), {"a": 0.5, "b": 0.3, "c": 0.2}, block_size=500).select("source", "mix_block", "mix_slot", "mix_release", "mix_deadline", "doc_id").collect()
    assert len(got) == 900 and all(r.mix_release <= r.mix_slot < r.mix_deadline for r in got)
    slots = {}
    for r in got:
        assert slots.setdefault(r.mix_slot, (r.source, r.mix_block)) == (r.source, r.mix_block)
    assert all(n == 5 for n in Counter((r.source, r.mix_block) for r in got).values())
    few = mixing.schedule(rows, {"a": 1.0}, block_size=1, max_slots=90).select("source", "mix_block").distinct().count()
    assert few == 90


def test_mixing_awkward_rows(spark):
    docs = awkward_docs(spark)
    out = mixing.interleave(clashing(docs))
    assert set(out.columns) == set(clashing(docs).columns) - {"mix_slot"}
    same = lambda df: Counter((r.doc_id, r.text, r.source) for r in df.select("doc_id", "text", "source").collect())
    assert same(out) == same(docs)
    assert mixing.schedule(docs.limit(0)).count() == 0
