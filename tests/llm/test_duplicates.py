"""Substring dedup, SimHash and components against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import graph, simhash, substring_dedup
from tests.llm.helpers import awkward_docs, clashing, words


def brute_removals(rows, window=50):
    """(doc_id, kept sha256, removed) of each row by comparing all windows."""
    split = [(i, (t or "").encode().split()) for i, t in rows]
    first: dict[tuple, int] = {}
    for i, w in split:
        for s in range(len(w) - window + 1) if i is not None else ():
            key = tuple(w[s : s + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = set()
        for s in range(len(w) - window + 1) if i is not None else ():
            if first[tuple(w[s : s + window])] < i:
                gone |= set(range(s, s + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i if i is not None else -1, hashlib.sha256(kept).hexdigest(), len(gone)))
    return sorted(out)


def overlapping(spark):
    """Passages of many lengths that overlap each other in many ways."""
    rng, base = random.Random(9), words(77, 400).split()
    rows = []
    for i in range(60):
        a = rng.randrange(0, 300)
        part = base[a : a + rng.choice([20, 49, 50, 51, 75, 120])]
        if rng.random() < 0.4 and len(part) > 10:
            part[rng.randrange(len(part))] = "changed"
        rows.append((rng.randrange(0, 1000) * 2 + 1, " ".join(words(i, rng.randrange(0, 12)).split() + part + words(i + 500, rng.randrange(0, 12)).split()), "en", "s", 1))
    return spark.createDataFrame(rows, awkward_docs(spark).schema)


@pytest.mark.parametrize("batches", [1, 4])
def test_removals_equal_brute_force(spark, batches):
    docs = awkward_docs(spark).unionAll(overlapping(spark))
    rows, lost = substring_dedup.removals(clashing(docs), batches)
    lost = {(r.doc_id, r.key): r for r in lost.collect()}
    got = []
    for r in rows.collect():
        x = lost.get((r.doc_id, r.key))
        got.append((r.doc_id if r.doc_id is not None else -1, x.kept_sha256 if x else r.sha256, x.n_removed if x else 0))
    assert sorted(got) == brute_removals([(r.doc_id, r.text) for r in docs.collect()])


def test_dedup_keeps_columns_and_untouched_texts(spark):
    docs = clashing(awkward_docs(spark))
    out = substring_dedup.dedup(docs)
    assert out.columns == docs.columns
    before, after = {(r.doc_id, r.text) for r in docs.collect()}, out.collect()
    assert sum(r.doc_id is None for r in after) == 1 and not any(r.doc_id == 4 for r in after)
    assert all((r.doc_id, r.text) in before for r in after if r.doc_id not in (2, 4, 9, 11))
    assert all(r.n_chars == len(r.text) for r in after if r.doc_id in (2, 9))
    assert substring_dedup.dedup(docs.limit(0)).count() == 0


def test_index_merges_batches_and_compacts(spark):
    index = substring_dedup.FingerprintIndex(spark, fanout=2)
    make = lambda rows: spark.createDataFrame(rows, "h long, doc_id long, key long")
    assert index.match(make([(1, 1, 0), (2, 1, 0), (7, 2, 0), (7, 3, 0)])).count() == 2
    assert {(r.h, r.doc_id) for r in index.match(make([(2, 4, 0), (5, 4, 0)])).collect()} == {(2, 1), (2, 4)}
    assert len(index.runs) == 2
    index.compact()
    assert len(index.runs) == 1 and spark.table(index.runs[0]).count() == 6
    hits = index.match(make([(5, 9, 0), (1, 9, 0), (8, 9, 0)]))
    assert {(r.h, r.doc_id) for r in hits.collect()} == {(5, 4), (5, 9), (1, 1), (1, 9)}
    plan = spark.table(index.runs[0]).groupBy("h").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # runs are bucketed: no shuffle of history
    index.close()


def test_index_lasts_over_calls(spark, tmp_path):
    """Two calls with parts of a table give what one call gives; runs of a level are merged; a call that is not saved leaves no trace."""
    docs = awkward_docs(spark).unionAll(overlapping(spark)).where("doc_id is not null")
    path = str(tmp_path / "index")
    cuts = [None, 30, 600, None]
    got = []
    for low, high in zip(cuts, cuts[1:], strict=False):
        part = docs.where(f"doc_id > {low}") if low is not None else docs
        part = part.where(f"doc_id <= {high}") if high is not None else part
        rows, lost = substring_dedup.removals(part, batches=1, index_path=path)
        lost = {(r.doc_id, r.key): r for r in lost.collect()}
        for r in rows.collect():
            x = lost.get((r.doc_id, r.key))
            got.append((r.doc_id, x.kept_sha256 if x else r.sha256, x.n_removed if x else 0))
    assert sorted(got) == brute_removals([(r.doc_id, r.text) for r in docs.collect()])
    index = substring_dedup.FingerprintIndex(spark, path=path)
    assert sorted(index.levels[r] for r in index.runs) == [0, 1] and len(index.documents) == 3
    index.match(spark.createDataFrame([(1, 1, 1)], "h long, doc_id long, key long"))
    index.close()
    again = substring_dedup.FingerprintIndex(spark, path=path)
    assert len(again.runs) == 2 and spark.table(again.runs[0]).count() > 0
    again.close()


def test_hot_join_equals_join(spark):
    from lodestone.llm.common import hot_join

    rows = spark.createDataFrame([(i % 7 if i % 3 else 0, i) for i in range(300)], "k long, v long")
    facts = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("first"))
    same = lambda df: sorted(map(tuple, df.select("k", "v", "n", "first").collect()))
    assert same(hot_join(rows, facts, ["k"], "n", 300, least=40)) == same(rows.join(facts, "k"))


def brute_components(ids, linked):
    """The least id that each id reaches."""
    label = dict(zip(ids, ids, strict=True))
    moved = True
    while moved:
        moved = False
        for a, b in linked:
            low = min(label[a], label[b])
            moved |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


@pytest.mark.parametrize(("max_bits", "parts"), [(2, None), (11, None), (5, 4)])
def test_links_equal_brute_force(spark, monkeypatch, max_bits, parts):
    """Random fingerprints, clusters of close ones, and keys with more rows than a block."""
    monkeypatch.setattr(simhash, "BLOCK", 64)
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = set()
    for _ in range(1200):
        f = int(centre[rng.integers(0, 3 if rng.random() < 0.5 else 40)])
        for b in rng.integers(0, 64, rng.integers(0, 2 + max_bits)):
            f ^= 1 << int(b)
        fps.add(f)
    fps = np.array(sorted(fps), dtype=np.uint64)
    ids = fps.view(np.int64).tolist()
    near = [(ids[i], ids[j]) for i in range(len(ids)) for j in np.nonzero(np.bitwise_count(fps[i] ^ fps[:i]) <= max_bits)[0]]
    found = simhash.links(spark.createDataFrame([(0, i) for i in ids], "k int, fp long"), max_bits, parts)
    labels = {r.v: r.c for r in graph.components(found).collect()}
    assert {i: labels.get(i, i) for i in ids} == brute_components(ids, near)
    assert {(min(r.a, r.b), max(r.a, r.b)) for r in found.collect()} <= {(min(p), max(p)) for p in near}


def test_links_of_near_copies_hold_in_both_fingerprints(spark, monkeypatch):
    """Fingerprints that all link by chance (12 bits that vary) make no group unless the next ones are near too, in keys of more rows than a block as well."""
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = np.random.default_rng(9)
    fp, other = rng.integers(0, 1 << 12, 80, dtype=np.uint64), rng.integers(0, 1 << 63, 80, dtype=np.uint64)
    for i in range(20):
        fp[60 + i], other[60 + i] = fp[i] ^ np.uint64(1 << i % 12), other[i] ^ np.uint64((1 << i % 30) - 1)
    rows = list(zip(fp.view(np.int64).tolist(), other.view(np.int64).tolist(), strict=True))
    at = range(len(rows))
    near = [(i, j) for i in at for j in range(i) if np.bitwise_count(fp[i] ^ fp[j]) <= 9 and np.bitwise_count(other[i] ^ other[j]) <= simhash.OTHER_BITS]
    found = simhash.links(spark.createDataFrame([(k, a, b) for k in (0, 1) for a, b in rows], "k int, fp long, other long"), 9).collect()
    for k in (0, 1):
        place = {r: i for i, r in enumerate(rows)}
        got = [(place[r.a, r.other_a], place[r.b, r.other_b]) for r in found if r.k == k]
        assert brute_components(at, got) == brute_components(at, near)
        assert len(set(brute_components(at, got).values())) > 20


def test_probes_of_near_copies_go_out_in_small_tasks(spark, monkeypatch, tmp_path):
    """One file of fingerprints is dealt to as many tasks as its probes ask for."""
    monkeypatch.setattr(simhash, "PROBE_ROWS", 1000)
    rng = np.random.default_rng(3)
    path = str(tmp_path / "prints")
    spark.createDataFrame([(0, int(x), int(y)) for x, y in rng.integers(0, 1 << 63, (300, 2))], "k int, fp long, other long").coalesce(1).write.parquet(path)
    found = simhash.links(spark.read.parquet(path), 9)
    assert int(re.search(r"Exchange RoundRobinPartitioning\((\d+)\)", found._jdf.queryExecution().executedPlan().toString())[1]) >= 10


def test_probes_of_near_copies_stay_few():
    """What a text sends out in the search for near copies does not grow with the table: random fingerprints, up to 14 million."""
    for n in (50_000, 500_000, 3_000_000, 14_000_000):
        plans = []
        for parts in simhash.PARTS:
            widths = [64 // parts + (i < 64 % parts) for i in range(parts)]
            shares = [np.array([math.comb(w, r) for r in range(w + 1)]) / 2**w for w in widths]
            plans.append((*simhash.thresholds(shares, widths, n, simhash.NEAR_BITS, simhash.NEAR_PROBE_COST), widths))
        _, chosen, widths = min(plans)
        assert sum(len(simhash.ball(w, t // 2)) for w, t in zip(widths, chosen, strict=True) if t >= 0) <= 52


def test_fingerprint_definition():
    import xxhash

    text = "The QUICK brown fox\tjumps É over"
    w = text.encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(len(w) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.majority(simhash.shingle_hashes(text, 3)) == want
    assert simhash.majority(simhash.shingle_hashes(None, 3)) == simhash.majority(simhash.shingle_hashes(" \n", 3)) == 0
    assert simhash.majority(simhash.shingle_hashes("Two words", 3)) == xxhash.xxh64_intdigest(b"two words", 42)


def test_thresholds_meet_the_pigeonhole():
    shares = [np.array([0.5, 0.3, 0.2]), np.array([0.001, 0.01, 0.989]), np.array([0.002, 0.02, 0.978])]
    for max_bits in (0, 1, 2, 3):
        got = simhash.thresholds(shares, [2, 2, 2], 10_000, max_bits)[1]
        assert sum(t + 1 for t in got) >= max_bits + 1
    assert simhash.thresholds(shares, [2, 2, 2], 10_000, 1)[1][0] == -1  # the crowded partition is left out


def test_clusters_and_dedup_awkward_rows(spark):
    docs = awkward_docs(spark)
    got = defaultdict(set)
    for r in simhash.clusters(clashing(docs), shingle=3, max_bits=2).collect():
        got[r.doc_id].add(r.component_id)
    assert got[4] == got[3] == {3} and got[6] == got[7] == got[5] == {5} and got[None] == {None} and got[9] == {9}
    kept = simhash.dedup(clashing(docs))
    assert kept.columns == clashing(docs).columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(10) == 1 and 4 not in ids and 7 not in ids and ids.count(None) == 1 and set(range(20, 40)) <= set(ids)
    assert simhash.dedup(docs.limit(0)).count() == 0


def test_near_copies_go_and_others_stay(spark):
    base = [words(i, 200).split() for i in range(12)]
    rows = [(i, " ".join(b), "en", "s", 1) for i, b in enumerate(base)]
    for i in range(6):
        near = list(base[i])
        near[50 + i] = "edited"
        rows.append((100 + i, " ".join(near), "en", "s", 1))
    ids = {r.doc_id for r in simhash.dedup(spark.createDataFrame(rows, awkward_docs(spark).schema)).collect()}
    assert ids == set(range(12))


def test_near_copies_by_resemblance(spark, monkeypatch):
    """Pairs of 0.8 or more link (all but few near the bound), none below: edits that leave 0.7 to 0.95, groups cut into blocks."""
    monkeypatch.setattr(simhash, "BLOCK", 8)
    monkeypatch.setattr(simhash, "BLOCK_SETS", 8)
    rng, rows = random.Random(4), []
    for i in range(60):
        base = words(i, 60 + 5 * i).split()
        rows.append((10 * i, " ".join(base)))
        for k in range(1, 5):
            near = list(base)
            for at in rng.sample(range(len(near)), max(1, len(near) * rng.randrange(1, 7) // 200)):
                near[at] = f"edit{k}"
            rows.append((10 * i + k, " ".join(near)))
    line = words(990, 40)
    rows += [(2000 + i, line + " " + words(3000 + i, rng.randrange(1, 30))) for i in range(80)]
    sets = [{tuple(w[s : s + 5]) for s in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    ids = [i for i, _ in rows]
    near = {(ids[j], ids[i]): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in range(len(rows)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    want = brute_components(ids, list(near))
    docs = spark.createDataFrame([(i, t.upper() if i % 2 else t, "en", "s", 1) for i, t in rows], awkward_docs(spark).schema)
    got = {r.doc_id: r.component_id for r in simhash.near_clusters(docs).collect()}
    assert all(want[got[i]] == want[i] for i in ids)  # nothing is made up
    linked = {p: got[p[0]] == got[p[1]] for p in near}
    assert sum(linked.values()) >= 0.97 * len(near) and all(ok for p, ok in linked.items() if near[p] >= 0.87)
    assert {r.doc_id for r in simhash.dedup(docs).collect()} == {i for i in ids if got[i] == i}


def test_sketches_drop_no_near_pair():
    """A sketch differs in no more bits than its set in members, and links within a block connect what near pairs connect."""
    rng = np.random.default_rng(5)
    base = [rng.integers(0, 1 << 63, size=n, dtype=np.uint64) for n in (1, 5, 40, 300, 5000)]
    sets = [np.unique(np.r_[x[rng.random(len(x)) > cut], rng.integers(0, 1 << 63, size=int(cut * len(x)), dtype=np.uint64)]) for x in base for cut in (0, 0.02, 0.05, 0.08, 0.1, 0.15) for _ in range(3)]
    odd = [simhash.odd_sketch(x) for x in sets]
    assert all(np.bitwise_count(a ^ b).sum() <= len(np.setxor1d(x, y)) for a, x in zip(odd, sets, strict=True) for b, y in zip(odd, sets, strict=True))
    ids = np.arange(len(sets))
    near = [(i, j) for i in range(len(sets)) for j in range(i) if simhash.near(sets[i], sets[j])]
    found = simhash.near_links(ids, np.zeros(len(sets), dtype=np.uint64), ids, sets, 13)
    assert set(found) <= {(j, i) for i, j in near} and len(found) < len(sets)
    assert brute_components(ids.tolist(), found) == brute_components(ids.tolist(), near)
    got = simhash.with_partner(ids, np.zeros(len(sets), dtype=np.uint64), np.array([len(x) for x in sets]), np.array(odd), 13)
    assert all(got[i] and got[j] for i, j in near)


def test_forest_keeps_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(400)] + [(i, j) for i in range(300, 330) for j in range(300, 330)]
    frame = spark.createDataFrame(edges, "a long, b long")
    for chunk in (50, 10_000):
        less = graph.forest(frame, chunk)
        same = lambda e: {(r.v, r.c) for r in graph.components(e).collect()}
        assert same(less) == same(frame)
    assert less.count() <= 229


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 200), (200, 300), (7, 7)]
    got = {r.v: r.c for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 200: 100, 300: 100}
