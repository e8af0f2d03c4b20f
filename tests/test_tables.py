"""Merges, ledger, shards, graphs, evaluation, archives, sources, sinks and streams on small rows."""

from __future__ import annotations

import gzip
import io
import json
import random
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestone.operators import content as C
from lodestone.operators import evaluation as E
from lodestone.operators import findings as M
from lodestone.operators import gitgraph as G
from lodestone.operators import ledger as L
from lodestone.operators import shards as S
from lodestone.sources import readers, sinks
from lodestone.streaming import pipeline as P

LEDGER = "tenant_id string, policy_hash string, ovid_hash string, status int, bytes_scanned long, findings_count int, run_id long, shard_id long, fence_epoch long, started_at long, finished_at long, error_code string"


def ledger_rows(rng, n):
    out = []
    for _ in range(n):
        status = rng.choice([1, 2, 3, 10, 11])
        out.append(("t", "p", str(rng.randrange(n // 6)), status, rng.randrange(5), rng.randrange(1, 4) if status == 11 else 0, rng.choice([-5, 3]), rng.randrange(3), rng.randrange(3), 1, rng.randrange(1, 4), rng.choice([None, "E1", "E2"]) if status < 10 else None))
    return out


def test_ledger_merge_has_no_order(spark):
    rows = ledger_rows(random.Random(1), 120)
    make = lambda r: spark.createDataFrame(r, LEDGER)
    whole = sorted(map(tuple, L.merge(make(rows)).collect()), key=str)
    halves = L.merge(L.merge(make(rows[60:])).unionByName(L.merge(make(rows[:60]))))
    assert sorted(map(tuple, halves.collect()), key=str) == whole
    assert sorted(map(tuple, L.merge(L.merge(make(rows))).collect()), key=str) == whole


def test_ledger_rules(spark):
    base = ("t", "p", "o")
    rows = [(*base, 10, 5, 0, 1, 1, 1, 1, 2, None), (*base, 11, 3, 2, 1, 1, 1, 1, 1, None), (*base, 1, 9, 0, 1, 1, 9, 9, 9, "E")]
    r = L.merge(spark.createDataFrame(rows, LEDGER)).first()
    assert (r.status, r.bytes_scanned, r.findings_count, r.finished_at, r.error_code) == (11, 9, 2, 1, None)
    rows = [(*base, 2, 0, 0, -1, 0, 0, 0, 5, None), (*base, 2, 0, 0, -9, 0, 0, 0, 5, None), (*base, 1, 0, 0, 0, 0, 0, 0, 9, "E")]
    r = L.merge(spark.createDataFrame(rows, LEDGER)).first()
    assert (r.run_id, r.error_code) == (-1, "E")  # signed order; the loser's code fills in
    bad = spark.createDataFrame([(*base, 10, 0, 1, 0, 0, 0, 0, 0, None), (*base, 7, 0, 0, 0, 0, 0, 0, 0, None), (*base, 11, 0, 1, 0, 0, 0, 0, 0, None)], LEDGER)
    assert {x.problem for x in L.shape_errors(bad).collect()} == {"clean with findings", "unknown status"}


def test_observation_ties(spark):
    schema = "k int, arrival int, run_id int, shard_id int, fence_epoch int, seen_at int, location_display string, location_url string"
    rows = [(1, 1, 1, 0, 0, 5, None, None), (1, 2, 2, 0, 0, 5, "b", "u"), (1, 3, 3, 0, 0, 5, "c", "v"), (2, 1, 1, 0, 0, 4, "a", "x"), (2, 2, 2, 0, 0, 6, None, None)]
    got = {r.k: (r.run_id, r.seen_at, r.location_display, r.location_url) for r in M.merge_observations(spark.createDataFrame(rows, schema), ["k"]).collect()}
    assert got == {1: (2, 5, "b", "u"), 2: (2, 6, "a", "x")}


def test_lease_log(spark):
    schema = "shard_id long, seq long, now long, op string, worker long, fence long, ttl long, cursor string, op_id long, payload_hash string"
    steps = [("acquire", 0, 1, 0, None), ("acquire", 5, 2, 0, None), ("checkpoint", 6, 1, 1, "b"), ("checkpoint", 7, 1, 1, "a"), ("renew", 8, 1, 0, None), ("renew", 9, 2, 1, None), ("acquire", 30, 2, 0, None), ("checkpoint", 31, 1, 1, "c"), ("park", 32, 2, 2, None), ("acquire", 33, 1, 0, None), ("unpark", 34, 9, 9, None), ("acquire", 35, 1, 0, None), ("complete", 36, 1, 3, None), ("unpark", 37, 1, 3, None)]
    rows = [(1, i, now, op, w, f, 10, c, i, "h") for i, (op, now, w, f, c) in enumerate(steps)]
    rows += [(1, 50, 40, "acquire", 1, 0, 10, None, 0, "h"), (1, 51, 41, "acquire", 1, 0, 10, None, 0, "other")]
    got = [r.outcome for r in S.replay(spark.createDataFrame(rows, schema)).orderBy("seq").collect()]
    assert got == ["ok", "leased", "ok", "cursor_back", "stale_fence", "not_owner", "ok", "stale_fence", "ok", "terminal", "ok", "ok", "ok", "not_parked", "replayed", "op_conflict"]


def test_route_has_open_ends_and_gaps(spark):
    shards = spark.createDataFrame([(1, "", "b"), (2, "b", "bb"), (3, "c", "")], "shard_id int, start string, end string")
    objects = spark.createDataFrame([(k,) for k in ("a", "azz", "b", "ba", "bb", "bz", "c", "zz")], "key string")
    assert {r.key: r.shard_id for r in S.route(objects, shards).collect()} == {"a": 1, "azz": 1, "b": 2, "ba": 2, "c": 3, "zz": 3}


def test_introduced_ignores_foreign_marks(spark):
    edges = spark.createDataFrame([(3, 2), (2, 1), (4, 2), (4, 3), (9, 8)], "c long, parent long")
    tips, marks = spark.createDataFrame([("m", 4), ("x", 9)], "root string, c long"), spark.createDataFrame([("m", 2), ("x", 3)], "root string, c long")
    assert {(r.c, r.root) for r in G.introduced(edges, tips, marks).collect()} == {(4, "m"), (3, "m"), (9, "x"), (8, "x")}


def test_tree_diff_kinds(spark):
    schema = "path string, oid string, mode string"
    old = spark.createDataFrame([("same", "1", "100644"), ("mod", "1", "100644"), ("gone", "1", "100644"), ("link", "1", "160000"), ("to_link", "1", "100644")], schema)
    new = spark.createDataFrame([("same", "1", "100644"), ("mod", "2", "100644"), ("add", "1", "100644"), ("link", "1", "100644"), ("to_link", "2", "160000")], schema)
    assert {(r.path, r.change) for r in G.tree_diff(old, new).collect()} == {("mod", "modify"), ("add", "add"), ("link", "add")}


def test_greedy_match_consumes(spark):
    f = spark.createDataFrame([("a", 1, 2, "r", 9, 1, 1), ("a", 5, 6, "r", 8, 1, 1), ("a", 7, 8, "r", 7, 5, 5), ("a", 9, 10, "r", 6, 9, 9), ("b", 1, 2, "r", 5, 1, 1)], "path string, start long, end long, rule string, confidence int, f_start long, f_end long")
    t = spark.createDataFrame([(1, "a", 1, 1, "positive"), (2, "a", 5, 6, "negative"), (3, "c", 1, 1, "positive")], "truth_id long, path string, line_start long, line_end long, label string")
    assert {(r.path, r.start): r.outcome for r in E.greedy_match(f, t).collect()} == {("a", 1): "tp", ("a", 5): "unlabeled", ("a", 7): "fp", ("a", 9): "unlabeled", ("b", 1): "unlabeled"}


def test_average_precision_ties_and_no_positives(spark):
    rows = [("g", 5, 1, 2), ("g", 5, 0, 2), ("g", 1, 1, 2), ("z", 5, 0, 0)]
    got = {r.g: r.ap for r in E.average_precision(E.pr_curve(spark.createDataFrame(rows, "g string, confidence int, is_tp int, positives int"), "g"), "g").collect()}
    assert got["g"] == pytest.approx(0.5 * 0.5 + 0.5 * 2 / 3) and got["z"] == 0


def test_bootstrap_covers(spark):
    rows = spark.createDataFrame([("a", 80, 20, 20), ("b", 0, 0, 0)], "grp string, tp int, fp int, fn int")
    got = {r.grp: r for r in E.bootstrap_interval(rows).collect()}
    assert got["a"].lower < 0.8 < got["a"].upper and got["b"].upper == 0
    assert {r.grp: r for r in E.bootstrap_interval(rows.repartition(2)).collect()} == got


def test_archives(spark):
    inner, box, bomb = io.BytesIO(), io.BytesIO(), io.BytesIO()
    with tarfile.open(fileobj=inner, mode="w:bz2") as t:
        info = tarfile.TarInfo("deep.txt")
        info.size = 4
        t.addfile(info, io.BytesIO(b"deep"))
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("in.tar.bz2", inner.getvalue())
        z.writestr("plain.txt", b"plain")
    with zipfile.ZipFile(bomb, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("zeros", b"\0" * (4 << 20))
    rows = [("a.zip", box.getvalue()), ("b.bin", gzip.compress(b"magic")), ("c.txt", b"text"), ("d.zip", b"PK\x03\x04broken"), ("e.zip", bomb.getvalue()), ("f.zip", None)]
    got = {r.path: (r.content and bytes(r.content), r.outcome) for r in C.expand_archives(readers.memory(spark, rows)).collect()}
    assert got["a.zip::in.tar.bz2::deep.txt"] == (b"deep", "ok") and got["a.zip::plain.txt"] == (b"plain", "ok") and got["b.bin::b"] == (b"magic", "ok")
    assert got["d.zip"][1] == "corrupt" and got["e.zip::zeros"] == (None, "ratio") and got["f.zip"][1] == "corrupt" and len(got) == 6
    shallow = {r.path: r.outcome for r in C.expand_archives(readers.memory(spark, rows[:1]), budget={"depth": 1}).collect()}
    assert shallow["a.zip::in.tar.bz2"] == "too_deep"


def test_extractors():
    assert C.dotenv_lines("export A='x y' # c\n# no\nB=\"l1\nl2\\n\"\nC=1 # c\n9=x\nD") == "A=x y\nB=l1\nl2\n\nC=1"
    assert C.extract_text("ipynb", b'{"cells":[{"cell_type":"code","source":"a"},{"cell_type":"raw","source":"b"}]}') == "a"
    assert C.extract_text("ipynb", b"{") is None
    cls = b"\xca\xfe\xba\xbe\0\0\0\x34\0\x04\x01\0\x05hello\x05\0\0\0\0\0\0\0\x01"
    assert C.class_strings(cls) == ["hello"]
    import importlib.util
    import marshal

    code = compile("X = 'a secret value'\n", "f.py", "exec")
    assert "a secret value" in C.pyc_strings(importlib.util.MAGIC_NUMBER + b"\0" * 12 + marshal.dumps(code))


def test_file_sources(spark, tmp_path):
    for name, body in {"a/x.py": b"1", "a/y.log": b"2", "b/z.py": b"345", "node_modules/q.py": b"6"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    names = lambda df: {r.path.split("/")[-1] for r in df.select("path").collect()}
    assert names(readers.files(spark, str(tmp_path), glob="*.py", ignore=["node_modules/"])) == {"x.py", "z.py"}
    assert names(readers.files(spark, str(tmp_path), ignore=["*.log", "/none"], max_bytes=1)) == {"x.py", "q.py"}
    assert names(readers.files(spark, str(tmp_path), start=f"file:{tmp_path}/b", end=f"file:{tmp_path}/c")) == {"z.py"}


def test_truth_sources(spark, tmp_path):
    (tmp_path / "f.jsonl").write_text('{"type":"finding","path":"a","start":1,"end":2,"rule":"r","confidence_score":3}\nnot json\n{"type":"summary"}\n')
    assert [r.ok for r in readers.findings_jsonl(spark, str(tmp_path / "f.jsonl")).collect()] == [True, False, False]
    (tmp_path / "t.json").write_text('[{"path":"a","line_start":1,"line_end":2,"label":"positive","rule":"r"}]')
    assert readers.truth_manifest(spark, str(tmp_path / "t.json")).first().line_end == 2
    head = "Id,FileID,Domain,RepoName,FilePath,LineStart,LineEnd,GroundTruth,ValueStart,ValueEnd,CryptographyKey,PredefinedPattern,Category\n"
    (tmp_path / "c.csv").write_text(head + "1,f,d,r,p,3,4,T,,,,,K\n2,f,d,r,p,x,4,F,,,,,K\n3,f,d,r,p,5,4,X,,,,,K\n4,f,d,r,p,5,6,Q,,,,,K\n")
    assert [r.skipped for r in readers.creddata(spark, str(tmp_path / "c.csv")).orderBy("line_end", "line_start").collect() if True].count(None) == 1
    (tmp_path / "l.csv").write_text("﻿name,num_risk,num_informative\n# note\na,2,3\n", encoding="utf-8")
    assert [(r.path, r.expected) for r in readers.leaky_repo(spark, str(tmp_path / "l.csv")).collect()] == [("a", 5)]


class Store:
    """A remote store for the test: one key fails for good, one at first."""

    def __init__(self, options):
        self.tries = {}

    def list_keys(self):
        return ["a", "b", "c"]

    def fetch(self, key):
        self.tries[key] = self.tries.get(key, 0) + 1
        if key == "b" and self.tries[key] < 2:
            raise OSError("later")
        if key == "c":
            raise ValueError("never")
        return key.encode()


def test_remote_source(spark):
    reader = readers.RemoteReader({"backend": "tests.test_tables:Store", "keys_per_task": "2"})
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert len(reader.partitions()) == 2 and rows == [("a", b"a", None), ("b", b"b", None), ("c", None, "permanent: never")]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", "r", 1, 3, 8), ("b", "q", 2, 5, 1)], "path string, rule string, start long, end long, confidence int")
    sinks.write_jsonl(rows, str(tmp_path / "j"))
    assert sorted(json.loads(r.value)["path"] for r in spark.read.text(str(tmp_path / "j")).collect()) == ["a", "b"]
    sinks.write_sarif(rows, str(tmp_path / "s"))
    logs = [json.loads(p.read_text()) for p in (tmp_path / "s").glob("part-*") if p.stat().st_size]
    assert {r["level"] for x in logs for r in x["runs"][0]["results"]} == {"error", "note"} and all(x["version"] == "2.1.0" for x in logs)
    sinks.write_text(rows, str(tmp_path / "t"))
    assert "a:1-3 r (confidence 8)" in {r.value for r in spark.read.text(str(tmp_path / "t")).collect()}


def test_stream_is_idempotent(spark, tmp_path):
    src, base = tmp_path / "in", str(tmp_path)
    rows = lambda ids: spark.createDataFrame([("t", "p", str(i), i) for i in ids], "tenant_id string, policy_hash string, ovid_hash string, v int")

    def scan(batch):
        entry = batch.select(*L.KEYS, F.lit(10).alias("status"), F.lit(1).cast("long").alias("bytes_scanned"), F.lit(0).alias("findings_count"), *[F.lit(1).cast("long").alias(c) for c in ("run_id", "shard_id", "fence_epoch", "started_at", "finished_at")], F.lit(None).cast("string").alias("error_code"))
        return batch.where("v % 2 = 0").select("ovid_hash", "v"), entry

    for n, (ids, checkpoint) in enumerate([(range(10), "c1"), (range(5, 15), "c1"), (range(0), "c2")]):
        rows(ids).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(rows([1]).schema).parquet(str(src))
        P.scan_stream(stream, scan, f"{base}/f", f"{base}/l", f"{base}/{checkpoint}", ["ovid_hash"])
        assert sinks.read_table(spark, f"{base}/f").count() == (5 if n == 0 else 8)
        assert sinks.read_table(spark, f"{base}/l").count() == (10 if n == 0 else 15)


def test_merges_survive_a_crash_anywhere(spark, tmp_path, monkeypatch):
    """A merge that stops before any one of its file operations leaves the table as it was; the retry adds its rows; only touched buckets are rewritten."""
    path = str(tmp_path / "t")
    rows = lambda ids: spark.createDataFrame([(i, f"v{i}") for i in ids], "k long, v string")
    put = lambda ids: sinks.merge_into(path, rows(ids), lambda all_: all_.dropDuplicates(["k"]), ["k"], buckets=4)
    have = lambda: sorted(r.k for r in sinks.read_table(spark, path).collect())
    assert sinks.read_table(spark, path) is None
    put([1, 2, 3])
    for n, step in enumerate(("_publish", "_clean")):
        with monkeypatch.context() as m:
            m.setattr(sinks, step, lambda *a: (_ for _ in ()).throw(OSError("crash")))
            with pytest.raises(OSError, match="crash"):
                put([10 + n])
        assert have() == [1, 2, 3, *range(10, 10 + n)] + ([11] if step == "_clean" else [])
        put([10 + n])
        assert have() == [1, 2, 3, *range(10, 11 + n)]
    before = sinks.manifest(spark, path, sinks.manifests(spark, path)[-1])["buckets"]
    put([12])
    after = sinks.manifest(spark, path, sinks.manifests(spark, path)[-1])["buckets"]
    assert sum(before.get(b) != d for b, d in after.items()) == 1 and len(sinks.manifests(spark, path)) == 2
    (tmp_path / "t" / "data-left").mkdir()  # of a crashed write
    put([13])
    assert have() == [1, 2, 3, 10, 11, 12, 13] and not (tmp_path / "t" / "data-left").exists()


def test_whole_scan(spark):
    import base64

    from lodestone.operators import wholescan as W
    from lodestone.sources import rules as R

    rules = R.parse("- {name: t, regex: 'tok_([a-z]{8})', anchors: [tok_]}")
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("in/a.txt", "tok_aaaaaaaa")
        z.writestr("in/.env", "X='tok_bbbbbbbb'")
        z.writestr("img.png", b"\x89PNG tok_cccccccc")
    files = [("/r/a.zip", box.getvalue()), ("/r/b.py", base64.b64encode(b"here is a tok_dddddddd for you")), ("/r/c.txt", b"nothing"), ("/r/d.gz", b"\x1f\x8bbroken"), ("/r/go.sum", b"tok_eeeeeeee"), ("/r/f.bin", b"\0tok_ffffffff"), ("/r/g.txt", None)]
    findings, ledger = W.scan_files(readers.memory(spark, files), rules, depth=1, now=7)
    got = {(r.object_id, r.path, r.secret) for r in findings.collect()}
    assert got == {("/r/a.zip", "/r/a.zip::in/a.txt", "aaaaaaaa"), ("/r/a.zip", "/r/a.zip::in/.env", "bbbbbbbb"), ("/r/b.py", "/r/b.py", "dddddddd")}
    states = sorted(((r.status, r.findings_count, r.error_code) for r in ledger.collect()), key=str)
    assert states == sorted([(11, 2, None), (11, 1, None), (10, 0, None), (2, 0, "corrupt"), (3, 0, "not_scannable"), (3, 0, "not_scannable"), (10, 0, None)], key=str)
    assert L.shape_errors(ledger).count() == 0


def test_nulls_and_empty_fields_have_their_own_digests(spark):
    from lodestone.operators import identity as I

    rows = spark.createDataFrame([(None,), ("",), ("-",)], "s string")
    assert rows.select(I.digest("d", "s").alias("d")).distinct().count() == 3


def test_plans_and_routes_of_keys_with_a_common_prefix(spark):
    items = spark.createDataFrame([(f"/data/repo/file{i:06d}", 1) for i in range(1000)], "key string, w int")
    plan = S.plan_shards(items, "key", "w", 16).orderBy("shard_id").collect()
    assert len(plan) == 16 and {r.weight for r in plan} <= {62, 63} and plan[0].start == "" and plan[-1].end == "" and all(a.end == b.start for a, b in zip(plan, plan[1:], strict=False))
    routed = S.route(items, spark.createDataFrame([(r.shard_id, r.start, r.end) for r in plan], "shard_id int, start string, end string")).groupBy("shard_id").count()
    assert {r.shard_id: r["count"] for r in routed.collect()} == {r.shard_id: r.weight for r in plan}


def test_reach_over_runs_forks_and_merges(spark):
    rng = random.Random(2)
    edges = {(i, i - 1) for i in range(1, 300) if i % 50} | {(i, rng.randrange(i)) for i in range(40, 300, 23)}
    parents: dict[int, set[int]] = {}
    for c, p in edges:
        parents.setdefault(c, set()).add(p)
    tips = [("a", 299), ("b", 120), ("c", 121), ("d", 7), ("e", 999)]
    want = set()
    for root, tip in tips:
        todo, seen = [tip], {tip}
        while todo:
            for p in parents.get(todo.pop(), ()):
                if p not in seen:
                    seen.add(p)
                    todo.append(p)
        want |= {(root, c) for c in seen}
    got = G.reach(spark.createDataFrame(sorted(edges), "c long, parent long"), spark.createDataFrame(tips, "root string, c long")).collect()
    assert len(got) == len(want) and {(r.root, r.c) for r in got} == want
