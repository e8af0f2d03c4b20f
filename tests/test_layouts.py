"""Queries on tables in other shapes than the smallest ones: folders of part files, nulls, wide keys."""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import random
import zipfile

import duckdb
import pyarrow as pa

from lodestone.operators import content as C
from lodestone.operators import detect as D
from lodestone.operators import evaluation as E
from lodestone.operators import wholescan as W
from lodestone.plans import all_queries
from lodestone.plans import content as plans_content
from lodestone.shared import BATCH_BYTES
from lodestone.sources import rules
from lodestone.streaming import pipeline as P
from tests.test_oracle import rows

QUERIES = all_queries()


def against_sql(spark, name, sf_dir, **tables):
    """The query's rows and those of its SQL over the given files."""
    con = duckdb.connect()
    for table, files in tables.items():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{files}'")
    fn, sql = QUERIES[name]
    return rows(fn(spark, str(sf_dir)).toPandas()), rows(con.execute(sql).fetchdf())


def test_stream_scan_reads_a_folder_of_part_files(spark, tmp_path):
    docs = [(1, "one", "en", "s", 3), (2, None, "en", "s", None), (3, "", "en", "s", 0), (4, "vier\n", "de", "s", 5)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(path)
    got, want = against_sql(spark, "stream_scan", tmp_path, documents=path + "/*.parquet")
    assert got == want and len(got) == 4


def test_stream_without_files_leaves_empty_tables(spark, tmp_path):
    (tmp_path / "in").mkdir()
    scan = lambda batch: (batch, batch.selectExpr("tenant_id", "policy_hash", "ovid_hash", "10 AS status", "0L AS bytes_scanned", "0 AS findings_count", "0L AS run_id", "0L AS shard_id", "0L AS fence_epoch", "0L AS started_at", "0L AS finished_at", "cast(null AS string) AS error_code"))
    stream = spark.readStream.schema("tenant_id string, policy_hash string, ovid_hash string").parquet(str(tmp_path / "in"))
    P.scan_stream(stream, scan, f"{tmp_path}/f", f"{tmp_path}/l", f"{tmp_path}/c", ["ovid_hash"])
    assert [P.read_table(spark, f"{tmp_path}/{t}").count() for t in "fl"] == [0, 0]


def test_range_keys_of_wide_numbers(spark, tmp_path):
    keys = [0, 254, 255, 256, 65279, 65280, 65534, 65535, 65536, 65551, 73727, 77823, 90000, 899999, 1048559, 1048560, 1048575, 1048576, 16777215, 5400000, 2**40 + 255]
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    got, want = against_sql(spark, "range_keys", tmp_path, customer=f"{tmp_path}/customer.parquet/*.parquet")
    assert got == want


def test_entries_go_on_in_batches(spark):
    """Many entries to a batch, large ones few to a batch; archives are made and read by all cores though their table is one file."""
    make = lambda bodies: pa.RecordBatch.from_arrays([pa.array([f"{i}.gz" for i in range(len(bodies))]), pa.array([gzip.compress(b, 1) for b in bodies])], names=["path", "content"])
    batches = [make([b"x"] * 300), make([b"y"] * 300)]
    got = list(C.expanded(iter(batches), C.BUDGET))
    assert [b.num_rows for b in got] == [600] and got[0].to_pylist()[599] == {"path": "299.gz::299", "content": b"y", "outcome": "ok"}
    large = {**C.BUDGET, "ratio": 1 << 20}
    assert [b.num_rows for b in C.expanded(iter([make([b"z" * (5 << 20)] * 3)]), large)] == [2, 1]
    assert list(C.expanded(iter([make([])]), C.BUDGET)) == []
    assert plans_content._packed(spark, "/root/testdata/sf0.01").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_greedy_match_of_whole_islands_in_any_batches(spark):
    """Islands cut anywhere into batches, nulls and placeholders; one exchange per call, since rows are not dealt again."""
    rng = random.Random(3)
    spans = [(f"p{rng.randrange(3)}" if i % 40 else None, x := rng.randrange(60), x + rng.randrange(4)) for i in range(240)]
    f = [(p, x, i % 9, f"r{i % 3}", rng.randrange(4), x, y) for i, (p, x, y) in enumerate(spans[:160])]
    t = [(i, p, x, y, rng.choice(["positive", "positive", "negative", "placeholder"]), f"g:r{i % 4}") for i, (p, x, y) in enumerate(spans[160:])]
    found = spark.createDataFrame(f, "path string, start long, end long, rule string, confidence int, f_start long, f_end long")
    truth = spark.createDataFrame(t, "truth_id long, path string, line_start long, line_end long, label string, rule string")

    def want(strict):
        free, out = sorted((x for x in t if x[4] == "positive"), key=lambda x: (x[2], x[3], x[0])), []
        negative = sorted((x for x in t if x[4] == "negative"), key=lambda x: (x[2], x[3], x[0]))
        for r in sorted(f, key=lambda r: (-r[4], r[1], r[2], r[3], r[6])):
            meets = lambda x, r=r: x[1] == r[0] and x[2] <= r[6] and x[3] >= r[5] and (not strict or r[3] in x[5].split(":"))
            item, outcome = next((x for x in free if meets(x)), None), "tp"
            if item is None:
                item, outcome = next((x for x in negative if meets(x)), None), "fp"
            else:
                free.remove(item)
            out.append((*r[:5], outcome if item else "unlabeled", item and item[0]))
        return sorted(map(repr, out))

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("7", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            for strict in (False, True):
                assert sorted(repr(tuple(r)) for r in E.greedy_match(found, truth, strict).collect()) == want(strict)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert E.greedy_match(found, truth)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_scans_bound_batches_by_bytes(spark):
    """Long texts come to Python few at once, whatever the size of their table; a size that the user has chosen stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.createDataFrame([(1, "token")], "doc_id long, text string")
    rule = [{**D.load()[0]}]
    try:
        spark.conf.unset(key)
        D.text_matches(docs, rule, "doc_id", "text", 0)
        assert spark.conf.get(key) == str(BATCH_BYTES)
        spark.conf.set(key, "1000")
        D.text_matches(docs, rule, "doc_id", "text", 0)
        assert spark.conf.get(key) == "1000"
    finally:
        spark.conf.unset(key)


def test_compressed_files_are_read_in_steps(monkeypatch):
    """No buffer of the size of the limit for every small file; limits and broken ends as before."""
    asked, opened = [], gzip.open

    class Asked(io.BytesIO):
        def read(self, n=-1):
            asked.append(n)
            return super().read(n)

    monkeypatch.setattr(C.gzip, "open", lambda f: Asked(opened(f).read()))
    body = bytes(range(256)) * 1024
    assert list(C.expand_one("a.gz", gzip.compress(body), C.BUDGET)) == [("a.gz::a", body, "ok")] and max(asked) == C.STEP_BYTES
    for most, outcome in ((len(body), "ok"), (len(body) - 1, "entry_too_large"), (1, "entry_too_large")):
        asked.clear()
        assert [r[2] for r in C.expand_one("a.gz", gzip.compress(body), {**C.BUDGET, "entry_bytes": most})] == [outcome] and sum(asked) <= most + 1 + C.STEP_BYTES
    monkeypatch.undo()
    assert list(C.expand_one("a.gz", gzip.compress(body)[:-9], C.BUDGET)) == [("a.gz", None, "corrupt")]
    assert list(C.expand_one("a.gz", gzip.compress(b"a") + gzip.compress(b"b"), C.BUDGET)) == [("a.gz::a", b"ab", "ok")]


def test_whole_scan_passes_once_over_the_contents(spark):
    """Neither table runs the pass again, no content is shuffled; a path given twice has one version, that of the last content; '::' may stand in a path."""
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("n.ipynb", json.dumps({"cells": [{"cell_type": "code", "source": "tok_aaaaaaaa"}]}))
        z.writestr("b.ipynb", "{")
    last = b"z tok_cccccccc"
    files = [("/x::y.zip", box.getvalue()), ("/a.txt", b"a tok_bbbbbbbb"), ("/a.txt", last), ("/a.txt", None), ("/n.txt", None), ("/e.env/.env", b"A='tok_dddddddd'")]
    files = spark.createDataFrame(files, "path string, content binary")
    found, ledger = W.scan_files(files, rules.parse("- {name: t, regex: 'tok_([a-z]{8})', anchors: [tok_]}"))
    for df in (found, ledger):
        assert "InArrow" not in df._jdf.queryExecution().executedPlan().toString()
    digest = lambda raw: hashlib.sha256(raw).hexdigest()
    assert sorted((r.object_id, r.path, r.secret, r.version) for r in found.collect()) == sorted([
        ("/x::y.zip", "/x::y.zip::n.ipynb", "aaaaaaaa", digest(box.getvalue())), ("/a.txt", "/a.txt", "bbbbbbbb", digest(last)), ("/a.txt", "/a.txt", "cccccccc", digest(last)),
        ("/e.env/.env", "/e.env/.env", "dddddddd", digest(b"A='tok_dddddddd'")),
    ])
    assert sorted((r.status, r.findings_count, r.bytes_scanned) for r in ledger.collect()) == sorted([(11, 1, len(box.getvalue())), (11, 2, len(last)), (10, 0, 0), (11, 1, 16)])


def test_identity_chain_keeps_the_rows_of_an_item_together(spark, tmp_path):
    """Within a task rows stand by item and version, ordered before the digests are made and without an exchange; rows are those of the SQL."""
    lines = [(i * 7919 % 41, i * 31 % 7 + 1, i % 23, i % 9, "ANR"[i % 3]) for i in range(900)]
    path = str(tmp_path / "lineitem.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string").repartition(2).write.parquet(path)
    got, want = against_sql(spark, "identity_chain", tmp_path, lineitem=path + "/*.parquet")
    assert got == want and len(got) == 900
    df = QUERIES["identity_chain"][0](spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and -1 < plan.find("sha2") < plan.find("Sort [")
    tasks = {}
    for p, *row in df.selectExpr("spark_partition_id()", "object_id", "version").collect():
        tasks.setdefault(p, []).append(row)
    assert all(x == sorted(x) for x in tasks.values())
