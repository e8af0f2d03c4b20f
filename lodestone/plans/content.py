"""Queries over content classes, archives, extraction, sources and streams."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.functions import bytespace as B
from lodestone.operators import content as C
from lodestone.operators import detect as D
from lodestone.operators import wholescan as W
from lodestone.shared import byte_batches, scratch, spread, stored
from lodestone.sources import readers, sinks
from lodestone.sources.readers import table
from lodestone.sources.rules import parse
from lodestone.streaming import pipeline as S

_NAMES = ("a.py", "b.test.js", "c.PNG", "Cargo.lock", ".env", ".env.local", "n.ipynb", "K.class", "app.jar", "m.pyc", "noext", "x.tar.gz", "y.tgz", "z.zip", "q.bz2", "r.gz", "t.tar")
_DIRS = ("src", "tests", "vendor/lib", "build", "Docs", "node_modules/p")
_PATH = "concat(element_at(array({d}), cast(p_partkey % {nd} as int) + 1), '/', element_at(array({n}), cast(p_partkey % {nn} as int) + 1))".format(d=", ".join(f"'{x}'" for x in _DIRS), nd=len(_DIRS), n=", ".join(f"'{x}'" for x in _NAMES), nn=len(_NAMES))
_PATH_SQL = f"[{', '.join(repr(x) for x in _DIRS)}][(p_partkey % {len(_DIRS)})::INT + 1] || '/' || [{', '.join(repr(x) for x in _NAMES)}][(p_partkey % {len(_NAMES)})::INT + 1]"
_BASE = "lower(regexp_extract(path, '[^/]*$'))"
_EXT = "regexp_extract(lower(regexp_extract(path, '[^/]*$')), '^.+\\.([^.]+)$', 1)"


def _paths(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", F.expr(_PATH).alias("path"))


def classify_content(spark, sf_dir):
    raw = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit("\u0000"))).otherwise(F.col("p_name"))
    return _paths(spark, sf_dir).select("p_partkey", C.classify("path", B.latin1(raw)).alias("verdict"))


CLASSIFY_SQL = f"""
WITH p AS (SELECT p_partkey, {_PATH_SQL} AS path FROM part),
f AS (SELECT p_partkey, CASE WHEN regexp_full_match({_BASE}, '\\.env(\\..*)?') THEN 'dotenv' WHEN {_EXT} = 'ipynb' THEN 'ipynb' WHEN {_EXT} = 'class' THEN 'class' WHEN {_EXT} IN ('jar', 'war') THEN 'jar' WHEN {_EXT} = 'pyc' THEN 'pyc' END AS f FROM p)
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN CASE WHEN f IS NULL THEN 'binary' ELSE 'extract:' || f END WHEN f IN ('dotenv', 'ipynb') THEN 'extract:' || f ELSE 'text' END AS verdict FROM f
"""


def path_policy(spark, sf_dir):
    return _paths(spark, sf_dir).groupBy("path").agg(F.count("*").alias("n")).select("path", "n", C.path_class("path").alias("bits"), C.scannable("path").alias("scannable"))


def _in(names) -> str:
    return "(" + ", ".join(f"'{x}'" for x in names) + ")"


_ANY_DIR = "len(list_filter(string_split(lower(path), '/'), lambda d: d IN {}) ) > 0"
PATH_POLICY_SQL = f"""
WITH p AS (SELECT {_PATH_SQL} AS path, count(*) AS n FROM part GROUP BY 1), e AS (SELECT *, {_EXT} AS ext, {_BASE} AS base FROM p),
b AS (SELECT path, n, CASE WHEN ext IN {_in(C.SOURCE_EXT)} AND base NOT IN {_in(C.LOCK_FILES)} THEN 1 ELSE 0 END + CASE WHEN {_ANY_DIR.format(_in(C.TEST_DIRS))} THEN 2 ELSE 0 END + CASE WHEN {_ANY_DIR.format(_in(C.VENDOR_DIRS))} THEN 4 ELSE 0 END + CASE WHEN {_ANY_DIR.format(_in(C.GENERATED_DIRS))} THEN 8 ELSE 0 END
  + CASE WHEN ext IN {_in(C.BINARY_EXT)} THEN 16 ELSE 0 END + CASE WHEN base IN {_in(C.LOCK_FILES)} THEN 64 ELSE 0 END AS known FROM e),
f AS (SELECT path, n, CASE WHEN known = 0 THEN 32 ELSE known END AS bits FROM b)
SELECT path, n, bits, bits & 80 = 0 AS scannable FROM f
"""


def archive_kinds(spark, sf_dir):
    return _paths(spark, sf_dir).select("p_partkey", C.archive_kind("path").alias("kind"))


KINDS_SQL = f"""
WITH p AS (SELECT p_partkey, {_PATH_SQL} AS path FROM part)
SELECT p_partkey, CASE WHEN path LIKE '%.tar.gz' OR path LIKE '%.tgz' THEN 'tar.gz' WHEN path LIKE '%.tar' THEN 'tar' WHEN path LIKE '%.zip' THEN 'zip' WHEN path LIKE '%.gz' THEN 'gzip' WHEN path LIKE '%.bz2' THEN 'bzip2' END AS kind FROM p
"""


def virtual_paths(spark, sf_dir):
    rows = _paths(spark, sf_dir)
    return rows.select("p_partkey", C.virtual_path(F.col("path"), F.concat(F.lit("./a/../"), "p_name", F.lit("\\x")), 40).alias("vpath"))


VPATH_SQL = f"""
WITH p AS (SELECT p_partkey, p_name, {_PATH_SQL} AS path FROM part), f AS (SELECT p_partkey, path || '::' || 'a/' || p_name || '/x' AS f FROM p)
SELECT p_partkey, CASE WHEN octet_length(encode(f)) <= 40 THEN f ELSE substring(f, 1, 22) || '~#' || substring(sha256(f), 1, 16) END AS vpath FROM f
"""


def _packed(spark, sf_dir):
    """A small archive per customer, made of table rows: gzip, zip, tar.gz in turn, some cut short."""
    import io
    import tarfile
    import zipfile

    import pandas as pd

    def pack(parts):
        import gzip

        for pdf in parts:
            out = []
            for k, name in zip(pdf.c_custkey, pdf.c_name, strict=True):
                body, box = f"{name}\n".encode() * 3, io.BytesIO()
                if k % 3 == 0:
                    out.append((f"c{k}.txt.gz", gzip.compress(body)[: 12 if k % 9 == 0 else None]))
                    continue
                if k % 3 == 1:
                    with zipfile.ZipFile(box, "w") as z:
                        z.writestr("one.txt", body)
                        z.writestr("two.txt.gz", gzip.compress(body))
                    out.append((f"c{k}.zip", box.getvalue()))
                    continue
                with tarfile.open(fileobj=box, mode="w:gz") as t:
                    info = tarfile.TarInfo("d/one.txt")
                    info.size = len(body)
                    t.addfile(info, io.BytesIO(body))
                out.append((f"c{k}.tgz", box.getvalue()))
            yield pd.DataFrame(out, columns=["path", "content"])

    return spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name")).mapInPandas(pack, "path string, content binary")


def expand_archives(spark, sf_dir):
    rows = C.expand_archives(_packed(spark, sf_dir))
    return rows.select("path", F.length("content").alias("bytes"), "outcome")


EXPAND_SQL = """
WITH c AS (SELECT c_custkey AS k, 3 * (octet_length(encode(c_name)) + 1) AS n FROM customer)
SELECT CASE WHEN k % 9 = 0 THEN 'c' || k || '.txt.gz' ELSE 'c' || k || '.txt.gz::c' || k || '.txt' END AS path, CASE WHEN k % 9 = 0 THEN NULL ELSE n END AS bytes, CASE WHEN k % 9 = 0 THEN 'corrupt' ELSE 'ok' END AS outcome FROM c WHERE k % 3 = 0
UNION ALL SELECT 'c' || k || '.zip::one.txt', n, 'ok' FROM c WHERE k % 3 = 1
UNION ALL SELECT 'c' || k || '.zip::two.txt.gz::two.txt', n, 'ok' FROM c WHERE k % 3 = 1
UNION ALL SELECT 'c' || k || '.tgz::d/one.txt', n, 'ok' FROM c WHERE k % 3 = 2
"""


def archive_outcomes(spark, sf_dir):
    return C.outcome_counts(C.expand_archives(_packed(spark, sf_dir), budget={"entries": 1}))


OUTCOMES_SQL = "SELECT CASE WHEN c_custkey % 9 = 0 THEN 'corrupt' ELSE 'ok' END AS outcome, count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT 'too_many_entries', count(*) FROM customer WHERE c_custkey % 3 = 1"


def extract_files(spark, sf_dir):
    """.env files and notebooks made of customers."""
    rows = table(spark, sf_dir, "customer").select(
        F.expr("CASE WHEN c_custkey % 2 = 0 THEN concat('c', c_custkey, '/.env') ELSE concat('c', c_custkey, '.ipynb') END").alias("path"),
        F.expr("""CASE WHEN c_custkey % 2 = 0 THEN concat('# note\\nexport NAME="', c_name, '"\\nSEG=', c_mktsegment, ' # x\\nbad line\\n') ELSE concat('{"cells":[{"cell_type":"code","source":["x = 1\\\\n","', c_name, '"]},{"cell_type":"markdown","source":"no"}]}') END""").cast("binary").alias("content"),
    )
    return C.extract(rows)


EXTRACT_SQL = """
SELECT CASE WHEN c_custkey % 2 = 0 THEN 'c' || c_custkey || '/.env' ELSE 'c' || c_custkey || '.ipynb' END AS path, CASE WHEN c_custkey % 2 = 0 THEN 'dotenv' ELSE 'ipynb' END AS format,
  CASE WHEN c_custkey % 2 = 0 THEN 'NAME=' || c_name || chr(10) || 'SEG=' || c_mktsegment ELSE 'x = 1' || chr(10) || c_name END AS text FROM customer
"""


def event_windows(spark, sf_dir):
    rows = S.event_windows(table(spark, sf_dir, "events"))
    return rows.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


EVENT_WINDOWS_SQL = "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"


TOKEN_RULE = """
- name: hex-token
  regex: 'token = "([0-9a-f]{40})"'
  anchors: [token]
  radius: 128
"""


def stream_scan(spark, sf_dir):
    """Documents read as a stream, each with one token line, scanned by one rule; findings and ledger entries merged batch by batch."""
    base, rules = scratch(spark, "stream"), parse(TOKEN_RULE)
    # A glob, since a stream takes no path of a single file: the table is a file or a folder of part files.
    stream = spark.readStream.schema(table(spark, sf_dir, "documents").schema).parquet(f"{sf_dir}/documents.parque[t]")
    line = F.concat(F.lit('\ntoken = "'), F.sha1(F.col("doc_id").cast("string").cast("binary")), F.lit('"\n'))
    items = stream.select(F.lit("t").alias("tenant_id"), F.lit("p").alias("policy_hash"), F.col("doc_id").cast("string").alias("ovid_hash"), F.concat(F.coalesce("text", F.lit("")), line).alias("text"))

    def scan(rows):
        found = D.scan(rows, rules, id_col="ovid_hash").select(F.col("object_id").alias("ovid_hash"), "name", "root_start", "span_start", "span_end", "secret_hash")
        found = stored(found, "found")  # both merges look at it twice
        some = found.groupBy("ovid_hash").agg(F.count("*").cast("int").alias("findings_count"))
        long = lambda x, name: F.lit(x).cast("long").alias(name)
        entries = rows.join(some, "ovid_hash", "left").select("tenant_id", "policy_hash", "ovid_hash", F.when(F.col("findings_count") > 0, 11).otherwise(10).alias("status"), F.octet_length("text").cast("long").alias("bytes_scanned"), F.coalesce("findings_count", F.lit(0)).alias("findings_count"), *[long(1, c) for c in ("run_id", "shard_id", "fence_epoch", "started_at", "finished_at")], F.lit(None).cast("string").alias("error_code"))
        return found, entries

    S.scan_stream(items, scan, base + "/findings", base + "/ledger", base + "/checkpoint", ["ovid_hash", "span_start", "secret_hash"])
    found, done = sinks.read_table(spark, base + "/findings"), sinks.read_table(spark, base + "/ledger")
    both = done.join(found.groupBy("ovid_hash").agg(F.count("*").alias("n"), F.max("span_start").alias("last")), "ovid_hash", "left")
    return both.select(F.col("ovid_hash").cast("long").alias("doc_id"), "status", F.coalesce("n", F.lit(0)).alias("n"), "last", "bytes_scanned")


STREAM_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') || chr(10) || 'token = "' || sha1(doc_id::VARCHAR) || '"' || chr(10) AS t FROM documents),
m AS (SELECT doc_id, t, regexp_extract_all(t, 'token = "[0-9a-f]{40}"') AS w FROM d)
SELECT doc_id, 11 AS status, len(w) AS n, octet_length(encode(t)) - 42 AS last, octet_length(encode(t)) AS bytes_scanned FROM m
"""


def whole_scan(spark, sf_dir):
    """Every document as a file (text, .env, notebook, gzip, binary or lock file in turn), through the whole scan: status and findings of each."""
    import gzip

    names = ("a.txt", ".env", "n.ipynb", "z.gz", "p.png", "go.sum")
    line = F.concat(F.lit('token = "'), F.sha1(F.col("doc_id").cast("string").cast("binary")), F.lit('"'))
    kind = (F.col("doc_id") % len(names)).cast("int")
    plain = F.concat(F.translate(F.coalesce("text", F.lit("")), "\"'\\", "   "), F.lit("\n"), line, F.lit("\n"))
    note = F.concat(F.lit('{"cells":[{"cell_type":"code","source":'), F.to_json(F.struct(line.alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(line.alias("x")))) - 6), F.lit("}]}"))
    body = F.when(kind == 1, F.concat(F.lit("K='"), line, F.lit("'\n"))).when(kind == 2, note).otherwise(plain)
    path = F.concat(F.lit("/d/"), F.col("doc_id").cast("string"), F.lit("/"), F.element_at(F.array(*[F.lit(n) for n in names]), kind + 1))

    def pack(batches):
        for b in batches:
            content = [gzip.compress(c.as_py()) if p.endswith(".gz") else c for p, c in zip(b.column(0).to_pylist(), b.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(content, pa.binary())], names=["path", "content"])

    byte_batches(spark)
    files = table(spark, sf_dir, "documents").where("doc_id is not null").select(path.alias("path"), F.encode(body, "UTF-8").alias("content")).mapInArrow(pack, "path string, content binary")
    findings, ledger = W.scan_files(stored(files, "files"), parse(TOKEN_RULE), depth=1)
    some = findings.groupBy("ovid_hash").agg(F.count_distinct("finding_id").alias("n_found"), F.max("object_id").alias("path"))
    return ledger.join(some, "ovid_hash", "left").groupBy("status", F.regexp_extract("path", "[^/]*$", 0).alias("file")).agg(F.count("*").alias("n_files"), F.sum(F.when(F.col("n_found") > 0, 1).otherwise(0)).alias("n_with"))


WHOLE_SQL = """
SELECT CASE WHEN doc_id % 6 < 4 THEN 11 ELSE 3 END AS status, CASE WHEN doc_id % 6 < 4 THEN ['a.txt', '.env', 'n.ipynb', 'z.gz'][(doc_id % 6)::INT + 1] END AS file, count(*) AS n_files, sum(CASE WHEN doc_id % 6 < 4 THEN 1 ELSE 0 END)::BIGINT AS n_with FROM documents WHERE doc_id IS NOT NULL GROUP BY 1, 2
"""


def source_findings(spark, sf_dir):
    """Findings written as JSON lines and read again."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("concat('f', l_orderkey) AS path", "l_partkey AS start", "l_partkey + 10 AS end", "concat('r', l_suppkey % 7) AS rule", "cast(l_quantity AS int) % 11 AS confidence")
    path = scratch(spark, "jsonl")
    sinks.write_jsonl(rows, path)
    return readers.findings_jsonl(spark, path).where("ok").groupBy("rule").agg(F.count("*").alias("n"), F.sum("start").alias("starts"), F.sum("confidence_score").alias("confidence"))


SOURCE_FINDINGS_SQL = "SELECT 'r' || (l_suppkey % 7) AS rule, count(*) AS n, sum(l_partkey)::BIGINT AS starts, sum(l_quantity::INT % 11)::BIGINT AS confidence FROM lineitem GROUP BY 1"


def source_creddata(spark, sf_dir):
    """Labelled rows written as CSV and read again, some of them bad."""
    line = lambda c: f"CASE WHEN o_orderkey % 10 = 3 THEN 'x' ELSE cast({c} AS string) END"
    rows = table(spark, sf_dir, "orders").selectExpr("cast(o_orderkey AS string) AS Id", "'f' AS FileID", "'d' AS Domain", "'r' AS RepoName", "concat('p', o_custkey) AS FilePath", f"{line('o_custkey')} AS LineStart", "cast(o_custkey + o_orderkey % 5 - 1 AS string) AS LineEnd", "element_at(array('T', 'F', 'X', 'Q'), cast(o_orderkey % 4 AS int) + 1) AS GroundTruth", "'' AS ValueStart", "'' AS ValueEnd", "'' AS CryptographyKey", "'' AS PredefinedPattern", "'Secret:Key' AS Category")
    path = scratch(spark, "creddata")
    rows.write.option("header", "true").csv(path)
    return readers.creddata(spark, path).groupBy("label", "skipped").agg(F.count("*").alias("n"), F.sum("line_start").alias("starts"))


SOURCE_CREDDATA_SQL = """
WITH r AS (SELECT ['positive', 'negative', 'placeholder', NULL][(o_orderkey % 4)::INT + 1] AS label, CASE WHEN o_orderkey % 10 = 3 THEN NULL ELSE o_custkey END AS a, o_custkey + o_orderkey % 5 - 1 AS b FROM orders)
SELECT label, CASE WHEN label IS NULL THEN 'unknown label' WHEN a IS NULL THEN 'bad line' WHEN a < 1 OR b < a THEN 'bad range' END AS skipped, count(*) AS n, sum(a)::BIGINT AS starts FROM r GROUP BY 1, 2
"""

QUERIES = {
    "classify_content": (classify_content, CLASSIFY_SQL),
    "path_policy": (path_policy, PATH_POLICY_SQL),
    "archive_kinds": (archive_kinds, KINDS_SQL),
    "virtual_paths": (virtual_paths, VPATH_SQL),
    "expand_archives": (expand_archives, EXPAND_SQL),
    "archive_outcomes": (archive_outcomes, OUTCOMES_SQL),
    "extract_files": (extract_files, EXTRACT_SQL),
    "event_windows": (event_windows, EVENT_WINDOWS_SQL),
    "stream_scan": (stream_scan, STREAM_SQL),
    "whole_scan": (whole_scan, WHOLE_SQL),
    "source_findings": (source_findings, SOURCE_FINDINGS_SQL),
    "source_creddata": (source_creddata, SOURCE_CREDDATA_SQL),
}
