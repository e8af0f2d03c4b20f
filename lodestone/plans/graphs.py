"""Queries over commit graphs, trees and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import evaluation as E
from lodestone.operators import gitgraph as G
from lodestone.sources import sinks
from lodestone.sources.readers import table

#: Histories are chains of 32 orders; every sixteenth commit has a second parent.


def _edges(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    first = o.where("o_orderkey % 32 <> 0").selectExpr("o_orderkey AS c", "o_orderkey - 1 AS parent", "0 AS parent_idx")
    second = o.where("o_orderkey % 16 = 7").selectExpr("o_orderkey AS c", "o_orderkey - 5 AS parent", "1 AS parent_idx")
    return first.unionAll(second)


EDGES_SQL = "e AS (SELECT o_orderkey AS c, o_orderkey - 1 AS parent, 0 AS parent_idx FROM orders WHERE o_orderkey % 32 <> 0 UNION ALL SELECT o_orderkey, o_orderkey - 5, 1 FROM orders WHERE o_orderkey % 16 = 7)"


def _tips(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderkey % 32 = 31")
    return o.selectExpr("concat('r', floor(o_orderkey / 32)) AS root", "o_orderkey AS c"), o.where("o_orderkey % 3 <> 0").selectExpr("concat('r', floor(o_orderkey / 32)) AS root", "o_orderkey - CASE WHEN o_orderkey % 5 = 0 THEN 40 ELSE 20 END AS c")


def introduced(spark, sf_dir):
    return G.introduced(_edges(spark, sf_dir).select("c", "parent"), *_tips(spark, sf_dir))


INTRODUCED_SQL = f"""
WITH RECURSIVE {EDGES_SQL},
t AS (SELECT 'r' || (o_orderkey // 32) AS root, o_orderkey AS c FROM orders WHERE o_orderkey % 32 = 31),
m AS (SELECT 'r' || (o_orderkey // 32) AS root, o_orderkey - CASE WHEN o_orderkey % 5 = 0 THEN 40 ELSE 20 END AS c FROM orders WHERE o_orderkey % 32 = 31 AND o_orderkey % 3 <> 0),
n AS (SELECT root, c FROM t UNION SELECT n.root, e.parent FROM n JOIN e ON n.c = e.c),
v AS (SELECT m.root, m.c FROM m JOIN n ON m.root = n.root AND m.c = n.c),
o AS (SELECT root, c FROM v UNION SELECT o.root, e.parent FROM o JOIN e ON o.c = e.c)
SELECT c, min(root) AS root FROM (SELECT root, c FROM n EXCEPT SELECT root, c FROM o) GROUP BY c
"""


def history_walk(spark, sf_dir):
    tips, _ = _tips(spark, sf_dir)
    return G.reach(_edges(spark, sf_dir).where("parent_idx = 0").select("c", "parent"), tips).groupBy("root").agg(F.count("*").alias("commits"), F.min("c").alias("oldest"))


WALK_SQL = "SELECT 'r' || (o_orderkey // 32) AS root, 32 AS commits, o_orderkey - 31 AS oldest FROM orders WHERE o_orderkey % 32 = 31"


def topological(spark, sf_dir):
    return G.topological(table(spark, sf_dir, "orders").selectExpr("o_orderkey % 32 AS generation", "md5(cast(cast(o_orderkey AS string) AS binary)) AS oid"))


TOPO_SQL = "SELECT o_orderkey % 32 AS generation, md5(o_orderkey::VARCHAR) AS oid FROM orders ORDER BY generation, oid"


def merge_parents(spark, sf_dir):
    return G.merge_parents(_edges(spark, sf_dir), "first")


MERGE_SQL = f"WITH {EDGES_SQL} SELECT * FROM e WHERE parent_idx = 0"


def start_refs(spark, sf_dir):
    refs = table(spark, sf_dir, "customer").selectExpr("concat(element_at(array('refs/heads/', 'refs/tags/', 'refs/remotes/', 'refs/notes/'), cast(c_custkey % 4 AS int) + 1), c_name) AS name", "c_custkey AS tip", "c_custkey = 8 AS is_default")
    return G.start_set(refs, "branches_and_tags").select("name", "tip")


START_REFS_SQL = "SELECT ['refs/heads/', 'refs/tags/'][(c_custkey % 4)::INT + 1] || c_name AS name, c_custkey AS tip FROM customer WHERE c_custkey % 4 < 2"


def snapshot_plan(spark, sf_dir):
    refs = table(spark, sf_dir, "customer").selectExpr("concat(element_at(array('refs/heads/', 'refs/tags/', 'refs/remotes/', 'refs/notes/'), cast(c_custkey % 4 AS int) + 1), c_name) AS name", "c_custkey % 9 AS tip", "c_custkey = 8 AS is_default")
    return G.snapshot_plan(refs, "remotes")


SNAPSHOT_SQL = "SELECT 'refs/remotes/' || c_name AS name, c_custkey % 9 AS tip, true AS snapshot_root FROM customer WHERE c_custkey % 4 = 2"


def blob_findings(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_partkey AS oid", "l_linenumber AS root_start", "l_linenumber + 9 AS root_end", "l_suppkey % 3 AS rule_id", "l_returnflag AS secret_hash", "cast(l_quantity AS int) % 11 AS confidence")
    return G.blob_findings(rows)


BLOB_SQL = "WITH o AS (SELECT l_partkey AS oid, l_linenumber, l_suppkey % 3 AS r, l_returnflag AS h, max(l_quantity::INT % 11) AS c FROM lineitem GROUP BY ALL) SELECT oid, count(*) AS n_findings, max(c) AS most, count(DISTINCT h) AS n_secrets FROM o GROUP BY oid"


def diff_history(spark, sf_dir):
    """Candidates of histories of 32 orders: an order's lines are its tree; excluded paths do not introduce; each blob once."""
    commits = _edges(spark, sf_dir).selectExpr("c", "parent", "parent_idx", "c AS topo")
    entries = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS c", "concat(element_at(array('src/', 'vendor/'), cast(l_linenumber % 2 AS int) + 1), l_linenumber, '.c') AS path", "l_partkey % 500 AS oid", "'100644' AS mode").groupBy("c", "path", "mode").agg(F.min("oid").alias("oid"))
    return G.first_introductions(G.diff_candidates(commits, entries, "first"), "^vendor/").select("oid", "topo", "path", "change")


DIFF_SQL = f"""WITH {EDGES_SQL}, n AS (SELECT l_orderkey AS c, ['src/', 'vendor/'][(l_linenumber % 2)::INT + 1] || l_linenumber || '.c' AS path, min(l_partkey % 500) AS oid FROM lineitem GROUP BY 1, 2),
d AS (SELECT n.oid, e.c AS topo, n.path, CASE WHEN o.oid IS NULL THEN 'add' ELSE 'modify' END AS change FROM e JOIN n ON n.c = e.c LEFT JOIN n o ON o.c = e.parent AND o.path = n.path WHERE e.parent_idx = 0 AND (o.oid IS NULL OR o.oid <> n.oid) AND NOT n.path LIKE 'vendor/%')
SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY oid ORDER BY topo, path) = 1"""


def _trees(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    old = li.where("l_linenumber <> 3").selectExpr("concat(l_orderkey, '/', l_linenumber) AS path", "l_partkey AS oid", "CASE WHEN l_partkey % 29 = 0 THEN '160000' ELSE '100644' END AS mode")
    new = li.where("l_linenumber <> 1").selectExpr("concat(l_orderkey, '/', l_linenumber) AS path", "l_partkey + CASE WHEN l_suppkey % 3 = 0 THEN 1 ELSE 0 END AS oid", "CASE WHEN l_partkey % 31 = 0 THEN '160000' ELSE '100644' END AS mode")
    return old, new


TREES_SQL = """o AS (SELECT l_orderkey || '/' || l_linenumber AS path, l_partkey AS oid, CASE WHEN l_partkey % 29 = 0 THEN '160000' ELSE '100644' END AS mode FROM lineitem WHERE l_linenumber <> 3),
n AS (SELECT l_orderkey || '/' || l_linenumber AS path, l_partkey + CASE WHEN l_suppkey % 3 = 0 THEN 1 ELSE 0 END AS oid, CASE WHEN l_partkey % 31 = 0 THEN '160000' ELSE '100644' END AS mode FROM lineitem WHERE l_linenumber <> 1)"""


def tree_diff(spark, sf_dir):
    return G.tree_diff(*_trees(spark, sf_dir))


TREE_DIFF_SQL = f"""WITH {TREES_SQL} SELECT n.path, n.oid, CASE WHEN o.path IS NULL OR o.mode = '160000' THEN 'add' ELSE 'modify' END AS change FROM n LEFT JOIN o ON n.path = o.path
WHERE n.mode <> '160000' AND (o.path IS NULL OR o.mode = '160000' OR o.oid <> n.oid)"""


def _candidates(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr("l_partkey AS oid", "l_orderkey AS topo", "concat(element_at(array('src/', 'vendor/', 'docs/'), cast(l_suppkey % 3 AS int) + 1), l_linenumber, '.c') AS path")


CANDIDATES_SQL = "cd AS (SELECT l_partkey AS oid, l_orderkey AS topo, ['src/', 'vendor/', 'docs/'][(l_suppkey % 3)::INT + 1] || l_linenumber || '.c' AS path FROM lineitem)"


def first_introductions(spark, sf_dir):
    return G.first_introductions(_candidates(spark, sf_dir), "^vendor/")


FIRST_SQL = f"WITH {CANDIDATES_SQL} SELECT * FROM cd WHERE NOT path LIKE 'vendor/%' QUALIFY row_number() OVER (PARTITION BY oid ORDER BY topo, path) = 1"


def unseen_blobs(spark, sf_dir):
    return G.unseen(_candidates(spark, sf_dir), table(spark, sf_dir, "part").where("p_size % 2 = 0").selectExpr("p_partkey AS oid"))


UNSEEN_SQL = f"WITH {CANDIDATES_SQL} SELECT cd.* FROM cd ANTI JOIN (SELECT p_partkey AS oid FROM part WHERE p_size % 2 = 0) s ON cd.oid = s.oid"


def identity_dictionary(spark, sf_dir):
    return G.identities(table(spark, sf_dir, "part").selectExpr("p_name AS author"))


IDENTITIES_SQL = "SELECT p_name AS identity, row_number() OVER (ORDER BY p_name) - 1 AS identity_id FROM (SELECT DISTINCT p_name FROM part)"


def finalize_watermarks(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    marks, tips = o.where("o_orderkey % 3 = 0").selectExpr("o_custkey AS ref", "o_orderkey AS c"), o.selectExpr("o_custkey AS ref", "o_orderkey AS c")
    one = lambda d: d.groupBy("ref").agg(F.max("c").alias("c"))
    return G.finalize(one(marks), one(tips), table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").selectExpr("c_custkey AS ref"))


FINALIZE_SQL = """
WITH m AS (SELECT o_custkey AS ref, max(o_orderkey) AS c FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1), t AS (SELECT o_custkey AS ref, max(o_orderkey) AS c FROM orders WHERE o_custkey % 2 = 0 GROUP BY 1)
SELECT coalesce(m.ref, t.ref) AS ref, coalesce(t.c, m.c) AS c FROM m FULL JOIN t ON m.ref = t.ref
"""

# -- evaluation -----------------------------------------------------------------------------------
_FINDINGS = {"path": "concat('f', l_orderkey % 400)", "start": "l_partkey % 50", "end": "l_partkey % 50 + 10", "rule": "concat('rule-', l_suppkey % 7)", "confidence": "cast(l_quantity AS int) % 11"}


def _findings(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} AS {n}" for n, e in _FINDINGS.items()])


FINDINGS_SQL = "fi AS (SELECT " + ", ".join(f'{e} AS "{n}"' for n, e in _FINDINGS.items()) + " FROM lineitem)"


def dedup_by_rule(spark, sf_dir):
    return E.dedup_by_rule(_findings(spark, sf_dir))


BY_RULE_SQL = f'WITH {FINDINGS_SQL} SELECT path, "start", "end", rule, max(confidence) AS confidence FROM fi GROUP BY ALL'


def dedup_across_rules(spark, sf_dir):
    return E.dedup_across_rules(_findings(spark, sf_dir))


ACROSS_SQL = f'WITH {FINDINGS_SQL} SELECT * FROM fi QUALIFY row_number() OVER (PARTITION BY path, "start", "end" ORDER BY confidence DESC, rule) = 1'


def _truth(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey AS truth_id", "concat('f', o_orderkey % 400) AS path", "o_custkey % 50 AS line_start", "o_custkey % 50 + 2 AS line_end", "CASE o_orderkey % 4 WHEN 0 THEN 'negative' WHEN 1 THEN 'placeholder' ELSE 'positive' END AS label")


def _lined(spark, sf_dir):
    return E.dedup_across_rules(_findings(spark, sf_dir)).withColumns({"f_start": F.col("start") + 0, "f_end": F.col("start") + 1})


def truth_candidates(spark, sf_dir):
    return E.candidates(_lined(spark, sf_dir), _truth(spark, sf_dir)).groupBy("path", "label").agg(F.count("*").alias("pairs"))


CANDIDATE_SQL = f"""WITH {FINDINGS_SQL}, f AS (SELECT * FROM fi QUALIFY row_number() OVER (PARTITION BY path, "start", "end" ORDER BY confidence DESC, rule) = 1),
t AS (SELECT 'f' || (o_orderkey % 400) AS path, o_custkey % 50 AS a, o_custkey % 50 + 2 AS b, CASE o_orderkey % 4 WHEN 0 THEN 'negative' WHEN 1 THEN 'placeholder' ELSE 'positive' END AS label FROM orders)
SELECT f.path, label, count(*) AS pairs FROM f JOIN t ON f.path = t.path AND t.a <= f."start" + 1 AND t.b >= f."start" GROUP BY ALL"""


def greedy_match(spark, sf_dir):
    """Paths of sixteen orders each: findings are their lines, truth items their orders."""
    f = table(spark, sf_dir, "lineitem").selectExpr("concat('f', floor(l_orderkey / 16)) AS path", *[f"{e} AS {n}" for n, e in _FINDINGS.items() if n != "path"])
    f = E.dedup_by_rule(f).withColumns({"f_start": F.col("start") + 0, "f_end": F.col("start") + 1})
    t = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS truth_id", "concat('f', floor(o_orderkey / 16)) AS path", "o_custkey % 50 AS line_start", "o_custkey % 50 + 2 AS line_end", "CASE o_orderkey % 4 WHEN 0 THEN 'negative' WHEN 1 THEN 'placeholder' ELSE 'positive' END AS label", "concat('group:rule-', o_custkey % 3, ':rule-', o_orderkey % 7) AS rule")
    return E.greedy_match(f, t, require_rule_match=False).unionAll(E.greedy_match(f.withColumn("path", F.concat(F.lit("by-rule/"), "path")), t.withColumn("path", F.concat(F.lit("by-rule/"), "path")), require_rule_match=True))


GREEDY_SQL = """
WITH RECURSIVE f0 AS (SELECT 'f' || (l_orderkey // 16) AS path, l_partkey % 50 AS s, l_partkey % 50 + 10 AS e, 'rule-' || (l_suppkey % 7) AS rule, max(l_quantity::INT % 11) AS conf FROM lineitem GROUP BY ALL),
f1 AS (SELECT path, s, e, rule, conf, false AS strict FROM f0 UNION ALL SELECT 'by-rule/' || path, s, e, rule, conf, true FROM f0),
f AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY conf DESC, s, e, rule) AS k FROM f1),
t0 AS (SELECT o_orderkey AS id, 'f' || (o_orderkey // 16) AS path, o_custkey % 50 AS a, o_custkey % 50 + 2 AS b, o_orderkey % 4 AS l, ['group', 'rule-' || (o_custkey % 3), 'rule-' || (o_orderkey % 7)] AS parts FROM orders),
t1 AS (SELECT * FROM t0 UNION ALL SELECT id, 'by-rule/' || path, a, b, l, parts FROM t0),
t AS (SELECT path, list({'id': id, 'a': a, 'b': b, 'l': l, 'parts': parts} ORDER BY a, b, id) AS items FROM t1 GROUP BY path),
c AS (SELECT f.*, list_transform(list_filter(coalesce(items, []), lambda x: x.l >= 2 AND x.a <= s + 1 AND x.b >= s AND (NOT strict OR list_contains(x.parts, rule))), lambda x: x.id) AS pos,
  list_transform(list_filter(coalesce(items, []), lambda x: x.l = 0 AND x.a <= s + 1 AND x.b >= s AND (NOT strict OR list_contains(x.parts, rule))), lambda x: x.id) AS neg FROM f LEFT JOIN t ON f.path = t.path),
w AS (SELECT path, 0::BIGINT AS k, []::BIGINT[] AS used, NULL::BIGINT AS hit FROM (SELECT DISTINCT path FROM f)
  UNION ALL SELECT w.path, c.k, CASE WHEN len(list_filter(c.pos, lambda x: NOT list_contains(w.used, x))) > 0 THEN list_append(w.used, list_filter(c.pos, lambda x: NOT list_contains(w.used, x))[1]) ELSE w.used END,
    list_filter(c.pos, lambda x: NOT list_contains(w.used, x))[1] FROM w JOIN c ON c.path = w.path AND c.k = w.k + 1)
SELECT c.path, c.s AS start, c.e AS "end", c.rule, c.conf AS confidence, CASE WHEN hit IS NOT NULL THEN 'tp' WHEN len(neg) > 0 THEN 'fp' ELSE 'unlabeled' END AS outcome, coalesce(hit, neg[1]) AS truth_id FROM c JOIN w ON c.path = w.path AND c.k = w.k
"""


def _scored(spark, sf_dir):
    """Labelled documents with a score from their text: toxicity as truth, by source."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    rows = rows.select("source", (F.length("text") % 11).alias("confidence"), F.col("quality").alias("is_tp"))
    return rows.withColumn("positives", F.sum("is_tp").over(E.Window.partitionBy("source")))


SCORED_SQL = "sc AS (SELECT source, length(text) % 11 AS confidence, quality AS is_tp, sum(quality) OVER (PARTITION BY source) AS positives FROM documents JOIN labels USING (doc_id))"
CURVE_SQL = f"""{SCORED_SQL}, ti AS (SELECT source, confidence, sum(is_tp) AS tp, count(*) AS n, max(positives) AS p FROM sc GROUP BY ALL),
cu AS (SELECT source, confidence, sum(tp) OVER w / sum(n) OVER w AS "precision", CASE WHEN p = 0 THEN 0 ELSE sum(tp) OVER w / p END AS recall FROM ti WINDOW w AS (PARTITION BY source ORDER BY confidence DESC))"""


def pr_curve(spark, sf_dir):
    return E.pr_curve(_scored(spark, sf_dir), "source").select("source", "confidence", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


PR_SQL = f'WITH {CURVE_SQL} SELECT source, confidence, round("precision", 6) AS "precision", round(recall, 6) AS recall FROM cu'


def average_precision(spark, sf_dir):
    rows = E.average_precision(E.pr_curve(_scored(spark, sf_dir), "source"), "source")
    return rows.select("source", *[F.round(c, 6).alias(c) for c in rows.columns if c != "source"])


AP_SQL = f"""WITH {CURVE_SQL}, g AS (SELECT *, (recall - coalesce(lag(recall) OVER (PARTITION BY source ORDER BY confidence DESC), 0)) * "precision" AS gain FROM cu)
SELECT source, round(sum(gain), 6) AS ap, round(max(CASE WHEN recall >= 0.8 - 1e-12 THEN "precision" END), 6) AS p_at_r80, round(max(CASE WHEN recall >= 0.9 - 1e-12 THEN "precision" END), 6) AS p_at_r90, round(max(CASE WHEN recall >= 0.95 - 1e-12 THEN "precision" END), 6) AS p_at_r95, round(max(CASE WHEN "precision" >= 0.95 - 1e-12 THEN recall END), 6) AS r_at_p95 FROM g GROUP BY source"""


def _classified(spark, sf_dir):
    return _findings(spark, sf_dir).withColumn("outcome", F.expr("CASE WHEN (start + confidence) % 3 = 0 THEN 'fp' WHEN (start + confidence) % 3 = 1 THEN 'tp' ELSE 'unlabeled' END"))


CLASSIFIED_SQL = f"""{FINDINGS_SQL}, cl AS (SELECT *, CASE WHEN ("start" + confidence) % 3 = 0 THEN 'fp' WHEN ("start" + confidence) % 3 = 1 THEN 'tp' ELSE 'unlabeled' END AS outcome FROM fi)"""


def confusion(spark, sf_dir):
    rows = E.confusion(_classified(spark, sf_dir), 100_000_000)
    return rows.select("tp", "fp", "unlabeled", "fn", *[F.round(c, 8).alias(c) for c in ("precision", "recall", "f1", "f2")])


CONFUSION_SQL = f"""WITH {CLASSIFIED_SQL}, c AS (SELECT count(*) FILTER (outcome = 'tp') AS tp, count(*) FILTER (outcome = 'fp') AS fp, count(*) FILTER (outcome = 'unlabeled') AS unlabeled FROM cl), r AS (SELECT *, 100000000 - tp AS fn, tp / (tp + fp) AS p, tp / 100000000 AS r FROM c)
SELECT tp, fp, unlabeled, fn, round(p, 8) AS "precision", round(r, 8) AS recall, round(2 * p * r / (p + r), 8) AS f1, round(5 * p * r / (4 * p + r), 8) AS f2 FROM r"""


def per_rule(spark, sf_dir):
    return E.per_rule(_classified(spark, sf_dir)).select("rule", "tp", "fp", F.round("precision", 6).alias("precision"))


PER_RULE_SQL = f"""WITH {CLASSIFIED_SQL} SELECT rule, count(*) FILTER (outcome = 'tp') AS tp, count(*) FILTER (outcome = 'fp') AS fp, round(count(*) FILTER (outcome = 'tp') / count(*) FILTER (outcome <> 'unlabeled'), 6) AS "precision" FROM cl GROUP BY rule"""


def error_book(spark, sf_dir):
    return E.error_book(_classified(spark, sf_dir), "fp", 5)


ERROR_SQL = f"""WITH {CLASSIFIED_SQL}, n AS (SELECT rule, count(*) AS n FROM cl WHERE outcome = 'fp' GROUP BY rule ORDER BY n DESC, rule LIMIT 5), b AS (SELECT rule, path, "start" FROM cl WHERE outcome = 'fp' QUALIFY row_number() OVER (PARTITION BY rule ORDER BY confidence DESC, "start", path DESC) = 1)
SELECT n.rule, n.n, b.path, b."start" FROM n JOIN b ON n.rule = b.rule"""


def bootstrap(spark, sf_dir):
    counts = E.per_rule(_classified(spark, sf_dir)).selectExpr("rule AS grp", "tp", "fp", "fp AS fn")
    return E.bootstrap_interval(counts)


def _counts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.where("o_custkey % 3 <> 0").groupBy(F.col("o_custkey").alias("path")).agg(F.count("*").alias("expected")), o.where("o_orderkey % 2 = 0").groupBy(F.col("o_custkey").alias("path")).agg(F.count("*").alias("actual"))


def count_comparison(spark, sf_dir):
    return E.count_comparison(*_counts(spark, sf_dir))


COUNT_SQL = """
WITH e AS (SELECT o_custkey AS path, count(*) AS e FROM orders WHERE o_custkey % 3 <> 0 GROUP BY 1), a AS (SELECT o_custkey AS path, count(*) AS a FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1)
SELECT coalesce(e.path, a.path) AS path, least(coalesce(e, 0), coalesce(a, 0)) AS tp, greatest(coalesce(a, 0) - coalesce(e, 0), 0) AS fp, greatest(coalesce(e, 0) - coalesce(a, 0), 0) AS fn FROM e FULL JOIN a ON e.path = a.path
"""


def regression_verdict(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "0.9 + (p_partkey % 7) / 1000.0D AS baseline", "CASE WHEN p_partkey % 23 = 0 THEN double('NaN') ELSE 0.9 - (p_partkey % 40) / 1000.0D END AS current", "CASE WHEN p_partkey % 3 = 0 THEN 0.9 + (p_partkey % 9) / 2000.0D END AS upper")
    return E.regression_verdict(rows).select("p_partkey", "verdict")


VERDICT_SQL = """
WITH r AS (SELECT p_partkey, 0.9::DOUBLE + (p_partkey % 7) / 1000.0::DOUBLE AS b, 0.9::DOUBLE - (p_partkey % 40) / 1000.0::DOUBLE AS c, CASE WHEN p_partkey % 3 = 0 THEN 0.9::DOUBLE + (p_partkey % 9) / 2000.0::DOUBLE END AS u FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 23 = 0 THEN 'block' WHEN u IS NOT NULL AND b <= u THEN 'pass' WHEN b - c >= 0.02::DOUBLE THEN 'block' WHEN b - c >= 0.005::DOUBLE THEN 'warn' ELSE 'pass' END AS verdict FROM r
"""


def rule_delta(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    count = lambda d: d.groupBy(F.concat("event_type", F.lit("-"), (F.col("user_id") % 50).cast("string")).alias("rule")).agg(F.count("*").alias("n"))
    return E.rule_delta(count(e.where("event_id % 2 = 0 AND user_id % 50 < 40")), count(e.where("event_id % 2 = 1 AND user_id % 50 > 10")))


DELTA_SQL = """
WITH a AS (SELECT event_type || '-' || (user_id % 50) AS rule, count(*) AS n FROM events WHERE event_id % 2 = 0 AND user_id % 50 < 40 GROUP BY 1), b AS (SELECT event_type || '-' || (user_id % 50) AS rule, count(*) AS n FROM events WHERE event_id % 2 = 1 AND user_id % 50 > 10 GROUP BY 1)
SELECT coalesce(a.rule, b.rule) AS rule, CASE WHEN a.rule IS NULL THEN 'new' WHEN b.rule IS NULL THEN 'removed' ELSE 'retained' END AS state, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta FROM a FULL JOIN b ON a.rule = b.rule
"""


def corpus_digest(spark, sf_dir):
    return E.corpus_digest(table(spark, sf_dir, "documents"), "doc_id", "text")


CORPUS_SQL = """
WITH d AS (SELECT sha256(doc_id || chr(0) || sha256(text)) AS d FROM documents), b AS (SELECT substring(d, 1, 2) AS b, sha256(array_to_string(list_sort(list(d)), '')) AS d, count(*) AS n FROM d GROUP BY 1)
SELECT sha256(array_to_string(list_sort(list(b || d)), '')) AS digest, sum(n)::BIGINT AS files FROM b
"""


def parity(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    a, b = li.selectExpr("l_partkey % 100 AS k", "l_returnflag AS f"), li.where("l_linenumber <> 2").selectExpr("l_partkey % 100 AS k", "CASE WHEN l_orderkey % 50 = 0 THEN 'X' ELSE l_returnflag END AS f")
    return E.parity(a, b).groupBy("side", "f").agg(F.count("*").alias("n"))


PARITY_SQL = """
WITH a AS (SELECT l_partkey % 100 AS k, l_returnflag AS f FROM lineitem), b AS (SELECT l_partkey % 100 AS k, CASE WHEN l_orderkey % 50 = 0 THEN 'X' ELSE l_returnflag END AS f FROM lineitem WHERE l_linenumber <> 2),
l AS (SELECT * FROM a EXCEPT ALL SELECT * FROM b), r AS (SELECT * FROM b EXCEPT ALL SELECT * FROM a)
SELECT 'left' AS side, f, count(*) AS n FROM l GROUP BY f UNION ALL SELECT 'right', f, count(*) FROM r GROUP BY f
"""


def sink_jsonl(spark, sf_dir):
    return E.dedup_across_rules(_findings(spark, sf_dir)).select(sinks.event_json("fs").alias("line"))


JSONL_SQL = f"""WITH {FINDINGS_SQL}, f AS (SELECT * FROM fi QUALIFY row_number() OVER (PARTITION BY path, "start", "end" ORDER BY confidence DESC, rule) = 1)
SELECT '{{"type":"finding","path":"' || path || '","start":' || "start" || ',"end":' || "end" || ',"rule":"' || rule || '","confidence_score":' || confidence || ',"source":"fs"}}' AS line FROM f"""


def sink_text(spark, sf_dir):
    return E.dedup_across_rules(_findings(spark, sf_dir)).select(sinks.event_text().alias("line"))


TEXT_SQL = f"""WITH {FINDINGS_SQL}, f AS (SELECT * FROM fi QUALIFY row_number() OVER (PARTITION BY path, "start", "end" ORDER BY confidence DESC, rule) = 1)
SELECT path || ':' || "start" || '-' || "end" || ' ' || rule || ' (confidence ' || confidence || ')' AS line FROM f"""


def sink_sarif(spark, sf_dir):
    return sinks.sarif_results(E.dedup_across_rules(_findings(spark, sf_dir))).select("path", "start", F.get_json_object("result", "$.ruleId").alias("rule"), F.get_json_object("result", "$.level").alias("level"))


SARIF_SQL = f"""WITH {FINDINGS_SQL} SELECT path, "start", rule, CASE WHEN confidence >= 7 THEN 'error' WHEN confidence >= 4 THEN 'warning' ELSE 'note' END AS level FROM fi QUALIFY row_number() OVER (PARTITION BY path, "start", "end" ORDER BY confidence DESC, rule) = 1"""


def sink_json_array(spark, sf_dir):
    rows = sinks.json_parts(E.dedup_across_rules(_findings(spark, sf_dir)))
    return rows.select("path", F.size(F.from_json("events", "array<struct<start:long>>")).alias("n"))


JSON_ARRAY_SQL = f"""WITH {FINDINGS_SQL} SELECT path, count(DISTINCT "start")::INT AS n FROM fi GROUP BY path"""

QUERIES = {
    "git_introduced": (introduced, INTRODUCED_SQL),
    "git_history_walk": (history_walk, WALK_SQL),
    "git_topological": (topological, TOPO_SQL),
    "git_merge_parents": (merge_parents, MERGE_SQL),
    "git_start_refs": (start_refs, START_REFS_SQL),
    "git_snapshot_plan": (snapshot_plan, SNAPSHOT_SQL),
    "git_blob_findings": (blob_findings, BLOB_SQL),
    "git_diff_history": (diff_history, DIFF_SQL),
    "git_tree_diff": (tree_diff, TREE_DIFF_SQL),
    "git_first_introductions": (first_introductions, FIRST_SQL),
    "git_unseen_blobs": (unseen_blobs, UNSEEN_SQL),
    "git_identity_dictionary": (identity_dictionary, IDENTITIES_SQL),
    "git_finalize_watermarks": (finalize_watermarks, FINALIZE_SQL),
    "eval_dedup_by_rule": (dedup_by_rule, BY_RULE_SQL),
    "eval_dedup_across_rules": (dedup_across_rules, ACROSS_SQL),
    "eval_truth_candidates": (truth_candidates, CANDIDATE_SQL),
    "eval_greedy_match": (greedy_match, GREEDY_SQL),
    "eval_pr_curve": (pr_curve, PR_SQL),
    "eval_average_precision": (average_precision, AP_SQL),
    "eval_confusion": (confusion, CONFUSION_SQL),
    "eval_per_rule": (per_rule, PER_RULE_SQL),
    "eval_error_book": (error_book, ERROR_SQL),
    "eval_bootstrap": (bootstrap, None),
    "eval_count_comparison": (count_comparison, COUNT_SQL),
    "eval_regression_verdict": (regression_verdict, VERDICT_SQL),
    "eval_rule_delta": (rule_delta, DELTA_SQL),
    "eval_corpus_digest": (corpus_digest, CORPUS_SQL),
    "eval_parity": (parity, PARITY_SQL),
    "sink_jsonl": (sink_jsonl, JSONL_SQL),
    "sink_text": (sink_text, TEXT_SQL),
    "sink_sarif": (sink_sarif, SARIF_SQL),
    "sink_json_array": (sink_json_array, JSON_ARRAY_SQL),
}
