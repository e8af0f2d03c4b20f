"""Evaluation of findings against labelled truth."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.detect import best_of

EPS = 1e-12
BLOCK_DROP, WARN_DROP = 0.02, 0.005


def normalised_path(path: Column, root: str = "") -> Column:
    clean = F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/(?:\\./)+", "/"), "^\\./", "")
    return F.regexp_replace(clean, f"^{root.rstrip('/')}/", "") if root else clean


def dedup_by_rule(findings: DataFrame) -> DataFrame:
    return findings.groupBy("path", "start", "end", "rule").agg(F.max("confidence").alias("confidence"))


def dedup_across_rules(findings: DataFrame) -> DataFrame:
    return best_of(findings, ["path", "start", "end"], F.desc("confidence"), "rule")


def candidates(findings: DataFrame, truth: DataFrame) -> DataFrame:
    """Findings with the truth items whose lines they overlap, per path."""
    return findings.join(truth, "path").where((F.col("line_start") <= F.col("f_end")) & (F.col("line_end") >= F.col("f_start")))


MATCHED = "path string, start long, end long, rule string, confidence int, outcome string, truth_id long"


def greedy_match(findings: DataFrame, truth: DataFrame, require_rule_match: bool = False) -> DataFrame:
    """Classify findings (path, start, end, rule, confidence, f_start, f_end): tp, fp or unlabeled.

    Most confident first, then by place and rule, each finding takes the first
    positive truth item (truth_id, path, line_start, line_end, label, rule)
    whose lines it overlaps and that no other has taken: tp.  Without one it
    is fp where it overlaps a negative item, else unlabeled; placeholders and
    taken items do not count.  With require_rule_match only items count whose
    rule, or one of its parts between colons, is the finding's.

    What is matched depends only on lines that overlap: a path's lines are cut
    where neither findings nor truth go on, and the pieces are matched apart.
    """
    none = lambda t: F.lit(None).cast(t)
    f = findings.select("path", F.col("f_start").cast("long").alias("a"), F.col("f_end").cast("long").alias("b"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("rule").cast("string").alias("rule"), F.col("confidence").cast("int").alias("confidence"), F.lit(0).alias("kind"), none("long").alias("truth_id"))
    rule = F.col("rule").cast("string") if "rule" in truth.columns else none("string")
    kind = F.when(F.col("label") == "positive", POSITIVE).otherwise(NEGATIVE)
    t = truth.where(F.col("label").isin("positive", "negative")).select("path", F.col("line_start").cast("long").alias("a"), F.col("line_end").cast("long").alias("b"), none("long").alias("start"), none("long").alias("end"), (rule if require_rule_match else none("string")).alias("rule"), none("int").alias("confidence"), kind.alias("kind"), F.col("truth_id").cast("long").alias("truth_id"))
    order = Window.partitionBy("path").orderBy("a", "b")
    reach = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = f.where(F.col("start").isNotNull()).unionAll(t).withColumn("_new", F.when(reach.isNull() | (F.col("a") > reach), 1).otherwise(0))
    rows = rows.withColumn("island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # Islands pass through one after the other: a task holds those of a batch.  The windows have left the rows in this
    # order, so that nothing is dealt or sorted again.
    dealt = rows.sortWithinPartitions("path", "a", "b")
    return dealt.select("path", "island", "a", "b", "start", "end", "rule", "confidence", "kind", "truth_id").mapInArrow(lambda batches: matched(batches, require_rule_match), MATCHED)


POSITIVE, NEGATIVE = 1, 2
_MATCHED = pa.schema([("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("rule", pa.string()), ("confidence", pa.int32()), ("outcome", pa.string()), ("truth_id", pa.int64())])
_LEAST, _MOST = -(2**63), 2**63 - 1


def _starts(rows: pa.RecordBatch | pa.Table) -> np.ndarray:
    """Row numbers at which another (path, island) begins, the first row left out."""
    path, island = pc.fill_null(pc.cast(pc.index_in(rows["path"], pc.unique(rows["path"])), pa.int64()), -1), rows["island"]
    path, island = np.asarray(path), np.asarray(island)
    return np.flatnonzero((path[1:] != path[:-1]) | (island[1:] != island[:-1])) + 1


def matched(batches: Iterator[pa.RecordBatch], require_rule_match: bool) -> Iterator[pa.RecordBatch]:
    """Findings of whole islands with their outcomes; rows come by path and island."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cuts = _starts(batch)
        fresh = bool(held) and [held[-1][c][-1].as_py() for c in ("path", "island")] != [batch[c][0].as_py() for c in ("path", "island")]
        cut = int(cuts[-1]) if len(cuts) else 0
        if cut or fresh:
            yield from judged(pa.Table.from_batches([*held, batch.slice(0, cut)]), require_rule_match)
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield from judged(pa.Table.from_batches(held), require_rule_match)


def judged(rows: pa.Table, require_rule_match: bool) -> Iterator[pa.RecordBatch]:
    """The findings among rows of whole islands, each with its outcome and item."""
    n = rows.num_rows
    number = lambda c, null: np.asarray(pc.fill_null(rows[c], null))
    island = np.zeros(n, np.int64)
    island[_starts(rows)] = 1
    island = np.cumsum(island)
    # Null lines meet nothing.
    a, b, kind = number("a", _MOST), number("b", _LEAST), number("kind", 0)
    truth_id, rule = number("truth_id", _LEAST), rows["rule"].to_pylist() if require_rule_match else None
    names = pc.unique(rows["rule"])
    rank = np.empty(len(names) + 1, np.int64)
    rank[np.asarray(pc.sort_indices(names))], rank[-1] = np.arange(len(names)), -1
    rank = rank[np.asarray(pc.fill_null(pc.index_in(rows["rule"], names), len(names)))]
    own = kind == 0
    first = lambda x, y: np.where(own, x, y)
    # Findings: most confident first, then by place and rule; items: by lines and id.  Items stand before the findings of their island.
    last, mid = first(number("end", 0), truth_id), first(number("start", 0), b)
    order = np.lexsort((first(rank, 0), last, mid, first(-(number("confidence", -(2**31)).astype(np.int64)), a), own, island))
    outcome, item = np.zeros(n, np.int8), np.zeros(n, np.int64)
    hit: dict[int, tuple[int, int]] = {}
    at, free, negative = -1, [], []
    for i, of, k, x, y in zip(order.tolist(), island[order].tolist(), kind[order].tolist(), a[order].tolist(), b[order].tolist(), strict=True):
        if of != at:
            at, free, negative = of, [], []
        if k:
            (free if k == POSITIVE else negative).append((x, y, i, (rule[i] or "").split(":") if rule else None))
            continue
        for q, (u, v, j, parts) in enumerate(free):
            if u <= y and v >= x and (parts is None or rule[i] in parts):
                hit[i] = (POSITIVE, j)
                del free[q]
                break
        else:
            for u, v, j, parts in negative:
                if u <= y and v >= x and (parts is None or rule[i] in parts):
                    hit[i] = (NEGATIVE, j)
                    break
    if hit:
        where = np.fromiter(hit, np.int64, len(hit))
        found = np.array(list(hit.values()), np.int64)
        outcome[where], item[where] = found[:, 0], found[:, 1]
    findings = np.flatnonzero(own)
    kinds = pa.array(["unlabeled", "tp", "fp"]).take(pa.array(outcome[findings]))
    items = rows["truth_id"].take(pa.array(item[findings], mask=outcome[findings] == 0))
    picked = rows.select(["path", "start", "end", "rule", "confidence"]).take(pa.array(findings))
    yield from pa.Table.from_arrays([*picked.columns, kinds, items], schema=_MATCHED).to_batches()


def confusion(classified: DataFrame, positives: int | Column) -> DataFrame:
    """tp, fp, unlabeled, fn, precision, recall, f1, f2; ratios of nothing are 0."""
    total = positives if isinstance(positives, Column) else F.lit(positives)
    out = classified.agg(F.count_if(F.col("outcome") == "tp").alias("tp"), F.count_if(F.col("outcome") == "fp").alias("fp"), F.count_if(F.col("outcome") == "unlabeled").alias("unlabeled"))
    out = out.withColumn("fn", total - F.col("tp"))
    return with_ratios(out)


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def with_ratios(counts: DataFrame) -> DataFrame:
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    rows = counts.withColumns({"precision": p, "recall": r})
    beta = lambda b: ratio((1 + b * b) * F.col("precision") * F.col("recall"), b * b * F.col("precision") + F.col("recall"))
    return rows.withColumns({"f1": beta(1.0), "f2": beta(2.0)})


def pr_curve(scored: DataFrame, group: str, confidence: str = "confidence", positive: str = "is_tp", total: str = "positives") -> DataFrame:
    """One point per group and distinct confidence, most confident first; ties are one point."""
    ties = scored.groupBy(group, confidence).agg(F.sum(F.col(positive).cast("long")).alias("tp"), F.count("*").alias("n"), F.max(total).alias("positives"))
    run = Window.partitionBy(group).orderBy(F.desc(confidence)).rowsBetween(Window.unboundedPreceding, 0)
    rows = ties.withColumns({"cum_tp": F.sum("tp").over(run), "cum_n": F.sum("n").over(run)})
    return rows.select(group, confidence, ratio(F.col("cum_tp"), F.col("cum_n")).alias("precision"), ratio(F.col("cum_tp"), F.col("positives")).alias("recall"))


def average_precision(curve: DataFrame, group: str, confidence: str = "confidence") -> DataFrame:
    """Area, precision at recalls .8 .9 .95 and recall at precision .95 of each group's curve."""
    before = F.coalesce(F.lag("recall").over(Window.partitionBy(group).orderBy(F.desc(confidence))), F.lit(0.0))
    rows = curve.withColumn("_gain", (F.col("recall") - before) * F.col("precision"))
    at = [F.max(F.when(F.col("recall") >= t - EPS, F.col("precision"))).alias(f"p_at_r{int(t * 100)}") for t in (0.8, 0.9, 0.95)]
    return rows.groupBy(group).agg(F.sum("_gain").alias("ap"), *at, F.max(F.when(F.col("precision") >= 0.95 - EPS, F.col("recall"))).alias("r_at_p95"))


def per_rule(classified: DataFrame) -> DataFrame:
    rows = classified.groupBy("rule").agg(F.count_if(F.col("outcome") == "tp").alias("tp"), F.count_if(F.col("outcome") == "fp").alias("fp"))
    return rows.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp")))


def bootstrap_interval(histogram: DataFrame, iterations: int = 1000, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """Interval of F1 per group from (grp, tp, fp, fn): counts are resampled, positives and findings apart.

    A group is one row of counts, so that resampling needs no rows.
    """

    def run(rows):
        for part in rows:
            out = []
            for r in part.itertuples(index=False):
                rng = np.random.default_rng([seed, *str(r.grp).encode()])
                pos = r.tp + r.fn
                tp = rng.binomial(pos, r.tp / pos, iterations) if pos else np.zeros(iterations)
                found = r.tp + r.fp
                fp = rng.binomial(found, r.fp / found, iterations) if found else np.zeros(iterations)
                f1 = np.sort(2 * tp / np.maximum(1, tp + fp + pos))
                out.append((r.grp, float(f1[int(np.floor(alpha / 2 * iterations))]), float(f1[min(iterations - 1, int(np.ceil((1 - alpha / 2) * iterations)) - 1)])))
            yield pd.DataFrame(out, columns=["grp", "lower", "upper"])

    return histogram.select(F.col("grp").cast("string").alias("grp"), "tp", "fp", "fn").mapInPandas(run, "grp string, lower double, upper double")


def count_comparison(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Per path tp, fp, fn from (path, expected) and (path, actual); files on one side count in full."""
    e, a = F.coalesce("expected", F.lit(0)), F.coalesce("actual", F.lit(0))
    return expected.join(actual, "path", "full").select("path", F.least(a, e).alias("tp"), F.greatest(a - e, F.lit(0)).alias("fp"), F.greatest(e - a, F.lit(0)).alias("fn"))


def regression_verdict(rows: DataFrame) -> DataFrame:
    """pass, warn or block from baseline, current and the upper end of current's interval (null: none)."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    b, c, u = (F.col(x) for x in ("baseline", "current", "upper"))
    drop = b - c
    verdict = F.when(~finite(b) | ~finite(c), "block").when(u.isNotNull() & (b <= u), "pass").when(drop >= BLOCK_DROP, "block").when(drop >= WARN_DROP, "warn").otherwise("pass")
    return rows.withColumn("verdict", verdict)


def rule_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    a, b = before.select("rule", F.col("n").alias("n_before")), after.select("rule", F.col("n").alias("n_after"))
    state = F.when(F.col("n_before").isNull(), "new").when(F.col("n_after").isNull(), "removed").otherwise("retained")
    return a.join(b, "rule", "full").select("rule", state.alias("state"), (F.coalesce("n_after", F.lit(0)) - F.coalesce("n_before", F.lit(0))).alias("delta"))


def error_book(classified: DataFrame, outcome: str, top: int = 20) -> DataFrame:
    """The rules with most errors of a kind, each with its most confident case."""
    rows = classified.where(F.col("outcome") == outcome)
    best = F.max_by(F.struct("path", "start"), F.struct("confidence", (-F.col("start")).alias("s"), "path"))
    return rows.groupBy("rule").agg(F.count("*").alias("n"), best.alias("_b")).orderBy(F.desc("n"), "rule").limit(top).select("rule", "n", F.col("_b.path").alias("path"), F.col("_b.start").alias("start"))


def redacted_context(text: Column, start: Column, end: Column, key: str, radius: int = 64) -> Column:
    """The text around a finding with a keyed hash in place of the secret."""
    left = F.greatest(start - radius, F.lit(0))
    secret = F.substring(text, start + 1, end - start)
    tag = F.substring(F.sha2(F.concat(F.lit(key), F.lit(":"), secret), 256), 1, 16)
    return F.concat(F.substring(text, left + 1, start - left), F.lit("[redacted:"), tag, F.lit("]"), F.substring(text, end + 1, F.lit(radius)))


def corpus_digest(files: DataFrame, path: str, content: str, group: int = 4096) -> DataFrame:
    """One digest of all (path, content), whatever their order: digests by leading hex digits, then of those, level by level.

    There are so many levels that a group holds some ``group`` digests.
    """
    one = F.sha2(F.concat_ws("\u0000", F.col(path).cast("string"), F.sha2(F.col(content).cast("string"), 256)), 256)
    count, digits = files.count(), 2
    while count > group * 16**digits:
        digits += 2
    rows = files.select(one.alias("d"), F.lit(1).cast("long").alias("n"))
    rows = rows.groupBy(F.substring("d", 1, digits).alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ""), 256).alias("d"), F.sum("n").alias("n"))
    for width in range(digits - 2, -1, -2):
        rows = rows.groupBy(F.substring("b", 1, width).alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("b", "d"))), ""), 256).alias("d"), F.sum("n").alias("n"))
    return rows.agg(F.coalesce(F.max("d"), F.sha2(F.lit(""), 256)).alias("digest"), F.sum("n").alias("files"))


def parity(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one side that the other lacks, with the side's name; repeats count."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))
