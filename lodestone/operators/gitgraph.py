"""Commit graphs as edge tables: reachability, tree differences, first introductions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.detect import best_of
from lodestone.shared import stored


def start_set(refs: DataFrame, mode: str, explicit: list[str] | None = None) -> DataFrame:
    """Refs (name, tip, is_default) of a selection: default, remotes, branches_and_tags or explicit."""
    name = F.col("name")
    chosen = {
        "default": F.col("is_default"),
        "remotes": name.startswith("refs/remotes/"),
        "branches_and_tags": name.startswith("refs/heads/") | name.startswith("refs/tags/"),
        "explicit": name.isin(explicit or []),
    }[mode]
    return refs.where(chosen).orderBy("name")


def segments(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(v, head): linear runs of commits, each vertex with the run's first one on the side of the tips.

    A vertex is inside a run if it has one child and is that child's one
    parent; starts (c) always begin a run.  Pointers are doubled, so that the
    rounds follow the logarithm of the longest run.
    """
    children, parents = edges.groupBy("parent").agg(F.count("*").alias("n"), F.min("c").alias("head")).where("n = 1"), edges.groupBy("c").agg(F.count("*").alias("m")).where("m = 1")
    runs = children.join(parents, F.col("head") == F.col("c")).select(F.col("parent").alias("v"), "head").join(starts.select(F.col("c").alias("v")).distinct(), "v", "left_anti")
    runs = stored(runs, "runs")
    while True:
        up = runs.select(F.col("v").alias("head"), F.col("head").alias("_up"))
        step = stored(runs.join(up, "head", "left").select("v", F.coalesce("_up", "head").alias("head"), F.col("_up").isNotNull().alias("moved")), "runs")
        if not step.where("moved").limit(1).count():
            return runs
        runs = step.select("v", "head")


def reach(edges: DataFrame, tips: DataFrame, hops: int = 4) -> DataFrame:
    """Commits that tips (root, c) reach by edges (c, parent): pairs (root, c), tips included.

    Linear runs of commits are shrunk to one vertex first; a round then
    follows up to ``hops`` edges between runs and keeps what is new, so that
    the rounds follow the number of forks and merges on a way, not of commits.
    """
    step = stored(edges.select("c", "parent").distinct(), "parents")
    runs = segments(step, tips)
    inside = runs.select(F.col("v").alias("c"), F.col("head").alias("_head"))
    between = step.join(runs.select(F.col("v").alias("parent")), "parent", "left_anti").join(inside, "c", "left").select(F.coalesce("_head", "c").alias("c"), "parent").distinct()
    between = stored(between, "between")
    frontier = found = stored(tips.select("root", "c").distinct(), "reach")
    while True:
        near, ahead = frontier, None
        for _ in range(hops):
            near = near.join(between, "c").select("root", F.col("parent").alias("c"))
            ahead = near if ahead is None else ahead.unionAll(near)
        frontier = stored(ahead.distinct().join(found, ["root", "c"], "left_anti"), "reach")
        if not frontier.limit(1).count():
            break
        found = found.unionAll(frontier)
    members = found.join(runs, F.col("c") == F.col("head")).select("root", F.col("v").alias("c"))
    return found.unionAll(members)


def introduced(edges: DataFrame, tips: DataFrame, marks: DataFrame) -> DataFrame:
    """Commits of each tip's history that its watermark's history lacks; a commit of two refs comes once.

    A watermark that the tip does not reach does not count.
    """
    # Tips and marks are followed in one walk; marks outside their tip's history are dropped after it.
    tagged = lambda rows, tag: rows.select(F.struct(F.lit(tag).alias("tag"), F.col("root")).alias("root"), "c")
    found = reach(edges, tagged(tips, "new").unionAll(tagged(marks, "old"))).select("root.tag", "root.root", "c")
    new, old = found.where(F.col("tag") == "new").drop("tag"), found.where(F.col("tag") == "old").drop("tag")
    valid = marks.join(new, ["root", "c"], "left_semi").select("root").distinct()
    return new.join(old.join(valid, "root", "left_semi"), ["root", "c"], "left_anti").groupBy("c").agg(F.min("root").alias("root"))


def snapshot_plan(refs: DataFrame, mode: str = "default") -> DataFrame:
    """Every chosen ref's tip, compared with the empty tree: no history, no watermark, a tip of two refs comes twice."""
    return start_set(refs, mode).select("name", "tip", F.lit(True).alias("snapshot_root"))


def blob_findings(found: DataFrame) -> DataFrame:
    """Findings of each blob, once per (root_start, root_end, rule_id, secret_hash), with the greatest confidence, and their number."""
    one = found.groupBy("oid", "root_start", "root_end", "rule_id", "secret_hash").agg(F.max("confidence").alias("confidence"))
    return one.groupBy("oid").agg(F.count("*").alias("n_findings"), F.max("confidence").alias("most"), F.count_distinct("secret_hash").alias("n_secrets"))


def diff_candidates(commits: DataFrame, entries: DataFrame, merges: str = "all") -> DataFrame:
    """Candidates of a history: for every commit and parent the entries that the commit adds or changes.

    commits: (c, parent, parent_idx, topo), parent null for a root commit.
    entries: (c, path, oid, mode), the flat tree of every commit.
    """
    pairs = merge_parents(commits, merges)
    new = pairs.join(entries, "c").select("c", "parent_idx", "topo", "path", "oid", "mode")
    old = pairs.join(entries.withColumnRenamed("c", "parent"), "parent").select("c", "parent_idx", "path", F.col("oid").alias("old_oid"), F.col("mode").alias("old_mode"))
    rows = new.where(F.col("mode") != "160000").join(old, ["c", "parent_idx", "path"], "left")
    was = F.col("old_oid").isNotNull() & (F.col("old_mode") != "160000")
    return rows.where(~was | (F.col("oid") != F.col("old_oid"))).select("c", "parent_idx", "topo", "path", "oid", F.when(was, "modify").otherwise("add").alias("change"))


def topological(commits: DataFrame) -> DataFrame:
    return commits.orderBy("generation", "oid")


def tree_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Entries (path, oid, mode) added or modified on the new side; deletions and gitlinks are left out."""
    a = old.select("path", F.col("oid").alias("old_oid"), F.col("mode").alias("old_mode"))
    rows = a.join(new, "path", "full").where(F.col("oid").isNotNull() & (F.col("mode") != "160000"))
    was = F.col("old_oid").isNotNull() & (F.col("old_mode") != "160000")
    return rows.where(~was | (F.col("oid") != F.col("old_oid"))).select("path", "oid", F.when(was, "modify").otherwise("add").alias("change"))


def merge_parents(candidates: DataFrame, mode: str = "all") -> DataFrame:
    return candidates if mode == "all" else candidates.where(F.col("parent_idx") == 0)


def first_introductions(candidates: DataFrame, excluded: str | None = None) -> DataFrame:
    """Each blob once, where it comes first by (topo, path); excluded paths do not introduce."""
    rows = candidates if excluded is None else candidates.where(~F.col("path").rlike(excluded))
    return best_of(rows, ["oid"], "topo", "path")


def unseen(candidates: DataFrame, seen: DataFrame) -> DataFrame:
    return candidates.join(seen.select("oid").distinct(), "oid", "left_anti")


def identities(commits: DataFrame, name: str = "author") -> DataFrame:
    """A dictionary of names with dense ids in name order, by counts per first characters rather than one window."""
    names = commits.select(F.col(name).alias("identity")).where("identity is not null").distinct().withColumn("_p", F.substring("identity", 1, 3))
    sizes = names.groupBy("_p").agg(F.count("*").alias("_n"))
    base = sizes.withColumn("_base", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).drop("_n")
    return names.join(base, "_p").select("identity", (F.col("_base") + F.row_number().over(Window.partitionBy("_p").orderBy("identity")) - 1).alias("identity_id"))


def finalize(watermarks: DataFrame, tips: DataFrame, complete: DataFrame) -> DataFrame:
    """Watermarks (ref, c) after a run: a tip replaces the old mark only where its ref's run is complete."""
    done = tips.join(complete.select("ref"), "ref", "left_semi").select("ref", F.col("c").alias("_new"))
    return watermarks.join(done, "ref", "full").select("ref", F.coalesce("_new", "c").alias("c"))
