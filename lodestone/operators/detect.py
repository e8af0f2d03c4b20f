"""Detection: anchors -> windows -> matches -> gates -> score -> dedup.

One narrow pass over the texts in Arrow batches finds anchors (Aho-Corasick),
merges their windows, decodes encoded runs level by level, and matches each
rule's pattern in the windows that pass the window's gates.  It sends on only
what the gates of a match look at.  Those gates, the score and the dedups are
built-in functions; the only shuffles are the dedups.  The rule table rides
along as a broadcast, its size is that of a rule file.
"""

from __future__ import annotations

import binascii
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import bytespace as B
from lodestone.functions import codecs as C
from lodestone.functions import gates as G
from lodestone.functions import validators as V
from lodestone.shared import byte_batches, spread
from lodestone.sources.rules import load, python_regex, rules_df

MERGE_GAP = 64
#: Bytes before the first anchor of a window at which the pattern's search begins.
BACK_SCAN = 64
#: Bytes on either side of a match that its gates may look at, at least.
CONTEXT = 64
FINDINGS_CAP = 8192
TRANSFORMS = ("url", "base64", "utf16")
MODES = ("always", "if_no_findings", "disabled")


def merged(hits: list[tuple], gap: int = MERGE_GAP, most: int | None = None) -> list[tuple]:
    """Sorted windows (start, end, ...), joined where the gap is small; the rest of a tuple is that of its first window.

    With ``most`` the gap doubles (from 128) while there are more: wider
    windows, which see more gates.  There is no such limit by default, so that
    a finding does not depend on what else is in its text.
    """
    out: list[tuple] = []
    for hit in sorted(hits):
        if out and hit[0] <= out[-1][1] + gap:
            out[-1] = (out[-1][0], max(hit[1], out[-1][1]), *out[-1][2:])
        else:
            out.append(hit)
    return merged(out, max(2 * MERGE_GAP, gap * 2), most) if most and len(out) > most else out


def window_islands(hits: DataFrame, keys: list[str], start: str = "w_start", end: str = "w_end", gap: int = MERGE_GAP) -> DataFrame:
    """Merge intervals per key where the gap is at most ``gap``: running maximum, island number, group."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(reach.isNull() | (F.col(start) > F.col("_reach") + gap), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = hits.withColumn("_reach", reach).withColumn("_island", island)
    return rows.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_hits")).drop("_island")


# -- the pass over texts ---------------------------------------------------------------------------

_URL, _BASE64 = re.compile(C.URL_RUN.encode()), re.compile(C.BASE64_RUN.encode())
_SHAPE = re.compile(rb"""[^=:>]*[=:>][ \t"'`=>]*[A-Za-z0-9_.-]{10,}""")
_LOWER = bytes(range(97, 123))
#: Everything that cannot stand in a base64 run becomes a space.
_RUNS = bytes(c if chr(c).isalnum() and c < 128 or c in b"+/_-\r\n\t" else 32 for c in range(256))


@lru_cache(maxsize=4)
def _compiled(text: str) -> tuple:
    """Automata of exact and of case-folded anchors, and each rule with its compiled pattern."""
    import ahocorasick
    import regex

    exact, folded, rules = ahocorasick.Automaton(), ahocorasick.Automaton(), {}
    ids: tuple[dict[str, set[int]], dict[str, set[int]]] = ({}, {})
    for r in json.loads(text):
        rules[r["rule_id"]] = {**r, "rx": regex.compile(python_regex(r["pattern"]).encode("latin-1"), regex.V1)}
        for a in r["anchors"]:
            ids[r["ignore_case"]].setdefault(a.lower() if r["ignore_case"] else a, set()).add(r["rule_id"])
    for found, by in zip((exact, folded), ids, strict=True):
        for literal, of in by.items():
            raw = literal.encode().decode("latin-1")
            found.add_word(raw, (len(raw), tuple(sorted(of))))
        if len(found):
            found.make_automaton()
    return exact, folded, rules


def _windows(buf: bytes, automata: tuple, rules: dict, whole: bool) -> Iterator[tuple[dict, int, int, int]]:
    """(rule, start, end, first anchor) of every merged window of a buffer."""
    raw = buf.decode("latin-1")
    hits: dict[int, list[tuple[int, int, int]]] = {}
    for found, line in zip(automata, (raw, None), strict=True):
        if len(found):
            for end, (n, ids) in found.iter(raw if line is not None else buf.lower().decode("latin-1")):
                for i in ids:
                    r = rules[i]
                    around = (r["seed_radius"] or r["radius"]) if r["confirm_any"] else r["radius"]
                    hits.setdefault(i, []).append((max(0, end + 1 - n - around), min(len(buf), end + 1 + around), end + 1 - n))
    for i, spans in hits.items():
        r = rules[i]
        for a, b, first in [(0, len(buf), 0)] if whole else merged(spans):
            # Two-phase rules look at a seed window first and widen it only if a confirming literal is in it.
            if r["confirm_any"]:
                if not any(x.encode() in buf[a:b] for x in r["confirm_any"]):
                    continue
                more = r["radius"] - (r["seed_radius"] or r["radius"])
                a, b = max(0, a - more), min(len(buf), b + more)
            yield r, a, b, 0 if whole else max(0, first - a - BACK_SCAN)


def window_passes(r: dict, window: bytes) -> bool:
    """The gates of a window: literals that must be in it, keywords, assignment shape, share of a-z."""
    seen = window.lower() if r["ignore_case"] else window
    has = lambda x: (x.lower() if r["ignore_case"] else x).encode() in seen
    if r["must_contain"] and r["must_contain"].encode() not in window:
        return False
    if not all(has(x) for x in r["confirm_all"]) or (r["keywords_any"] and not any(has(x) for x in r["keywords_any"])):
        return False
    if r["assignment_shape"] and not _SHAPE.match(window):
        return False
    lower = len(window) - len(window.translate(None, _LOWER))
    return r["max_lower_pct"] is None or len(window) < (r["min_window_len"] or 0) or lower * 100 <= len(window) * r["max_lower_pct"]


def secret_span(m, group: int | None) -> tuple[int, int]:
    """The rule's group if it is not empty, else the first group that is not, else the whole match."""
    for g in ([group] if group is not None else []) + list(range(1, m.re.groups + 1)):
        if m.end(g) > m.start(g):
            return m.span(g)
    return m.span()


def _base64(run: bytes) -> bytes | None:
    plain = run.translate(bytes.maketrans(b"-_", b"+/"), b"\r\n\t =")
    plain = plain[:-1] if len(plain) % 4 == 1 else plain
    try:
        return binascii.a2b_base64(plain + b"=" * (-len(plain) % 4))
    except binascii.Error:
        return None


def decoded_runs(buf: bytes, transforms: tuple[str, ...]) -> Iterator[tuple[str, int, int, bytes]]:
    """(kind, start, end, bytes) of every encoded run of a buffer; bytes with NULs are read as UTF-16 from either byte on."""
    if "url" in transforms and b"%" in buf:
        for m in _URL.finditer(buf):
            if b"%" in m[0] and (out := unquote_to_bytes(m[0])) != m[0]:
                yield "url", m.start(), m.end(), out
    if "base64" in transforms and max(map(len, buf.translate(_RUNS).split(b" "))) >= 32:
        for m in _BASE64.finditer(buf):
            if len(m[0].translate(None, b"\r\n\t =")) >= 32 and (out := _base64(m[0])):
                yield "base64", m.start(), m.end(), out
    if "utf16" in transforms and b"\0" in buf:
        for order in ("le", "be"):
            for parity in (0, 1):
                body = buf[parity : len(buf) - (len(buf) - parity) % 2]
                yield f"utf16{order}{parity}", 0, len(buf), body.decode(f"utf-16-{order}", "replace").encode("utf-8", "surrogatepass")


_STEP = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_MATCH = pa.struct([
    ("rule_id", pa.int32()), ("steps", pa.list_(_STEP)), ("root_start", pa.int64()), ("root_end", pa.int64()), ("span_start", pa.int64()), ("span_end", pa.int64()),
    ("context", pa.string()), ("at", pa.int32()), ("size", pa.int32()), ("inside", pa.int32()), ("secret", pa.string()),
])
_STEP_TYPE = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_MATCH_TYPE = T.StructType([
    T.StructField("rule_id", T.IntegerType()), T.StructField("steps", T.ArrayType(_STEP_TYPE)), *[T.StructField(c, T.LongType()) for c in ("root_start", "root_end", "span_start", "span_end")],
    T.StructField("context", T.StringType()), *[T.StructField(c, T.IntegerType()) for c in ("at", "size", "inside")], T.StructField("secret", T.StringType()),
])


def found_in(text: bytes, exact, folded, rules: dict, depth: int, transforms: tuple[str, ...], whole: bool, items: int | None, size: int | None) -> tuple[list[dict], int]:
    """The matches of a text and of what is decoded from it, and how many runs a budget left undecoded."""
    out, dropped, n, total = [], 0, 0, 0
    todo = [(text, [])]
    while todo:
        buf, steps = todo.pop()
        for r, a, b, skip in _windows(buf, (exact, folded), rules, whole):
            window = buf[a:b]
            if not window_passes(r, window):
                continue
            for m in r["rx"].finditer(window[skip:]):
                start, end = m.start() + skip, m.end() + skip
                if start == end:
                    continue
                s, e = (x + skip for x in secret_span(m, r["secret_group"]))
                wide = max(CONTEXT, r["lookbehind"] or 0, r["lookahead"] or 0)
                left, right = max(0, start - wide), min(len(window), end + wide)
                root = (steps[0]["start"], steps[0]["end"]) if steps else (a + start, a + end)
                out.append({
                    "rule_id": r["rule_id"], "steps": steps, "root_start": root[0], "root_end": root[1], "span_start": a + s, "span_end": a + e,
                    "context": window[left:right].decode("latin-1"), "at": start - left, "size": end - start, "inside": s - left, "secret": window[s:e].decode("latin-1"),
                })
        if len(steps) < depth:
            for kind, start, end, body in decoded_runs(buf, transforms):
                if (items is not None and n >= items) or (size is not None and total + len(body) > size):
                    dropped += 1
                    continue
                n, total = n + 1, total + len(body)
                todo.append((body, [*steps, {"kind": kind, "start": start, "end": end}]))
    return out, dropped


def matcher(rules: list[dict], binary: bool, depth: int, modes: dict[str, str] | None = None, whole_text: bool = False, items: int | None = None, size: int | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The pass over batches of (object_id, text) that gives object_id, found (array of matches), dropped."""
    modes = {**dict.fromkeys(TRANSFORMS, "always"), **(modes or {})}
    if not set(modes) <= set(TRANSFORMS) or not set(modes.values()) <= set(MODES):
        raise ValueError(f"transforms are {TRANSFORMS}, modes are {MODES}")
    transforms = tuple(t for t in TRANSFORMS if modes[t] != "disabled")
    table = json.dumps(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact, folded, by_id = _compiled(table)
        for batch in batches:
            found, dropped = [], []
            for value in batch.column(1):
                text = value.as_py()
                raw = (text or b"") if binary else (text or "").encode("utf-8", "surrogatepass")
                rows, lost = found_in(raw, exact, folded, by_id, depth, transforms, whole_text, items, size)
                found.append(rows)
                dropped.append(lost)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(_MATCH)), pa.array(dropped, pa.int32())], names=["object_id", "found", "dropped"])

    return run


def matches_schema(object_id: T.StructField) -> T.StructType:
    return T.StructType([object_id, T.StructField("found", T.ArrayType(_MATCH_TYPE)), T.StructField("dropped", T.IntegerType())])


def text_matches(objects: DataFrame, rules: list[dict], id_col: str, text_col: str, depth: int, modes: dict[str, str] | None = None, whole_text: bool = False, items: int | None = None, size: int | None = None) -> DataFrame:
    """object_id, found (array of matches), dropped of every object: one narrow pass."""
    picked = objects.select(F.col(id_col).alias("object_id"), F.col(text_col).alias("text"))
    run = matcher(rules, isinstance(picked.schema["text"].dataType, T.BinaryType), depth, modes, whole_text, items, size)
    byte_batches(objects.sparkSession)
    return spread(picked).mapInArrow(run, matches_schema(picked.schema["object_id"]))


# -- gates of a match ------------------------------------------------------------------------------


def offline_verdict(spec: F.Column, secret: F.Column, rules: list[dict]):
    """The verdict by the rule's validator; null where it has none."""
    out = F.lit(None).cast("string")
    for text in sorted({r["offline"] for r in rules if r["offline"]}):
        kind = json.loads(text)
        if kind["type"] == "crc32_base62":
            value = V.crc32_base62(secret, kind["prefix_skip"], kind["payload_len"], kind["checksum_len"])
        else:
            value = V.VALIDATORS[kind["type"]](secret)
        out = F.when(spec == text, value).otherwise(out)
    return out


def gated(found: DataFrame, rules: list[dict]) -> DataFrame:
    """Matches (joined with their rules) that pass the match gates in order, with their confidence.

    Decoded matches are neither held against the context safelist nor
    validated offline.
    """
    secret, root = F.col("secret"), F.size("steps") == 0
    context = F.when(F.col("ignore_case"), F.lower("context")).otherwise(F.col("context"))
    keywords = F.when(F.col("ignore_case"), F.transform("keywords_any", F.lower)).otherwise(F.col("keywords_any"))
    entropy = F.when(F.col("min_bits").isNotNull(), G.entropy_outcome(secret, F.col("min_bits"), F.col("min_len"), F.col("max_len"), F.col("min_entropy_bits"), F.col("digit_penalty")))
    rows = found.withColumn("entropy", entropy).where(F.coalesce(F.col("entropy") != "failed", F.lit(True)))
    keyword = F.col("keywords_any").isNotNull() & G.keyword_near(context, F.col("at"), F.col("size"), keywords)
    rows = rows.withColumn("keyword", F.coalesce(keyword, F.lit(False)))
    rows = rows.where(F.col("value_suppressors_any").isNull() | ~G.suppressed(secret, F.col("value_suppressors_any")))
    local = G.local_context_passes(F.col("context"), F.col("inside"), F.length("secret"), F.col("lookbehind"), F.col("lookahead"), F.coalesce("same_line_assignment", F.lit(False)), F.coalesce("quoted", F.lit(False)), F.col("key_names"))
    rows = rows.where(F.col("lookbehind").isNull() | local)
    full = F.substring(F.col("context"), F.col("at") + 1, F.col("size"))
    rows = rows.where((~root | ~G.context_safelisted(full)) & ~G.secret_safelisted(secret))
    rows = rows.where(F.col("uuid_format_secret") | ~G.uuid_shaped(secret))
    rows = rows.withColumn("verdict", F.when(root, offline_verdict(F.col("offline"), secret, rules))).where(F.coalesce(F.col("verdict") != "invalid", F.lit(True)))
    score = G.confidence(F.coalesce(F.col("entropy") == "passed", F.lit(False)), F.col("keyword"), F.col("assignment_shape"), F.coalesce(F.col("verdict") == "valid", F.lit(False)))
    return rows.withColumn("confidence", score).where(F.col("confidence") >= F.col("min_confidence"))


def best_of(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    """One row per key: the first in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") == 1).drop("_n")


IN_OBJECT = ["object_id", "rule_id", "root_start", "root_end", "span_start", "span_end"]


def in_object_dedup(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per object, rule, root and span one finding: the deepest decoded, then the most confident.

    Spans of decoded buffers are offsets in their own buffer, so that the root
    is part of the key; scans add the secret's hash and the way of decoding.
    """
    return best_of(rows, keys or IN_OBJECT, F.desc("depth"), F.desc("confidence"))


def cross_rule_dedup(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One finding per place and secret over all rules: higher confidence, then name, then id."""
    return best_of(rows, keys or ["object_id", "root_start", "root_end", "span_start", "span_end", "secret_hash"], F.desc("confidence"), "name", "rule_id")


def capped(rows: DataFrame, keys: list[str], *order, cap: int = FINDINGS_CAP) -> DataFrame:
    """The first cap rows of each key, and how many others there were (dropped)."""
    w = Window.partitionBy(*keys)
    return rows.withColumn("_n", F.row_number().over(w.orderBy(*order))).withColumn("dropped", F.greatest(F.count("*").over(w) - cap, F.lit(0))).where(F.col("_n") <= cap).drop("_n")


def without_skipped(found: DataFrame, kinds: list[str]) -> DataFrame:
    """Findings without those from buffers that transforms of mode if_no_findings would not have decoded.

    Such a transform leaves a buffer alone that has findings of its own.
    """
    if not kinds:
        return found
    has = found.select("object_id", F.col("steps").alias("_buffer")).distinct()
    at = F.filter(F.sequence(F.lit(1), F.size("steps")), lambda i: F.regexp_replace(F.element_at("steps", i.cast("int"))["kind"], "^utf16.*", "utf16").isin(kinds))
    parents = F.transform(F.when(F.size("steps") > 0, at).otherwise(F.array().cast("array<int>")), lambda i: F.slice("steps", F.lit(1), i - 1))
    rows = found.withColumn("_f", F.struct(*[c for c in found.columns if c != "object_id"]))
    held = rows.select("object_id", "steps", F.explode(parents).alias("_buffer")).join(has, ["object_id", "_buffer"], "left_semi").select("object_id", "steps").distinct()
    return found.join(held, ["object_id", "steps"], "left_anti")


FINDING = ["object_id", "rule_id", "name", "root_start", "root_end", "span_start", "span_end", "secret", "secret_hash", "confidence", "verdict", "depth", "steps"]


def scan(objects: DataFrame, rules: list[dict] | None = None, id_col: str = "object_id", text_col: str = "text", depth: int = 1, whole_text: bool = False, modes: dict[str, str] | None = None, items: int | None = None, size: int | None = None) -> DataFrame:
    """Findings of every object (text or binary content).

    depth: how many times encoded runs are decoded and scanned again.
    Findings of decoded buffers carry the run's place in the object as root and
    the way to their buffer as steps.  modes: always, if_no_findings or
    disabled for url, base64 and utf16.  items and size bound the decoded
    buffers and bytes of an object (``undecoded`` counts what they leave out);
    there is no bound unless one is given.
    """
    rules = rules or load()
    return findings(text_matches(objects, rules, id_col, text_col, depth, modes, whole_text, items, size), rules, modes)


def findings(matches: DataFrame, rules: list[dict], modes: dict[str, str] | None = None) -> DataFrame:
    """Findings of the matches that text_matches has found: gates, score, dedups."""
    rows = matches.where(F.size("found") > 0).select("object_id", F.explode("found").alias("m")).select("object_id", "m.*")
    rows = gated(rows.join(F.broadcast(rules_df(matches.sparkSession, rules)), "rule_id"), rules)
    rows = rows.withColumn("depth", F.size("steps")).withColumn("secret_hash", F.sha2(F.encode("secret", "ISO-8859-1"), 256)).select(*FINDING)
    rows = without_skipped(rows, [t for t, m in (modes or {}).items() if m == "if_no_findings"])
    way = F.array_join(F.transform("steps", lambda s: s["kind"]), "/")
    return cross_rule_dedup(in_object_dedup(rows.withColumn("_way", way), [*IN_OBJECT, "secret_hash", "_way"]).drop("_way"))


def undecoded(objects: DataFrame, rules: list[dict] | None = None, id_col: str = "object_id", text_col: str = "text", depth: int = 3, items: int | None = 256, size: int | None = 512 << 10) -> DataFrame:
    """Objects in which a decode budget leaves runs out, and how many."""
    return text_matches(objects, rules or load(), id_col, text_col, depth, None, False, items, size).where("dropped > 0").select("object_id", "dropped")
