"""Rule tables: YAML of rules becomes rows of a small table."""

from __future__ import annotations

import hashlib
import json
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from lodestone.functions.bytespace import java_regex

BUILTIN = Path(__file__).with_name("rules.yaml")
RULE_SCHEMA = """rule_id int, name string, regex string, n_groups int, secret_group int, anchors array<string>, radius int,
 must_contain string, keywords_any array<string>, value_suppressors_any array<string>,
 min_bits double, min_len int, max_len int, min_entropy_bits double, digit_penalty boolean,
 max_lower_pct int, min_window_len int, confirm_any array<string>, seed_radius int,
 lookbehind int, lookahead int, same_line_assignment boolean, quoted boolean, key_names array<string>,
 offline string, ignore_case boolean, uuid_format_secret boolean, assignment_shape boolean, min_confidence int"""
#: Shannon thresholds from which the character-class gate is on unless a rule says otherwise.
AUTO_CHAR_CLASS_BITS = 3.0


def parse(text: str) -> list[dict]:
    """Rules as rows; unknown fields are ignored, a missing name or regex is an error."""
    import yaml

    rows = []
    for i, r in enumerate(yaml.safe_load(text) or []):
        if not r.get("name") or not r.get("regex"):
            raise ValueError(f"rule {i} needs a name and a regex")
        entropy, chars, local, two = r.get("entropy") or {}, r.get("char_class") or {}, r.get("local_context") or {}, r.get("two_phase") or {}
        bits = entropy.get("min_bits_per_byte")
        if not chars and bits is not None and bits >= AUTO_CHAR_CLASS_BITS:
            chars = {"max_lower_pct": 95, "min_window_len": 32}
        groups = re.sub(r"\(\?P<\w+>", "(", r["regex"])
        keywords, shape = r.get("keywords_any"), bool(r.get("assignment_shape"))
        least = r.get("min_confidence")
        if least is None:
            least = 3 if keywords and bits is not None else 2 if shape else 0
        rows.append({
            "rule_id": i, "name": r["name"], "pattern": r["regex"], "regex": java_regex(r["regex"]), "n_groups": len(re.findall(r"(?<!\\)\((?!\?)", groups)),
            "secret_group": r.get("secret_group"), "anchors": list(map(str, r.get("anchors") or [])), "radius": r.get("radius", 256),
            "must_contain": r.get("must_contain"), "keywords_any": keywords, "value_suppressors_any": r.get("value_suppressors_any"),
            "min_bits": bits, "min_len": entropy.get("min_len", 1), "max_len": entropy.get("max_len", 256),
            "min_entropy_bits": entropy.get("min_entropy_bits_per_byte"), "digit_penalty": bool(entropy.get("digit_penalty")),
            "max_lower_pct": chars.get("max_lower_pct"), "min_window_len": chars.get("min_window_len"),
            "confirm_any": two.get("confirm_any"), "seed_radius": two.get("seed_radius"),
            "lookbehind": local.get("lookbehind"), "lookahead": local.get("lookahead"),
            "same_line_assignment": local.get("require_same_line_assignment"), "quoted": local.get("require_quoted"), "key_names": local.get("key_names_any"),
            "ignore_case": bool(r.get("ignore_case")), "confirm_all": mandatory_literals(r["regex"], bool(r.get("ignore_case"))),
            "offline": json.dumps(r["offline_validation"], sort_keys=True) if r.get("offline_validation") else None,
            "uuid_format_secret": bool(r.get("uuid_format_secret")), "assignment_shape": shape, "min_confidence": least,
        })
    return rows


def python_regex(pattern: str) -> str:
    """A pattern for the matching pass: a bare $ and \\z are the very end."""
    ends = re.sub(r"(\\.)|(\[\^?\]?(?:\\.|[^\]\\])*\])|(\$)", lambda m: "\\Z" if m[1] == "\\z" or (m[3] and "(?m)" not in pattern) else m[0], pattern, flags=re.S)
    return ends


def mandatory_literals(pattern: str, ignore_case: bool = False, least: int = 3) -> list[str]:
    """Literals of three characters or more that every match holds; none where the pattern is beyond this parser.

    Patterns that ignore case have such literals only if the rule does too:
    they are compared in lower case then.
    """
    parser = re._parser
    try:
        tree = parser.parse(re.sub(r"\\z", r"\\Z", pattern))
    except (re.error, OverflowError):
        return []
    if not ignore_case and "(?i" in pattern:
        return []
    out: list[str] = []

    def walk(items, run: str) -> str:
        for op, arg in items:
            name = str(op)
            if name == "LITERAL" and arg < 128:
                run += chr(arg)
                continue
            if name == "SUBPATTERN":
                run = walk(arg[-1], run)
                continue
            out.append(run)
            run = ""
            if name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] > 0:
                out.append(walk(arg[2], ""))
        return run

    out.append(walk(tree, ""))
    return sorted({x for x in out if len(x) >= least})


def load(path: str | Path | None = None) -> list[dict]:
    return parse(Path(path or BUILTIN).read_text(encoding="utf-8"))


def rules_df(spark: SparkSession, rules: list[dict] | None = None) -> DataFrame:
    names = [x.split()[0] for x in RULE_SCHEMA.replace("\n", " ").split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in (rules or load())], RULE_SCHEMA)


def rules_digest(rules: list[dict]) -> str:
    """Order does not matter."""
    return hashlib.sha256("\n".join(sorted(json.dumps(r, sort_keys=True) for r in rules)).encode()).hexdigest()
