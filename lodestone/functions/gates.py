"""Gates of the detection pipeline as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.bytespace import col, contains_any, java_regex

# Patterns of matches that are no secrets, by their context.
CONTEXT_SAFELIST = (
    r"(?i)\b(?:placeholder|dummy|fake|sample|example|test)[-_ ]{0,3}(?:key|token|secret|password)\b|\b(?:key|token|secret|password)[-_ ]{0,3}(?:placeholder|dummy|fake|sample|example|test)\b",
    r"\bAKIA[0-9A-Z]{9}EXAMPLE\b",
    r"\*{3,}",
    r"[:=]\s*(?:\$\{[A-Za-z_][A-Za-z0-9_]*\}|\$[A-Za-z_][A-Za-z0-9_]*)",
    r"(?i)\$\((?:openssl|uuidgen)\b[^)]*\)",
    r"(?i)[:=]\s*(?:null|changeme|todo|fixme)\b",
    r"(?i)\bhunter2\b",
    r"(?i)\b(?:0123456789|abcdefghij)\b",
    r"""(?i)\b(?:classpath:[^\s"'`]+|xsi:schemaLocation\b|xmlns(?::[A-Za-z0-9_-]+)?=)""",
    r"(?:\$\{[A-Za-z_][A-Za-z0-9_]*\}|\{\{[A-Za-z_][A-Za-z0-9_]*\}\})",
    r"""(?i)\b(?:https?|ssh)://(?:localhost|(?:[A-Za-z0-9-]+\.)*example(?:\.[A-Za-z]{2,})?)(?::\d+)?(?:/[^\s"']*)?""",
    r"(?i)(?:<\s*/?\s*(?:secret|token|password)\s*>|(?:secretmanager|vault)://|secret(?:manager)?[:=])",
    r"(?i)\b(?:for example|sample config|example config)\b",
    r"(?i)\b(?:INSERT[_\s-]?YOUR|REPLACE[_\s-]?WITH)[A-Z0-9_\s-]*\b",
    r"(?:ZXhhbXBsZQ==|c2FtcGxl={0,2}|dGVzdA==)",
    r"(?m)^(?:<{7}|={7}|>{7})(?: .*)?$",
    r"(?i)\b(?:__tests?__|fixtures?|mocks?)\b",
    r"(?i)\b(?:sha(?:1|224|256|384|512)|md5)\s*[:=]\s*[A-Fa-f0-9]{8,}\b",
)
# Patterns of extracted values that are no secrets.
SECRET_SAFELIST = (
    r"(?i)^(?:placeholder|dummy|fake|sample|example|test)[-_ ]{0,3}(?:key|token|secret|password)$|^(?:key|token|secret|password)[-_ ]{0,3}(?:placeholder|dummy|fake|sample|example|test)$",
    r"^AKIA[0-9A-Z]{9}EXAMPLE$",
    r"\*{3,}",
    r"(?i)^(?:null|changeme|todo|fixme)$",
    r"(?i)^hunter2$",
    r"(?i)^(?:0123456789|abcdefghij)$",
    r"(?:\$\{[A-Za-z_][A-Za-z0-9_]*\}|\{\{[A-Za-z_][A-Za-z0-9_]*\}\})",
    r"(?i)^(?:INSERT[_\s-]?YOUR|REPLACE[_\s-]?WITH)[A-Z0-9_\s-]*$",
    r"(?:ZXhhbXBsZQ==|c2FtcGxl={0,2}|dGVzdA==)",
)
UUID = r"^[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}$"
#: Bits taken from the entropy of a value of digits only, over log2 of its length.
DIGIT_PENALTY = 1.2


def _counts(value: Column) -> Column:
    chars = F.split(value, "")
    return F.transform(F.array_distinct(chars), lambda k: F.size(F.filter(chars, lambda z: z == k)))


def shannon(value: Column | str) -> Column:
    """Bits per character: log2 n minus the mean of log2 of the counts; 0 for the empty value."""
    value = col(value)
    n = F.length(value)
    spread = F.aggregate(_counts(value), F.lit(0.0), lambda a, c: a + c * F.log2(c.cast("double")))
    return F.when(n > 0, F.log2(n.cast("double")) - spread / n).otherwise(F.lit(0.0))


def min_entropy(value: Column | str) -> Column:
    value = col(value)
    n = F.length(value)
    return F.when(n > 0, F.log2(n.cast("double")) - F.log2(F.array_max(_counts(value)).cast("double"))).otherwise(F.lit(0.0))


def entropy_outcome(value: Column | str, min_bits: Column | float, min_len: Column | int, max_len: Column | int, min_entropy_bits: Column | float | None = None, digit_penalty: Column | bool = False) -> Column:
    """'bypassed' (shorter than min_len), 'failed' or 'passed', of the first max_len characters."""
    value = col(value)
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    head = F.substring(value, F.lit(1), lit(max_len))
    n = F.length(head)
    penalty = F.when(lit(digit_penalty) & head.rlike(r"^[0-9]+\z") & (n > 1), F.lit(DIGIT_PENALTY) / F.log2(n.cast("double"))).otherwise(F.lit(0.0))
    failed = shannon(head) - penalty < lit(min_bits)
    if min_entropy_bits is not None:
        failed = failed | F.coalesce(min_entropy(head) < lit(min_entropy_bits).cast("double"), F.lit(False))
    return F.when(F.length(value) < lit(min_len), "bypassed").when(failed, "failed").otherwise("passed")


def char_class_passes(window: Column | str, max_lower_pct: Column | int = 95, min_window_len: Column | int = 32) -> Column:
    """No more than so many of 100 characters are a-z; short windows pass."""
    window = col(window)
    n = F.length(window)
    return (n < min_window_len) | (F.length(F.regexp_replace(window, "[^a-z]", "")) * 100 <= n * max_lower_pct)


def assignment_shape(window: Column | str) -> Column:
    """The first separator is followed by a token of ten characters or more."""
    return col(window).rlike("""^[^=:>]*[=:>][ \\t"'`=>]*[A-Za-z0-9_.-]{10,}""")


def uuid_shaped(secret: Column | str) -> Column:
    return col(secret).rlike(java_regex(UUID))


def safelisted(value: Column | str, patterns: tuple[str, ...]) -> Column:
    """Any pattern matches; one alternation, flags stay inside their own group."""
    return col(value).rlike("|".join(f"(?:{java_regex(p)})" for p in patterns))


def context_safelisted(full_match: Column | str) -> Column:
    return safelisted(full_match, CONTEXT_SAFELIST)


def secret_safelisted(secret: Column | str) -> Column:
    return safelisted(secret, SECRET_SAFELIST)


def suppressed(secret: Column | str, literals: list[str] | Column) -> Column:
    return contains_any(secret, literals)


def keyword_near(text: Column, start: Column, length: Column, keywords: list[str] | Column, radius: int = 32) -> Column:
    """A keyword lies within radius bytes of the match."""
    left = F.greatest(start - radius, F.lit(0))
    return contains_any(F.substring(text, left + 1, start + length + radius - left), keywords)


def line_bounds(text: Column, start: Column, lookbehind: Column | int, lookahead: Column | int) -> tuple[Column, Column]:
    """Part of the secret's line before it, and whether both line ends were in reach."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    left = F.greatest(start - lookbehind, F.lit(0))
    before = F.substring(text, left + 1, start - left)
    after = F.substring(text, start + 1, lit(lookahead))
    known = F.contains(before, F.lit("\n")) & F.contains(after, F.lit("\n"))
    return F.substring_index(before, "\n", -1), known


def local_context_passes(text: Column, start: Column, length: Column, lookbehind: Column | int = 256, lookahead: Column | int = 128, same_line_assignment: Column | bool = True, quoted: Column | bool = False, key_names: Column | list[str] | None = None) -> Column:
    """Quoting, an assignment before the secret on its line, a key name there; unknown bounds pass."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    l, r = F.substring(text, start, F.lit(1)), F.substring(text, start + length + 1, F.lit(1))
    ok = ~lit(quoted) | (start == 0) | (r == "") | (l.isin("'", '"', "`") & (l == r))
    line, known = line_bounds(text, start, lookbehind, lookahead)
    on_line = ~lit(same_line_assignment) | line.rlike("[=:>]")
    if isinstance(key_names, Column):
        on_line = on_line & (key_names.isNull() | contains_any(line, key_names))
    elif key_names:
        on_line = on_line & contains_any(line, key_names)
    return ok & (~known | on_line)


def confidence(entropy_passed: Column, keyword: Column, shape_rule: Column, offline_valid: Column) -> Column:
    """+1 measured entropy, +2 keyword near by, +2 assignment-shape rule, +5 valid checksum; 0 to 10."""
    score = F.when(entropy_passed, 1).otherwise(0) + F.when(keyword, 2).otherwise(0) + F.when(shape_rule, 2).otherwise(0) + F.when(offline_valid, 5).otherwise(0)
    return F.least(F.greatest(score, F.lit(0)), F.lit(10))


def least_confidence(explicit: Column, has_keywords: Column, has_entropy: Column, shape_rule: Column) -> Column:
    """Explicit, else 3 for keyword and entropy, else 2 for assignment shape, else 0."""
    return F.coalesce(explicit, F.when(has_keywords & has_entropy, 3).when(shape_rule, 2).otherwise(0))
