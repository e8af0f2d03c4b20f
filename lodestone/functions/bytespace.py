"""Texts as bytes: a Latin-1 column has one character per byte, so that length, substring and regexp count bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def latin1(text: Column | str) -> Column:
    """A text's UTF-8 bytes, one character each."""
    return F.decode(F.encode(col(text), "UTF-8"), "ISO-8859-1")


def utf8(raw: Column | str) -> Column:
    """The text of a Latin-1 column."""
    return F.decode(F.encode(col(raw), "ISO-8859-1"), "UTF-8")


def java_regex(pattern: str) -> str:
    """A pattern for Java: only \\n ends a line, a bare $ is the very end, named groups become plain ones."""
    import re

    pattern = re.sub(r"\(\?P<\w+>", "(", pattern)
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            out.append(pattern[i : i + 2])
            i += 2
            continue
        if c == "[" and not in_class:
            in_class = True
        elif c == "]" and in_class:
            in_class = False
        out.append("\\z" if c == "$" and not in_class and "(?m)" not in pattern else c)
        i += 1
    return "(?d)" + "".join(out)


def spans(text: Column | str, pattern: Column | str, group: Column | int = 0) -> Column:
    """Array of (match, secret, start): leftmost matches that do not overlap, start in characters of text.

    Offsets come from the pieces between the matches.  Patterns must not match
    the empty string.
    """
    text, pattern = col(text), F.lit(pattern) if isinstance(pattern, str) else pattern
    group = F.lit(group) if isinstance(group, int) else group
    found, inner, gaps = F.regexp_extract_all(text, pattern, F.lit(0)), F.regexp_extract_all(text, pattern, group), F.split(text, pattern, -1)
    ends = lambda a, n: F.aggregate(F.slice(a, F.lit(1), n), F.lit(0), lambda s, x: s + F.length(x))
    one = lambda i: F.struct(
        F.element_at(found, i).alias("match"),
        F.when(F.element_at(inner, i) != "", F.element_at(inner, i)).otherwise(F.element_at(found, i)).alias("secret"),
        (ends(gaps, i) + ends(found, i - 1)).alias("start"),
    )
    return F.when(F.size(found) > 0, F.transform(F.sequence(F.lit(1), F.size(found)), one))


def line_of(text: Column | str, offset: Column) -> Column:
    """The 1-based line of a character offset."""
    head = F.substring(col(text), F.lit(1), offset)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def contains_any(text: Column | str, literals: list[str] | Column) -> Column:
    text = col(text)
    if isinstance(literals, Column):
        return F.exists(literals, lambda x: F.contains(text, x))
    out = F.lit(False)
    for x in literals:
        out = out | F.contains(text, F.lit(x))
    return out


def contains_all(text: Column | str, literals: list[str] | Column) -> Column:
    text = col(text)
    if isinstance(literals, Column):
        return F.forall(literals, lambda x: F.contains(text, x))
    out = F.lit(True)
    for x in literals:
        out = out & F.contains(text, F.lit(x))
    return out
