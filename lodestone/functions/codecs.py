"""Decoding passes over texts: URL-percent, base64 and UTF-16 spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.bytespace import col, spans

URL_RUN = r"[A-Za-z0-9%+\-._~:/?#\[\]@!$&'()*,;=]{16,65536}"
BASE64_RUN = r"[A-Za-z0-9+/_-][A-Za-z0-9+/_\-\r\n\t]{30,}={0,2}"


def _first(found: Column, most: int | None) -> Column:
    return found if most is None else F.slice(found, 1, most)


def url_spans(text: Column | str, plus_too: bool = False, most: int | None = None) -> Column:
    """All runs (the first ones if most is given) of URL characters that hold a % (or +): (match, secret, start)."""
    found = spans(text, URL_RUN)
    return _first(F.filter(found, lambda s: s["match"].rlike("[%+]" if plus_too else "%")), most)


def url_decode(raw: Column | str) -> Column:
    """%HH becomes that byte (a Latin-1 character), whatever else stays as it is."""
    pieces = F.split(col(raw), "(?=%[0-9A-Fa-f]{2})")
    one = lambda p: F.when(p.rlike("^%[0-9A-Fa-f]{2}"), F.concat(F.decode(F.unhex(F.substring(p, 2, 2)), "ISO-8859-1"), F.substring(p, F.lit(4), F.length(p)))).otherwise(p)
    return F.array_join(F.transform(pieces, one), "")


def base64_spans(text: Column | str, least: int = 32, most: int | None = None) -> Column:
    """All runs (the first ones if most is given) of base64 characters of a length: (match, secret, start)."""
    return _first(F.filter(spans(text, BASE64_RUN), lambda s: F.length(F.regexp_replace(s["match"], r"[\s=]", "")) >= least), most)


def base64_decode(raw: Column | str) -> Column:
    """Bytes of standard or URL-safe base64 with white space; null if it is none."""
    plain = F.regexp_replace(F.translate(col(raw), "-_", "+/"), r"[\s=]", "")
    whole = F.when(F.length(plain) % 4 == 1, F.substring(plain, F.lit(1), F.length(plain) - 1)).otherwise(plain)
    padded = F.rpad(whole, F.ceil(F.length(whole) / 4).cast("int") * 4, F.lit("="))
    return F.try_to_binary(padded, F.lit("base64"))


def utf16_decode(content: Column | str, big_endian: bool = False, parity: int = 0) -> Column:
    """Bytes read as UTF-16 from the first or second byte on; bad units become U+FFFD."""
    content = col(content)
    body = F.substring(content, F.lit(1 + parity), F.floor((F.length(content) - parity) / 2).cast("int") * 2)
    return F.decode(body, "UTF-16BE" if big_endian else "UTF-16LE")
