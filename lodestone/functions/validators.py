"""Offline validators: 'valid', 'invalid' or 'indeterminate' from the secret alone, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.bytespace import col

BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Macaroon header of a package index token: version, field, length, "pypi.org", field.
PYPI_HEADER_HEX = "020108707970692E6F726702"


def verdict(known: Column, valid: Column) -> Column:
    return F.when(~known, "indeterminate").when(valid, "valid").otherwise("invalid")


def base62_value(digits: Column) -> Column:
    """The number that base-62 digits stand for; null for other characters and beyond 32 bits."""
    value = F.aggregate(F.split(digits, ""), F.lit(0).cast("decimal(38,0)"), lambda a, c: (a * 62 + F.instr(F.lit(BASE62), c) - 1).cast("decimal(38,0)"))
    return F.when(digits.rlike(r"^[0-9A-Za-z]+\z") & (value < F.lit(1 << 32)), value.cast("long"))


def _crc(payload: Column) -> Column:
    return F.crc32(F.encode(payload, "ISO-8859-1"))


def crc32_base62(secret: Column | str, prefix_skip: int, payload_len: int, checksum_len: int) -> Column:
    secret = col(secret)
    said = base62_value(F.substring(secret, prefix_skip + payload_len + 1, checksum_len))
    return verdict((F.length(secret) >= prefix_skip + payload_len + checksum_len) & said.isNotNull(), said == _crc(F.substring(secret, prefix_skip + 1, payload_len)))


def github_fine_grained_pat(secret: Column | str) -> Column:
    secret = col(secret)
    said = base62_value(F.substring(secret, 88, 6))
    return verdict((F.length(secret) >= 93) & secret.startswith("github_pat_") & said.isNotNull(), said == _crc(F.substring(secret, 1, 87)))


def grafana_service_account(secret: Column | str) -> Column:
    secret = col(secret)
    digits = F.substring(secret, 39, 8)
    known = (F.length(secret) >= 46) & secret.startswith("glsa_") & (F.substring(secret, 38, 1) == "_") & digits.rlike(r"^[0-9A-Fa-f]{8}\z")
    return verdict(known, F.conv(digits, 16, 10).cast("long") == _crc(F.substring(secret, 1, 37)))


def aws_account_id(suffix: Column) -> Column:
    """The 40 account bits of a key id's base-32 suffix."""
    value = F.aggregate(F.split(F.substring(suffix, 1, 9), ""), F.lit(0).cast("long"), lambda a, c: a * 32 + F.instr(F.lit(BASE32), c) - 1)
    return F.shiftright(value, 4).bitwiseAND(F.lit((1 << 40) - 1))


def aws_access_key(secret: Column | str) -> Column:
    secret = col(secret)
    suffix = F.substring(secret, 5, 16)
    known = (F.length(secret) >= 20) & secret.rlike("^(?:AKIA|ASIA|ABIA|ACCA|A3T[A-Z0-9])")
    return verdict(known, suffix.rlike(r"^[A-Z2-7]{16}\z") & (aws_account_id(suffix) <= 999_999_999_999))


def sentry_org_token(secret: Column | str) -> Column:
    secret = col(secret)
    rest = F.substring(secret, F.lit(8), F.length(secret))
    cut = F.length(rest) - F.length(F.substring_index(rest, "_", -1))
    payload, signature = F.substring(rest, F.lit(1), cut - 1), F.substring_index(rest, "_", -1)
    known = secret.startswith("sntrys_") & F.contains(rest, F.lit("_")) & (F.length(signature) >= 43)
    bad = ~F.substring(signature, 1, 43).rlike(r"^[A-Za-z0-9+/]{43}\z")
    open_ = known & ~bad & ((F.length(payload) == 0) | (F.floor(F.length(payload) * 3 / 4) > 512))
    head = F.unhex(F.hex(F.lit('{"iat":')))
    # Twelve characters hold nine bytes, seven of them are looked at.
    first = F.try_to_binary(F.rpad(F.regexp_replace(F.substring(payload, 1, 12), "=", ""), 12, "A"), F.lit("base64"))
    good = payload.rlike(r"^[A-Za-z0-9+/=]+\z") & (F.length(F.regexp_replace(F.substring(payload, 1, 12), "=", "")) >= 10) & (F.substring(F.hex(first), 1, 14) == F.hex(head))
    return F.when(~known | open_, "indeterminate").when(bad, "invalid").when(F.coalesce(good, F.lit(False)), "valid").otherwise("invalid")


def pypi_token(secret: Column | str) -> Column:
    secret = col(secret)
    body = F.substring(secret, 6, 16)
    header = F.hex(F.try_to_binary(F.translate(body, "-_", "+/"), F.lit("base64")))
    known = (F.length(secret) >= 21) & secret.startswith("pypi-")
    return verdict(known, F.coalesce(body.rlike(r"^[A-Za-z0-9_-]{16}\z") & (header == PYPI_HEADER_HEX), F.lit(False)))


# Token layouts after their prefix; (prefix, enough parts to judge, layout).
SLACK_LAYOUTS = (
    (r"^(?i:xoxe)\.(?i:xoxb|xoxp)-", r"^[^-]*-", r"^[0-9]-[A-Z0-9]{163,166}\z"),
    (r"^xoxp-", r"^(?:[^-]*-){3}", r"^(?:[0-9]{10,13}-){3}[A-Za-z0-9-]{28,34}\z"),
    (r"^xox[os]-", r"^(?:[^-]*-){3}", r"^(?:[0-9]+-){3}[0-9A-Fa-f]+\z"),
    (r"^xox[ar]-", r"^.", r"^(?:[0-9]-)?[A-Za-z0-9]{8,48}\z"),
    (r"^(?i:xapp)-", r"^(?:[^-]*-){3}", r"^[0-9]-[A-Z0-9]+-[0-9]+-[a-z0-9]+(?:-.*)?\z"),
)


def slack_token(secret: Column | str) -> Column:
    secret = col(secret)
    rest = F.substring(secret, F.lit(6), F.length(secret))
    out = F.when(F.length(secret) < 5, "indeterminate")
    for prefix, enough, layout in SLACK_LAYOUTS:
        body = F.regexp_replace(secret, prefix, "")
        out = out.when(secret.rlike(prefix), verdict(body.rlike("(?s)" + enough), body.rlike("(?s)" + layout)))
    bot = rest.rlike(r"^[0-9]{10,13}-[0-9]{10,13}-[A-Za-z0-9-]+\z") | rest.rlike(r"^[0-9]{8,14}-[A-Za-z0-9]{18,26}\z")
    out = out.when(secret.startswith("xoxb-"), F.when(bot, "valid").otherwise("indeterminate"))
    user = verdict(rest.rlike(r"(?s)^(?:[^-]*-){3}"), rest.rlike(r"^(?:[0-9]{10,13}-){3}[A-Za-z0-9-]{28,34}\z"))
    refresh = F.when(rest.rlike(r"^[0-9]-"), F.when(rest.rlike(r"^[0-9]-[A-Z0-9]{146}\z"), "valid").otherwise("invalid")).when(rest.rlike(r"^[0-9]{10,13}-"), user).otherwise("indeterminate")
    return out.when(secret.rlike("^(?i:xoxe)-"), refresh).otherwise("indeterminate")


VALIDATORS = {
    "github_fine_grained_pat": github_fine_grained_pat,
    "grafana_service_account": grafana_service_account,
    "aws_access_key": aws_access_key,
    "sentry_org_token": sentry_org_token,
    "pypi_token": pypi_token,
    "slack_token": slack_token,
}
