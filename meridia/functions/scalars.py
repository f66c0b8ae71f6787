"""Scalar functions: keys, hashes, masks, delays and weighted choices."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, for trimming.
SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}([.,]\d+)?(Z|[+-]\d{2}:\d{2})$"

#: Fixed values of retries and parking.
RETRY_BASE_SECONDS = 10
RETRY_MAX_SECONDS = 900
MAX_ATTEMPTS = 5
PARK_AFTER = 10


def trimmed(x: Column) -> Column:
    return F.regexp_replace(F.coalesce(x, F.lit("")), f"^{SPACE}+|{SPACE}+$", "")


def sha256_of(*parts: Column) -> Column:
    """Hex SHA-256 of the parts joined by a bar."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def identity_hash(tenant: Column, namespace: Column, value: Column) -> Column:
    return sha256_of(tenant, namespace, value)


def idempotency_key(tenant: Column, destination: Column, subscription: Column, profile: Column, source: Column, change: Column) -> Column:
    return sha256_of(tenant, destination, subscription, profile, source, change)


def rfc3339(text: Column) -> Column:
    """Timestamp of a full RFC 3339 text, or null."""
    return F.when(text.rlike(RFC3339), F.try_to_timestamp(F.regexp_replace(text, ",", ".")))


def rfc3339_text(ts: Column) -> Column:
    """Seconds precision, UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def retry_delay_seconds(attempt: Column) -> Column:
    """Doubling from RETRY_BASE_SECONDS, at most RETRY_MAX_SECONDS; attempts count from 1."""
    step = F.least(F.greatest(attempt, F.lit(1)) - 1, F.lit(20))
    return F.least(F.lit(RETRY_MAX_SECONDS).cast("long"), (F.lit(RETRY_BASE_SECONDS) * F.pow(F.lit(2.0), step)).cast("long"))


def park_delay_seconds(attempts: Column, base: int, cap: int) -> Column:
    step = F.least(attempts, F.lit(30))
    return F.least(F.lit(cap).cast("long"), (F.lit(base) * F.pow(F.lit(2.0), step)).cast("long"))


def split_target(key: Column, branches: list[tuple[int, int]]) -> Column:
    """Weighted choice by the first eight bytes of SHA-256: branches are (weight, target)."""
    total = sum(w for w, _ in branches)
    point = F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)") % F.lit(total).cast("decimal(20,0)")
    out, reach = None, 0
    for weight, target in branches:
        reach += weight
        out = F.when(point < reach, target) if out is None else out.when(point < reach, target)
    return out


def mask_name(x: Column) -> Column:
    return F.when(x == "", "").otherwise(F.concat(F.substring(x, 1, 1), F.lit("***")))


def mask_email(x: Column) -> Column:
    at = F.instr(x, "@")
    return F.when(at <= 1, mask_name(x)).otherwise(F.concat(F.substring(x, 1, 1), F.lit("***"), F.substring(x, at, F.char_length(x))))


def mask_phone(x: Column) -> Column:
    n = F.char_length(x)
    return (
        F.when(n == 0, "")
        .when(n <= 8, "****")
        .otherwise(F.concat(F.substring(x, 1, 5), F.lit("****"), F.substring(x, n - 2, F.lit(3))))
    )


def mask_identifier(namespace: Column, value: Column) -> Column:
    return (
        F.when(namespace == "email", mask_email(value))
        .when(namespace == "phone", mask_phone(value))
        .otherwise(mask_name(value))
    )


def sealed(value: Column, key: Column) -> Column:
    """AES-GCM, base64 of nonce, cipher text and tag."""
    return F.base64(F.aes_encrypt(value, key, F.lit("GCM")))


def unsealed(value: Column, key: Column) -> Column:
    """The clear text, or null where the key doesn't fit."""
    return F.try_aes_decrypt(F.unbase64(value), key, F.lit("GCM")).cast("string")


def let(x: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(x)`` with ``x`` evaluated once, however often ``fn`` uses it inside lambdas."""
    return F.element_at(F.transform(F.array(x), fn), 1)


def _fnv1a(hexed: Column) -> Column:
    n = F.char_length(hexed).cast("int")
    codes = F.transform(
        F.when(n > 0, F.sequence(F.lit(1), n, F.lit(2))).otherwise(F.array().cast("array<int>")),
        lambda i: F.conv(F.substring(hexed, i, F.lit(2)), 16, 10).cast("long"),
    )
    return F.aggregate(
        codes,
        F.lit(2166136261).cast("long"),
        lambda acc, b: (acc.bitwiseXOR(b) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF)),
    )


def fnv1a_31(data: Column) -> Column:
    """31-bit FNV-1a of a text's UTF-8 bytes."""
    return let(F.hex(F.encode(data, "UTF-8")), _fnv1a).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")
