"""Fingerprints and keyed hashes (TXT-15..19, AGR-29)."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions.text import col, normalize_path, strip, text_or


def _sha(parts: list[Column], sep: str = ":") -> Column:
    return F.sha2(F.concat_ws(sep, *parts), 256)


def _low(c) -> Column:
    return F.lower(strip(c))


def fingerprint_v1(repository, rule, cwe, path) -> Column:
    """TXT-15: repository-scoped hash of rule, class and path."""
    return F.left(_sha([
        _low(text_or(repository, "default")),
        _low(text_or(rule, "unknown")),
        _low(F.coalesce(col(cwe), F.lit(""))),
        F.lower(F.replace(strip(F.coalesce(col(path), F.lit(""))), F.lit("\\"), F.lit("/"))),
    ]), F.lit(32))


def fingerprint_v2(repository, path, rule, category, scope, sink, occurrence) -> Column:
    """TXT-16: line-resilient hash. Scope and sink keep their case; a numeric
    ``:line`` suffix of the path is dropped."""
    p = F.replace(strip(text_or(path, "unknown")), F.lit("\\"), F.lit("/"))
    cat = F.coalesce(col(category), F.lit(""))
    rule_value = F.coalesce(F.nullif(col(rule), F.lit("")), F.nullif(cat, F.lit("")), F.lit("unknown"))
    return F.left(_sha([
        _low(text_or(repository, "default")),
        F.lower(F.regexp_replace(p, ":[0-9]+$", "")),
        _low(rule_value),
        _low(cat),
        text_or(strip(F.coalesce(col(scope), F.lit(""))), "<module>"),
        text_or(strip(F.coalesce(col(sink), F.lit(""))), "unknown"),
        F.coalesce(col(occurrence).try_cast("int"), F.lit(0)).cast("string"),
    ]), F.lit(32))


def inline_fingerprint(path, rule, cwe, scope, sink, title, discriminator) -> Column:
    """TXT-17: hash that ties an inline comment to a finding."""
    return F.left(_sha([
        F.lower(normalize_path(path)),
        _low(text_or(rule, "unknown")),
        _low(F.coalesce(col(cwe), F.lit(""))),
        text_or(strip(F.coalesce(col(scope), F.lit(""))), "<module>"),
        strip(F.coalesce(col(sink), F.lit(""))),
        _low(F.coalesce(col(title), F.lit(""))),
        text_or(col(discriminator).cast("string"), "0"),
    ]), F.lit(16))


def joined_hash(*parts, size: int = 64, sep: str = "|") -> Column:
    """TXT-18: hash over separator-joined fields."""
    return F.left(_sha([F.coalesce(col(p).cast("string"), F.lit("")) for p in parts], sep), F.lit(size))


def set_digest(values: Column) -> Column:
    """AGR-29: hash of the sorted distinct values of an array."""
    return F.left(F.sha2(F.array_join(F.array_sort(F.array_distinct(values)), ","), 256), F.lit(16))


def signature_valid(body, signature, secret: str) -> Column:
    """TXT-19: ``sha256=<hex>`` signature check. The keyed hash is two nested
    hashes over the key's two pads, which are literals."""
    key = secret.encode()
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\x00")
    inner, outer = (F.unhex(F.lit(bytes(b ^ x for b in block).hex())) for x in (0x36, 0x5C))
    want = F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, col(body).cast("binary")), 256))), 256)
    present = F.coalesce(col(body), F.lit("")) != ""
    return F.coalesce(F.lit(bool(key)) & present & (col(signature) == F.concat(F.lit("sha256="), want)), F.lit(False))
