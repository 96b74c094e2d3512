"""Filters shared by the analytics (FLT-01..09, SRT-10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Window names and their length in days.
WINDOW_DAYS = {"7d": 7, "30d": 30, "90d": 90, "all": None}
DEFAULT_WINDOW = "30d"
# Author spellings that mean "nobody".
PLACEHOLDER_AUTHORS = ["none", "null", "unknown", ""]


def window_days(window: str | None) -> int | None:
    """FLT-01: resolve a window name; blank means the default, junk is an error."""
    name = (window or DEFAULT_WINDOW).strip().lower() or DEFAULT_WINDOW
    if name not in WINDOW_DAYS:
        raise ValueError(f"unsupported time window: {window!r}")
    return WINDOW_DAYS[name]


def in_window(df: DataFrame, window: str | None, now: str, column: str = "created_at") -> DataFrame:
    """FLT-02: ``created_at >= now - N days``. The bound is a literal, so the
    comparison reaches the Parquet scan as a pushed filter."""
    days = window_days(window)
    if days is None:
        return df
    kind = df.schema[column].dataType.typeName()
    cutoff = F.lit(now).cast(kind) - F.expr(f"INTERVAL {days} DAYS")
    return df.filter(F.col(column) >= cutoff)


def clamp_limit(limit: int | None, default: int = 20, cap: int = 100) -> int:
    """SRT-10: missing or non-positive limits become the default, large ones the cap."""
    return default if limit is None or int(limit) <= 0 else min(cap, int(limit))


def _present(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def repo_id(owner: str = "owner", repository: str = "repository") -> Column:
    """FLT-06: ``owner/name`` when both exist, else whichever exists, else 'default'."""
    o, r = _present(F.col(owner)), _present(F.col(repository))
    return F.coalesce(F.concat(o, F.lit("/"), r), r, o, F.lit("default"))


def repo_matches(target: str, owner: str = "owner", repository: str = "repository") -> Column:
    """FLT-03: case-insensitive substring of ``owner/name`` or of ``name``.
    The name is a substring of the pair, so with both parts present one test is enough."""
    t = F.lit(target.strip().lower())
    o, r = _present(F.lower(owner)), _present(F.lower(repository))
    return F.coalesce(F.coalesce(F.concat(o, F.lit("/"), r), r).contains(t), F.lit(False))


def repo_matches_developer(target: str, owner: str = "owner", repository: str = "repository") -> Column:
    """FLT-04: as above, but a bare owner is a candidate too."""
    t = F.lit(target.strip().lower())
    o, r = _present(F.lower(owner)), _present(F.lower(repository))
    return F.coalesce(F.coalesce(F.concat(o, F.lit("/"), r), r, o).contains(t), F.lit(False))


def repo_equals(target, column: str = "repository_id") -> Column:
    """FLT-05: exact match, ignoring case."""
    return F.lower(F.col(column).cast("string")) == F.lit(str(target).strip().lower())


def clean_author(author: str = "author") -> Column:
    """FLT-07: trimmed author, NULL for placeholders."""
    a = F.trim(F.col(author))
    return F.when(~F.lower(a).isin(PLACEHOLDER_AUTHORS), a)


def suppression_live(now: str, status: str = "status", expires: str = "expires_at", kind: str = "timestamp_ntz") -> Column:
    """FLT-08 on a native timestamp: ACTIVE and not yet past its expiry."""
    exp = F.col(expires)
    return (F.upper(status) == "ACTIVE") & (exp.isNull() | (exp > F.lit(now).cast(kind)))


def suppression_live_iso(now: str, status: str = "status", expires: str = "expires_at") -> Column:
    """FLT-08 on ISO text: blank means no expiry; zone-less or malformed text fails closed."""
    raw = F.trim(F.col(expires))
    zoned = raw.rlike(r"(?i)(z|[+-]\d{2}:?\d{2}(:?\d{2})?)$")
    parsed = F.when(zoned, F.try_to_timestamp(raw))
    alive = F.when(F.col(expires).isNull() | (F.col(expires) == ""), F.lit(True)).otherwise(
        F.coalesce(parsed > F.lit(now).cast("timestamp"), F.lit(False))
    )
    return F.coalesce(F.upper(status) == "ACTIVE", F.lit(False)) & alive


def completed(status: str = "status") -> Column:
    """FLT-09."""
    return F.col(status).isin("success", "completed")
