"""Sort modes of the tables and pages by key instead of by offset (SRT-15, SRT-16).

A page is a filter and a top-k: each task sends at most ``size`` rows, whatever
the page's number. Every row carries a cursor, the keys of its place; the page
after it starts behind these keys, so rows that are added or removed elsewhere
neither repeat nor skip any.

Texts are ordered by the root collation of Unicode and missing ones count as
empty; unknown severities weigh 0, missing numbers are 0 and missing moments
are 1970-01-01; a missing expiry comes last in both directions. The ``ids`` end
every order and must identify a row; NULL ids come last.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidewatch.operators.dashboards import _SEVERITY_ORDER, rank_of

# The sort modes of each table; a minus sign turns a term around.
SORT_MODES = {
    "vulnerabilities": {
        "sev-desc": "-severity title", "sev-asc": "severity title", "title-asc": "title", "title-desc": "-title",
        "conf-desc": "-confidence", "date-desc": "-analysis_created_at", "date-asc": "analysis_created_at",
    },
    "developers": {
        "findings-desc": "-total_findings developer", "findings-asc": "total_findings developer", "crit-desc": "-critical_count developer",
        "crit-asc": "critical_count developer", "high-desc": "-high_count developer", "high-asc": "high_count developer",
        "dev-asc": "developer", "dev-desc": "-developer", "date-desc": "-last_activity", "date-asc": "last_activity",
    },
    "suppressions": {
        "created-desc": "-created_at", "created-asc": "created_at", "expires-asc": "expires_at", "expires-desc": "-expires_at",
        "sev-desc": "-severity title", "sev-asc": "severity title", "title-asc": "title", "title-desc": "-title",
    },
    "history": {"severity-desc": "-severity title", "severity-asc": "severity title", "file-asc": "file_path line", "title-asc": "title"},
    "review": {
        "severity-desc": "-severity title", "severity-asc": "severity title", "file-asc": "file_path line",
        "status-open-first": "is_false_positive -severity_name", "title-asc": "title",
    },
    "extraction": {"default": "cwe_id programming_language cve_id hash file_change_id"},
}
_TEXTS = {"title", "developer", "file_path"}
_CODES = {"cwe_id", "programming_language", "cve_id", "hash", "file_change_id"}  # texts compared by code point
_MOMENTS = {"analysis_created_at", "last_activity", "created_at"}
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


@dataclass(frozen=True)
class Key:
    """One sort key. ``raw`` names the column whose own values bound the key, so
    that a reader may skip files by it."""

    value: Column
    descending: bool = False
    collated: bool = False
    raw: str | None = None

    def comparable(self, value: Column) -> Column:
        return F.collate(value, "UNICODE") if self.collated else value

    def order(self) -> Column:
        c = self.comparable(self.value)
        return c.desc_nulls_last() if self.descending else c.asc_nulls_last()

    def behind(self, last: Column) -> Column:
        """The key lies behind a value; NULL lies behind every other one."""
        mine, other = self.comparable(self.value), self.comparable(last)
        further = mine < other if self.descending else mine > other
        return last.isNotNull() & (self.value.isNull() | further)

    def same(self, last: Column) -> Column:
        return self.comparable(self.value).eqNullSafe(self.comparable(last))


def _term(df: DataFrame, term: str) -> list[Key]:
    down, name = term.startswith("-"), term.lstrip("-")
    if name == "severity":
        return [Key(rank_of("severity", _SEVERITY_ORDER), down)]
    if name == "severity_name":
        return [Key(F.coalesce("severity", F.lit("")), down, True)]
    if name == "is_false_positive":
        return [Key(F.coalesce(F.col(name), F.lit(False)), down)]
    kind = df.schema[name].dataType
    if name == "expires_at":
        return [Key(F.col(name).isNull()), Key(F.col(name), down)]
    if name in _MOMENTS:
        return [Key(F.coalesce(F.col(name), F.lit("1970-01-01").cast(kind)), down, raw=name)]
    if name in _TEXTS or name in _CODES:
        return [Key(F.coalesce(F.col(name).cast("string"), F.lit("")), down, name in _TEXTS)]
    if isinstance(kind, StringType):  # a text is no number, so all rows tie
        return []
    if kind.typeName() in ("double", "float"):  # NaN counts as missing, so the column's own order is another one
        return [Key(F.coalesce(F.nanvl(F.col(name), F.lit(0.0).cast(kind)), F.lit(0).cast(kind)), down)]
    return [Key(F.coalesce(F.col(name), F.lit(0).cast(kind)), down, raw=name)]


def sort_keys(df: DataFrame, view: str, mode: str, ids: Sequence[str]) -> list[Key]:
    if mode not in SORT_MODES[view]:
        raise ValueError(f"unknown sort mode of {view}: {mode!r}")
    return [k for term in SORT_MODES[view][mode].split() for k in _term(df, term)] + [Key(F.col(i)) for i in ids]


def ordered(df: DataFrame, view: str, mode: str, ids: Sequence[str]) -> DataFrame:
    """SRT-15: the whole table in a sort mode."""
    return df.orderBy(*[k.order() for k in sort_keys(df, view, mode, ids)])


def page(df: DataFrame, view: str, mode: str, ids: Sequence[str], size: int, after: str | None = None) -> DataFrame:
    """The first ``size`` rows, or those behind a cursor, in order, each with its
    own ``cursor``. A cursor of another view or mode is an error."""
    keys = sort_keys(df, view, mode, ids)
    place = F.struct(*[k.value.alias(f"k{i}") for i, k in enumerate(keys)])
    rows = df
    if after is not None:
        state = json.loads(after)
        if state.get("order") != f"{view}/{mode}":
            raise ValueError(f"the cursor is not one of {view}/{mode}")
        schema = df.select(place.alias("p")).schema["p"].dataType
        last = F.from_json(F.lit(json.dumps(state["keys"])), schema, _JSON)
        rows = df.filter(_bound(keys[0], last["k0"]) & _behind(keys, last))
    top = rows.orderBy(*[k.order() for k in keys]).limit(size)
    return top.withColumn("cursor", F.to_json(F.struct(F.lit(f"{view}/{mode}").alias("order"), place.alias("keys")), {**_JSON, "ignoreNullFields": "false"}))


def _behind(keys: Sequence[Key], last: Column) -> Column:
    """The row comparison: behind in the first key, or equal there and behind in the rest."""
    out = F.lit(False)
    for i in reversed(range(len(keys))):
        out = keys[i].behind(last[f"k{i}"]) | (keys[i].same(last[f"k{i}"]) & out)
    return out


def _bound(key: Key, last: Column) -> Column:
    """What the first key implies for its own column, in a form that readers of
    Parquet understand."""
    if key.raw is None:
        return F.lit(True)
    c = F.col(key.raw)
    return c.isNull() | (c <= last if key.descending else c >= last)
