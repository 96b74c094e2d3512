"""Read-only analytics over analyses, findings and suppressions (AGR-01..07)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import predicates as P
from tidewatch.operators.ranking import beside

SEVERITIES = ["critical", "high", "medium", "low", "info"]
GATES = ["allow", "block", "review"]


def severity_counts(severity: str | Column = "severity") -> list[Column]:
    sev = F.lower(severity)
    return [F.count_if(sev == s).alias(f"{s}_count") for s in SEVERITIES]


def gate_counts(status: str = "review_status") -> list[Column]:
    gate = F.lower(status)
    known = F.coalesce(gate.isin(GATES), F.lit(False))
    return [F.count_if(gate == g).alias(f"{g}_count") for g in GATES] + [F.count_if(~known).alias("unknown_count")]


def _sum(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0)).alias(name)


def findings_per_analysis(findings: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """One row per analysis: finding counters (AGR-02). Partial aggregation
    shrinks the rows before the shuffle. With ``selected`` the findings are
    first cut down by a semi join, which Spark broadcasts when it is small."""
    rows = findings.select("analysis_id", "severity")
    if selected is not None:
        rows = rows.join(selected.select("analysis_id"), "analysis_id", "left_semi")
    return rows.groupBy("analysis_id").agg(F.count(F.lit(1)).alias("finding_count"), *severity_counts())


def severity_histogram(findings: DataFrame) -> DataFrame:
    """AGR-02, whole table."""
    return findings.groupBy(F.lower("severity").alias("severity")).agg(F.count(F.lit(1)).alias("n"))


def repository_analytics(
    analyses: DataFrame, findings: DataFrame, now: str, window: str = "30d", limit: int | None = 20
) -> DataFrame:
    """AGR-05 / SRT-04: risk per repository; repositories without findings stay."""
    sel = P.in_window(analyses, window, now).select(
        "analysis_id", "created_at", "review_status", P.repo_id().alias("repository_id")
    )
    per = findings_per_analysis(findings, None if P.window_days(window) is None else sel)
    out = (
        sel.join(per, "analysis_id", "left")
        .groupBy("repository_id")
        .agg(
            F.count(F.lit(1)).alias("analysis_count"),
            _sum("finding_count"),
            *[_sum(f"{s}_count") for s in SEVERITIES],
            *gate_counts(),
            F.max("created_at").alias("last_analysis_at"),
        )
    )
    return first_rows(out, [
        F.desc("critical_count"), F.desc("high_count"), F.desc("finding_count"), F.desc("analysis_count"),
        F.lower("repository_id"), "repository_id",
    ], limit)


def vulnerability_analytics(
    analyses: DataFrame, findings: DataFrame, now: str, window: str = "30d", repository: str | None = None, limit: int | None = 20
) -> DataFrame:
    """AGR-04 / SRT-03: findings per category with severity columns."""
    sel = P.in_window(analyses, window, now)
    if repository:
        sel = sel.filter(P.repo_matches(repository))
    rows = findings.select("analysis_id", "category", "severity")
    if repository or P.window_days(window) is not None:
        rows = rows.join(sel.select("analysis_id"), "analysis_id", "left_semi")
        grouped = rows
    else:
        # every analysis qualifies: count per (analysis, category) before the join
        pre = rows.groupBy("analysis_id", "category", F.lower("severity").alias("severity")).agg(F.count(F.lit(1)).alias("_n"))
        grouped = pre.join(sel.select("analysis_id"), "analysis_id", "left_semi")
    n = F.col("_n") if "_n" in grouped.columns else F.lit(1)
    sev = F.lower("severity")
    out = grouped.groupBy(F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit("General Security")).alias("category")).agg(
        F.sum(n).cast("long").alias("finding_count"),
        *[F.sum(F.when(sev == s, n).otherwise(0)).cast("long").alias(f"{s}_count") for s in SEVERITIES],
    )
    return first_rows(out, [
        F.desc("finding_count"), F.desc("critical_count"), F.desc("high_count"), F.desc("medium_count"),
        F.lower("category"), "category",
    ], limit)


def developer_analytics(
    analyses: DataFrame, now: str, window: str | None = None, repository: str | None = None, limit: int | None = 20
) -> DataFrame:
    """AGR-06 / SRT-05: per author, sums of the stored summary counters
    (``finding_count`` and ``*_count`` columns), not of finding rows."""
    sel = P.in_window(analyses, window, now) if window else analyses
    if repository:
        sel = sel.filter(P.repo_matches_developer(repository))
    repo = F.nullif(P.repo_id(), F.lit("default"))
    sel = sel.withColumn("developer", P.clean_author()).filter("developer IS NOT NULL").withColumn("_repo", repo)
    gate = F.lower("review_status")
    out = sel.groupBy("developer").agg(
        F.count(F.lit(1)).alias("total_analyses"),
        F.sum(F.coalesce("finding_count", F.lit(0))).alias("total_findings"),
        *[F.sum(F.coalesce(f"{s}_count", F.lit(0))).alias(f"{s}_count") for s in SEVERITIES[:4]],
        *[F.count_if(gate == g).alias(f"{g}_count") for g in ("block", "review", "allow")],
        F.max("created_at").alias("last_activity"),
    )
    order = [
        F.desc("critical_count"), F.desc("high_count"), F.desc("total_findings"), F.desc("total_analyses"),
        F.lower("developer"), "developer",
    ]
    top = first_rows(out, order, limit)
    # repositories are gathered for the developers that are shown only
    pairs = sel.select("developer", "_repo").filter("_repo IS NOT NULL").join(top.select("developer"), "developer", "left_semi").distinct()
    repos = pairs.groupBy("developer").agg(F.array_join(F.sort_array(F.collect_list("_repo")), ",").alias("repositories"))
    return top.join(repos, "developer", "left").withColumn("repositories", F.coalesce("repositories", F.lit(""))).orderBy(*order)


def suppression_states(now: str) -> list[Column]:
    live = P.suppression_live(now)
    active = F.upper("status") == "ACTIVE"
    return [
        F.count_if(live).alias("active_count"),
        F.count_if(active & ~live).alias("expired_count"),
        F.count_if(F.upper("status") == "REVOKED").alias("revoked_count"),
    ]


def _suppressions_in(suppressions: DataFrame, now: str, window: str, repository) -> DataFrame:
    rows = P.in_window(suppressions, window, now)
    return rows.filter(P.repo_equals(repository)) if repository is not None else rows


def analytics_summary(
    analyses: DataFrame, findings: DataFrame, suppressions: DataFrame,
    now: str, suppressions_now: str, window: str = "30d", repository: str | None = None,
) -> DataFrame:
    """AGR-03: one row. Each side is reduced to a single row of counters before
    the three are put side by side."""
    sel = P.in_window(analyses, window, now)
    if repository:
        sel = sel.filter(P.repo_matches(repository))
    totals = sel.agg(F.count(F.lit(1)).alias("total_analyses"), *gate_counts())
    narrowed = repository is not None or P.window_days(window) is not None
    per = findings_per_analysis(findings, sel if narrowed else None)
    if not narrowed:
        per = per.join(sel.select("analysis_id"), "analysis_id", "left_semi")
    sums = per.agg(
        _sum("finding_count"), *[_sum(f"{s}_count") for s in SEVERITIES]
    ).withColumnRenamed("finding_count", "total_findings").withColumn(
        "other_severity_count", F.col("total_findings") - sum(F.col(f"{s}_count") for s in SEVERITIES)
    )
    sup = _suppressions_in(suppressions, suppressions_now, window, repository).agg(*suppression_states(suppressions_now))
    return beside(totals, sums, sup)


def suppression_analytics(suppressions: DataFrame, now: str, window: str = "30d", repository=None) -> DataFrame:
    """AGR-07 as tidy rows: (metric, bucket, n) for states, reasons and versions.
    The three histograms come from one grouped pass."""
    rows = _suppressions_in(suppressions, now, window, repository)
    live = P.suppression_live(now)
    state = F.when(F.upper("status") == "REVOKED", "revoked").when(live, "active").when(
        F.upper("status") == "ACTIVE", "expired"
    ).otherwise("other")
    reason = F.trim(F.coalesce(F.nullif(F.col("reason_code"), F.lit("")), F.lit("FALSE_POSITIVE")))
    version = F.concat(F.lit("v"), F.coalesce(F.nullif(F.col("fingerprint_version"), F.lit(0)), F.lit(1)).cast("string"))
    small = rows.groupBy(state.alias("state"), reason.alias("reason"), version.alias("version")).agg(
        F.count(F.lit(1)).alias("n")
    )
    tall = small.select(
        F.explode(F.array(
            F.struct(F.lit("total").alias("metric"), F.lit("all").alias("bucket")),
            F.struct(F.lit("state").alias("metric"), F.col("state").alias("bucket")),
            F.struct(F.lit("reason").alias("metric"), F.col("reason").alias("bucket")),
            F.struct(F.lit("version").alias("metric"), F.col("version").alias("bucket")),
        )).alias("m"), "n",
    )
    return tall.groupBy(F.col("m.metric").alias("metric"), F.col("m.bucket").alias("bucket")).agg(F.sum("n").alias("n"))


def count_rows(df: DataFrame, *conditions: Column) -> DataFrame:
    """AGR-01: filtered COUNT(*)."""
    for c in conditions:
        df = df.filter(c)
    return df.agg(F.count(F.lit(1)).alias("n"))


def first_rows(df: DataFrame, order: list, limit: int | None) -> DataFrame:
    """All rows in order, or the first ``limit``."""
    rows = df.orderBy(*order)
    return rows if limit is None else rows.limit(limit)


def page(df: DataFrame, order: list[Column], limit: int | None = 20, offset: int = 0, cap: int = 100) -> DataFrame:
    """SRC-01 / SRC-19 / SRT-01 / SRT-02: ordered page with clamped bounds."""
    return df.orderBy(*order).offset(max(0, int(offset))).limit(P.clamp_limit(limit, cap=cap))


def latest_completed(analyses: DataFrame, keys: Sequence[str], done: Sequence[str] = ("completed",)) -> DataFrame:
    """RNK-09: of every key the latest completed analysis, ties by the larger id.
    A grouped maximum, so a key with very many analyses is reduced before the shuffle."""
    rows = analyses.filter(F.lower("status").isin(*done))
    return rows.groupBy(*keys).agg(F.max(F.struct("created_at", "analysis_id")).alias("_m")).select(*keys, "_m.analysis_id", "_m.created_at")


def analysis_detail(analyses: DataFrame, findings: DataFrame, analysis_id: int) -> DataFrame:
    """SRC-02: one analysis with its findings, one row each (one row without a
    finding if there is none). The id is a literal and reaches both scans."""
    one = analyses.filter(F.col("analysis_id") == analysis_id)
    own = findings.filter(F.col("analysis_id") == analysis_id)
    return one.join(own, "analysis_id", "left")
