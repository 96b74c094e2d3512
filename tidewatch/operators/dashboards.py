"""Dashboard shaping: trends, buckets, table filters and sorts (AGR-16..23, FLT-27..34,
PRJ-15/16/21, RNK-15/16, SRT-12..15). Empty inputs give empty frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import predicates as P
from tidewatch.operators.ranking import exact_quantiles, top_n


def daily_trend(analyses: DataFrame) -> DataFrame:
    """AGR-16 / STR-11: UTC day buckets, by full date so years never merge."""
    return analyses.groupBy(F.to_date("created_at").alias("day")).agg(
        F.count(F.lit(1)).alias("analyses"), F.coalesce(F.sum("finding_count"), F.lit(0)).alias("findings")
    )


def last_days(trend: DataFrame, n: int = 7) -> DataFrame:
    """RNK-15: the newest ``n`` day buckets in time order."""
    return trend.orderBy(F.desc("day")).limit(n).orderBy("day")


def top_repositories(repos: DataFrame, measure: str, n: int = 4) -> DataFrame:
    """SRT-12."""
    return (
        repos.filter(F.col(measure) > 0)
        .orderBy(F.desc(measure), "repository_id")
        .limit(n)
        .select("repository_id", F.col(measure).alias("value"))
    )


def portfolio_totals(repos: DataFrame) -> DataFrame:
    """AGR-20."""
    risky = (F.col("critical_count") > 0) | (F.col("high_count") > 0) | (F.col("block_count") > 0)
    return repos.agg(
        F.count(F.lit(1)).alias("repositories"),
        F.sum("analysis_count").alias("analyses"),
        F.sum("finding_count").alias("findings"),
        F.sum("critical_count").alias("critical"),
        F.sum("high_count").alias("high"),
        F.sum("block_count").alias("blocked"),
        F.count_if(risky).alias("needs_attention"),
    )


def developer_overview(analyses: DataFrame) -> DataFrame:
    """AGR-18. Pre-grouped by (developer, repository), so the two distinct
    counts run over few rows."""
    rows = analyses.select(
        P.clean_author().alias("developer"), F.nullif(P.repo_id(), F.lit("default")).alias("repo"),
        "finding_count", "critical_count", "high_count",
    ).filter("developer IS NOT NULL")
    pre = rows.groupBy("developer", "repo").agg(
        F.count(F.lit(1)).alias("a"), F.sum("finding_count").alias("f"), F.sum("critical_count").alias("c"),
        F.sum("high_count").alias("h"),
    )
    return pre.agg(
        F.countDistinct("developer").alias("developers"), F.sum("a").alias("analyses"), F.sum("f").alias("findings"),
        F.sum("c").alias("critical"), F.sum("h").alias("high"), F.countDistinct("repo").alias("repositories"),
    )


def distinct_lists(analyses: DataFrame, findings: DataFrame) -> DataFrame:
    """AGR-17: the distinct repositories, categories and files as tidy rows."""
    repos = analyses.select(F.lit("repository").alias("kind"), P.repo_id().alias("value"))
    rows = findings.select(F.explode(F.array(
        F.struct(F.lit("category").alias("kind"), F.col("category").alias("value")),
        F.struct(F.lit("file").alias("kind"), F.col("file_path").alias("value")),
    )).alias("x")).select("x.*")
    return repos.unionByName(rows).distinct()


def bar_scale(df: DataFrame, column: str) -> DataFrame:
    """AGR-21: largest value, at least 1."""
    return df.agg(F.greatest(F.max(column), F.lit(1)).cast("long").alias("max_count"))


def nonzero_buckets(wide: DataFrame, keys: list[str]) -> DataFrame:
    """FLT-32: unpivot severity counters and drop empty buckets."""
    cols = [c for c in wide.columns if c.endswith("_count")]
    tall = wide.unpivot(keys, cols, "sev", "n")
    return tall.filter("n > 0").withColumn("sev", F.regexp_replace("sev", "_count$", ""))


def display_gate(status: str = "review_status") -> Column:
    """PRJ-21: a missing gate shows as block."""
    return F.coalesce(F.lower(status), F.lit("block"))


def display_date(column: str = "created_at") -> Column:
    """SCL-05: ``MMM d, yyyy``; missing becomes a dash."""
    return F.coalesce(F.date_format(column, "MMM d, yyyy"), F.lit("—"))


def display_time(column: str = "created_at") -> Column:
    return F.coalesce(F.date_format(column, "hh:mm a"), F.lit("—"))


def recent_rows(analyses: DataFrame, n: int = 5) -> DataFrame:
    """RNK-16 / PRJ-21: newest rows in display form."""
    return analyses.orderBy(F.desc("created_at"), "analysis_id").limit(n).select(
        "analysis_id",
        P.repo_id().alias("target"),
        display_date().alias("shown_date"),
        display_time().alias("shown_time"),
        F.when(P.completed(), "Completed").otherwise("Failed").alias("state"),
        display_gate().alias("gate"),
    )


def _finding_order() -> list[Column]:
    return [F.col("finding_id"), F.col("seen_at"), F.lower("severity")]


def finding_preview(findings: DataFrame) -> DataFrame:
    """SRT-14: per analysis the first critical, else first high, else first finding."""
    sev = F.lower("severity")
    pick = F.when(sev == "critical", 0).when(sev == "high", 1).otherwise(2)
    return top_n(findings, ["analysis_id"], [pick, *_finding_order()], 1).select(
        "analysis_id", "finding_id", sev.alias("severity")
    )


def top_findings(findings: DataFrame, n: int) -> DataFrame:
    """SRT-13: the leading ``n`` findings of every analysis."""
    return top_n(findings, ["analysis_id"], _finding_order(), n).select(
        "analysis_id", "finding_id", F.lower("severity").alias("severity")
    )


def flatten_findings(analyses: DataFrame, findings: DataFrame) -> DataFrame:
    """PRJ-16: one row per finding with its repository and a location string."""
    a = analyses.select("analysis_id", P.repo_id().alias("target"), "created_at")
    return findings.join(a, "analysis_id").withColumn(
        "location", F.concat("file_path", F.lit(":"), F.col("line").cast("string"))
    )


def text_search(text: str, columns: list[str]) -> Column:
    """Substring search over several fields, ignoring case."""
    t = F.lit(text.strip().lower())
    hits = [F.coalesce(F.contains(F.lower(F.col(c).cast("string")), t), F.lit(False)) for c in columns]
    return reduce(lambda a, b: a | b, hits)


def filter_vulnerabilities(
    flat: DataFrame, severity: str | None = None, category: str | None = None, repository: str | None = None,
    text: str | None = None,
) -> DataFrame:
    """FLT-27."""
    out = flat
    if severity:
        out = out.filter(F.lower("severity") == severity.lower())
    if category:
        out = out.filter(F.col("category") == category)
    if repository:
        out = out.filter(F.contains(F.lower("target"), F.lit(repository.lower())))
    if text:
        out = out.filter(text_search(text, [
            "title", "description", "category", "file_path", "target", "signal_type", "finding_id"]))
    return out


def filter_suppressions(
    rows: DataFrame, now: str, state: str | None = None, reason: str | None = None, text: str | None = None
) -> DataFrame:
    """FLT-29."""
    live, active = P.suppression_live(now), F.upper("status") == "ACTIVE"
    states = {"active": live, "expired": active & ~live, "revoked": F.upper("status") == "REVOKED"}
    out = rows
    if state:
        out = out.filter(states[state])
    if reason:
        out = out.filter(F.col("reason_code") == reason)
    return out.filter(text_search(text, ["repository_id"])) if text else out


def filter_developers(
    analyses: DataFrame, repository: str | None = None, posture: str | None = None, severity: str | None = None,
    text: str | None = None,
) -> DataFrame:
    """FLT-28 over the developer roll-up. Membership is counted in the same
    pass, so no per-developer array is carried."""
    rows = analyses.withColumn("developer", P.clean_author()).filter("developer IS NOT NULL")
    here = F.nullif(P.repo_id(), F.lit("default")) == F.lit(repository) if repository else F.lit(True)
    out = rows.groupBy("developer").agg(
        F.coalesce(F.sum("critical_count"), F.lit(0)).alias("critical_count"),
        F.coalesce(F.sum("high_count"), F.lit(0)).alias("high_count"),
        F.count_if(F.lower("review_status") == "block").alias("block_count"),
        F.count_if(F.lower("review_status") == "review").alias("review_count"),
        F.count_if(F.lower("review_status") == "allow").alias("allow_count"),
        F.count_if(here).alias("_here"),
    ).filter("_here > 0")
    if posture:
        out = out.filter(F.col(f"{posture}_count") > 0)
    if severity:
        out = out.filter(F.col(f"{severity}_count") > 0)
    if text:
        out = out.filter(text_search(text, ["developer"]))
    return out.select("developer", "critical_count", "block_count")


def filter_history(
    analyses: DataFrame, findings: DataFrame, severity: str | None = None, category: str | None = None,
    status: str | None = None, text: str | None = None,
) -> DataFrame:
    """FLT-30: severity and category must meet in one finding of the analysis."""
    out = analyses
    if status:
        out = out.filter(F.col("status") == status)
    if text:
        out = out.withColumn("_target", P.repo_id()).filter(text_search(text, ["_target"]))
    if severity or category:
        f = findings
        if severity:
            f = f.filter(F.lower("severity") == severity)
        if category:
            f = f.filter(F.col("category") == category)
        out = out.join(f.select("analysis_id"), "analysis_id", "left_semi")
    return out


def filter_pull_requests(
    analyses: DataFrame, gate: str | None = None, repository: str | None = None, text: str | None = None
) -> DataFrame:
    """FLT-31: the repository test is a substring test in both directions."""
    out = analyses.withColumn("_repo", F.lower(P.repo_id())).withColumn("_author", F.trim("author"))
    if gate:
        out = out.filter(F.coalesce(F.lower("review_status"), F.lit("unknown")) == gate)
    if repository:
        t = F.lit(repository.lower())
        out = out.filter(F.contains(F.col("_repo"), t) | F.contains(t, F.col("_repo")))
    if text:
        out = out.filter(text_search(text, ["_author", "_repo", "pr_number", "analysis_id", "status"]))
    return out.drop("_repo", "_author")


def quick_search(analyses: DataFrame, text: str, hits: int = 10) -> DataFrame:
    """FLT-33: targets and analyses matching a text, at most ten."""
    a = analyses.select(F.lit("analysis").alias("kind"), F.col("analysis_id").cast("string").alias("label"))
    t = analyses.select(F.lit("target").alias("kind"), P.repo_id().alias("label"))
    both = a.filter(text_search(text, ["label"])).unionByName(t.filter(text_search(text, ["label"]))).distinct()
    return both.orderBy(F.desc("kind"), "label").limit(hits)


def users(customer: DataFrame) -> DataFrame:
    """PRJ-15: typed user rows."""
    return customer.select(
        F.col("c_custkey").alias("user_id"),
        F.col("c_name").alias("full_name"),
        F.col("c_mktsegment").alias("segment"),
        F.when(F.col("c_acctbal") > 9000, "ADMIN").otherwise("USER").alias("role"),
        F.when(F.col("c_mktsegment") == "BUILDING", "DISABLED").otherwise("ACTIVE").alias("status"),
    )


# The roles and states a user may have.
ROLES, STATES = ("ADMIN", "USER"), ("ACTIVE", "DISABLED")


def filter_users(rows: DataFrame, role: str | None = None, status: str | None = None) -> DataFrame:
    """SRC-19: unknown role or state names are ignored, not an error."""
    if role and role.strip().upper() in ROLES:
        rows = rows.filter(F.col("role") == role.strip().upper())
    if status and status.strip().upper() in STATES:
        rows = rows.filter(F.col("status") == status.strip().upper())
    return rows


def last_admin_flags(rows: DataFrame) -> DataFrame:
    """FLT-34: flag the user whose removal would leave no active admin: the only
    active admin, if there is exactly one."""
    admins = rows.filter((F.col("role") == "ADMIN") & (F.col("status") == "ACTIVE"))
    only = admins.agg(F.count(F.lit(1)).alias("n"), F.min("user_id").alias("user_id")).filter("n = 1").select("user_id", F.lit(True).alias("_only"))
    return rows.join(only, "user_id", "left").withColumn("last_admin", F.coalesce("_only", F.lit(False))).drop("_only")


def bench_statistics(df: DataFrame, key: str, value: str) -> DataFrame:
    """AGR-23 / SCL-07: mean, median, interpolated p95, sample deviation."""
    q = exact_quantiles(df, key, value, {"median": 0.5, "p95": 0.95})
    basic = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_samp(value), 6).alias("stddev"))
    return basic.join(q, key).select(
        key, "n", "mean", F.round("median", 6).alias("median"), F.round("p95", 6).alias("p95"), "stddev")


def metric_counters(events: DataFrame) -> DataFrame:
    """AGR-22: monotone counters and the latest observed value."""
    return events.groupBy(F.col("event_type").alias("metric")).agg(
        F.count(F.lit(1)).alias("total"),
        F.round(F.max_by("value", F.struct("ts", "event_id")), 6).alias("last_value"),
    )


# Display order of severities and confidences.
_SEVERITY_ORDER = {"critical": 5, "high": 4, "medium": 3, "low": 2, "info": 1}
_CONFIDENCE_ORDER = {"high": 3, "medium": 2, "low": 1}


def rank_of(column: str, ranks: dict[str, int], default: int = 0) -> Column:
    """SCL-08: rank of a name as a literal map lookup."""
    m = F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])
    return F.coalesce(F.try_element_at(m, F.lower(column)), F.lit(default))


def sort_rows(df: DataFrame, by: str, descending: bool = False, tiebreak: str = "finding_id") -> DataFrame:
    """SRT-15: table sorts; missing values go last in both directions."""
    key = {
        "severity": rank_of("severity", _SEVERITY_ORDER),
        "confidence": rank_of("confidence", _CONFIDENCE_ORDER),
    }.get(by, F.lower(F.col(by)) if by in df.columns and df.schema[by].dataType.typeName() == "string" else F.col(by))
    return df.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), tiebreak)
