"""Analytics queries (survey sections 2.1, 2.3, 2.5, 2.7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import analytics as A
from tidewatch.operators import dashboards as D
from tidewatch.operators import predicates as P
from tidewatch.plans.registry import query
from tidewatch.sources import bridge as B

NOW = B.ANALYSES_NOW
ENOW = B.EVENTS_NOW

REPO = ("coalesce(CASE WHEN owner IS NOT NULL AND repository IS NOT NULL THEN owner || '/' || repository END, "
        "repository, owner, 'default')")
SEV = ",\n".join(f"count(*) FILTER (WHERE lower(severity) = '{s}') AS {s}_count" for s in A.SEVERITIES)
SEV_SUM = ", ".join(f"CAST(coalesce(sum({s}_count), 0) AS BIGINT) AS {s}_count" for s in A.SEVERITIES)
GATE = ", ".join(f"count(*) FILTER (WHERE lower(review_status) = '{g}') AS {g}_count" for g in A.GATES)
GATE += ", count(*) FILTER (WHERE review_status IS NULL OR lower(review_status) NOT IN ('allow','block','review')) AS unknown_count"


def cutoff(window: str, now: str = NOW) -> str:
    days = P.window_days(window)
    return "TRUE" if days is None else f"created_at >= TIMESTAMP '{now}' - INTERVAL {days} DAY"


def _repository_sql(window: str) -> str:
    return f"""
, sel AS (SELECT analysis_id, created_at, review_status, {REPO} AS repository_id FROM analyses WHERE {cutoff(window)}),
per AS (SELECT analysis_id, count(*) AS finding_count, {SEV} FROM findings GROUP BY analysis_id)
SELECT repository_id, count(*) AS analysis_count, CAST(coalesce(sum(finding_count), 0) AS BIGINT) AS finding_count,
       {SEV_SUM}, {GATE}, max(created_at) AS last_analysis_at
FROM sel LEFT JOIN per USING (analysis_id) GROUP BY repository_id
ORDER BY critical_count DESC, high_count DESC, finding_count DESC, analysis_count DESC, lower(repository_id), repository_id
LIMIT 20"""


def _register_windows() -> None:
    for window in P.WINDOW_DAYS:
        def run(spark, d, window=window):
            return A.repository_analytics(B.analyses(spark, d), B.findings(spark, d), NOW, window)

        query(f"repository_analytics_{window}", _repository_sql(window), ("analyses", "findings"))(run)


_register_windows()


def _vuln_sql(window: str, where: str, limit: int) -> str:
    return f"""
, sel AS (SELECT analysis_id FROM analyses WHERE {cutoff(window)} AND {where})
SELECT category, count(*) AS finding_count, {SEV}
FROM findings WHERE analysis_id IN (SELECT analysis_id FROM sel)
GROUP BY category
ORDER BY finding_count DESC, critical_count DESC, high_count DESC, medium_count DESC, lower(category), category
LIMIT {limit}"""


FUZZY = ("coalesce(contains(coalesce(CASE WHEN owner IS NOT NULL AND repository IS NOT NULL THEN lower(owner) || '/' || lower(repository) END,"
         " lower(repository)), '{t}'), FALSE)")


@query("vulnerability_analytics_30d", _vuln_sql("30d", "TRUE", 20), ("analyses", "findings"))
def _(spark, d):
    return A.vulnerability_analytics(B.analyses(spark, d), B.findings(spark, d), NOW, "30d")


@query("vulnerability_analytics_all", _vuln_sql("all", "TRUE", 500), ("analyses", "findings"))
def _(spark, d):
    return A.vulnerability_analytics(B.analyses(spark, d), B.findings(spark, d), NOW, "all", limit=500)


@query("vulnerability_analytics_repo", _vuln_sql("all", FUZZY.format(t="asia/nation_1"), 20), ("analyses", "findings"))
def _(spark, d):
    return A.vulnerability_analytics(B.analyses(spark, d), B.findings(spark, d), NOW, "all", "ASIA/nation_1")


def _dev_sql(window: str | None, where: str) -> str:
    w = cutoff(window) if window else "TRUE"
    return f"""
, sel AS (SELECT *, trim(author) AS developer, nullif({REPO}, 'default') AS repo FROM analyses
          WHERE {w} AND {where} AND lower(trim(author)) NOT IN ('none', 'null', 'unknown', '')),
per AS (SELECT analysis_id, count(*) AS finding_count, {SEV} FROM findings GROUP BY analysis_id)
SELECT developer, count(*) AS total_analyses, CAST(coalesce(sum(finding_count), 0) AS BIGINT) AS total_findings,
       {", ".join(f"CAST(coalesce(sum({s}_count), 0) AS BIGINT) AS {s}_count" for s in A.SEVERITIES[:4])},
       {", ".join(f"count(*) FILTER (WHERE lower(review_status) = '{g}') AS {g}_count" for g in ("block", "review", "allow"))},
       coalesce(string_agg(DISTINCT repo, ',' ORDER BY repo), '') AS repositories, max(created_at) AS last_activity
FROM sel LEFT JOIN per USING (analysis_id) GROUP BY developer
ORDER BY critical_count DESC, high_count DESC, total_findings DESC, total_analyses DESC, lower(developer), developer
LIMIT 20"""


def with_summary(spark, d):
    """Analyses carrying their stored summary counters."""
    per = A.findings_per_analysis(B.findings(spark, d))
    return B.analyses(spark, d).join(per, "analysis_id", "left")


@query("developer_analytics", _dev_sql(None, "TRUE"), ("analyses", "findings"))
def _(spark, d):
    return A.developer_analytics(with_summary(spark, d), NOW)


@query(
    "developer_analytics_repo_90d",
    _dev_sql("90d", "coalesce(contains(lower(" + REPO + "), 'europe'), FALSE)"),
    ("analyses", "findings"),
)
def _(spark, d):
    return A.developer_analytics(with_summary(spark, d), NOW, "90d", "Europe")


def _summary_sql(window: str, where: str, sup_where: str) -> str:
    return f"""
, sel AS (SELECT * FROM analyses WHERE {cutoff(window)} AND {where}),
t AS (SELECT count(*) AS total_analyses, {GATE} FROM sel),
f AS (SELECT count(*) AS total_findings, {SEV},
      count(*) FILTER (WHERE lower(severity) NOT IN ('critical','high','medium','low','info')) AS other_severity_count
      FROM findings WHERE analysis_id IN (SELECT analysis_id FROM sel)),
s AS (SELECT count(*) FILTER (WHERE upper(status) = 'ACTIVE' AND (expires_at IS NULL OR expires_at > TIMESTAMP '{ENOW}')) AS active_count,
      count(*) FILTER (WHERE upper(status) = 'ACTIVE' AND expires_at <= TIMESTAMP '{ENOW}') AS expired_count,
      count(*) FILTER (WHERE upper(status) = 'REVOKED') AS revoked_count
      FROM suppressions WHERE {cutoff(window, ENOW)} AND {sup_where})
SELECT * FROM t, f, s"""


@query("analytics_summary_all", _summary_sql("all", "TRUE", "TRUE"), ("analyses", "findings", "suppressions"))
def _(spark, d):
    return A.analytics_summary(B.analyses(spark, d), B.findings(spark, d), B.suppressions(spark, d), NOW, ENOW, "all")


@query("analytics_summary_7d", _summary_sql("7d", "TRUE", "TRUE"), ("analyses", "findings", "suppressions"))
def _(spark, d):
    return A.analytics_summary(B.analyses(spark, d), B.findings(spark, d), B.suppressions(spark, d), NOW, ENOW, "7d")


@query(
    "analytics_summary_repo",
    _summary_sql("all", FUZZY.format(t="nation_7"), "lower(CAST(repository_id AS VARCHAR)) = 'nation_7'"),
    ("analyses", "findings", "suppressions"),
)
def _(spark, d):
    return A.analytics_summary(
        B.analyses(spark, d), B.findings(spark, d), B.suppressions(spark, d), NOW, ENOW, "all", "NATION_7"
    )


def _sup_sql(window: str, where: str = "TRUE") -> str:
    return f"""
, r AS (SELECT *, CASE WHEN upper(status) = 'REVOKED' THEN 'revoked'
          WHEN upper(status) = 'ACTIVE' AND (expires_at IS NULL OR expires_at > TIMESTAMP '{ENOW}') THEN 'active'
          WHEN upper(status) = 'ACTIVE' THEN 'expired' ELSE 'other' END AS state
        FROM suppressions WHERE {cutoff(window, ENOW)} AND {where})
SELECT 'total' AS metric, 'all' AS bucket, count(*) AS n FROM r
UNION ALL SELECT 'state', state, count(*) FROM r GROUP BY state
UNION ALL SELECT 'reason', coalesce(reason_code, 'FALSE_POSITIVE'), count(*) FROM r GROUP BY 2
UNION ALL SELECT 'version', 'v' || fingerprint_version, count(*) FROM r GROUP BY 2"""


@query("suppression_analytics_all", _sup_sql("all"), ("suppressions",))
def _(spark, d):
    return A.suppression_analytics(B.suppressions(spark, d), ENOW, "all")


@query("suppression_analytics_repo_7d", _sup_sql("7d", "repository_id = 8"), ("suppressions",))
def _(spark, d):
    return A.suppression_analytics(B.suppressions(spark, d), ENOW, "7d", 8)


@query(
    "severity_histogram",
    "SELECT lower(severity) AS severity, count(*) AS n FROM findings GROUP BY 1",
    ("findings",),
)
def _(spark, d):
    return A.severity_histogram(B.findings(spark, d))


@query("gate_distribution", f"SELECT count(*) AS total, {GATE} FROM analyses", ("analyses",))
def _(spark, d):
    return B.analyses(spark, d).agg(F.count(F.lit(1)).alias("total"), *A.gate_counts())


@query(
    "list_analyses_page",
    "SELECT analysis_id, status, created_at, user_id FROM analyses WHERE user_id >= 100 "
    "ORDER BY created_at DESC, analysis_id LIMIT 20 OFFSET 40",
    ("analyses",),
)
def _(spark, d):
    rows = B.analyses(spark, d).select("analysis_id", "status", "created_at", "user_id").filter("user_id >= 100")
    return A.page(rows, [F.desc("created_at"), F.col("analysis_id")], limit=0, offset=40)


@query(
    "list_analyses_owner",
    "SELECT analysis_id, status, created_at FROM analyses WHERE user_id = 1 ORDER BY created_at DESC, analysis_id LIMIT 100",
    ("analyses",),
)
def _(spark, d):
    rows = B.analyses(spark, d).filter("user_id = 1").select("analysis_id", "status", "created_at")
    return A.page(rows, [F.desc("created_at"), F.col("analysis_id")], limit=1000)


@query(
    "count_analyses_completed",
    "SELECT count(*) AS n FROM analyses WHERE status IN ('success', 'completed') AND user_id < 500",
    ("analyses",),
)
def _(spark, d):
    return A.count_rows(B.analyses(spark, d), P.completed(), F.col("user_id") < 500)


@query(
    "list_users_page",
    """SELECT c_custkey AS user_id, c_name AS full_name, CASE WHEN c_acctbal > 9000 THEN 'ADMIN' ELSE 'USER' END AS role
       FROM customer WHERE c_acctbal > 9000 AND c_mktsegment <> 'BUILDING'
       ORDER BY c_mktsegment DESC, c_custkey LIMIT 50 OFFSET 3""",
)
def _(spark, d):
    users = D.users(B.table(spark, d, "customer"))
    rows = D.filter_users(users, role="admin", status="ACTIVE")
    return A.page(rows, [F.desc("segment"), F.col("user_id")], 50, 3, cap=200).select("user_id", "full_name", "role")


@query(
    "count_users_by_role",
    """SELECT CASE WHEN c_acctbal > 9000 THEN 'ADMIN' ELSE 'USER' END AS role,
       CASE WHEN c_mktsegment = 'BUILDING' THEN 'DISABLED' ELSE 'ACTIVE' END AS status, count(*) AS n
       FROM customer GROUP BY 1, 2""",
)
def _(spark, d):
    return D.users(B.table(spark, d, "customer")).groupBy("role", "status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "list_suppressions",
    """SELECT suppression_id, repository_id, created_at, expires_at FROM suppressions
       WHERE repository_id = 8 AND upper(status) = 'ACTIVE' ORDER BY created_at DESC, suppression_id""",
    ("suppressions",),
)
def _(spark, d):
    return (
        B.suppressions(spark, d)
        .filter(P.repo_equals(8) & (F.upper("status") == "ACTIVE"))
        .select("suppression_id", "repository_id", "created_at", "expires_at")
        .orderBy(F.desc("created_at"), "suppression_id")
    )


@query(
    "author_clean",
    """SELECT lower(trim(author)) IN ('none','null','unknown','') AS placeholder, count(*) AS n,
              count(DISTINCT CASE WHEN lower(trim(author)) NOT IN ('none','null','unknown','') THEN trim(author) END) AS authors
       FROM analyses GROUP BY 1""",
    ("analyses",),
)
def _(spark, d):
    a = B.analyses(spark, d).select(P.clean_author().alias("a"))
    return a.groupBy(F.col("a").isNull().alias("placeholder")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("a").alias("authors")
    )


@query(
    "suppression_liveness",
    f"""SELECT suppression_id, upper(status) = 'ACTIVE' AND (expires_at IS NULL OR expires_at > TIMESTAMP '{ENOW}') AS live
        FROM suppressions""",
    ("suppressions",),
)
def _(spark, d):
    return B.suppressions(spark, d).select("suppression_id", P.suppression_live(ENOW).alias("live"))


@query(
    "suppression_liveness_iso",
    f"""SELECT suppression_id, upper(status) = 'ACTIVE' AND event_type <> 'view' AND
          (event_type = 'signup' OR expires_at > TIMESTAMP '{ENOW}') AS live
        FROM (SELECT s.*, e.event_type FROM suppressions s JOIN events e ON e.event_id = s.suppression_id)""",
    ("suppressions",),
)
def _(spark, d):
    # zone-less text (event type view) must fail closed
    e = B.table(spark, d, "events").select("event_id", "event_type")
    s = B.suppressions(spark, d).join(e, F.col("event_id") == F.col("suppression_id"))
    iso = F.date_format("expires_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    s = s.withColumn("expires_at", F.when(F.col("event_type") == "view", iso)
                     .when(F.col("event_type") == "click", F.concat(iso, F.lit("Z")))
                     .otherwise(F.concat(iso, F.lit("+00:00"))))
    return s.select("suppression_id", P.suppression_live_iso(ENOW).alias("live"))


# --- dashboard shaping -------------------------------------------------------

@query(
    "daily_trend",
    """, per AS (SELECT analysis_id, count(*) AS c FROM findings GROUP BY 1)
       SELECT date_trunc('day', created_at)::DATE AS day, count(*) AS analyses, CAST(coalesce(sum(c), 0) AS BIGINT) AS findings
       FROM analyses LEFT JOIN per USING (analysis_id) GROUP BY 1""",
    ("analyses", "findings"),
)
def _(spark, d):
    return D.daily_trend(with_summary(spark, d))


@query(
    "last7_trend",
    """, per AS (SELECT analysis_id, count(*) AS c FROM findings GROUP BY 1)
       SELECT date_trunc('day', created_at)::DATE AS day, count(*) AS analyses, CAST(coalesce(sum(c), 0) AS BIGINT) AS findings
       FROM analyses LEFT JOIN per USING (analysis_id) GROUP BY 1 ORDER BY 1 DESC LIMIT 7""",
    ("analyses", "findings"),
)
def _(spark, d):
    return D.last_days(D.daily_trend(with_summary(spark, d)), 7)


TOP4 = """, per AS (SELECT analysis_id, count(*) AS finding_count FROM findings GROUP BY 1),
g AS (SELECT """ + REPO + """ AS repository_id, CAST(coalesce(sum(finding_count), 0) AS BIGINT) AS finding_count,
      count(*) FILTER (WHERE lower(review_status) = 'block') AS block_count
      FROM analyses LEFT JOIN per USING (analysis_id) GROUP BY 1)
SELECT repository_id, {m} AS value FROM g WHERE {m} > 0 ORDER BY {m} DESC, repository_id LIMIT 4"""


@query("top4_repos_by_findings", TOP4.format(m="finding_count"), ("analyses", "findings"))
def _(spark, d):
    return D.top_repositories(_repo_totals(spark, d), "finding_count")


@query("top4_repos_by_blocked", TOP4.format(m="block_count"), ("analyses", "findings"))
def _(spark, d):
    return D.top_repositories(_repo_totals(spark, d), "block_count")


def _repo_totals(spark, d):
    return with_summary(spark, d).groupBy(P.repo_id().alias("repository_id")).agg(
        F.count(F.lit(1)).alias("analysis_count"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ["finding_count"] + [f"{s}_count" for s in A.SEVERITIES]],
        *A.gate_counts(),
    )


@query(
    "portfolio_totals",
    f""", per AS (SELECT analysis_id, count(*) AS finding_count, {SEV} FROM findings GROUP BY 1),
g AS (SELECT {REPO} AS repository_id, count(*) AS analyses, sum(finding_count) AS findings, sum(critical_count) AS crit,
      sum(high_count) AS high, count(*) FILTER (WHERE lower(review_status) = 'block') AS blocked
      FROM analyses LEFT JOIN per USING (analysis_id) GROUP BY 1)
SELECT count(*) AS repositories, CAST(sum(analyses) AS BIGINT) AS analyses, CAST(sum(findings) AS BIGINT) AS findings,
       CAST(sum(crit) AS BIGINT) AS critical, CAST(sum(high) AS BIGINT) AS high, CAST(sum(blocked) AS BIGINT) AS blocked,
       count(*) FILTER (WHERE crit > 0 OR high > 0 OR blocked > 0) AS needs_attention FROM g""",
    ("analyses", "findings"),
)
def _(spark, d):
    return D.portfolio_totals(_repo_totals(spark, d))


@query(
    "developer_overview",
    f""", sel AS (SELECT *, nullif({REPO}, 'default') AS repo FROM analyses
          WHERE lower(trim(author)) NOT IN ('none','null','unknown','')),
per AS (SELECT analysis_id, count(*) AS finding_count, {SEV} FROM findings GROUP BY 1)
SELECT count(DISTINCT trim(author)) AS developers, count(*) AS analyses, CAST(sum(finding_count) AS BIGINT) AS findings,
       CAST(sum(critical_count) AS BIGINT) AS critical, CAST(sum(high_count) AS BIGINT) AS high,
       count(DISTINCT repo) AS repositories
FROM sel LEFT JOIN per USING (analysis_id)""",
    ("analyses", "findings"),
)
def _(spark, d):
    return D.developer_overview(with_summary(spark, d))


@query(
    "distinct_lists",
    f"""SELECT 'category' AS kind, category AS value FROM findings GROUP BY 2
        UNION ALL SELECT 'repository', {REPO} FROM analyses GROUP BY 2
        UNION ALL SELECT 'file', file_path FROM findings GROUP BY 2""",
    ("analyses", "findings"),
)
def _(spark, d):
    return D.distinct_lists(B.analyses(spark, d), B.findings(spark, d))


@query(
    "max_category_count",
    "SELECT greatest(max(n), 1) AS max_count FROM (SELECT count(*) AS n FROM findings GROUP BY category)",
    ("findings",),
)
def _(spark, d):
    return D.bar_scale(B.findings(spark, d).groupBy("category").agg(F.count(F.lit(1)).alias("n")), "n")


@query(
    "zero_bucket_removal",
    """SELECT category, sev, n FROM (SELECT category, lower(severity) AS sev, count(*) AS n FROM findings GROUP BY 1, 2)
       WHERE sev IN ('critical','high','medium','low','info')""",
    ("findings",),
)
def _(spark, d):
    wide = B.findings(spark, d).groupBy("category").agg(*A.severity_counts())
    return D.nonzero_buckets(wide, ["category"])


@query(
    "recent_analyses",
    f"""SELECT analysis_id, {REPO} AS target, strftime(created_at, '%b %-d, %Y') AS shown_date, strftime(created_at, '%I:%M %p') AS shown_time,
         CASE WHEN status IN ('completed','success') THEN 'Completed' ELSE 'Failed' END AS state,
         coalesce(lower(review_status), 'block') AS gate
       FROM analyses ORDER BY created_at DESC, analysis_id LIMIT 5""",
    ("analyses",),
)
def _(spark, d):
    return D.recent_rows(B.analyses(spark, d), 5)


@query(
    "dashboard_gate_buckets",
    "SELECT coalesce(lower(review_status), 'block') AS gate, count(*) AS n FROM analyses GROUP BY 1",
    ("analyses",),
)
def _(spark, d):
    return B.analyses(spark, d).groupBy(D.display_gate().alias("gate")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "finding_preview",
    """SELECT analysis_id, finding_id, severity FROM (
         SELECT analysis_id, finding_id, lower(severity) AS severity, row_number() OVER (PARTITION BY analysis_id
           ORDER BY CASE lower(severity) WHEN 'critical' THEN 0 WHEN 'high' THEN 1 ELSE 2 END, finding_id, seen_at, lower(severity)) AS rn
         FROM findings) WHERE rn = 1""",
    ("findings",),
)
def _(spark, d):
    return D.finding_preview(B.findings(spark, d))


@query(
    "top5_findings_per_analysis",
    """SELECT analysis_id, finding_id, severity FROM (
         SELECT analysis_id, finding_id, lower(severity) AS severity, row_number() OVER (PARTITION BY analysis_id
           ORDER BY finding_id, seen_at, lower(severity)) AS rn FROM findings) WHERE rn <= 5""",
    ("findings",),
)
def _(spark, d):
    return D.top_findings(B.findings(spark, d), 5)


@query(
    "vulnerability_table_filter",
    f"""SELECT f.analysis_id, finding_id, lower(severity) AS severity, {REPO} AS target, file_path || ':' || line AS location
        FROM findings f JOIN analyses a ON a.analysis_id = f.analysis_id
        WHERE lower(severity) = 'critical' AND category = 'Brand#12' AND contains(lower({REPO}), 'asia')
          AND (contains(lower(title), 'economy') OR contains(lower(description), 'economy') OR contains(lower(category), 'economy')
               OR contains(lower(file_path), 'economy') OR contains(lower({REPO}), 'economy') OR contains(lower(signal_type), 'economy')
               OR contains(lower(finding_id), 'economy'))""",
    ("analyses", "findings"),
)
def _(spark, d):
    flat = D.flatten_findings(B.analyses(spark, d), B.findings(spark, d))
    return D.filter_vulnerabilities(flat, severity="critical", category="Brand#12", repository="asia", text="economy").select(
        "analysis_id", "finding_id", F.lower("severity").alias("severity"), "target", "location"
    )


@query(
    "suppression_table_filter",
    f"""SELECT suppression_id, reason_code FROM suppressions
        WHERE upper(status) = 'ACTIVE' AND expires_at <= TIMESTAMP '{ENOW}' AND reason_code = 'TEST_CODE'
          AND contains(CAST(repository_id AS VARCHAR), '1')""",
    ("suppressions",),
)
def _(spark, d):
    return D.filter_suppressions(B.suppressions(spark, d), ENOW, state="expired", reason="TEST_CODE", text="1").select(
        "suppression_id", "reason_code"
    )


@query(
    "developer_table_filter",
    f""", sel AS (SELECT *, trim(author) AS developer, nullif({REPO}, 'default') AS repo FROM analyses
           WHERE lower(trim(author)) NOT IN ('none','null','unknown','')),
per AS (SELECT analysis_id, count(*) FILTER (WHERE lower(severity) = 'critical') AS c FROM findings GROUP BY 1),
g AS (SELECT developer, CAST(coalesce(sum(c), 0) AS BIGINT) AS critical_count,
        count(*) FILTER (WHERE lower(review_status) = 'block') AS block_count,
        count(*) FILTER (WHERE repo = 'AFRICA/NATION_5') AS here
      FROM sel LEFT JOIN per USING (analysis_id) GROUP BY 1)
SELECT developer, critical_count, block_count FROM g
WHERE here > 0 AND block_count > 0 AND critical_count > 0 AND contains(lower(developer), '1')""",
    ("analyses", "findings"),
)
def _(spark, d):
    return D.filter_developers(with_summary(spark, d), repository="AFRICA/NATION_5", posture="block", severity="critical", text="1")


@query(
    "history_filter",
    f"""SELECT analysis_id, status FROM analyses a
        WHERE status = 'failed' AND contains(lower({REPO}), 'nation_2')
          AND EXISTS (SELECT 1 FROM findings f WHERE f.analysis_id = a.analysis_id AND lower(f.severity) = 'high' AND f.category = 'Brand#3')""",
    ("analyses", "findings"),
)
def _(spark, d):
    return D.filter_history(B.analyses(spark, d), B.findings(spark, d), severity="high", category="Brand#3",
                            status="failed", text="nation_2").select("analysis_id", "status")


@query(
    "pull_request_filter",
    f"""SELECT analysis_id, pr_number FROM analyses
        WHERE coalesce(lower(review_status), 'unknown') = 'block'
          AND (contains('europe/nation_3', lower({REPO})) OR contains(lower({REPO}), 'europe/nation_3'))
          AND (contains(lower(trim(author)), '2') OR contains(lower({REPO}), '2') OR contains(CAST(pr_number AS VARCHAR), '2')
               OR contains(CAST(analysis_id AS VARCHAR), '2') OR contains(status, '2'))""",
    ("analyses",),
)
def _(spark, d):
    return D.filter_pull_requests(B.analyses(spark, d), gate="block", repository="Europe/nation_3", text="2").select(
        "analysis_id", "pr_number"
    )


@query(
    "workspace_search",
    f"""SELECT kind, label FROM (
          SELECT 'analysis' AS kind, CAST(analysis_id AS VARCHAR) AS label FROM analyses WHERE contains(CAST(analysis_id AS VARCHAR), '77')
          UNION SELECT 'target', {REPO} FROM analyses WHERE contains(lower({REPO}), '77'))
        ORDER BY kind DESC, label LIMIT 10""",
    ("analyses",),
)
def _(spark, d):
    return D.quick_search(B.analyses(spark, d), "77")


@query(
    "suppressed_open_counts",
    f"""SELECT count(*) FILTER (WHERE live) AS suppressed, count(*) FILTER (WHERE NOT live) AS open
        FROM (SELECT upper(status) = 'ACTIVE' AND (expires_at IS NULL OR expires_at > TIMESTAMP '{ENOW}') AS live FROM suppressions)""",
    ("suppressions",),
)
def _(spark, d):
    live = P.suppression_live(ENOW)
    return B.suppressions(spark, d).agg(F.count_if(live).alias("suppressed"), F.count_if(~live).alias("open"))


@query(
    "admin_guard",
    """SELECT c_custkey AS user_id, n = 1 AND c_acctbal > 9000 AND c_mktsegment <> 'BUILDING' AS last_admin
       FROM customer, (SELECT count(*) AS n FROM customer WHERE c_acctbal > 9000 AND c_mktsegment <> 'BUILDING')""",
)
def _(spark, d):
    return D.last_admin_flags(D.users(B.table(spark, d, "customer"))).select("user_id", "last_admin")


@query(
    "bench_statistics",
    """SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median,
         round(quantile_cont(value, 0.95), 6) AS p95, round(stddev_samp(value), 6) AS stddev FROM events GROUP BY 1""",
)
def _(spark, d):
    return D.bench_statistics(B.table(spark, d, "events"), "event_type", "value")


@query(
    "metric_counters",
    """SELECT event_type AS metric, count(*) AS total, round(max_by(value, (ts, event_id)), 6) AS last_value FROM events GROUP BY 1""",
)
def _(spark, d):
    return D.metric_counters(B.table(spark, d, "events"))
