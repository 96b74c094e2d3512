"""The first two pages of every sort mode of every table (survey 2.8)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tidewatch.operators import analytics as A
from tidewatch.operators import keyset as K
from tidewatch.operators import predicates as P
from tidewatch.plans.registry import query
from tidewatch.session import shared_dir
from tidewatch.sources import bridge as B

SIZE = 25
RANK = "CASE lower(severity) WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 WHEN 'info' THEN 1 ELSE 0 END"
MOMENT = "coalesce({}, TIMESTAMP '1970-01-01')"


def pages(df, view, ids):
    """The second page starts at the cursor of the first one's last row."""
    out = []
    for mode in K.SORT_MODES[view]:
        first = K.page(df, view, mode, ids, SIZE)
        shown = first.select("cursor").collect()  # one page
        last = shown[-1]["cursor"] if shown else None
        both = [first] + ([K.page(df, view, mode, ids, SIZE, last)] if last else [])
        out += [p.select(F.lit(mode).alias("mode"), F.lit(n + 1).alias("page"), *ids) for n, p in enumerate(both)]
    return reduce(lambda a, b: a.unionByName(b), out)


def once_written(df, name):
    """Joined or grouped once, then sorted in many ways: every page reads the table again."""
    at = shared_dir(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def pages_sql(rows, ids, modes):
    """Both pages of each mode by the row numbers of a full sort."""
    cut = "SELECT '{m}' AS mode, CAST(ceil(rn / {n}.0) AS INT) AS page, {i} FROM (SELECT {i}, row_number() OVER (ORDER BY {o}, {i}) AS rn FROM x) WHERE rn <= {t}"
    parts = [cut.format(m=m, o=o, i=", ".join(ids), n=SIZE, t=2 * SIZE) for m, o in modes.items()]
    return f", x AS ({rows}) " + " UNION ALL ".join(parts)


FINDING = ["analysis_id", "finding_id", "seen_at"]


@query(
    "pages_vulnerabilities",
    pages_sql(
        "SELECT f.*, a.created_at AS day, CASE WHEN line_no % 3 > 0 THEN supp_id / 100.0 END AS score FROM findings f JOIN analyses a USING (analysis_id)", FINDING,
        {"sev-desc": f"{RANK} DESC, title", "sev-asc": f"{RANK}, title", "title-asc": "title", "title-desc": "title DESC",
         "conf-desc": "coalesce(score, 0) DESC", "date-desc": "day DESC", "date-asc": "day"}),
    ("analyses", "findings"),
)
def _(spark, d):
    a = B.analyses(spark, d).select("analysis_id", F.col("created_at").alias("analysis_created_at"))
    score = F.when(F.col("line_no") % 3 > 0, F.col("supp_id") / 100.0)
    rows = B.findings(spark, d).join(a, "analysis_id").select(*FINDING, "severity", "title", "analysis_created_at", score.alias("confidence"))
    return pages(once_written(rows, "vulnerabilities"), "vulnerabilities", FINDING)


@query(
    "pages_developers",
    pages_sql(
        """SELECT trim(author) AS developer, max(created_at) AS last_activity, coalesce(sum(n), 0) AS n, coalesce(sum(c), 0) AS c, coalesce(sum(h), 0) AS h
           FROM analyses LEFT JOIN (SELECT analysis_id, count(*) AS n, count(*) FILTER (WHERE lower(severity) = 'critical') AS c, count(*) FILTER (WHERE lower(severity) = 'high') AS h FROM findings GROUP BY 1) USING (analysis_id)
           WHERE lower(trim(author)) <> 'unknown' GROUP BY 1""", ["developer"],
        {"findings-desc": "n DESC", "findings-asc": "n", "crit-desc": "c DESC", "crit-asc": "c", "high-desc": "h DESC", "high-asc": "h",
         "dev-asc": "developer", "dev-desc": "developer DESC", "date-desc": "last_activity DESC", "date-asc": "last_activity"}),
    ("analyses", "findings"),
)
def _(spark, d):
    rows = B.analyses(spark, d).join(A.findings_per_analysis(B.findings(spark, d)), "analysis_id", "left")
    people = rows.withColumn("developer", P.clean_author()).filter("developer IS NOT NULL").groupBy("developer").agg(
        F.sum("finding_count").alias("total_findings"), F.sum("critical_count").alias("critical_count"), F.sum("high_count").alias("high_count"),
        F.max("created_at").alias("last_activity"))
    return pages(once_written(people, "developers"), "developers", ["developer"])


@query(
    "pages_suppressions",
    pages_sql(
        "SELECT *, CASE suppression_id % 5 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'low' WHEN 2 THEN 'odd' WHEN 3 THEN NULL ELSE 'info' END AS severity FROM suppressions", ["suppression_id"],
        {"created-desc": "created_at DESC", "created-asc": "created_at", "expires-asc": "expires_at NULLS LAST", "expires-desc": "expires_at DESC NULLS LAST",
         "sev-desc": f"{RANK} DESC, coalesce(reason_code, '')", "sev-asc": f"{RANK}, coalesce(reason_code, '')",
         "title-asc": "coalesce(reason_code, '')", "title-desc": "coalesce(reason_code, '') DESC"}),
    ("suppressions",),
)
def _(spark, d):
    severity = F.expr("CASE suppression_id % 5 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'low' WHEN 2 THEN 'odd' WHEN 3 THEN NULL ELSE 'info' END")
    rows = B.suppressions(spark, d).select("suppression_id", "created_at", "expires_at", F.col("reason_code").alias("title"), severity.alias("severity"))
    return pages(rows, "suppressions", ["suppression_id"])


@query(
    "pages_history",
    pages_sql("SELECT * FROM findings", FINDING, {
        "severity-desc": f"{RANK} DESC, title", "severity-asc": f"{RANK}, title", "file-asc": "file_path, line", "title-asc": "title"}),
    ("findings",),
)
def _(spark, d):
    return pages(B.findings(spark, d), "history", FINDING)


@query(
    "pages_review",
    pages_sql("SELECT *, CASE WHEN part_id % 7 > 0 THEN part_id % 4 = 0 END AS fp FROM findings", FINDING, {
        "severity-desc": f"{RANK} DESC, title", "severity-asc": f"{RANK}, title", "file-asc": "file_path, line",
        # of two spellings the capital letters come last, so first when turned around
        "status-open-first": "coalesce(fp, FALSE), lower(severity) DESC, severity", "title-asc": "title"}),
    ("findings",),
)
def _(spark, d):
    flag = F.when(F.col("part_id") % 7 > 0, F.col("part_id") % 4 == 0)
    return pages(B.findings(spark, d).withColumn("is_false_positive", flag), "review", FINDING)


@query(
    "pages_extraction",
    pages_sql("SELECT * FROM findings", FINDING, {"default": "category, lower(signal_type), document_id, scope, finding_id"}),
    ("findings",),
)
def _(spark, d):
    rows = B.findings(spark, d).select(
        *FINDING, F.col("category").alias("cwe_id"), F.lower("signal_type").alias("programming_language"), F.col("document_id").alias("cve_id"),
        F.col("scope").alias("hash"), F.col("finding_id").alias("file_change_id"))
    return pages(rows, "extraction", FINDING)
