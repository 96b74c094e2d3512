"""Finding and suppression queries (survey 2.3-2.6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import hashing as H
from tidewatch.functions import text as T
from tidewatch.operators import findings as X
from tidewatch.operators import suppression as S
from tidewatch.operators.ranking import position_in_group
from tidewatch.plans.registry import query
from tidewatch.sources import bridge as B

NOW = B.ANALYSES_NOW
POS = ["line_no", "part_id", "supp_id", "seen_at", "severity", "confidence"]
POS_SQL = "line_no, part_id, supp_id, seen_at, severity, confidence"

EID = "CASE WHEN signal_type IN ('weak_cryptography', 'path_traversal_call') THEN '' ELSE document_id END"

# normalized findings, shared by several checks
NORM = f""", norm AS (
  SELECT analysis_id, {POS_SQL.replace('severity, confidence', 'severity AS raw_sev, confidence AS raw_conf')},
    title, category, description, file_path, line, document_id, signal_type, signal_name, {EID} AS evidence_id,
    CASE WHEN lower(severity) IN ('critical','high','medium','low','unknown') THEN lower(severity) ELSE 'unknown' END AS sev,
    CASE WHEN lower(confidence) IN ('high','medium','low') THEN lower(confidence) ELSE 'low' END AS conf
  FROM findings),
keyed AS (SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY line_no, part_id, supp_id, seen_at, sev, conf, document_id, signal_name, file_path) AS pos,
    CASE WHEN evidence_id <> '' THEN 'E' || evidence_id
      ELSE concat_ws('|', lower(category), lower(title), document_id, signal_type, signal_name) END AS k,
    CASE sev WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS sr,
    CASE conf WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END AS cr FROM norm),
merged AS (SELECT analysis_id, k, max(sr) AS sr, max(cr) AS cr, min(pos) AS pos, count(*) AS merged_rows,
    count(DISTINCT concat_ws('|', document_id, line, signal_type, signal_name)) AS evidence_count FROM keyed GROUP BY 1, 2),
m AS (SELECT g.analysis_id, g.k, g.sr, g.cr, g.pos, g.merged_rows, g.evidence_count, x.title, x.category, x.document_id, x.file_path, x.line,
    x.description, x.signal_type, x.signal_name,
    CASE g.sr WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'unknown' END AS severity,
    CASE g.cr WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence
    FROM merged g JOIN keyed x ON x.analysis_id = g.analysis_id AND x.pos = g.pos),
ranked AS (SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY sr DESC, cr DESC, category, title, document_id, pos) AS rk FROM m),
kept AS (SELECT * FROM ranked WHERE rk <= 20),
report AS (SELECT analysis_id, count(*) AS total_findings, count(*) FILTER (WHERE severity = 'critical') AS critical_count,
    count(*) FILTER (WHERE severity = 'high') AS high_count, count(*) FILTER (WHERE severity = 'medium') AS medium_count,
    count(*) FILTER (WHERE severity = 'low') AS low_count, count(*) FILTER (WHERE severity = 'unknown') AS info_count
    FROM kept GROUP BY 1),
gated AS (SELECT *, CASE WHEN critical_count > 0 OR high_count > 0 THEN 'block' WHEN medium_count > 0 THEN 'review' ELSE 'allow' END AS review_status
    FROM report)
"""


POS_NORM = ["line_no", "part_id", "supp_id", "seen_at", "severity", "confidence", "document_id", "signal_name", "file_path"]


def normalized(spark, d, view=B.findings):
    f = view(spark, d)
    eid = F.when(F.col("signal_type").isin("weak_cryptography", "path_traversal_call"), "").otherwise(F.col("document_id"))
    f = f.withColumns({"evidence_id": eid, "line_start": F.col("line"), "line_end": F.col("line")})
    return X.normalize_findings(f)


# what the order of a report and the texts made of it read
FIELDS = ["title", "category", "document_id"]


# a document is one part under one flag, and evidence ids here are document ids
BY_DOCUMENT = ["part_id"]


def merged(spark, d, fields=FIELDS):
    return X.merge_findings(normalized(spark, d, B.findings_by_part), ["analysis_id"], POS_NORM, fields, BY_DOCUMENT)


def reports(spark, d, fields=FIELDS):
    return X.report_rows(X.rank_findings(merged(spark, d, fields), ["analysis_id"]), ["analysis_id"])


@query(
    "finding_enum_clamp",
    """SELECT CASE WHEN lower(severity) IN ('critical','high','medium','low','unknown') THEN lower(severity) ELSE 'unknown' END AS severity,
              CASE WHEN lower(confidence) IN ('high','medium','low') THEN lower(confidence) ELSE 'low' END AS confidence, count(*) AS n
       FROM findings GROUP BY 1, 2""",
    ("findings",),
)
def _(spark, d):
    return normalized(spark, d).groupBy("severity", "confidence").agg(F.count(F.lit(1)).alias("n"))


@query(
    "finding_merge",
    NORM + """SELECT analysis_id, title, category, document_id, severity, confidence, evidence_count, merged_rows FROM m""",
    ("findings",),
)
def _(spark, d):
    m = X.with_evidence_count(merged(spark, d), normalized(spark, d, B.findings_by_part), ["analysis_id"], BY_DOCUMENT)
    return m.select("analysis_id", "title", "category", "document_id", "severity", "confidence", "evidence_count", "merged_rows")


@query(
    "finding_merge_global",
    """, norm AS (SELECT *, CASE WHEN lower(severity) IN ('critical','high','medium','low') THEN lower(severity) ELSE 'unknown' END AS sev FROM findings)
    SELECT lower(category) AS category, signal_type, count(DISTINCT concat_ws('|', document_id, line, signal_type, signal_name)) AS evidence_count,
      count(*) AS merged_rows,
      CASE max(CASE sev WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END)
        WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'unknown' END AS severity
    FROM norm GROUP BY 1, 2""",
    ("findings",),
)
def _(spark, d):
    # one huge identity per (category, signal): every row of it merges into one finding
    f = normalized(spark, d).withColumn("evidence_id", F.concat_ws("/", F.lower("category"), "signal_type"))
    out = X.with_evidence_count(X.merge_findings(f, [], POS_NORM, ["category", "signal_type"]), f, [])
    return out.select(F.lower("category").alias("category"), "signal_type", "evidence_count", "merged_rows", "severity")


@query(
    "merged_evidence_rows",
    NORM + """SELECT analysis_id, k AS identity, document_id, line AS line_start, signal_name, count(*) AS n FROM keyed GROUP BY 1, 2, 3, 4, 5, signal_type""",
    ("findings",),
)
def _(spark, d):
    k = normalized(spark, d).withColumn("identity", F.replace(X.identity(), F.lit("\x1f"), F.lit("|")))
    return k.groupBy("analysis_id", "identity", *X.EVIDENCE).agg(F.count(F.lit(1)).alias("n")).select(
        "analysis_id", "identity", "document_id", "line_start", "signal_name", "n")


@query(
    "finding_rank_cap",
    NORM + "SELECT analysis_id, 'finding_' || rk AS finding_id, title, severity, confidence, document_id FROM kept",
    ("findings",),
)
def _(spark, d):
    return X.rank_findings(merged(spark, d), ["analysis_id"]).select(
        "analysis_id", "finding_id", "title", "severity", "confidence", "document_id")


@query(
    "finding_counts_before_cap",
    NORM + """SELECT k.analysis_id, k.finding_id, g.total_before_cap, CASE WHEN g.ch > 0 THEN 'block' WHEN g.m > 0 THEN 'review' ELSE 'allow' END AS gate_before_cap
      FROM (SELECT analysis_id, 'finding_' || rk AS finding_id FROM kept WHERE rk <= 2) k
      JOIN (SELECT analysis_id, count(*) AS total_before_cap, count(*) FILTER (WHERE severity IN ('critical', 'high')) AS ch, count(*) FILTER (WHERE severity = 'medium') AS m FROM kept GROUP BY 1) g USING (analysis_id)""",
    ("findings",),
)
def _(spark, d):
    # the two strongest findings of each report next to what the whole report holds; no report here reaches the 20 of ``kept``
    return X.rank_findings(merged(spark, d), ["analysis_id"], 2, counted=True).select("analysis_id", "finding_id", "total_before_cap", "gate_before_cap")


@query(
    "repository_report",
    NORM + """SELECT analysis_id, total_findings, critical_count, high_count, medium_count, low_count, info_count, review_status FROM gated""",
    ("findings",),
)
def _(spark, d):
    return reports(spark, d).drop("findings")


@query(
    "gate_evaluation",
    NORM + """, x AS (SELECT g.*, a.status, lower(a.review_status) AS declared FROM gated g JOIN analyses a USING (analysis_id))
    SELECT analysis_id, CASE WHEN status = 'failed' OR declared IS NULL OR declared <> review_status THEN 'INVALID' ELSE upper(review_status) END AS decision,
      CASE WHEN status = 'failed' OR declared IS NULL OR declared <> review_status THEN 1
           WHEN review_status = 'block' THEN 1 WHEN review_status = 'review' THEN 2 ELSE 0 END AS exit_code FROM x""",
    ("analyses", "findings"),
)
def _(spark, d):
    a = B.analyses(spark, d).select("analysis_id", "status", F.lower("review_status").alias("declared"))
    r = reports(spark, d).drop("review_status", "findings").join(a, "analysis_id").withColumnRenamed("declared", "review_status")
    return X.gate_evaluation(r).select("analysis_id", "decision", "exit_code")


VALID = "SELECT 'ev-' || p_partkey || '-' || flag AS document_id FROM part, (SELECT unnest(['A', 'R']) AS flag) WHERE p_size <= 40"


def valid_documents(spark, d):
    p = B.table(spark, d, "part").filter("p_size <= 40")
    return p.select(F.explode(F.array(F.lit("A"), F.lit("R"))).alias("flag"), "p_partkey").select(
        F.concat(F.lit("ev-"), F.col("p_partkey").cast("string"), F.lit("-"), "flag").alias("document_id"))


@query(
    "evidence_grounding",
    f"SELECT analysis_id, finding_id, document_id FROM findings WHERE document_id IN ({VALID})",
    ("findings",),
)
def _(spark, d):
    return X.ground(B.findings(spark, d), valid_documents(spark, d)).select("analysis_id", "finding_id", "document_id")


@query(
    "actionable_evidence",
    f"""SELECT title, category, count(*) AS n FROM (SELECT CASE signal_type
         {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.SIGNAL_TITLES.items())} END AS title,
         CASE signal_type WHEN 'unsafe_database_execution' THEN 'Injection' WHEN 'command_execution_call' THEN 'Injection'
           WHEN 'dynamic_code_execution' THEN 'Code Execution' WHEN 'possible_hardcoded_secret' THEN 'Credential Management'
           WHEN 'path_traversal_call' THEN 'File Security' ELSE 'General Security' END AS category FROM findings)
       WHERE title IS NOT NULL GROUP BY 1, 2""",
    ("findings",),
)
def _(spark, d):
    cats = {"unsafe_database_execution": "sql_injection", "command_execution_call": "command_execution",
            "dynamic_code_execution": "dynamic_code_execution", "possible_hardcoded_secret": "credential_handling",
            "path_traversal_call": "path_traversal"}
    ev = B.findings(spark, d).select(
        "signal_type", "signal_name", F.col("description").alias("message"), "severity", "confidence", "line",
        F.col("line").alias("line_end"), X.lookup("signal_type", cats).alias("category"), F.col("document_id").alias("evidence_id"))
    return X.evidence_to_findings(ev).groupBy("title", "category").agg(F.count(F.lit(1)).alias("n"))


@query(
    "provider_output_clamp",
    f""", g AS (SELECT *, CASE WHEN lower(severity) IN ('critical','high','medium','low') THEN lower(severity) ELSE 'unknown' END AS sev,
        row_number() OVER (PARTITION BY category ORDER BY analysis_id, line_no, part_id, supp_id, seen_at, lower(severity)) AS rn
        FROM findings WHERE document_id IN ({VALID}))
    SELECT category, count(*) AS total_findings, count(*) FILTER (WHERE sev = 'critical') AS critical_count,
      count(*) FILTER (WHERE sev = 'high') AS high_count, count(*) FILTER (WHERE sev = 'medium') AS medium_count,
      count(*) FILTER (WHERE sev = 'low') AS low_count, 0 AS info_count FROM g WHERE rn <= 20 GROUP BY 1""",
    ("findings",),
)
def _(spark, d):
    order = [F.col(c) for c in ("analysis_id", "line_no", "part_id", "supp_id", "seen_at", "severity")]
    return X.clamp_provider_output(B.findings(spark, d), valid_documents(spark, d), ["category"], order)


@query(
    "structured_retrieval_query",
    """, base AS (SELECT analysis_id, finding_id, concat_ws(' ',
        CASE signal_type WHEN 'unsafe_database_execution' THEN 'CWE-89 sql_injection' WHEN 'command_execution_call' THEN 'CWE-78 command_execution'
          WHEN 'dynamic_code_execution' THEN 'dynamic_code_execution' WHEN 'possible_hardcoded_secret' THEN 'CWE-798 credential_handling'
          WHEN 'path_traversal_call' THEN 'CWE-22 path_traversal' ELSE 'CWE-327 weak_cryptography' END,
        category, title, CASE WHEN lower(severity) IN ('critical', 'high') THEN lower(severity) || ' severity' END) AS q, seen_at, severity
      FROM findings)
    SELECT analysis_id, finding_id, q AS query FROM base""",
    ("findings",),
)
def _(spark, d):
    f = B.findings(spark, d).withColumn("cwe_id", F.lit(None).cast("string"))
    return X.structured_query(f).select("analysis_id", "finding_id", "query")


# --- fingerprints and suppressions -------------------------------------------

FP = """, f AS (SELECT fi.*, coalesce(a.repository, 'default') AS repository FROM findings fi JOIN analyses a ON a.analysis_id = fi.analysis_id),
fp AS (SELECT *, left(sha256(concat_ws(':', lower(repository), signal_type, lower(category), lower(file_path))), 32) AS fp_v1,
  left(sha256(concat_ws(':', lower(repository), lower(file_path), signal_type, lower(category), scope, signal_name, '0')), 32) AS fp_v2 FROM f),
rec AS (SELECT concat(analysis_id, '/', finding_id) AS suppression_id, analysis_id + 1000000000 * CAST(line_no % 2 AS BIGINT) AS analysis_id, finding_id, repository, fp_v1, fp_v2,
  CASE WHEN line_no % 2 = 0 THEN 2 ELSE 1 END AS fingerprint_version, seen_at AS created_at,
  CASE WHEN severity = 'CRITICAL' THEN 'REVOKED' ELSE 'ACTIVE' END AS status,
  CASE WHEN confidence = 'high' THEN NULL WHEN confidence = 'MEDIUM' THEN TIMESTAMP '2002-01-01' ELSE TIMESTAMP '2000-01-01' END AS expires_at
  FROM fp WHERE lower(severity) IN ('critical', 'info')),
act AS (SELECT * FROM rec WHERE status = 'ACTIVE'),
d0 AS (SELECT * FROM act QUALIFY row_number() OVER (PARTITION BY analysis_id, finding_id ORDER BY created_at DESC, suppression_id DESC) = 1),
d2 AS (SELECT * FROM act QUALIFY row_number() OVER (PARTITION BY repository, fp_v2 ORDER BY created_at DESC, suppression_id DESC) = 1),
d1 AS (SELECT * FROM act WHERE fingerprint_version = 1 QUALIFY row_number() OVER (PARTITION BY repository, fp_v1 ORDER BY created_at DESC, suppression_id DESC) = 1),
d1all AS (SELECT * FROM act QUALIFY row_number() OVER (PARTITION BY repository, fp_v1 ORDER BY created_at DESC, suppression_id DESC) = 1)
"""


def fingerprinted(spark, d):
    return S.with_fingerprints(B.findings_of_analyses(spark, d))


def records(fp):
    """Suppression records derived from a share of the findings: odd positions are
    old-style records of other analyses, so they only match by fingerprint."""
    odd = F.col("line_no") % 2
    return fp.filter(F.lower("severity").isin("critical", "info")).select(
        F.concat(F.col("analysis_id").cast("string"), F.lit("/"), "finding_id").alias("suppression_id"),
        (F.col("analysis_id") + 1000000000 * odd).alias("analysis_id"),
        "finding_id", "repository", "fp_v1", "fp_v2",
        F.when(odd == 0, 2).otherwise(1).alias("fingerprint_version"),
        F.col("seen_at").alias("created_at"),
        F.when(F.col("severity") == "CRITICAL", "REVOKED").otherwise("ACTIVE").alias("status"),
        F.when(F.col("confidence") == "MEDIUM", F.lit("2002-01-01").cast("timestamp_ntz"))
        .when(F.col("confidence") != "high", F.lit("2000-01-01").cast("timestamp_ntz")).alias("expires_at"),
    )


@query("fingerprint_v1", FP + "SELECT analysis_id, finding_id, fp_v1 FROM fp", ("analyses", "findings"))
def _(spark, d):
    return fingerprinted(spark, d).select("analysis_id", "finding_id", "fp_v1")


@query("fingerprint_v2", FP + "SELECT analysis_id, finding_id, fp_v2 FROM fp", ("analyses", "findings"))
def _(spark, d):
    return fingerprinted(spark, d).select("analysis_id", "finding_id", "fp_v2")


@query(
    "inline_fingerprint",
    """SELECT analysis_id, finding_id, left(sha256(concat_ws(':', lower(file_path), signal_type, '', scope, signal_name, lower(title), finding_id)), 16) AS fp
       FROM findings""",
    ("findings",),
)
def _(spark, d):
    return B.findings(spark, d).select("analysis_id", "finding_id", H.inline_fingerprint(
        F.concat(F.lit("./"), F.replace("file_path", F.lit("/"), F.lit("//"))), "signal_type", F.lit(""), "scope", "signal_name", "title", "finding_id").alias("fp"))


@query(
    "suppression_resolution",
    FP + f""", amb AS (SELECT analysis_id, file_path, signal_type, category, count(*) AS c FROM fp GROUP BY 1, 2, 3, 4),
x AS (SELECT fp.analysis_id, fp.finding_id, fp.seen_at, fp.severity, amb.c,
   coalesce(d0.suppression_id, d2.suppression_id, d1.suppression_id) AS suppression_id,
   CASE WHEN d0.suppression_id IS NOT NULL THEN 'id' WHEN d2.suppression_id IS NOT NULL THEN 'v2' WHEN d1.suppression_id IS NOT NULL THEN 'v1' END AS matched_by,
   CASE WHEN d0.suppression_id IS NOT NULL THEN d0.expires_at WHEN d2.suppression_id IS NOT NULL THEN d2.expires_at ELSE d1.expires_at END AS exp,
   CASE WHEN d0.suppression_id IS NOT NULL THEN d0.fingerprint_version WHEN d2.suppression_id IS NOT NULL THEN d2.fingerprint_version ELSE d1.fingerprint_version END AS ver
 FROM fp JOIN amb USING (analysis_id, file_path, signal_type, category)
 LEFT JOIN d0 ON d0.analysis_id = fp.analysis_id AND d0.finding_id = fp.finding_id
 LEFT JOIN d2 ON d2.repository = fp.repository AND d2.fp_v2 = fp.fp_v2
 LEFT JOIN d1 ON d1.repository = fp.repository AND d1.fp_v1 = fp.fp_v1)
SELECT analysis_id, finding_id, suppression_id, matched_by,
  suppression_id IS NOT NULL AND exp IS NOT NULL AND exp <= TIMESTAMP '{NOW}' AS is_expired,
  coalesce(ver = 1 AND c > 1, FALSE) AS legacy_ambiguous,
  suppression_id IS NOT NULL AND (exp IS NULL OR exp > TIMESTAMP '{NOW}') AND NOT coalesce(ver = 1 AND c > 1, FALSE) AS suppressed
FROM x""",
    ("analyses", "findings"),
)
def _(spark, d):
    fp = fingerprinted(spark, d)
    return S.resolve(fp, records(fp), NOW).select(
        "analysis_id", "finding_id", "suppression_id", "matched_by", "is_expired", "legacy_ambiguous", "suppressed")


@query(
    "suppression_check",
    FP + f""", cnt AS (SELECT analysis_id, fp_v1, count(*) AS c FROM fp GROUP BY 1, 2)
SELECT fp.analysis_id, fp.finding_id, CASE WHEN d2.suppression_id IS NOT NULL THEN d2.expires_at IS NULL OR d2.expires_at > TIMESTAMP '{NOW}'
   WHEN d1all.suppression_id IS NOT NULL THEN cnt.c <= 1 AND (d1all.expires_at IS NULL OR d1all.expires_at > TIMESTAMP '{NOW}')
   ELSE FALSE END AS suppressed
FROM fp JOIN cnt USING (analysis_id, fp_v1)
LEFT JOIN d2 ON d2.repository = fp.repository AND d2.fp_v2 = fp.fp_v2
LEFT JOIN d1all ON d1all.repository = fp.repository AND d1all.fp_v1 = fp.fp_v1""",
    ("analyses", "findings"),
)
def _(spark, d):
    fp = fingerprinted(spark, d)
    return S.is_suppressed(fp, records(fp), NOW).select("analysis_id", "finding_id", "suppressed")


@query(
    "ambiguity_guard",
    "SELECT analysis_id, file_path, signal_type, category, count(*) AS same_rule FROM findings GROUP BY 1, 2, 3, 4",
    ("findings",),
)
def _(spark, d):
    return S.ambiguity(B.findings(spark, d))


@query(
    "occurrence_index",
    """SELECT analysis_id, finding_id, row_number() OVER (PARTITION BY file_path, signal_type, scope
         ORDER BY line, analysis_id, finding_id, seen_at, severity) - 1 AS occurrence FROM findings""",
    ("findings",),
)
def _(spark, d):
    # RNK-03 over whole tables: a (path, rule, scope) group can be of any size
    f = B.findings(spark, d).select("analysis_id", "finding_id", "file_path", "signal_type", "scope", "line", "seen_at", "severity")
    order = [F.col(c) for c in ("line", "analysis_id", "finding_id", "seen_at", "severity")]
    out = position_in_group(f, ["file_path", "signal_type", "scope"], F.floor(F.col("line") / 64), order, "occurrence")
    return out.select("analysis_id", "finding_id", "occurrence")


@query(
    "fingerprint_set_digest",
    NORM + """SELECT analysis_id, left(sha256(string_agg(DISTINCT document_id, ',' ORDER BY document_id)), 16) AS digest FROM kept GROUP BY 1""",
    ("findings",),
)
def _(spark, d):
    # a report holds at most twenty findings, so the list is bounded
    ids = F.transform("findings", lambda f: f["document_id"])
    return reports(spark, d).select("analysis_id", H.set_digest(ids).alias("digest"))


@query(
    "reason_validation",
    """SELECT reason_error, count(*) AS n FROM (SELECT CASE
         WHEN coalesce(reason_code, 'FALSE_POSITIVE') NOT IN ('FALSE_POSITIVE','ACCEPTED_RISK','TEST_OR_MOCK','EXTERNAL_SANITIZATION','OTHER') THEN 'unknown code'
         WHEN coalesce(reason_code, 'FALSE_POSITIVE') IN ('ACCEPTED_RISK','EXTERNAL_SANITIZATION','OTHER') AND length(CAST(suppression_id AS VARCHAR)) < 5 THEN 'comment required'
         END AS reason_error FROM suppressions) GROUP BY 1""",
    ("suppressions",),
)
def _(spark, d):
    r = B.suppressions(spark, d).withColumn("reason", F.col("suppression_id").cast("string"))
    return S.validate_reason(r).groupBy("reason_error").agg(F.count(F.lit(1)).alias("n"))


@query(
    "path_normalize",
    """SELECT page_id, regexp_replace(ltrim(replace('./..//' || url || '\\a\\\\b', '\\', '/'), './'), '/{2,}', '/', 'g') AS path FROM pages""",
)
def _(spark, d):
    return B.table(spark, d, "pages").select("page_id", T.normalize_path(
        F.concat(F.lit("./..//"), "url", F.lit("\\a\\\\b"))).alias("path"))
