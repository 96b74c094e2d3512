"""Report, explanation and sink queries (survey 2.2, 2.9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.embedding import embed
from tidewatch.operators import predicates as P
from tidewatch.operators import reports as R
from tidewatch.operators.findings import SIGNAL_CWES, lookup
from tidewatch.plans import q_findings as QF
from tidewatch.plans.q_analytics import REPO
from tidewatch.plans.registry import query
from tidewatch.session import shared_dir
from tidewatch.sinks import tables as S
from tidewatch.sources import bridge as B

PRODUCT = "Tidewatch"


def reports(spark, d, fields=QF.FIELDS):
    a = B.analyses(spark, d).select("analysis_id", P.repo_id().alias("repository_id"), "pr_number",
                                    F.left(F.sha2(F.col("analysis_id").cast("string"), 256), F.lit(40)).alias("head_sha"))
    return QF.reports(spark, d, fields).join(a, "analysis_id").withColumn("analyzed_files", F.col("total_findings"))


BASE = QF.NORM + f""", lines AS (SELECT analysis_id,
   string_agg(rk || '. **[' || upper(severity) || ']** `finding_' || rk || '` — ' || title, chr(10) ORDER BY rk) FILTER (WHERE rk <= 10) AS md,
   string_agg('- **[' || upper(severity) || ']** `finding_' || rk || '`: ' || title || chr(10), '' ORDER BY rk) FILTER (WHERE rk <= 10) AS ck,
   string_agg('• ' || CASE severity WHEN 'critical' THEN '🔴' WHEN 'high' THEN '🟠' WHEN 'medium' THEN '🟡' WHEN 'low' THEN '🟢' ELSE '⚪' END || ' *' || title || '* — `' || document_id || ':' || line || '`', chr(10) ORDER BY rk) FILTER (WHERE rk <= 5) AS sl
   FROM kept GROUP BY 1),
x AS (SELECT g.*, lines.md, lines.ck, lines.sl, {REPO} AS repo, a.pr_number, left(sha256(CAST(analysis_id AS VARCHAR)), 40) AS sha
   FROM gated g JOIN lines USING (analysis_id) JOIN analyses a USING (analysis_id))
"""


def _map(col, table, default=None):
    body = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items())
    return f"(CASE {col} {body} {f'ELSE {default!r}' if default else ''} END)"


@query(
    "ci_markdown",
    BASE + f"""SELECT analysis_id, concat_ws(chr(10), '{R.MARKER}', '## {PRODUCT} Security Analysis', '- **Repository**: `' || repo || '`', '- **Branch**: `main`',
      '- **Analysis ID**: `' || analysis_id || '`', '', '### Security Decision: `' || {_map('review_status', R.CI_LABEL)} || '`', '', '### Severity Summary',
      '- **Total Findings**: `' || total_findings || '`', '- **Critical**: `' || critical_count || '`', '- **High**: `' || high_count || '`', '- **Medium**: `' || medium_count || '`',
      '- **Low**: `' || low_count || '`', '- **Info**: `' || info_count || '`', '', '### Recommended Action', {_map('review_status', R.CI_ADVICE)}, '',
      '### Key Security Findings', md, CASE WHEN total_findings > 10 THEN chr(10) || '*...and ' || (total_findings - 10) || ' additional findings.*' END, '', '---',
      '*Automated DevSecOps Security Audit generated by {PRODUCT}.*') AS markdown FROM x""",
    ("analyses", "findings"),
)
def _(spark, d):
    return R.ci_summary(reports(spark, d), PRODUCT).select("analysis_id", "markdown")


@query(
    "pr_comment",
    BASE + f"""SELECT analysis_id, '{R.MARKER}' || chr(10) || '<!-- head-sha:' || sha || ' -->' || chr(10) || '## {PRODUCT} Security Analysis for **' || repo || '** (PR #' || pr_number || ')' || chr(10) || chr(10)
     || '**Security Gate Verdict**: `' || {_map('review_status', R.COMMENT_LABEL)} || '`' || chr(10) || chr(10) || '### Summary Telemetry' || chr(10) || '- **Analyzed Files**: ' || total_findings || chr(10)
     || '- **Total Security Findings**: ' || total_findings || chr(10) || '- **Critical Severity**: `' || critical_count || '`' || chr(10) || '- **High Severity**: `' || high_count || '`' || chr(10)
     || '- **Medium Severity**: `' || medium_count || '`' || chr(10) || '- **Low Severity**: `' || low_count || '`' || chr(10) || '- **Info**: `' || info_count || '`' || chr(10) || chr(10)
     || '### Key Findings' || chr(10) || chr(10) || md || chr(10) || CASE WHEN total_findings > 10 THEN chr(10) || '*...and ' || (total_findings - 10) || ' additional findings.*' ELSE '' END || chr(10) || chr(10)
     || '### Recommended Next Action' || chr(10) || {_map('review_status', R.COMMENT_ACTION)} || chr(10) || chr(10) || '---  ' || chr(10) || '*Automated DevSecOps Security Audit generated by {PRODUCT}.*' AS comment FROM x""",
    ("analyses", "findings"),
)
def _(spark, d):
    return R.pr_comment(reports(spark, d), PRODUCT).select("analysis_id", "comment")


@query(
    "check_run_payload",
    BASE + f"""SELECT analysis_id, {_map('review_status', R.CHECK_CONCLUSION)} AS conclusion, '### Finding Summary' || chr(10) || chr(10) || ck
       || CASE WHEN total_findings > 10 THEN chr(10) || '*...and ' || (total_findings - 10) || ' additional findings.*' ELSE '' END AS text,
     {_map('review_status', R.COMMIT_STATE)} AS state, '{PRODUCT}: ' || upper(review_status) || ' (' || critical_count || ' Critical, ' || high_count || ' High, ' || medium_count || ' Medium)' AS description FROM x""",
    ("analyses", "findings"),
)
def _(spark, d):
    c = R.check_run(reports(spark, d), PRODUCT)
    j = lambda c, p: F.get_json_object(c, p)
    return c.select("analysis_id", j("check_run", "$.conclusion").alias("conclusion"), j("check_run", "$.output.text").alias("text"),
                    j("commit_status", "$.state").alias("state"), j("commit_status", "$.description").alias("description"))


@query(
    "notification_payload",
    BASE + f"""SELECT analysis_id, {_map('review_status', R.GATE_ICON)} || ' {PRODUCT} Security Gate: ' || {_map('review_status', R.GATE_LABEL)} || ' — PR #' || pr_number || ' (' || repo || ')' AS headline,
      sl || CASE WHEN total_findings > 5 THEN chr(10) || '• ... and ' || (total_findings - 5) || ' more findings' ELSE '' END AS findings_text FROM x""",
    ("analyses", "findings"),
)
def _(spark, d):
    return R.notification(reports(spark, d, [*QF.FIELDS, "line", "line_start"]), PRODUCT).select("analysis_id", "headline", "findings_text")


@query(
    "review_events",
    QF.NORM + """SELECT analysis_id, CASE review_status WHEN 'allow' THEN 'APPROVE' WHEN 'block' THEN 'REQUEST_CHANGES' ELSE 'COMMENT' END AS enforced, 'COMMENT' AS commented FROM gated""",
    ("findings",),
)
def _(spark, d):
    return QF.reports(spark, d).select("analysis_id", R.review_event("enforce").alias("enforced"), R.review_event().alias("commented"))


FAM = "CASE signal_type WHEN 'unsafe_database_execution' THEN 0 WHEN 'command_execution_call' THEN 1 WHEN 'path_traversal_call' THEN 2 WHEN 'possible_hardcoded_secret' THEN 4 ELSE -1 END"


def _fam(k, other):
    return f"CASE {FAM} " + " ".join(f"WHEN {i} THEN '{x[k].replace(chr(39), chr(39) * 2)}'" for i, x in enumerate(R.FAMILIES)) + f" ELSE {other} END"


@query(
    "fallback_explanation",
    f""", f AS (SELECT *, CASE signal_type WHEN 'unsafe_database_execution' THEN 'CWE-89' WHEN 'command_execution_call' THEN 'CWE-78' WHEN 'path_traversal_call' THEN 'CWE-22'
          WHEN 'possible_hardcoded_secret' THEN 'CWE-798' WHEN 'weak_cryptography' THEN 'CWE-327' END AS cwe FROM findings)
    SELECT analysis_id, finding_id, title || ' detected in ''' || document_id || ''' at line ' || line || '.' AS summary,
      {_fam(2, "'A ' || category || ' pattern was found (signal ''' || signal_type || '''). It matters if the values that reach it come from outside and are not checked.'")} AS why_it_matters,
      {_fam(5, "'Let only checked values reach this operation.'")} AS safer_pattern,
      CASE WHEN cwe IS NULL THEN 'OWASP Top 10' ELSE 'OWASP / ' || cwe || ',' || cwe END AS refs FROM f""",
    ("findings",),
)
def _(spark, d):
    f = B.findings(spark, d).withColumn("cwe_id", lookup("signal_type", SIGNAL_CWES))
    return R.fallback_explanation(f).select(
        "analysis_id", "finding_id", "summary", "why_it_matters", "safer_pattern", F.array_join("references", ",").alias("refs"))


@query(
    "explanation_validation",
    """SELECT doc_id, left(sha256(CASE WHEN lang = 'en' THEN 'Doc was found by a code rule.' WHEN length(t) > 300 THEN left(t, 300) || '...[truncated]' ELSE t END), 16) AS summary_h,
         CASE WHEN lang = 'en' THEN 'OWASP / CWE-1' ELSE 'a,b' END AS refs
       FROM (SELECT *, trim(regexp_replace(translate(text, '"\\', ''), '\\s+', ' ', 'g')) AS t FROM documents)""".replace("\\\\s", "\\s"),
)
def _(spark, d):
    t = F.trim(F.regexp_replace(F.translate("text", '"\\', ""), r"\s+", " "))
    good = F.concat(F.lit('Here: {"summary": "'), t, F.lit('", "references": ["a", " b ", "a", ""]}'))
    docs = B.table(spark, d, "documents").select(
        "doc_id", F.when(F.col("lang") == "en", "no answer").otherwise(good).alias("answer"), F.lit("Doc").alias("title"), F.lit("x").alias("category"), F.lit("CWE-1").alias("cwe_id"))
    out = R.validate_explanation(docs)
    return out.select("doc_id", F.left(F.sha2("summary", 256), F.lit(16)).alias("summary_h"), F.array_join("references", ",").alias("refs"))


# --- sinks: written to the shared folder and read back --------------------------

@query(
    "sink_upsert",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'new' ELSE o_orderpriority END AS note FROM orders WHERE o_orderstatus <> 'P'""",
)
def _(spark, d):
    path = shared_dir(spark, "upsert")
    o = B.table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    S.replace(o.select("o_orderkey", F.col("o_orderpriority").alias("note")), path, ["o_orderkey"], 8)
    twice = o.filter("o_orderstatus = 'F'").select("o_orderkey", F.explode(F.array(F.lit("old"), F.lit("new"))).alias("note"))
    S.upsert(twice, path, ["o_orderkey"], [F.col("note")], 8)
    S.delete(spark, path, o.filter("o_orderstatus = 'P'"), ["o_orderkey"], 8)
    return spark.read.parquet(path).drop(S.BUCKET)


@query(
    "remediation_guidance",
    """WITH r AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN '  ask ' || p_brand WHEN 1 THEN '' WHEN 2 THEN '   ' END AS own, CASE WHEN p_size % 3 = 0 THEN p_brand || chr(10) END AS rec,
         CASE p_size % 4 WHEN 0 THEN 'CWE-89' WHEN 1 THEN 'CWE-78' WHEN 2 THEN 'CWE-1' END AS cwe FROM part),
       t AS (SELECT *, CASE WHEN own IS NULL OR own = '' THEN rec ELSE own END AS s FROM r)
       SELECT p_partkey, CASE WHEN trim(s, ' ' || chr(10)) <> '' THEN trim(s, ' ' || chr(10)) WHEN cwe = 'CWE-89' THEN 'Keep the statement' WHEN cwe = 'CWE-78' THEN 'Start the program d' END AS head,
         CASE WHEN trim(s, ' ' || chr(10)) <> '' THEN true WHEN cwe IN ('CWE-89', 'CWE-78') THEN false END AS is_specific FROM t""",
)
def _(spark, d):
    n = F.col("p_size")
    rows = B.table(spark, d, "part").select(
        "p_partkey", F.when(n % 5 == 0, F.concat(F.lit("  ask "), "p_brand")).when(n % 5 == 1, "").when(n % 5 == 2, "   ").alias("own"),
        F.when(n % 3 == 0, F.concat("p_brand", F.lit("\n"))).alias("rec"), F.when(n % 4 == 0, "CWE-89").when(n % 4 == 1, "CWE-78").when(n % 4 == 2, "CWE-1").alias("cwe"))
    g = rows.select("p_partkey", R.remediation_guidance("own", "rec", "cwe").alias("g"))
    head = F.when(F.col("g.is_specific"), F.col("g.text")).otherwise(F.regexp_extract("g.text", r"^(Keep the statement|Start the program d)", 1))
    return g.select("p_partkey", head.alias("head"), "g.is_specific")


@query(
    "sink_ingest_documents",
    """SELECT doc_id || '_' || lang AS document_id, length(text) AS n FROM documents WHERE lang <> 'de'""",
)
def _(spark, d):
    path = shared_dir(spark, "ingest")
    docs = B.table(spark, d, "documents").select(
        F.when(F.col("lang") != "de", F.concat(F.col("doc_id").cast("string"), F.lit("_"), "lang")).alias("document_id"), F.col("text").alias("content"),
        F.create_map(F.lit("lang"), "lang", F.lit("none"), F.lit(None).cast("string")).alias("metadata"))
    S.ingest(docs, path, [F.col("content")], embed)
    return spark.read.parquet(path).select("document_id", F.length("content").alias("n"))


@query(
    "sink_insert_missing",
    "SELECT doc_id FROM documents",
)
def _(spark, d):
    path = shared_dir(spark, "missing")
    docs = B.table(spark, d, "documents").select("doc_id", "lang")
    S.insert_missing(docs.filter("lang = 'en'"), path, ["doc_id"], 8)
    S.insert_missing(docs, path, ["doc_id"], 8)
    return spark.read.parquet(path).select("doc_id")
