"""Record queries: identities, counters, revocations, lookups (survey 2.1, 2.2, 2.5, 2.7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import analytics as A
from tidewatch.operators import findings as X
from tidewatch.operators import reports as R
from tidewatch.operators import suppression as S
from tidewatch.plans.registry import query
from tidewatch.sinks import tables
from tidewatch.sources import bridge as B


@query(
    "identity_projection",
    """SELECT o_orderkey AS analysis_id, CASE o_orderstatus WHEN 'F' THEN 'own' || o_custkey WHEN 'O' THEN 'ri' || o_custkey ELSE 's' || o_custkey END AS owner,
         CASE WHEN o_orderstatus = 'P' THEN 'repo' ELSE 'r' || o_custkey END AS repository, left(trim(CASE WHEN o_custkey % 3 = 0 THEN '  Ann ' ELSE repeat('name ', 30) END), 100) AS author,
         CASE WHEN o_custkey % 2 = 0 THEN o_custkey ELSE 0 END AS finding_count FROM orders""",
)
def _(spark, d):
    key, st = F.col("o_custkey").cast("string"), F.col("o_orderstatus")
    raw = B.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("analysis_id"), F.when(st == "F", F.concat(F.lit("own"), key)).otherwise("").alias("owner"),
        F.when(st != "P", F.concat(F.lit("r"), key)).alias("repository"), F.when(F.col("o_custkey") % 3 == 0, "  Ann ").alias("author"),
        F.struct(F.when(st == "O", F.concat(F.lit("ri"), key)).otherwise("").alias("owner"), F.lit("").alias("repository"), F.lit(None).cast("string").alias("author")).alias("repository_info"),
        F.struct(F.concat(F.lit("s"), key).alias("owner"), F.lit("repo").alias("repository"), F.repeat(F.lit("name "), 30).alias("author"),
                 F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey")).alias("total_findings")).alias("summary"))
    return X.identity_projection(raw)


@query(
    "scan_traceability",
    """SELECT l_orderkey, l_linenumber, greatest(0, CAST(l_quantity AS BIGINT) - 25) AS files_considered, coalesce(CASE WHEN l_returnflag <> 'N' THEN l_linenumber END, 0) AS files_analyzed,
         greatest(0.0, CAST(l_quantity AS DOUBLE) * 1.25 - 20.0) AS duration_ms, CASE WHEN l_returnflag = 'A' THEN 'incremental' ELSE 'full' END AS analysis_mode FROM lineitem""",
)
def _(spark, d):
    li, zero = B.table(spark, d, "lineitem"), F.lit(0).cast("long")
    stats = li.select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity").cast("long") - 25).alias("files_considered"), F.when(F.col("l_returnflag") != "N", F.col("l_linenumber")).alias("files_analyzed"),
        zero.alias("files_excluded"), zero.alias("cache_hits"), zero.alias("cache_misses"), (F.col("l_quantity").cast("double") * 1.25 - 20.0).alias("duration_ms"),
        (F.col("l_returnflag") == "A").alias("is_incremental"))
    return R.traceability(stats).select("l_orderkey", "l_linenumber", "files_considered", "files_analyzed", "duration_ms", "analysis_mode")


@query(
    "revoke_suppressions",
    """SELECT o_orderkey AS suppression_id, CASE WHEN o_custkey % 7 = 0 THEN 'REVOKED' ELSE 'ACTIVE' END AS status,
         CASE WHEN o_custkey % 7 = 0 THEN TIMESTAMP '2002-01-01 00:00:00' ELSE CAST(o_orderdate AS TIMESTAMP) END AS updated_at FROM orders""",
)
def _(spark, d):
    o = B.table(spark, d, "orders").select(F.col("o_orderkey").alias("suppression_id"), "o_custkey", F.lit("ACTIVE").alias("status"), F.col("o_orderdate").cast("timestamp_ntz").alias("updated_at"))
    return S.revoke(o, o.filter("o_custkey % 7 = 0"), "2002-01-01 00:00:00").drop("o_custkey")


@query("unique_violations", "SELECT user_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 1")
def _(spark, d):
    return tables.uniqueness_errors(B.table(spark, d, "events"), "user_id")


@query(
    "droppable_collections",
    "SELECT CASE WHEN c_custkey % 2 = 0 THEN 'ast_' ELSE 'kb_' END || c_custkey AS collection FROM customer WHERE c_custkey % 2 = 0",
)
def _(spark, d):
    c = B.table(spark, d, "customer").select("c_custkey")
    names = c.select(F.concat(F.when(F.col("c_custkey") % 2 == 0, "ast_").otherwise("kb_"), F.col("c_custkey").cast("string")).alias("collection"))
    return tables.droppable(names.unionByName(c.limit(1).select(F.lit("ast_documents").alias("collection"))))


@query(
    "resolved_weakness",
    """SELECT analysis_id, finding_id, CASE WHEN line_no = 1 THEN 'CWE-79' WHEN line_no = 2 THEN 'CWE-22' ELSE CASE signal_type WHEN 'unsafe_database_execution' THEN 'CWE-89'
         WHEN 'command_execution_call' THEN 'CWE-78' WHEN 'possible_hardcoded_secret' THEN 'CWE-798' WHEN 'path_traversal_call' THEN 'CWE-22' END END AS cwe
       FROM findings WHERE signal_type IN ('unsafe_database_execution', 'command_execution_call', 'possible_hardcoded_secret', 'path_traversal_call') OR line_no < 3""",
    ("findings",),
)
def _(spark, d):
    known = ["unsafe_database_execution", "command_execution_call", "possible_hardcoded_secret", "path_traversal_call"]
    f = B.findings(spark, d).filter(F.col("signal_type").isin(*known) | (F.col("line_no") < 3))
    direct = F.when(F.col("line_no") == 1, "cwe-79").when(F.col("line_no") == 2, "22")
    return f.select("analysis_id", "finding_id", R.resolve_cwe(direct, "signal_type", X.SIGNAL_CWES).alias("cwe"))


@query(
    "latest_completed_analysis",
    """SELECT user_id, analysis_id, created_at FROM analyses WHERE status = 'completed'
       QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, analysis_id DESC) = 1""",
    ("analyses",),
)
def _(spark, d):
    return A.latest_completed(B.analyses(spark, d), ["user_id"])


@query(
    "analysis_detail",
    "SELECT a.analysis_id, a.status, f.finding_id, f.severity FROM analyses a LEFT JOIN findings f USING (analysis_id) WHERE a.analysis_id = 7",
    ("analyses", "findings"),
)
def _(spark, d):
    return A.analysis_detail(B.analyses(spark, d), B.findings(spark, d), 7).select("analysis_id", "status", "finding_id", "severity")
