"""Deterministic views that let the supplied star schema stand in for the
service's tables. Every view exists twice: as a lazy DataFrame and as a SQL
common table expression, so a Spark plan and its check read the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import default

# Anchors for "now": the last order date and the day after the last event.
ANALYSES_NOW = "2001-08-01 00:00:00"
EVENTS_NOW = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Spread a scan with fewer splits than cores before heavy per-row work. A
    large input has more splits than that and is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


_ANALYSES = """
  SELECT o.o_orderkey AS analysis_id,
         CASE o.o_orderpriority WHEN '5-LOW' THEN 'failed' WHEN '1-URGENT' THEN 'completed' ELSE 'success' END AS status,
         o.o_orderdate AS created_at,
         CASE WHEN c.c_acctbal < 0 THEN ' Unknown ' ELSE concat(c.c_name, ' ') END AS author,
         CASE WHEN c.c_mktsegment = 'HOUSEHOLD' THEN NULL ELSE r.r_name END AS owner,
         CASE WHEN c.c_mktsegment = 'FURNITURE' THEN NULL ELSE n.n_name END AS repository,
         CASE WHEN o.o_orderpriority = '4-NOT SPECIFIED' THEN NULL
              WHEN o.o_orderstatus = 'F' THEN 'Block' WHEN o.o_orderstatus = 'P' THEN 'review' ELSE 'allow' END AS review_status,
         o.o_custkey AS user_id,
         CAST(floor(o.o_totalprice) AS BIGINT) AS pr_number
  FROM {orders} o
  JOIN {customer} c ON o.o_custkey = c.c_custkey
  JOIN {nation} n ON c.c_nationkey = n.n_nationkey
  JOIN {region} r ON n.n_regionkey = r.r_regionkey"""

_FINDINGS = """
  SELECT l.l_orderkey AS analysis_id,
         concat(CAST(l.l_linenumber AS VARCHAR(20)), '-', CAST(l.l_partkey AS VARCHAR(20)), '-', CAST(l.l_suppkey AS VARCHAR(20))) AS finding_id,
         concat('Risky ', lower(p.p_type), ' call') AS title,
         concat('Call reaches ', p.p_name) AS description,
         CASE WHEN l.l_linestatus = 'F' THEN upper(l.sev) ELSE l.sev END AS severity,
         CASE l.l_returnflag WHEN 'R' THEN 'high' WHEN 'A' THEN 'MEDIUM' ELSE 'maybe' END AS confidence,
         p.p_brand AS category,
         concat('src/', replace(p.p_name, ' ', '/'), '.py') AS file_path,
         CAST(l.l_suppkey + 1 AS INT) AS line,
         CASE p.p_type WHEN 'ECONOMY' THEN 'unsafe_database_execution' WHEN 'STANDARD' THEN 'command_execution_call'
              WHEN 'PROMO' THEN 'dynamic_code_execution' WHEN 'SMALL' THEN 'possible_hardcoded_secret'
              WHEN 'MEDIUM' THEN 'path_traversal_call' ELSE 'weak_cryptography' END AS signal_type,
         concat('call_', CAST(p.p_size AS VARCHAR(20))) AS signal_name,
         concat('fn_', CAST(l.l_linenumber AS VARCHAR(20))) AS scope,
         concat('ev-', CAST(l.l_partkey AS VARCHAR(20)), '-', l.l_returnflag) AS document_id,
         l.l_partkey AS part_id, l.l_suppkey AS supp_id, l.l_linenumber AS line_no, l.l_shipdate AS seen_at
  FROM (SELECT *, CASE WHEN l_quantity >= 45 THEN 'critical' WHEN l_quantity >= 35 THEN 'high'
                       WHEN l_quantity >= 20 THEN 'medium' WHEN l_quantity >= 5 THEN 'low'
                       WHEN l_quantity >= 2 THEN 'info' ELSE 'note' END AS sev FROM {lineitem}) l
  JOIN {part} p ON l.l_partkey = p.p_partkey"""

_SUPPRESSIONS = """
  SELECT event_id AS suppression_id,
         user_id AS repository_id,
         event_id AS analysis_id,
         CASE event_type WHEN 'error' THEN 'revoked' ELSE 'ACTIVE' END AS status,
         CASE event_type WHEN 'click' THEN 'TEST_CODE' WHEN 'view' THEN 'ACCEPTED_RISK'
              WHEN 'purchase' THEN NULL ELSE 'OTHER' END AS reason_code,
         CASE WHEN event_type IN ('click', 'error') THEN 1 ELSE 2 END AS fingerprint_version,
         ts AS created_at,
         CASE WHEN event_type = 'signup' THEN NULL
              ELSE {expiry} END AS expires_at
  FROM {{events}}"""

_KDOCS = """
  SELECT doc_id, CASE WHEN lang = 'es' THEN 'knowledge' ELSE 'ast' END AS collection, text AS content,
         CASE lang WHEN 'en' THEN 'security_evidence' WHEN 'fr' THEN 'function_structure'
                   WHEN 'de' THEN 'module_structure' ELSE 'security_knowledge' END AS document_type,
         source AS title,
         CASE WHEN n_chars > 3000 THEN concat('CWE-', CAST(n_chars % 100 AS VARCHAR(20))) END AS cwe_id
  FROM {documents}"""

_VIEWS = {
    "kdocs": (("documents",), _KDOCS, _KDOCS),
    "analyses": (("orders", "customer", "nation", "region"), _ANALYSES, _ANALYSES),
    "findings": (("lineitem", "part"), _FINDINGS, _FINDINGS),
    "suppressions": (
        ("events",),
        _SUPPRESSIONS.format(expiry="ts + make_dt_interval(0, CAST(floor(value) AS INT), 0, 0)"),
        _SUPPRESSIONS.format(expiry="ts + to_hours(CAST(floor(value) AS INT))"),
    ),
}


def _view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables, body, _ = _VIEWS[name]
    return spark.sql(body, **{t: table(spark, sf_dir, t) for t in tables})


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "analyses")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "findings")


def findings_by_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings, hashed by ``part_id``: their join is merged at every size, so
    what groups by part afterwards needs no shuffle of the texts. A part with
    very many rows is split, at the price of a shuffle."""
    default(spark, "spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    body = _FINDINGS.replace("SELECT", "SELECT /*+ MERGE(p) */", 1)
    return spark.sql(body, lineitem=table(spark, sf_dir, "lineitem"), part=table(spark, sf_dir, "part"))


def findings_of_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings whose analysis is there, with its ``repository`` ('default' where
    it has none). The texts of a finding are made after both joins, so that these
    send the columns they are made of."""
    body = _FINDINGS.replace("AS seen_at", "AS seen_at, coalesce(a.repository, 'default') AS repository") + "\n  JOIN {analyses} a ON a.analysis_id = l.l_orderkey"
    return spark.sql(body, lineitem=table(spark, sf_dir, "lineitem"), part=table(spark, sf_dir, "part"), analyses=analyses(spark, sf_dir))


def suppressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "suppressions")


def knowledge_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval documents with an open metadata map."""
    meta = F.create_map(
        F.lit("document_type"), "document_type", F.lit("title"), "title", F.lit("cwe_id"), "cwe_id")
    return spread(_view(spark, sf_dir, "kdocs"), "doc_id").withColumn("metadata", meta)


def sql_views(*names: str) -> str:
    """``WITH`` clause defining the named views for the SQL side."""
    if not names:
        return ""
    parts = []
    for n in names:
        tables, _, body = _VIEWS[n]
        parts.append(f"{n} AS ({body.format(**{t: t for t in tables})})")
    return "WITH " + ",\n".join(parts) + "\n"


def now_lit(value: str):
    return F.lit(value).cast("timestamp_ntz")
