"""Curation queries (survey 2.3-2.6). The fix corpus is mapped onto the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import curation as C
from tidewatch.plans.registry import query
from tidewatch.sources import bridge as B

CWES = ["CWE-89", "CWE-79", "CWE-787", "cwe-22", "CWE-119", "CWE-502", "78", "CWE-20", "CWE-94", "CWE-352"]


def cwe_of(c):
    return F.element_at(F.array(*[F.lit(x) for x in CWES]), (c % len(CWES) + 1).cast("int"))


def cwe_sql(c):
    return f"(CAST([{', '.join(repr(x) for x in CWES)}] AS VARCHAR[]))[CAST({c} % {len(CWES)} + 1 AS INT)]"


def kev(spark, d):
    p = B.table(spark, d, "part")
    a, b = cwe_of(F.col("p_partkey")), cwe_of(F.length("p_name") + F.col("p_size"))
    cwes = F.when(F.col("p_brand") == "Brand#1", "").when(F.col("p_brand") < "Brand#2", a).otherwise(F.concat(a, F.lit("; "), b))
    return p.select(
        F.concat(F.lit(" cve-"), F.col("p_size").cast("string")).alias("cveID"), F.col("p_brand").alias("vendorProject"), F.col("p_name").alias("product"),
        F.when(F.col("p_type") == "PROMO", "").otherwise(F.col("p_type")).alias("vulnerabilityName"), F.lit("2024-01-01").alias("dateAdded"),
        F.concat(F.lit("password = 'pw"), F.col("p_partkey").cast("string"), F.lit("x'")).alias("shortDescription"), F.lit("patch").alias("requiredAction"),
        F.when(F.col("p_type") == "SMALL", "see vendor").alias("notes"), cwes.alias("cwes"), F.col("p_partkey").alias("pos"))


KEV = f"""WITH k AS (SELECT upper(trim(' cve-' || p_size)) AS cve, p_partkey AS pos, p_brand, p_name, p_type,
   CASE WHEN p_brand = 'Brand#1' THEN '' WHEN p_brand < 'Brand#2' THEN {cwe_sql('p_partkey')} ELSE {cwe_sql('p_partkey')} || '; ' || {cwe_sql('(length(p_name) + p_size)')} END AS cwes FROM part),
 t AS (SELECT cve, pos, cwes, unnest(regexp_split_to_array(cwes, '[,;]')) AS tok, generate_subscripts(regexp_split_to_array(cwes, '[,;]'), 1) AS i FROM k),
 m AS (SELECT cve, pos, i, upper(trim(tok)) AS cwe FROM t WHERE upper(trim(tok)) IN ({', '.join(repr(x) for x in C.SUPPORTED)})),
 a AS (SELECT cve, cwe, min(pos * 100 + i) AS ord FROM m GROUP BY 1, 2),
 g AS (SELECT cve, string_agg(cwe, ', ' ORDER BY ord) AS cwes, CAST(min(ord) // 100 AS BIGINT) AS first_pos FROM a GROUP BY 1)
"""


@query(
    "kev_documents",
    KEV + r"""SELECT 'knowledge_cisa_kev_' || g.cve AS document_id, split_part(g.cwes, ', ', 1) AS cwe_id, g.cwes,
     concat_ws(E'\n\n', '# ' || g.cve || ': ' || CASE WHEN p_type = 'PROMO' THEN p_name ELSE p_type END, '**Vendor/Product**: ' || p_brand || ' ' || p_name,
       '**CWE Associations**: ' || g.cwes, '**Date Added to KEV**: 2024-01-01', '**Description**: password = ''[REDACTED_SECRET]''',
       '**Required Remediation**: patch', CASE WHEN p_type = 'SMALL' THEN '**Notes**: see vendor' END) AS content
     FROM g JOIN k ON k.cve = g.cve AND k.pos = g.first_pos""",
)
def _(spark, d):
    return C.kev_documents(kev(spark, d)).select("document_id", "cwe_id", F.array_join("cwes", ", ").alias("cwes"), "content")


@query(
    "kev_statistics",
    KEV + f"""SELECT (SELECT count(*) FROM k) AS total_source_records, (SELECT count(*) FROM k WHERE cwes = '') AS missing_cwe_records,
      (SELECT count(*) FROM k WHERE cwes <> '' AND pos NOT IN (SELECT pos FROM m)) AS unsupported_cwe_records,
      (SELECT count(*) FROM g) AS distinct_matched_cves, (SELECT count(*) FROM a) AS matched_cwe_associations""",
)
def _(spark, d):
    return C.kev_statistics(kev(spark, d))


def star(spark, d):
    o, li, p, c = (B.table(spark, d, n) for n in ("orders", "lineitem", "part", "customer"))
    s = lambda x: F.col(x).cast("string")
    fixes = o.select(F.concat(F.lit("CVE-"), s("o_custkey")).alias("cve_id"), s("o_orderkey").alias("hash"), F.concat(F.lit("repo/"), s("o_orderpriority")).alias("repo_url"))
    commits = o.select(s("o_orderkey").alias("hash"), F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderpriority")).alias("msg"))
    lang = F.when(F.col("l_returnflag") == "A", "Python").when(F.col("l_returnflag") == "R", "TypeScript").otherwise("C++")
    fcid = F.concat_ws("-", s("l_orderkey"), s("l_linenumber"), s("l_partkey"), s("l_suppkey"))
    file_change = li.select(
        fcid.alias("file_change_id"), s("l_orderkey").alias("hash"), F.concat(F.lit("f"), s("l_partkey"), F.lit(".x")).alias("filename"),
        F.repeat(F.lit("b"), (F.col("l_quantity") * 4).cast("int")).alias("code_before"),
        F.when(F.col("l_linestatus") == "F", "").otherwise(F.repeat(F.lit("a"), (F.col("l_quantity") * 5).cast("int"))).alias("code_after"),
        F.lit("@@").alias("diff"), lang.alias("programming_language"))
    method = li.join(p, F.col("l_partkey") == F.col("p_partkey")).filter("p_type = 'PROMO'").select(
        fcid.alias("file_change_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("code"), F.lit("1").alias("before_change")).distinct()
    cwe = c.select(F.concat(F.lit("CVE-"), s("c_custkey")).alias("cve_id"), cwe_of(F.col("c_nationkey")).alias("cwe_id"))
    cve = c.select(F.concat(F.lit("CVE-"), s("c_custkey")).alias("cve_id"), F.col("c_name").alias("description"))
    repo = o.select(F.concat(F.lit("repo/"), "o_orderpriority").alias("repo_url"), F.col("o_orderpriority").alias("repo_name")).distinct()
    return fixes, commits, file_change, method, cwe, cve, repo


FC = f"""fc AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS file_change_id, CAST(l_orderkey AS VARCHAR) AS hash, l_partkey, l_quantity, l_linestatus,
   CASE l_returnflag WHEN 'A' THEN 'python' WHEN 'R' THEN 'typescript' ELSE 'c++' END AS lang FROM lineitem),
 fx AS (SELECT 'CVE-' || o_custkey AS cve_id, CAST(o_orderkey AS VARCHAR) AS hash, CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderpriority END AS msg, o_custkey FROM orders),
 cw AS (SELECT 'CVE-' || c_custkey AS cve_id, {cwe_sql('c_nationkey')} AS cwe_id FROM customer)"""
FIXROWS = f"""WITH {FC}, mc AS (SELECT DISTINCT file_change_id, p_name AS method FROM fc JOIN part ON l_partkey = p_partkey WHERE p_type = 'PROMO'),
 r AS (SELECT fc.*, fx.cve_id, fx.msg, cw.cwe_id AS raw, coalesce(mc.method, '') AS method,
   CASE WHEN upper(cw.cwe_id) LIKE 'CWE-%' THEN upper(cw.cwe_id) WHEN regexp_matches(cw.cwe_id, '^[0-9]+$') THEN 'CWE-' || cw.cwe_id ELSE '' END AS cwe
   FROM fc JOIN fx USING (hash) LEFT JOIN cw ON cw.cve_id = fx.cve_id LEFT JOIN mc ON mc.file_change_id = fc.file_change_id)"""


@query(
    "cvefix_multi_join",
    FIXROWS + " SELECT file_change_id, cve_id, raw AS cwe_id, method AS method_name, count(*) AS n FROM r GROUP BY 1, 2, 3, 4",
)
def _(spark, d):
    fixes, commits, fc, method, cwe, _, _ = star(spark, d)
    return C.fix_rows(fc, fixes, commits, cwe, method).groupBy(
        "file_change_id", "cve_id", "cwe_id", F.coalesce("method_name", F.lit("")).alias("method_name")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "cvefix_documents",
    FIXROWS + f"""SELECT 'knowledge_cvefixes_' || cve_id || '_' || cwe || '_' || row_number() OVER (ORDER BY cve_id, file_change_id, hash, cwe, method) AS document_id, lang AS language
     FROM (SELECT DISTINCT cve_id, cwe, file_change_id, method, hash, lang FROM r WHERE lang IN ('python', 'typescript') AND cwe IN ({', '.join(repr(x) for x in C.SUPPORTED)}))
""",
)
def _(spark, d):
    fixes, commits, fc, method, cwe, _, _ = star(spark, d)
    return C.fix_documents(C.fix_rows(fc, fixes, commits, cwe, method)).select("document_id", "language")


EXTRACT = f"""WITH {FC}, x AS (SELECT fc.*, fx.cve_id, cw.cwe_id, 4 * l_quantity BETWEEN 100 AND 3000 AND 5 * l_quantity BETWEEN 100 AND 3000 AS moderate
   FROM fc JOIN fx USING (hash) JOIN cw ON cw.cve_id = fx.cve_id WHERE lang IN ('python', 'typescript') AND l_linestatus = 'O' AND msg <> ''
   AND cw.cwe_id IN ({', '.join(repr(x) for x in C.EXTRACTED)})),
 pool AS (SELECT *, max(moderate) OVER (PARTITION BY lang, cwe_id) AS has FROM x)"""


@query("extraction_join", EXTRACT + " SELECT file_change_id, cve_id, cwe_id, lang AS language, count(*) AS n FROM x GROUP BY 1, 2, 3, 4")
def _(spark, d):
    fixes, commits, fc, _, cwe, cve, repo = star(spark, d)
    return C.extraction_rows(fixes, cwe, commits, cve, fc, repo).groupBy("file_change_id", "cve_id", "cwe_id", "language").agg(F.count(F.lit(1)).alias("n"))


@query(
    "moderate_pool",
    EXTRACT + " SELECT lang AS language, cwe_id, count(*) AS n FROM pool WHERE moderate OR NOT has GROUP BY 1, 2",
)
def _(spark, d):
    fixes, commits, fc, _, cwe, cve, repo = star(spark, d)
    return C.prefer_moderate(C.extraction_rows(fixes, cwe, commits, cve, fc, repo)).groupBy("language", "cwe_id").agg(F.count(F.lit(1)).alias("n"))


@query("stratified_pick")
def _(spark, d):
    fixes, commits, fc, _, cwe, cve, repo = star(spark, d)
    return C.stratified_pick(C.prefer_moderate(C.extraction_rows(fixes, cwe, commits, cve, fc, repo)))


@query("orphan_files", f"WITH {FC} SELECT count(*) AS orphans FROM fc WHERE hash NOT IN (SELECT hash FROM fx)")
def _(spark, d):
    fixes, _, fc, *_ = star(spark, d)
    return fc.join(fixes, "hash", "left_anti").agg(F.count(F.lit(1)).alias("orphans"))


@query(
    "subset_profile",
    f"WITH {FC} SELECT lang AS language, count(*) AS n, count(DISTINCT hash) AS hashes, count(DISTINCT l_partkey) AS files FROM fc GROUP BY 1",
)
def _(spark, d):
    _, _, fc, *_ = star(spark, d)
    return fc.groupBy(F.lower("programming_language").alias("language")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("hash").alias("hashes"), F.countDistinct("filename").alias("files"))


@query(
    "nvd_description",
    """SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_name WHEN c_mktsegment = 'FURNITURE' THEN 'first ' || c_name ELSE 'Flaw in ' || c_name END AS description FROM customer""",
)
def _(spark, d):
    c = B.table(spark, d, "customer")
    es = F.concat(F.lit("[{'lang': 'es', 'value': 'first "), "c_name", F.lit("'}"))
    raw = F.when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("  "), "c_name")).when(F.col("c_mktsegment") == "FURNITURE", F.concat(es, F.lit("]"))).otherwise(
        F.concat(es, F.lit(", {'lang': 'en', 'value': 'Flaw in "), "c_name", F.lit(" '}]")))
    return c.select("c_custkey", C.clean_description(raw).alias("description"))
