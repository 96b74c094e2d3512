import hashlib
import re

import duckdb
import pytest
from conftest import SF, plan_of
from pyspark.sql import functions as F

from tidewatch.functions import hashing as H
from tidewatch.operators import findings as X
from tidewatch.operators import suppression as S

SCHEMA = (
    "scope_id int, pos int, evidence_id string, title string, category string, description string, severity string, confidence string, "
    "file_path string, line int, document_id string, line_start int, line_end int, signal_type string, signal_name string"
)


def f(pos, eid="", title="T", cat="C", sev="low", conf="low", doc="d1", line=1, desc="x"):
    return (1, pos, eid, title, cat, desc, sev, conf, "p.py", line, doc, line, line, "s", "n")


def test_normalize_clamps_masks_and_drops(rows):
    df = rows([f(1, sev=" HIGH ", conf="odd", title=" a THIS_SECRET_MUST_NOT_APPEAR "), f(2, sev="info", title="   "), f(3, doc="  "),
               f(4, desc="y" * 2001)], SCHEMA)
    got = X.normalize_findings(df).orderBy("pos").collect()
    assert [r["pos"] for r in got] == [1, 2, 4]
    assert (got[0]["severity"], got[0]["confidence"], got[0]["title"]) == ("high", "low", "a [REDACTED_SECRET]")
    assert (got[1]["severity"], got[1]["title"]) == ("unknown", "Security Finding")
    assert got[2]["description"] == "y" * 2000 + "...[truncated]"


def test_merge_takes_strongest_and_first(rows):
    df = rows([f(2, "e", title="second", sev="critical", line=5), f(1, "e", title="first", sev="low", conf="high"), f(3, "e", line=5)], SCHEMA)
    m = X.with_evidence_count(X.merge_findings(df, ["scope_id"], ["pos"]), df, ["scope_id"]).collect()
    assert len(m) == 1
    assert (m[0]["title"], m[0]["severity"], m[0]["confidence"], m[0]["evidence_count"], m[0]["merged_rows"]) == ("first", "critical", "high", 2, 3)
    ev = X.merged_evidence(df, ["scope_id"], ["pos"]).orderBy("first_seen").collect()
    assert [r["line_start"] for r in ev] == [1, 5]


def test_identity_without_evidence_id_ignores_case(rows):
    df = rows([f(1, title="SQL", cat=" Inj"), f(2, title="sql ", cat="inj"), f(3, title="sql", cat="inj", doc="d2")], SCHEMA)
    assert X.merge_findings(df, ["scope_id"], ["pos"]).count() == 2


def test_merge_sends_only_the_wanted_fields(rows):
    data = [f(i, f"e{i % 4}" if i % 3 else "", title=f"t{i % 5}", sev=["low", "high", "critical"][i % 3], doc=f"d{i % 2}", desc=f"x{i}") for i in range(40)]
    df = rows([(None if i % 5 == 0 else i % 2, *r[1:]) for i, r in enumerate(data)], SCHEMA)
    whole = X.merge_findings(df, ["scope_id"], ["pos"])
    few = X.merge_findings(df, ["scope_id"], ["pos"], ["title"])
    cols = ["scope_id", "title", "severity", "confidence", "merged_rows"]
    assert sorted(map(str, few.select(cols).collect())) == sorted(map(str, whole.select(cols).collect()))
    plan = few._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not [x for x in plan if "description" in x and "LogicalRDD" not in x]
    # the identity text is made after the groups met, so that it is not sent
    assert {(r["scope_id"], r["identity"]) for r in whole.collect()} == {(r[0], r[1]) for r in df.select("scope_id", X.identity()).collect()}
    a, b = (X.with_evidence_count(m, df, ["scope_id"]).select("scope_id", "title", "evidence_count") for m in (few, whole))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and a.count() == few.count()


def test_cap_order_and_report(rows):
    data = [f(i, f"e{i}", title=f"t{i:02d}", sev="medium") for i in range(25)] + [f(99, "z", sev="high")]
    ranked = X.rank_findings(X.merge_findings(rows(data, SCHEMA), ["scope_id"], ["pos"]), ["scope_id"])
    got = {r["finding_id"]: r["title"] for r in ranked.collect()}
    assert len(got) == 20 and got["finding_1"] == "T" and got["finding_2"] == "t00"
    rep = X.report_rows(ranked, ["scope_id"]).collect()[0]
    assert (rep["total_findings"], rep["high_count"], rep["medium_count"], rep["review_status"]) == (20, 1, 19, "block")
    assert [x["rank"] for x in rep["findings"]] == list(range(1, 21))


@pytest.mark.parametrize("row,want", [
    (("success", "block", 1, 0, 0, 0, 0), ("BLOCK", 1)),
    (("completed", "review", 0, 0, 2, 0, 0), ("REVIEW", 2)),
    (("success", "allow", 0, 0, 0, 5, 1), ("ALLOW", 0)),
    (("success", "allow", 1, 0, 0, 0, 0), ("INVALID", 1)),
    (("failed", "block", 1, 0, 0, 0, 0), ("INVALID", 1)),
    (("success", "block", None, 1, 0, 0, 0), ("INVALID", 1)),
    (("success", "block", 1, -1, 0, 0, 0), ("INVALID", 1)),
])
def test_gate(rows, row, want):
    df = rows([row], "status string, review_status string, critical_count int, high_count int, medium_count int, low_count int, info_count int")
    r = X.gate_evaluation(df).collect()[0]
    assert (r["decision"], r["exit_code"]) == want


def test_structured_query(rows):
    df = rows([(None, "unsafe_database_execution", "Injection", "SQL injection via SQL string", "High"), (None, "unknown", "Unknown", "", "low")],
              "cwe_id string, signal_type string, category string, title string, severity string")
    got = [r["query"] for r in X.structured_query(df).collect()]
    assert got == ["CWE-89 sql_injection Injection SQL via string high severity", "general_security"]


def test_fingerprints_match_the_plain_formula(rows):
    df = rows([(" Org/App ", "RULE", "CWE-89", "Src\\A.py:12", "Fn", "cursor.Execute")], "r string, rule string, cwe string, p string, s string, k string")
    got = df.select(H.fingerprint_v1("r", "rule", "cwe", "p").alias("a"),
                    H.fingerprint_v2("r", "p", "rule", "cwe", "s", "k", F.lit("2")).alias("b"),
                    H.fingerprint_v2(F.lit(None), F.lit(None), F.lit(None), F.lit(None), F.lit(None), F.lit(None), F.lit("x")).alias("c")).collect()[0]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()[:32]
    assert got["a"] == sha("org/app:rule:cwe-89:src/a.py:12")
    assert got["b"] == sha("org/app:src/a.py:rule:cwe-89:Fn:cursor.Execute:2")
    assert got["c"] == sha("default:unknown:unknown::<module>:unknown:0")


def test_ambiguous_legacy_record_suppresses_nothing(rows, spark):
    base = [(1, "a", "r", "p.py", "sig", "C", "f1", "n1"), (1, "b", "r", "p.py", "sig", "C", "f2", "n2"), (2, "c", "r", "p.py", "sig", "C", "f3", "n3")]
    fs = S.with_fingerprints(rows(base, "analysis_id long, finding_id string, repository string, file_path string, signal_type string, category string, scope string, signal_name string"))
    v1 = fs.filter("finding_id = 'c'").select(F.lit("s1").alias("suppression_id"), F.lit(9).cast("long").alias("analysis_id"), F.lit("zz").alias("finding_id"), "repository", "fp_v1",
                                              F.lit(None).cast("string").alias("fp_v2"), F.lit(1).alias("fingerprint_version"),
                                              F.lit("2026-01-01").cast("timestamp_ntz").alias("created_at"), F.lit("ACTIVE").alias("status"),
                                              F.lit(None).cast("timestamp_ntz").alias("expires_at"))
    got = {r["finding_id"]: (r["matched_by"], r["legacy_ambiguous"], r["suppressed"]) for r in S.resolve(fs, v1, "2026-02-01").collect()}
    assert got == {"a": ("v1", True, False), "b": ("v1", True, False), "c": ("v1", False, True)}


def test_expired_v2_does_not_fall_back(rows):
    fs = S.with_fingerprints(rows([(1, "a", "r", "p.py", "sig", "C", "f1", "n1")], "analysis_id long, finding_id string, repository string, file_path string, signal_type string, category string, scope string, signal_name string"))
    rec = fs.select(F.lit("s").alias("suppression_id"), F.lit(9).cast("long").alias("analysis_id"), F.lit("z").alias("finding_id"), "repository", "fp_v1", "fp_v2",
                    F.lit(2).alias("fingerprint_version"), F.lit("2026-01-01").cast("timestamp_ntz").alias("created_at"), F.lit("ACTIVE").alias("status"),
                    F.lit("2026-01-02").cast("timestamp_ntz").alias("expires_at"))
    assert [r["suppressed"] for r in S.is_suppressed(fs, rec, "2026-02-01").collect()] == [False]


def test_resolution_sends_names_instead_of_texts(rows):
    kind = "analysis_id long, finding_id string, repository string, file_path string, signal_type string, category string, scope string, signal_name string"
    fs = S.with_fingerprints(rows([(1, "a", "r", "p.py", "sig", "C", "f1", "n1"), (1, "b", "r", None, "p.py", "C", "f2", "n2"), (1, "c", "r", "p.py", None, "C", "f3", "n3"), (None, "d", None, "p.py", "sig", "C", "f1", "n1")], kind))
    rec = fs.select(F.concat(F.lit("s"), "finding_id").alias("suppression_id"), F.lit(9).cast("long").alias("analysis_id"), F.lit("z").alias("finding_id"), "repository",
                    "fp_v1", F.when(F.col("finding_id") != "c", F.col("fp_v2")).alias("fp_v2"), F.lit(1).alias("fingerprint_version"),
                    F.lit("2026-01-01").cast("timestamp_ntz").alias("created_at"), F.lit("ACTIVE").alias("status"), F.lit(None).cast("timestamp_ntz").alias("expires_at"))
    out = S.resolve(fs, rec, "2026-02-01")
    # NULL is no path or rule of another row, and a record without repository or fingerprint matches nothing
    assert {r["finding_id"]: (r["suppression_id"], r["matched_by"], r["legacy_ambiguous"]) for r in out.collect()} == {
        "a": ("sa", "v2", False), "b": ("sb", "v2", False), "c": ("sc", "v1", False), "d": (None, None, False)}
    assert {r["finding_id"] for r in S.is_suppressed(fs, rec, "2026-02-01").filter("suppressed").collect()} == {"a", "b", "c"}
    plan = plan_of(out.select("finding_id", "suppressed")).split("== Physical")[-1]
    assert "hashpartitioning(_fp_v2" in plan and "hashpartitioning(repository" not in plan and "hashpartitioning(fp_v" not in plan


def test_reason_rules(rows):
    df = rows([("OTHER", "abc"), ("OTHER", "long enough"), (None, None), ("NOPE", "x"), ("FALSE_POSITIVE", "y" * 1001)], "reason_code string, reason string")
    assert [r["reason_error"] for r in S.validate_reason(df).collect()] == ["comment required", None, None, "unknown code", "comment too long"]


def test_counts_before_the_cap(rows):
    data = [f(i, f"e{i}", title=f"t{i:02d}", sev="medium") for i in range(25)] + [f(99, "z", sev="high")]
    merged = X.merge_findings(rows(data, SCHEMA), ["scope_id"], ["pos"])
    for cap in (1, 5, 20):
        got = X.rank_findings(merged, ["scope_id"], cap, counted=True).collect()
        assert len(got) == cap and {(r["total_before_cap"], r["gate_before_cap"]) for r in got} == {(26, "block")}


def test_null_keys_keep_their_rows(rows):
    data = [(1, "f1", None, None, "c", "r", "2a", "1a"), (1, "f2", None, None, "c", "r", "2b", "1b"), (None, "f3", "p", "s", None, "r", "2c", "1c"), (1, "f4", "p", "s", "c", "r", "2d", "1d")]
    fs = rows(data, "analysis_id long, finding_id string, file_path string, signal_type string, category string, repository string, fp_v2 string, fp_v1 string")
    none = rows([], "suppression_id long, analysis_id long, finding_id string, repository string, fp_v2 string, fp_v1 string, fingerprint_version int, status string, expires_at timestamp_ntz, updated_at timestamp_ntz, created_at timestamp_ntz")
    assert sorted(r["finding_id"] for r in S.resolve(fs, none, "2026-02-01").collect()) == ["f1", "f2", "f3", "f4"]
    df = rows([(None, *f(1, "e")[1:]), (None, *f(2, "e", line=5)[1:])], SCHEMA)
    m = X.with_evidence_count(X.merge_findings(df, ["scope_id"], ["pos"]), df, ["scope_id"]).collect()
    assert [(r["scope_id"], r["evidence_count"]) for r in m] == [(None, 2)]


def test_merge_by_document_keeps_ranks_and_sends_positions_only_for_ties(rows):
    # evidence ids are empty or the document; d1 and d3 hold several findings, some alike in all that is read before the position
    data = [(i % 3 or None, (i * 7) % 40, "" if i % 2 else f"d{i % 6}", "T", "C", "x", ["low", "high"][i % 5 == 0], "low", f"p{i}.py", 1, f"d{i % 6}", 1, 1, f"s{i % 4}", "n", i % 6 % 4)
            for i in range(40)]
    df = rows(data, SCHEMA + ", part_id int")
    plain, by = (X.merge_findings(df, ["scope_id"], ["pos", "file_path"], ["title", "category", "document_id", "signal_type"], b) for b in (None, ["part_id"]))
    cols = ["scope_id", "finding_id", "title", "document_id", "severity", "confidence", "merged_rows", "signal_type"]
    want, got = (sorted(map(str, X.rank_findings(m, ["scope_id"]).select(cols).collect())) for m in (plain, by))
    assert got == want and len({r["signal_type"] for r in by.collect()}) > 2
    n = {(r["scope_id"], r["document_id"]): r["count"] for r in by.groupBy("scope_id", "document_id").count().collect()}
    assert set(n.values()) > {1} and all((r["_first"] is None) == (n[r["scope_id"], r["document_id"]] == 1) for r in by.collect())
    a, b = (X.with_evidence_count(m, df, ["scope_id"], k).select("scope_id", "document_id", "signal_type", "evidence_count") for m, k in ((plain, None), (by, ["part_id"])))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and a.count() == plain.count()


REPORTS = ["finding_rank_cap", "fingerprint_set_digest"]


@pytest.mark.parametrize("name", REPORTS)
def test_reports_send_their_texts_once(spark, name):
    import __spark_entry__ as entry

    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert sorted(re.findall(r"Exchange hashpartitioning\((\w+)#", plan)) == ["analysis_id", "l_partkey", "p_partkey"]
    assert "Broadcast" not in plan


@pytest.mark.parametrize("name", [*REPORTS, "finding_merge"])
def test_reports_over_a_hot_part_and_parts_listed_twice(spark, tmp_path, name):
    import __spark_entry__ as entry

    con = duckdb.connect()
    con.execute(f"""COPY (SELECT * REPLACE (CASE WHEN l_orderkey % 5 > 0 THEN 3 ELSE l_partkey % 20 END AS l_partkey, l_orderkey % 400 AS l_orderkey)
        FROM '{SF}/lineitem.parquet') TO '{tmp_path}/lineitem.parquet' (ROW_GROUP_SIZE 2048)""")  # several map tasks
    con.execute(f"""COPY (SELECT * FROM '{SF}/part.parquet' UNION ALL SELECT * REPLACE ('old ' || p_name AS p_name, lower(p_type) AS p_type)
        FROM '{SF}/part.parquet' WHERE p_partkey % 2 = 1) TO '{tmp_path}/part.parquet'""")
    for t in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2000", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8000",
            "spark.sql.files.maxPartitionBytes": "20000", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        df = entry.queries()[name](spark, str(tmp_path))
        got = sorted(tuple(map(str, r)) for r in df.collect())
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert got == sorted(tuple(map(str, r)) for r in want) and len(got) > 300
    assert "skew=true" in plan  # the hot part is dealt over several tasks


def test_direct_records_meet_findings_within_an_analysis(rows):
    kind = "analysis_id int, finding_id string, repository string, file_path string, signal_type string, category string, fp_v1 string, fp_v2 string"
    fs = rows([(1, "a", "r", "p", "s", "c", "x", "y"), (1, "a", "r", "p", "s", "c", "x", "z"), (1, "b", "r", "p", "s", "d", "y", "w"), (2, "a", "r", None, "s", "c", "x", "v"),
               (None, "a", "r", "p", "s", "c", "u", "u"), (1, None, "r", "p", "s", "c", "u", "u"), (3, "a", "q", "p", "s", "c", "k", "k")], kind)
    rec = rows([("s1", 1, "a", 2, "2026-01-01"), ("s2", 1, "a", 1, "2026-01-02"), ("s3", 1, "a", 1, "2026-01-02"), ("s4", 2, "a", 1, "2026-01-01"), ("s5", None, "a", 2, "2026-01-01"),
                ("s6", 1, None, 2, "2026-01-01"), ("s7", 2**40 + 1, "b", 2, "2026-01-01"), ("s8", 9, "a", 2, "2026-01-01")],
               "suppression_id string, analysis_id long, finding_id string, fingerprint_version int, day string").selectExpr(
        "*", "'r' AS repository", "CAST(NULL AS string) AS fp_v1", "IF(suppression_id = 's8', 'y', NULL) AS fp_v2", "CAST(day AS timestamp_ntz) AS created_at", "'ACTIVE' AS status", "CAST(NULL AS timestamp_ntz) AS expires_at")
    out = S.resolve(fs, rec, "2026-02-01")
    assert set(out.columns) == {*fs.columns, "suppression_id", "matched_by", "is_expired", "legacy_ambiguous", "suppressed"}
    # the newest record with the highest id wins; NULL ids match nothing; a v2 fingerprint is no v1 fingerprint, here of b
    got = sorted((str(r["analysis_id"]), str(r["finding_id"]), r["fp_v2"], r["suppression_id"], r["matched_by"], r["legacy_ambiguous"], r["suppressed"]) for r in out.collect())
    assert got == [("1", "None", "u", None, None, False, False), ("1", "a", "y", "s3", "id", True, False), ("1", "a", "z", "s3", "id", True, False), ("1", "b", "w", None, None, False, False),
                   ("2", "a", "v", "s4", "id", False, True), ("3", "a", "k", None, None, False, False), ("None", "a", "u", None, None, False, False)]
    check = S.is_suppressed(fs, rec, "2026-02-01").collect()
    assert sorted((r["analysis_id"], str(r["finding_id"]), r["fp_v2"]) for r in check if r["suppressed"]) == [(1, "a", "y")] and len(check) == 6


@pytest.mark.parametrize("name", ["suppression_resolution", "suppression_check"])
def test_findings_are_shuffled_once_per_fingerprint(spark, name):
    import __spark_entry__ as entry

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    by = re.findall(r"Exchange hashpartitioning\(([^)]*?), 8\)", plan.replace("#", " #"))
    by = [", ".join(k.split()[0] for k in keys.split(", ")) for keys in by]
    assert by.count("_fp_v21, _fp_v22") == by.count("_fp_v11, _fp_v12") == 1
    # nothing is shuffled by rule, by finding id or by a counted fingerprint; the records of a name are
    assert {k for k in by if not re.fullmatch(r"[a-z]+_[a-z]+key", k)} <= {"_fp_v21, _fp_v22", "_fp_v11, _fp_v12", "_name1, _name2", "analysis_id"}
