import datetime as dt

import pytest
from conftest import SF, plan_of
from pyspark.sql import functions as F

from tidewatch.operators import analytics as A
from tidewatch.operators import dashboards as D
from tidewatch.operators import predicates as P
from tidewatch.operators.ranking import exact_quantiles, position_in_group, top_n
from tidewatch.sources import bridge as B

NOW = "2026-01-31 00:00:00"
ANALYSIS = "analysis_id long, created_at timestamp_ntz, author string, owner string, repository string, review_status string"


def analyses(rows):
    now = dt.datetime(2026, 1, 31)
    data = [(i, now - dt.timedelta(days=d), a, o, r, s) for i, (d, a, o, r, s) in enumerate([
        (3, "ann", "Org", "App", "allow"), (15, " bob ", "Org", "App", "BLOCK"), (45, "None", None, "Lib", None), (120, "", "Org", None, "odd")])]
    return rows(data, ANALYSIS)


@pytest.mark.parametrize("window,n", [("7d", 1), ("30d", 2), ("90d", 3), ("all", 4), (None, 2), (" 7D ", 1)])
def test_windows(rows, window, n):
    assert P.in_window(analyses(rows), window, NOW).count() == n


def test_window_bound_is_inclusive(rows):
    df = rows([(dt.datetime(2026, 1, 24),), (dt.datetime(2026, 1, 23, 23, 59, 59),)], "created_at timestamp_ntz")
    assert P.in_window(df, "7d", NOW).count() == 1


def test_unknown_window():
    with pytest.raises(ValueError):
        P.window_days("1y")


@pytest.mark.parametrize("given,want", [(None, 20), (0, 20), (-3, 20), (7, 7), (500, 100)])
def test_limits(given, want):
    assert P.clamp_limit(given) == want


def test_repository_matching(rows):
    a = analyses(rows)
    ids = [r[0] for r in a.select(P.repo_id()).collect()]
    assert ids == ["Org/App", "Org/App", "Lib", "Org"]
    assert a.filter(P.repo_matches("org/a")).count() == 2
    assert a.filter(P.repo_matches("org")).count() == 2  # a bare owner is no candidate
    assert a.filter(P.repo_matches_developer("org")).count() == 3
    assert a.filter(P.repo_matches("x' OR '1'='1")).count() == 0


def test_liveness_of_iso_text(rows):
    data = [("ACTIVE", None), ("active", ""), ("ACTIVE", "2026-02-01T00:00:00Z"), ("ACTIVE", "2026-01-01T00:00:00+00:00"),
            ("ACTIVE", "2026-02-01T00:00:00"), ("ACTIVE", "junk"), ("REVOKED", None)]
    got = [r[0] for r in rows(data, "status string, expires_at string").select(P.suppression_live_iso(NOW)).collect()]
    assert got == [True, True, True, False, False, False, False]


def test_empty_store(rows):
    a = rows([], ANALYSIS)
    f = rows([], "analysis_id long, category string, severity string")
    s = rows([], "status string, expires_at timestamp_ntz, created_at timestamp_ntz, repository_id string, reason_code string, fingerprint_version int")
    one = A.analytics_summary(a, f, s, NOW, NOW).collect()
    assert len(one) == 1 and all(v == 0 for v in one[0])
    assert A.repository_analytics(a, f, NOW).count() == 0
    assert A.suppression_analytics(s, NOW).count() == 0


def test_repository_without_findings_stays(rows):
    f = rows([(0, "c", "CRITICAL"), (0, "c", "weird")], "analysis_id long, category string, severity string")
    got = {r["repository_id"]: r for r in A.repository_analytics(analyses(rows), f, NOW, "all").collect()}
    assert got["Org/App"]["finding_count"] == 2 and got["Org/App"]["critical_count"] == 1
    assert got["Lib"]["finding_count"] == 0 and got["Lib"]["unknown_count"] == 1


def test_empty_category_is_named(rows):
    f = rows([(0, "", "low"), (1, None, "low")], "analysis_id long, category string, severity string")
    got = A.vulnerability_analytics(analyses(rows), f, NOW, "all").collect()
    assert [(r["category"], r["finding_count"]) for r in got] == [("General Security", 2)]


def test_sorting_nulls_last(rows):
    df = rows([("a", None), ("b", "low"), ("c", "critical")], "finding_id string, severity string")
    assert [r[0] for r in D.sort_rows(df, "severity", True).collect()] == ["c", "b", "a"]


def test_users_ignore_unknown_filters(rows):
    u = rows([(1, "ADMIN", "ACTIVE"), (2, "USER", "ACTIVE")], "user_id int, role string, status string")
    assert D.filter_users(u, role="nonsense").count() == 2
    assert [r["last_admin"] for r in D.last_admin_flags(u).orderBy("user_id").collect()] == [True, False]


def test_time_filter_reaches_the_scan(spark):
    text = plan_of(P.in_window(B.table(spark, SF, "orders").withColumnRenamed("o_orderdate", "created_at"), "7d", B.ANALYSES_NOW))
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in text


def test_group_limit_runs_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    text = plan_of(top_n(df, ["k"], [F.col("id")], 2))
    assert text.count("WindowGroupLimit") >= 2 and "Partial" in text


def test_position_in_a_hot_group(spark):
    n = 20000
    df = spark.range(n).select(F.when(F.col("id") % 3 < 2, "hot").otherwise("cold").alias("k"), ((F.col("id") * 7919) % 5000).alias("line"), "id")
    got = position_in_group(df, ["k"], F.floor(F.col("line") / 64), [F.col("line"), F.col("id")], "p").toPandas()
    want = got.sort_values(["k", "line", "id"]).groupby("k").cumcount()
    assert (got.loc[want.index, "p"] == want).all()


def test_inputs_unchanged(rows):
    a = analyses(rows)
    before = a.collect()
    A.developer_analytics(a.selectExpr("*", *[f"0 AS {c}" for c in ("finding_count", "critical_count", "high_count", "medium_count", "low_count")]), NOW).collect()
    assert a.collect() == before


def test_quantiles_of_a_hot_key(rows):
    import numpy as np

    rng = np.random.default_rng(2)
    data = [("hot" if i % 4 else f"k{i % 3}", float(np.round(rng.normal(0, 50), 1))) for i in range(3000)] + [("one", 7.5), ("nul", None)]
    got = {r["k"]: (r["a"], r["b"]) for r in exact_quantiles(rows(data, "k string, v double"), "k", "v", {"a": 0.5, "b": 0.95}, 10.0).collect()}
    assert set(got) == {k for k, v in data if v is not None}
    for k, (a, b) in got.items():
        v = [x for kk, x in data if kk == k]
        assert abs(a - np.quantile(v, 0.5)) < 1e-9 and abs(b - np.quantile(v, 0.95)) < 1e-9
