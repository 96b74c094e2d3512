"""Sort modes and pages by key."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from tidewatch.operators import keyset as K

SCHEMA = ("id long, part string, severity string, title string, confidence double, analysis_created_at timestamp_ntz, created_at timestamp, expires_at timestamp_ntz, "
          "developer string, total_findings long, critical_count int, high_count decimal(10,2), last_activity date, file_path string, line int, is_false_positive boolean, "
          "cwe_id string, programming_language string, cve_id string, hash string, file_change_id string")


def some_rows(n, seed=7):
    r = random.Random(seed)
    words = [None, "", "alpha", "Alpha", "ALPHA", "álpha", "beta", "b-eta", "b eta", "Zed", "zed", "ß", "quote\"d", "tab\tbed", "☃"]
    stamp = lambda: r.choice([None, dt.datetime(2024, 1, 1, 0, 0, 0, r.randrange(3)), dt.datetime(1960, 5, 5), dt.datetime(2024, 1, r.randrange(1, 5))])
    word = lambda: r.choice(words)
    return [(i // 2 if i % 11 else None, "ab"[i % 2] if i % 13 else None, r.choice([None, "critical", "HIGH", "medium", "odd", "Info", "low"]), word(),
             r.choice([None, float("nan"), 0.1, 0.30000000000000004, -2.5]), stamp(), stamp(), stamp(), word(), r.choice([None, 0, 5, 2**60]), r.choice([None, 0, 3]),
             r.choice([None, 0, 1]), r.choice([None, dt.date(2024, 1, 2), dt.date(1970, 1, 1)]), word(), r.choice([None, 0, 7]), r.choice([None, True, False]),
             word(), word(), word(), word(), f"{i:04d}") for i in range(n)]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(*x[:9], x[9], x[10], None if x[11] is None else __import__("decimal").Decimal(x[11]), *x[12:]) for x in some_rows(60)]
    return spark.createDataFrame(rows, SCHEMA).withColumn("n", F.monotonically_increasing_id()).repartition(4).cache()


IDS = ["id", "part", "n"]


@pytest.mark.parametrize("view, mode", [("vulnerabilities", "sev-desc"), ("vulnerabilities", "conf-desc"), ("vulnerabilities", "date-asc"), ("suppressions", "created-desc"),
                                        ("suppressions", "expires-desc"), ("suppressions", "expires-asc"), ("developers", "high-asc"), ("developers", "date-desc"),
                                        ("review", "status-open-first"), ("history", "file-asc"), ("extraction", "default")])
def test_pages_cover_the_order(table, view, mode):
    whole = [r.n for r in K.ordered(table, view, mode, IDS).collect()]
    got, after = [], None
    while True:
        rows = K.page(table, view, mode, IDS, 17, after).collect()
        got += [r.n for r in rows]
        if len(rows) < 17:
            break
        after = rows[-1].cursor
    assert got == whole and len(set(got)) == 60


def test_every_mode_sorts(table):
    for view, modes in K.SORT_MODES.items():
        for mode in modes:
            assert K.page(table, view, mode, IDS, 3).count() == 3


def test_order_of_missing_values(rows):
    day = dt.datetime(2024, 1, 1)
    df = rows([(1, "HIGH", "b", None, None, day), (2, "weird", None, 0.5, day, None), (3, None, "a", float("nan"), dt.datetime(1960, 1, 1), day - dt.timedelta(1)),
               (4, "low", "B", -1.0, day, None)], "id long, severity string, title string, confidence double, analysis_created_at timestamp_ntz, expires_at timestamp_ntz")
    order = lambda view, mode: [r.id for r in K.ordered(df, view, mode, ["id"]).collect()]
    assert order("vulnerabilities", "sev-desc") == [1, 4, 2, 3]  # empty title before "a"
    assert order("vulnerabilities", "sev-asc") == [2, 3, 4, 1]
    assert order("vulnerabilities", "title-asc") == [2, 3, 1, 4]  # b before B
    assert order("vulnerabilities", "conf-desc") == [2, 1, 3, 4]
    assert order("vulnerabilities", "date-asc") == [3, 1, 2, 4]
    assert order("vulnerabilities", "date-desc") == [2, 4, 1, 3]
    assert order("suppressions", "expires-asc") == [3, 1, 2, 4]
    assert order("suppressions", "expires-desc") == [1, 3, 2, 4]


def test_text_confidence_is_no_number(rows):
    df = rows([(2, "high"), (1, "low")], "id long, confidence string")
    assert [r.id for r in K.ordered(df, "vulnerabilities", "conf-desc", ["id"]).collect()] == [1, 2]


def test_rows_added_elsewhere_do_not_move_the_page(rows):
    df = rows([(i, f"t{i:02d}") for i in range(10)], "id long, title string")
    last = K.page(df, "history", "title-asc", ["id"], 4).collect()[-1].cursor
    more = df.unionByName(rows([(99, "a"), (98, "")], "id long, title string")).filter("id <> 3")
    assert [r.id for r in K.page(more, "history", "title-asc", ["id"], 3, last).collect()] == [4, 5, 6]


def test_empty_table_and_wrong_cursor(rows):
    df = rows([], "id long, title string")
    assert K.page(df, "history", "title-asc", ["id"], 5).collect() == []
    with pytest.raises(ValueError, match="unknown sort mode"):
        K.page(df, "history", "date-desc", ["id"], 5)
    cursor = K.page(rows([(1, "x")], "id long, title string"), "history", "title-asc", ["id"], 5).head().cursor
    assert K.page(df, "history", "title-asc", ["id"], 5, cursor).collect() == []
    with pytest.raises(ValueError, match="not one of"):
        K.page(df, "vulnerabilities", "title-asc", ["id"], 5, cursor)


def test_plan_is_a_top_k_with_a_pushed_bound(spark, table, tmp_path):
    table.write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    cursor = K.page(df, "vulnerabilities", "date-desc", IDS, 5).tail(1)[0].cursor
    plan = plan_of(K.page(df, "vulnerabilities", "date-desc", IDS, 5, cursor))
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan
    assert "LessThanOrEqual(analysis_created_at" in plan


def test_pages_of_a_joined_view_join_once(spark):
    from conftest import SF
    from tidewatch.plans import load_all
    from tidewatch.plans.registry import QUERIES

    load_all()
    plan = plan_of(QUERIES["pages_vulnerabilities"](spark, SF)).split("== Physical")[-1]
    assert "Join" not in plan and plan.count("Scan parquet") >= 14  # each page reads what was written once
