"""Linked tables: one switch for parent and children, lookups, cleanups."""

import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from tidewatch.session import shared_dir
from tidewatch.sinks import linked as L
from tidewatch.sinks.positions import choose, located

LINKS = {"analyses": ["analysis_id"], "findings": ["analysis_id"], "suppressions": ["analysis_id"]}


def tables(spark, rows, **more):
    t = L.LinkedTables(spark, shared_dir(spark, "linked-test"), LINKS, 4, **more)
    t.save(analyses=rows([(i, f"s{i % 3}", i * 10) for i in range(12)] + [(None, "null key", 1)], "analysis_id long, status string, at int"),
           findings=rows([(i, f"f{j}") for i in range(12) for j in range(i % 4)] + [(None, "f")], "analysis_id long, finding string"),
           suppressions=rows([(i, "x") for i in range(0, 12, 2)], "analysis_id long, reason string"))
    return t


def got(t, name, snapshot=None):
    return sorted(map(tuple, t.read(name, snapshot).collect()), key=str)


def test_cascade_and_null_keys(spark, rows):
    t = tables(spark, rows)
    before = got(t, "suppressions")
    t.delete(rows([(3,), (7,), (99,), (None,)], "analysis_id long"), cascade=["findings"])
    assert {r[0] for r in got(t, "analyses")} == set(range(12)) - {3, 7}
    assert sorted(got(t, "findings")) == [(i, f"f{j}") for i in range(12) for j in range(i % 4) if i not in (3, 7)]
    assert got(t, "suppressions") == before
    t.delete(t.read("analyses"))
    assert [got(t, n) for n in LINKS] == [[], [], []] and t.read("analyses").columns == ["analysis_id", "status", "at"]


def test_save_replaces_whole_parents(spark, rows):
    t = tables(spark, rows)
    for _ in range(2):  # again changes nothing
        t.save(analyses=rows([(5, "new", 1), (50, "new", 2)], "analysis_id long, status string, at int"), findings=rows([(50, "g")], "analysis_id long, finding string"))
    assert [r for r in got(t, "findings") if r[0] in (5, 50)] == [(50, "g")] and [r for r in got(t, "analyses") if r[1] == "new"] == [(5, "new", 1), (50, "new", 2)]
    assert L.LinkedTables(spark, t.root, LINKS, 64).buckets == 4  # the first change fixed it


def test_a_broken_change_leaves_the_old_rows(spark, rows, monkeypatch):
    t = tables(spark, rows)
    want = {n: got(t, n) for n in LINKS}

    def broken(*_):
        raise OSError("no space left")

    monkeypatch.setattr(t, "_publish", broken)
    with pytest.raises(OSError):
        t.delete(rows([(3,)], "analysis_id long"))  # all folders are written, the pointer is not
    assert {n: got(t, n) for n in LINKS} == want
    monkeypatch.undo()
    # a failure between the two tables
    real = t._in_bucket
    monkeypatch.setattr(t, "_in_bucket", lambda df, c: broken() if "finding" in df.columns else real(df, c))
    with pytest.raises(OSError):
        t.delete(rows([(3,)], "analysis_id long"))
    monkeypatch.undo()
    assert {n: got(t, n) for n in LINKS} == want
    assert t.vacuum() == 2 and {n: got(t, n) for n in LINKS} == want and t.vacuum() == 0


def test_two_writers(spark, rows, monkeypatch):
    t = tables(spark, rows)
    stale = t.snapshot()
    t.delete(rows([(3,)], "analysis_id long"))
    want = {n: got(t, n) for n in LINKS}
    late = L.LinkedTables(spark, t.root, LINKS)
    monkeypatch.setattr(late, "snapshot", lambda number=None: stale)
    with pytest.raises(L.ConcurrentChange):
        late.delete(rows([(4,)], "analysis_id long"))
    assert {n: got(t, n) for n in LINKS} == want and got(t, "analyses", stale) != want["analyses"]


def test_bounded_cleanup(spark, rows):
    t = tables(spark, rows)
    due, order = F.col("at") <= 70, [F.col("at"), F.col("analysis_id")]
    assert [t.cleanup(due, order, 3, ["findings"]) for _ in range(4)] == [3, 3, 3, 0]
    assert {r[0] for r in got(t, "analyses")} == {8, 9, 10, 11} and {r[0] for r in got(t, "findings")} == {9, 10, 11}
    assert len(got(t, "suppressions")) == 6
    empty = L.LinkedTables(spark, shared_dir(spark, "linked-test"), LINKS)
    assert empty.cleanup(due, order, 3) == 0 and empty.read("analyses") is None and empty.lookup("analyses", 1) is None and empty.vacuum() == 0


def test_cleanup_without_a_limit_is_one_change(spark, rows):
    t = tables(spark, rows)
    due, order, before = F.col("at") <= 70, [F.col("at"), F.col("analysis_id")], t.snapshot().number
    n = t.cleanup(due, order, None, ["findings"])
    assert n == 9 - t.cleanup(due, order, 3) and t.snapshot().number == before + 1
    assert {r[0] for r in got(t, "analyses")} == {8, 9, 10, 11} and {r[0] for r in got(t, "findings")} == {9, 10, 11}


def test_lookups_read_one_bucket(spark, rows):
    t = tables(spark, rows, blooms={"analyses": ["status"]})
    for i in (0, 5, 11):
        assert [tuple(r) for r in t.lookup("analyses", i).collect()] == [(i, f"s{i % 3}", i * 10)]
    found = t.lookup("findings", 7)
    folders = {f.rsplit("/", 2)[1] for f in found.inputFiles()}
    assert len(folders) == 1 and len({f.rsplit("/", 2)[1] for f in t.read("findings").inputFiles()}) > 1
    assert "EqualTo(analysis_id,7)" in found._jdf.queryExecution().executedPlan().toString() and found.count() == 3
    assert t.lookup("analyses", 400).count() == 0 and {r["analysis_id"] for r in t.lookup_by("analyses", "status", "s2").collect()} == {2, 5, 8, 11}


def test_retention_cutoff(spark):
    r = spark.range(1).select(L.retention_cutoff("2024-03-31 00:00:00", 30).alias("a"), L.retention_cutoff("2024-03-31 00:00:00", -5).alias("b")).first()
    assert str(r["a"]) == "2024-03-01 00:00:00" and str(r["b"]) == "2024-03-30 00:00:00"


def test_rows_are_chosen_by_position(spark, tmp_path):
    spark.range(100_000).selectExpr("id", "id % 7 AS k").repartition(3, "k").write.parquet(f"{tmp_path}/rows")  # blocks of 32,768 and files of several
    at = located(spark.read.parquet(f"{tmp_path}/rows"))
    for i, (cond, keep) in enumerate([("id % 3 = 0", True), ("id % 3 = 0", False), ("id < 0", True), ("id < 0", False), ("true", True)]):
        got = choose(at, at.filter(cond).select("_file", "_row"), f"{tmp_path}/bits{i}", keep)
        want = spark.range(100_000).filter(cond if keep else f"NOT ({cond})")
        assert got.columns == ["id", "k"] and got.select("id").exceptAll(want).isEmpty() and got.count() == want.count()
    none = located(spark.read.parquet(f"{tmp_path}/rows")).filter("k = 8")
    assert choose(none, none.select("_file", "_row"), f"{tmp_path}/none", False).count() == 0


def test_stored_rows_are_copied_without_a_shuffle(spark, rows):
    t = tables(spark, rows)
    kept = t._without(t.snapshot(), range(4), rows([(3,), (7,), (None,)], "analysis_id long"), ["findings"], "data/copy")["findings"]
    assert sorted(map(tuple, kept.collect())) == [(i, f"f{j}") for i in range(12) for j in range(i % 4) if i not in (3, 7)]
    assert "Exchange hashpartitioning" not in plan_of(kept)


def test_rows_are_filled_where_they_are_written(spark, rows):
    keys = rows([(5, "new", 1), (50, "new", 2)], "analysis_id long, status string, at int")
    more = rows([(50, "h", None), (50, "g", 7), (5, "f", 8)], "analysis_id long, finding string, n int")
    u = L.LinkedTables(spark, shared_dir(spark, "linked-test"), LINKS, 4)
    u.save({"findings": (more, ["analysis_id", "finding"])}, analyses=keys, findings=rows([(50, "g", "x"), (50, "h", None), (5, "f", "y")], "analysis_id long, finding string, note string"))
    assert {tuple(r) for r in u.read("findings").select("analysis_id", "finding", "note", "n").collect()} == {(50, "g", "x", 7), (50, "h", None, None), (5, "f", "y", 8)}


def test_many_small_changes_do_not_pile_up_files(spark, rows):
    t = L.LinkedTables(spark, shared_dir(spark, "linked-test"), {"a": ["id"]}, 1)
    for i in range(30):
        t.save(a=rows([(i, "x")], "id long, v string"))
    assert len(t.read("a").inputFiles()) <= 2 * (L.MANY_CHANGES + 8) and {r[0] for r in t.read("a").collect()} == set(range(30))


def test_a_bucket_is_written_in_shares(spark, rows):
    t = L.LinkedTables(spark, shared_dir(spark, "linked-test"), {"a": ["id"]}, 1)
    many, shares = t._clustered(t._in_bucket(spark.range(4000), ["id"]), "a")
    sizes = [r["count"] for r in many.groupBy("_bucket", "_part").count().collect()]
    assert shares == len(sizes) == 16 and max(sizes) < 400
