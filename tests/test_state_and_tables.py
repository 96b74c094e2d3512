import datetime as dt
import random

from conftest import SF
from pyspark.sql import functions as F

from tidewatch.operators import curation as C
from tidewatch.operators import reports as R
from tidewatch.plans import q_stream as Q
from tidewatch.session import shared_dir
from tidewatch.sinks import tables as S
from tidewatch.sources import bridge as B
from tidewatch.streaming import fsm
from tidewatch.streaming import leases as L

T0, S_ = 1_700_000_000_000_000, 1_000_000


def test_reservation_transitions():
    state, seen = None, []
    for op, t, ref in [("reserve", 0, ""), ("reserve", 299, ""), ("reserve", 300, ""), ("release", 301, ""), ("release", 302, ""), ("reserve", 303, ""),
                       ("complete", 304, "a1"), ("reserve", 9999, ""), ("release", 9999, "")]:
        state, r = fsm.reservation(state, op, T0 + t * S_, ref, 300)
        seen.append(r)
    assert seen == ["reserved", "in_progress", "reserved", "released", "noop", "reserved", "completed", "already_completed", "noop"]
    assert fsm.reservation(("completed", "", fsm.FOREVER), "reserve", T0, "", 300)[1] == "reserved"  # no analysis: retry


def test_dispatch_transitions():
    state, seen = None, []
    for op, t, ref in [("claim", 0, ""), ("claim", 5, ""), ("failure", 6, "c9|x"), ("failure", 7, "c1|http_500"), ("claim", 8, ""), ("unknown", 9, "c2|timeout"),
                       ("claim", 10, ""), ("success", 11, "c2")]:
        state, r = fsm.dispatch(state, op, T0 + t * S_, ref, 60)
        seen.append(r)
    assert seen == ["claimed", "in_progress", "rejected", "failure", "claimed", "unknown", "ambiguous_delivery_held", "rejected"]
    assert fsm.dispatch(("failed", "c1", 1, "http_400", 0), "claim", T0, "", 60)[1] == "terminal_failure"
    assert fsm.dispatch(("failed", "c3", 3, "x", 0), "claim", T0, "", 60)[1] == "max_attempts_exceeded"
    sent = fsm.dispatch(("sending", "c1", 1, "", T0), "success", T0, "c1", 60)[0]
    free = fsm.dispatch(("sending", "c1", 1, "", T0), "release", T0, "c1", 60)[0]
    again = fsm.dispatch(free, "claim", T0, "", 60)[0]
    assert again[1:3] == ("c2", 1) and fsm.dispatch(again, "success", T0, "c1", 60) == (again, "rejected")  # no token twice
    assert fsm.dispatch(free, "failure", T0, "", 60) == (free, "rejected")
    assert fsm.dispatch(sent, "failure", T0, "", 60) == (sent, "rejected") and fsm.dispatch(sent, "claim", T0, "", 60)[1] == "already_sent"


def test_claims_over_several_micro_batches(spark, tmp_path):
    rnd = random.Random(5)
    events = sorted((rnd.choice("ab"), T0 + rnd.randrange(0, 5000) * S_) for _ in range(400))
    want, last = [], {}
    for k, t in sorted(events, key=lambda x: x[1]):
        if k not in last or t >= last[k] + 600 * S_:
            last[k] = t
            want.append((k, t))
    src = str(tmp_path / "in")
    for lo in range(0, 5000, 1250):  # one file per time slice, read one per micro-batch
        part = [e for e in events if lo * S_ <= e[1] - T0 < (lo + 1250) * S_]
        spark.createDataFrame(part, "key string, ts_us long").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("key string, ts_us long").option("maxFilesPerTrigger", 1).parquet(src)
    got = L.run_to_table(L.claim_stream(stream, 600), "test-claims").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    batch = spark.createDataFrame([(k, dt.datetime.fromtimestamp(t / 1e6, dt.timezone.utc).replace(tzinfo=None)) for k, t in events], "key string, ts timestamp_ntz")
    n = L.claim_batch(batch, ["key"], "ts", 600).distinct().count()
    assert n == len(want)


def test_lease_streams_equal_a_plain_loop(spark):
    for shape, run, step in ((Q.lease_events, L.reservation_stream, fsm.reservation), (Q.dispatch_events, L.dispatch_stream, fsm.dispatch)):
        got = {r["event_id"]: r["result"] for r in L.run_to_table(run(shape(Q.stream(spark, SF)), 3600), "test-lease").collect()}
        states, want = {}, {}
        for r in sorted(shape(B.table(spark, SF, "events")).collect(), key=lambda r: (r["ts_us"], r["event_id"])):
            states[r["key"]], want[r["event_id"]] = step(states.get(r["key"]), r["op"], r["ts_us"], r["ref"], 3600)
        assert got == want


def test_keys_of_a_shard_keep_their_own_records_over_micro_batches(spark, tmp_path):
    rnd, src = random.Random(8), str(tmp_path / "in")
    keys, ops = ["a", "b", "c", "d", "None", None], ["claim", "claim", "failure", "unknown", "success", "release"]
    events = [(rnd.choice(keys), i, rnd.choice(ops), rnd.choice(["", "|http_500"]), T0 + i * 600 * S_) for i in range(300)]
    schema = "key string, event_id long, op string, ref string, ts_us long"
    for lo in range(0, 300, 100):
        spark.createDataFrame(events[lo:lo + 100], schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    got = {r["event_id"]: r["result"] for r in L.run_to_table(L.dispatch_stream(stream, 3600, shards=2), "test-shards").collect()}
    states, want = {}, {}
    for k, i, op, ref, ts in events:
        states[k], want[i] = fsm.dispatch(states.get(k), op, ts, ref, 3600)
    assert got == want


def test_bypass_ids(rows):
    assert [r[0] for r in rows([("",), (None,), ("NONE",), (" unknown ",), ("x",)], "k string").select(L.claims_bypass("k")).collect()] == [True] * 4 + [False]


def test_tables(spark, rows):
    path = shared_dir(spark, "t")
    S.replace(rows([(1, "a"), (1, "b"), (2, "c")], "id int, v string"), path, ["id"], 4)
    S.replace(rows([(1, "z")], "id int, v string"), path, ["id"], 4)
    S.replace(rows([(1, "z")], "id int, v string"), path, ["id"], 4)
    read = lambda: sorted((r["id"], r["v"]) for r in spark.read.parquet(path).collect())
    assert read() == [(1, "z"), (2, "c")]
    S.insert_missing(rows([(2, "no"), (3, "yes")], "id int, v string"), path, ["id"], 4)
    assert read() == [(1, "z"), (2, "c"), (3, "yes")]
    S.delete(spark, path, rows([(1,), (9,)], "id int"), ["id"], 4)
    assert read() == [(2, "c"), (3, "yes")]
    assert [r["e"] for r in S.uniqueness_errors(rows([("x",), ("x",), ("y",), (None,), (None,)], "e string"), "e").collect()] == ["x"]
    assert [r[0] for r in S.droppable(rows([("ast_1",), ("ast_documents",), ("other",)], "collection string")).collect()] == ["ast_1"]


KEV = [("cve-1", "V", "P", "Name", "d", "desc", "act", "", "", "", "CWE-89; cwe-79,CWE-999"), ("CVE-1", "V2", "P2", "N2", "d", "x", "y", "", "", "n", "CWE-22,CWE-89"),
       ("CVE-2", "", "", "", "", "", "", "", "", "", ""), ("CVE-3", "", "", "", "", "", "", "", "", "", "CWE-1"), ("", "", "", "", "", "", "", "", "", "", "CWE-89")]


def test_kev(spark, tmp_path, rows):
    import csv

    names = [c.split()[0] for c in C.KEV_SCHEMA.split(", ")]
    with open(tmp_path / "kev.csv", "w", newline="") as f:
        csv.writer(f).writerows([names, *KEV])
    assert C.read_kev(spark, str(tmp_path / "kev.csv")).count() == 5
    df = rows([(*r, i) for i, r in enumerate(KEV)], C.KEV_SCHEMA + ", pos int")
    d = C.kev_documents(df).collect()
    assert len(d) == 1 and d[0]["cwes"] == ["CWE-89", "CWE-79", "CWE-22"] and d[0]["cwe_id"] == "CWE-89" and "# CVE-1: Name" in d[0]["content"]
    assert tuple(C.kev_statistics(df).collect()[0]) == (5, 1, 1, 1, 3)


def test_weakness_catalog(spark, tmp_path):
    xml = """<Catalog><Weaknesses>
<Weakness ID="89" Name="SQLi"><Description>one
  two</Description><Extended_Description><p>more <b>text</b></p></Extended_Description>
<Potential_Mitigations><Mitigation><Description>m1</Description></Mitigation><Mitigation><Description>m2</Description></Mitigation></Potential_Mitigations></Weakness>
<Weakness ID="89" Name="again"><Description>later</Description></Weakness>
<Weakness ID="1" Name="other"><Description>x</Description></Weakness>
<Weakness ID="787" Name="oob"><Description>y</Description></Weakness></Weaknesses></Catalog>"""
    (tmp_path / "c.xml").write_text(xml)
    w = C.read_weaknesses(spark, str(tmp_path / "c.xml")).withColumn("pos", F.monotonically_increasing_id())
    v = spark.createDataFrame([], C.VIEW_SCHEMA)
    d = C.weakness_documents(w, v, "pos").collect()
    assert [r["cwe_id"] for r in d] == ["CWE-89", "CWE-787"] and [r["is_supported"] for r in d] == [True, False] and all(r["is_top_25"] for r in d)
    assert d[0]["content"].startswith("# CWE-89: SQLi\n\n**Description**: one two\n\n**Details**: more text\n\n**Mitigations**:\n- m1\n- m2")


def test_stratified_pick_equals_a_plain_walk(rows):
    rnd = random.Random(9)
    data = list({(rnd.choice(["python", "javascript"]), rnd.choice(["CWE-79", "CWE-89", "CWE-22"]), f"CVE-{rnd.randrange(6)}", f"fc{rnd.randrange(25)}"): 0 for _ in range(150)})
    data = [(*x, f"h{i % 7}") for i, x in enumerate(sorted(data))]
    got = C.stratified_pick(rows(data, "language string, cwe_id string, cve_id string, file_change_id string, hash string")).collect()
    want, changes, cves = [], set(), set()
    for stratum in sorted({x[:2] for x in data}):
        pool, n = sorted((x for x in data if x[:2] == stratum), key=lambda x: (x[2], x[4], x[3])), 0
        for strict in (True, False):
            for x in pool:
                if n < 3 and x[3] not in changes and (not strict or x[2] not in cves):
                    want.append((*stratum, x[2], x[3]))
                    changes.add(x[3])
                    cves.add(x[2])
                    n += 1
    assert sorted((r["language"], r["cwe_id"], r["cve_id"], r["file_change_id"]) for r in got) == sorted(want)


def test_claims_after_a_long_gap_bypass_and_release(rows):
    day, t0 = dt.timedelta(days=1), dt.datetime(2024, 1, 1)
    hot = [("k", t0 + i * day) for i in range(30)] + [("k", dt.datetime(2024, 6, 30))]
    df = rows(hot + [(" None ", t0), (" None ", t0), (None, t0)], "key string, ts timestamp_ntz")
    got = L.claim_batch(df, ["key"], "ts", 7 * 86400, L.claims_bypass("key")).collect()
    assert sorted(r.accepted_at for r in got if r.key == "k") == [t0 + i * day for i in (0, 7, 14, 21, 28)] + [dt.datetime(2024, 6, 30)]
    assert sum(r.key == " None " for r in got) == 2 and sum(r.key is None for r in got) == 1
    claims = rows([("a", t0), ("b", t0), ("c", t0)], "key string, accepted_at timestamp_ntz")
    released = rows([("a", t0 + day), ("b", t0 - day)], "key string, released_at timestamp_ntz")
    assert sorted(r.key for r in L.release_claims(claims, released, ["key"]).collect()) == ["b", "c"]


def test_tables_keep_their_layout_and_refuse_what_they_cannot_read(spark, rows, tmp_path):
    import pytest

    path = str(tmp_path / "t")
    S.replace(rows([(1, "a"), (2, "b")], "k int, v string"), path, ["k"], 8)
    S.replace(rows([(1, "c")], "k int, v string"), path, ["k"], 3)
    S.insert_missing(rows([(3, "y"), (3, "x"), (2, "z")], "k int, v string"), path, ["k"], 5)
    assert sorted((r.k, r.v) for r in S.read_table(spark, path).collect()) == [(1, "c"), (2, "b"), (3, "x")]
    assert S.read_table(spark, str(tmp_path / "none")) is None
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part-0.parquet").write_bytes(b"not a table")
    with pytest.raises(Exception):  # noqa: B017
        S.read_table(spark, str(tmp_path / "broken"))


def test_any_bytes_are_read(spark):
    from tidewatch.operators import paths as P

    df = spark.createDataFrame([("a", 4, bytearray(b"caf\xe9")), ("b", 3, bytearray(b"a\x00b")), ("c", 0, bytearray(b"")), ("d", 2, bytearray("é".encode())), ("e", 1, None)], "path string, size long, content binary")
    got = {r.path: (r.skip, r.source) for r in P.read_sources(df).collect()}
    assert got["a"] == (None, "caf\ufffd") and got["b"] == ("binary", None) and got["c"] == (None, "") and got["d"][0] == "binary" and got["e"] == (None, None)
    assert {r.skip for r in P.read_sources(df, max_bytes=3).filter("path = 'a'").collect()} == {"too_large"}


def test_fix_documents_are_numbered_without_a_cut(rows):
    data = [(f"CVE-20{i % 5}-{i:04d}", "CWE-89", i, f"h{i}", "Python" if i % 9 else "agnostic", "f", "m", "a", "b", None, None, "True") for i in range(250)]
    df = rows(data, "cve_id string, cwe_id string, file_change_id int, hash string, programming_language string, filename string, msg string, code_before string, code_after string, method_name string, method_code string, before_change string")
    ids = [r.document_id for r in C.fix_documents(df).collect()]
    kept = sorted(d[0] for d in data if d[4] == "Python")
    assert sorted(ids) == sorted(f"knowledge_cvefixes_{c}_CWE-89_{i + 1}" for i, c in enumerate(kept))
    assert C.fix_documents(df, 7).count() == 7


def test_explanations(rows):
    df = rows([("Path traversal", "C", None, "d", "f", 3, "s", "n"), (None, None, None, None, None, None, None, None)],
              "title string, category string, cwe_id string, document_id string, file_path string, line int, signal_type string, signal_name string")
    a, b = R.fallback_explanation(df).collect()
    assert a["summary"] == "Path traversal detected in 'd' at line 3." and a["references"] == ["OWASP / CWE-22", "CWE-22"]
    assert b["summary"] == "Security Finding detected in 'source file' at line 1." and b["references"] == ["OWASP Top 10"]
    bad = rows([("<script>x</script> hi", "T", "C", None), ('{"summary": "<script>x</script> hi", "recommendation": "do"}', "T", "C", "CWE-1")],
               "answer string, title string, category string, cwe_id string")
    x, y = R.validate_explanation(bad).collect()
    assert x["summary"].startswith("T was found") and y["summary"] == "[REDACTED_SCRIPT] hi" and y["remediation"] == "do" and y["references"] == ["OWASP / CWE-1"]


def test_claims_of_a_null_key(rows):
    import datetime as d

    data = [(k, d.datetime(2024, 1, day)) for k in ("a", None) for day in (1, 3)]
    got = L.claim_batch(rows(data, "key string, ts timestamp_ntz"), ["key"], "ts", 3600).collect()
    assert sorted((str(r["key"]), r["accepted_at"].day) for r in got) == [("None", 1), ("None", 3), ("a", 1), ("a", 3)]
