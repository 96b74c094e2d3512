import itertools
import random

from pyspark.sql import functions as F

from tidewatch.operators import coderules as C
from tidewatch.operators import diffscope as X
from tidewatch.operators import intervals as I
from tidewatch.operators import jsrules as J
from tidewatch.operators import paths as P


DIFFS = [
    ("@@ -10,5 +20,7 @@\n ctx\n+a\n+b\n ctx", [21, 22], [], [21, 22]),
    ("@@ -10 +20 @@\n+a", [20], [], [20]),
    ("@@ -1,2 +11,2 @@\n+a\n+b\n@@ -40,2 +50,3 @@\n c\n c\n+z", [11, 12, 52], [], [11, 12, 52]),
    ("@@ -5,3 +5,3 @@\n ctx\n-x\n-y\n+z", [6], [6, 7], [6]),
    ("@@ -5,3 +5,1 @@\n ctx\n-x\n-y\n", [], [6, 7], [6]),
    ("@@ -1,3 +0,0 @@\n-a\n+b", [], [1], [1]),
    ("@@ -1,2 +1,2 @@\n a\n--- gone\n+late", [], [], []),
    ("not a diff", [], [], []),
]


def test_diff(rows):
    got = {}
    for r in X.changed_lines(rows([(i, x[0]) for i, x in enumerate(DIFFS)], "diff_id int, patch string")).collect():
        got.setdefault((r["diff_id"], r["kind"]), []).append(r["line"])
    for i, (patch, *want) in enumerate(DIFFS):
        assert [sorted(got.get((i, k), [])) for k in ("added", "deleted", "affected")] == want, patch


def test_diffs_are_read_inside_their_row(rows):
    long = "@@ -1,3000 +1,3000 @@\n" + "\n".join(f"+line {i}" for i in range(3000))
    df = X.changed_lines(rows([(1, long), (2, None), (3, "")], "diff_id int, patch string"))
    assert df.filter("kind = 'added'").count() == 3000 and "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_intervals_equal_brute_force(rows):
    rnd = random.Random(3)
    iv = [(i, "k" if i % 3 else "h", s := rnd.randrange(1, 3000), s + rnd.choice([0, 1, 5, 60, 900])) for i in range(150)]
    pt = [(i, "k" if i % 2 else "h", rnd.randrange(1, 4000)) for i in range(200)]
    got = I.containing(rows(pt, "p int, f string, line int"), rows(iv, "i int, f string, s int, e int"), ["f"], "line", "s", "e").select("p", "i").collect()
    want = [(p, i) for (p, pf, x), (i, f, s, e) in itertools.product(pt, iv) if pf == f and s <= x <= e]
    assert sorted(map(tuple, got)) == sorted(want)
    for top in (1, I.LINES_TOP):
        few = I.containing(rows(pt, "p int, f string, line int"), rows(iv, "i int, f string, s int, e int"), ["f"], "line", "s", "e", top=top).select("p", "i")
        assert sorted(map(tuple, few.collect())) == sorted(want)


def test_scopes(rows):
    fn = rows([("f", "outer", None, 1, 20), ("f", "inner", None, 5, 8), ("f", "m", "K", 30, 40)], "file string, name string, class_name string, start_line int, end_line int")
    ln = rows([("f", x) for x in (6, 7, 10, 25, 31)], "file string, line long")
    files = rows([("f", 50)], "file string, total_lines int")
    sc = X.changed_scopes(ln, fn, files, ["file"])
    assert sorted((r["scope_type"], r["name"], r["changed"]) for r in sc.collect()) == [
        ("function", "inner", 2), ("function", "outer", 1), ("method", "K.m", 1), ("module", "<module>", 1)]
    f = rows([("f", 1, 2), ("f", 2, 25), ("f", 3, 26), ("f", 4, None), ("g", 5, 99), ("f", 6, 35)], "file string, id int, line int")
    assert sorted(r["id"] for r in X.filter_to_diff(f, sc, ln, ["file"]).collect()) == [1, 2, 4, 5, 6]


def test_changed_file_match(rows):
    p = rows([(1, "src/a.py"), (1, "b.py"), (1, "zzz.py"), (1, "./x/c.py")], "pr int, file_path string")
    c = rows([(1, "a.py", 1), (1, "lib/b.py", 2), (1, "x/c.py", 3), (1, "c.py", 0)], "pr int, filename string, file_order int")
    assert {r["path"]: r["target"] for r in X.match_changed_file(p, c, ["pr"]).collect()} == {"src/a.py": "a.py", "b.py": "lib/b.py", "x/c.py": "x/c.py"}


def test_lines_meet_spans_over_block_borders(rows):
    spans = [(i, "f" if i % 3 else "g", f"n{i % 7}", None if i % 2 else "K", s, s + 7 * (i % 90)) for i, s in enumerate(range(1, 1400, 5))] + [(999, "f", "long", None, 1, 100_000), (998, "f", "none", None, 9, 3)]
    points = [(f, x) for f in "fgh" for x in range(1, 2000, 17)] + [("f", 255), ("f", 256), ("f", 257), ("f", 99_999)]
    fn = rows(spans, "i int, file string, name string, class_name string, start_line int, end_line int").drop("i")
    ln = rows(points, "file string, line long")
    want = set()
    for f, x in points:
        inside = [s for s in spans if s[1] == f and s[4] <= x <= s[5]]
        if inside:
            b = min(inside, key=lambda s: (s[5] - s[4], -s[4], s[2], s[3] or ""))
            want.add((f, x, *b[2:]))
    out = X.tightest_scope(ln, fn, ["file"])
    assert {tuple(r) for r in out.collect()} == want
    plan = out._jdf.queryExecution()
    assert plan.optimizedPlan().toString().count("Generate explode") == 1  # a line is one row of the join
    assert "Broadcast" not in plan.executedPlan().toString()
    found = rows([(i, *p) for i, p in enumerate(points)] + [(-1, "f", None), (-2, "new", 3)], "id int, file string, line int")
    files = rows([(f, 2000) for f in "fgh"], "file string, total_lines int")
    few = ln.filter("line % 3 = 0")
    sc = X.changed_scopes(few, fn, files, ["file"])
    held = [r for r in sc.collect() if r["scope_type"] != "module"]
    marks = {tuple(r) for r in few.collect()}
    keep = {i for i, (f, x) in enumerate(points) if (f, x) in marks or any(r["file"] == f and r["start_line"] <= x <= r["end_line"] for r in held)} | {-1, -2}
    got = [r["id"] for r in X.filter_to_diff(found, sc, few, ["file"]).collect()]
    assert sorted(got) == sorted(keep)


def test_files_of_comments_are_not_broadcast(rows):
    f = rows([(1, "./repo/src/a.py", 3), (1, "a.py", 3), (1, "b.py", 3), (1, "", 3), (2, "src/a.py", 3), (2, "a.py", 4)], "pr int, file_path string, line int")
    c = rows([(1, "src/a.py", 2), (1, "a.py", 1), (1, "lib/b.py", 3), (1, "", 4), (2, "src/a.py", 1), (2, "src/a.py", 0)], "pr int, filename string, file_order int")
    added = rows([(1, "src/a.py", 3), (1, "lib/b.py", 3), (1, "a.py", 3), (2, "src/a.py", 3)], "pr int, target string, line int")
    out = X.inline_commentable(f, c, added, ["pr"])
    # the frames of suffixes and lines are larger than they look
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["pr"], r["path"], r["target"]) for r in out.collect()) == [
        (1, "a.py", "a.py"), (1, "b.py", "lib/b.py"), (1, "repo/src/a.py", "a.py"), (2, "src/a.py", "src/a.py")]


STATES = ["STATIC", "TAINTED", "SANITIZED", "UNVERIFIED_DYNAMIC", "UNKNOWN"]


def compose(a, b):
    if a == b:
        return a
    if "TAINTED" in (a, b):
        return "TAINTED"
    return "SANITIZED" if {a, b} == {"STATIC", "SANITIZED"} else "UNVERIFIED_DYNAMIC"


def test_lattice_tables(rows):
    pairs = list(itertools.product(STATES, STATES))
    df = rows(pairs, "a string, b string").select("a", "b", C.compose_states(F.array("a", "b")).alias("c"), C.join_states(F.array("a", "b")).alias("j"))
    for r in df.collect():
        assert r["c"] == compose(r["a"], r["b"])
        assert r["j"] == (r["a"] if r["a"] == r["b"] else "UNVERIFIED_DYNAMIC")
    tall = rows([(i, s) for i, p in enumerate(pairs) for s in p], "g int, state string")
    for r in tall.groupBy("g").agg(C.compose_agg().alias("c")).collect():
        assert r["c"] == compose(*pairs[r["g"]])


PYTHON = [
    ("def f(c, q):\n    c.execute('SELECT 1')\n", []),
    ("Q = 'SELECT 1'\ndef f(c):\n    c.execute(Q)\n", []),
    ("def f(c, u):\n    c.execute(f'SELECT {u}')\n", [(2, "unsafe_database_execution", "high", "high")]),
    ("def f(c, u):\n    c.execute('SELECT {}'.format(u))\n", [(2, "unsafe_database_execution", "high", "high")]),
    ("def f(c):\n    x = int(request.args['a'])\n    c.execute('SELECT ' + str(x))\n", []),
    ("def f():\n    x = html.escape(request.args['a'])\n    c.execute('SELECT ' + x)\n", [(3, "unsafe_database_execution", "high", "high")]),
    ("def f():\n    subprocess.run(['ls', '-l'])\n", []),
    ("def f(d):\n    subprocess.run(['ls', d])\n", [(2, "command_execution_call", "medium", "medium")]),
    ("def f():\n    subprocess.run(['ls', request.args['d']])\n", [(2, "command_execution_call", "critical", "high")]),
    ("def f():\n    subprocess.run('ls', shell=True)\n", [(2, "command_execution_call", "critical", "high")]),
    ("def f():\n    os.system('ls')\n", [(2, "command_execution_call", "medium", "medium")]),
    ("def f():\n    eval('1')\n", [(2, "dynamic_code_execution", "high", "high")]),
    ("def f(n):\n    open('/tmp/' + n)\n    open('x')\n", [(2, "path_traversal_call", "high", "high")]),
    ("def f(n):\n    return Response('<b>' + n)\n", [(2, "reflected_xss_call", "high", "medium")]),
    ("def f(n):\n    return '<b>' + html.escape(request.args['n'])\n", []),
    ("def f():\n    self.password = 'x'\n", [(2, "possible_hardcoded_secret", "medium", "medium")]),
    ("os.system('x' + y)\n", []),
    ("def f():\n    for i in x:\n        q = request.args['a']\n    c.execute(q)\n", [(4, "unsafe_database_execution", "medium", "medium")]),
    ("def g(x):\n    return int(x)\ndef f(c):\n    c.execute('a' + g(request.args['a']))\n", []),
    ("def g(x):\n    return g(x)\ndef f(c):\n    c.execute(g(request.args['a']))\n", [(4, "unsafe_database_execution", "high", "high")]),
    ("def f(token, o):\n    t = o\n    h = {'Authorization': t}\n", []),
]


def test_python_rules(rows):
    src = rows([(f"f{i:02d}.py", x[0]) for i, x in enumerate(PYTHON)], "file_path string, source string")
    got = {}
    for r in C.python_signals(C.python_facts(src)).collect():
        got.setdefault(r["file_path"], []).append((r["line"], r["signal_type"], r["severity"], r["confidence"]))
    for i, (text, want) in enumerate(PYTHON):
        assert sorted(got.get(f"f{i:02d}.py", [])) == want, text


def test_python_structure(rows):
    src = "import os, sys\nfrom a.b import c\nclass K:\n    async def m(self, x=1, *r):\n        if x:\n            y = os.getcwd()\n        return y\ndef g():\n    pass\n"
    facts = C.python_facts(rows([("f.py", src), ("bad.py", "def (")], "file_path string, source string"))
    by = {(r["file_path"], r["name"]): r for r in facts.collect()}
    m = by["f.py", "m"]
    assert (m["class_name"], m["is_async"], m["params"], m["calls"], m["assignments"], m["returns"]) == ("K", True, ["self", "x", "*r"], ["os.getcwd"], ["y"], 1)
    assert m["control"]["if"] == 1 and (m["start_line"], m["end_line"]) == (4, 7)
    assert by["f.py", None]["imports"] == ["os", "sys", "a.b"] and by["bad.py", None]["parse_status"] == "error"
    docs = C.rag_documents(facts, C.python_signals(facts)).collect()
    assert sum(d["document_type"] == "function_structure" for d in docs) == 2
    assert any("Function m is a asynchronous method in class K." in d["content"] for d in docs)


JAVASCRIPT = [
    ("import { exec as run } from 'child_process';\nrun(cmd);", ["command_execution_call"]),
    ("require('child_process').execSync(`ls ${d}`);", ["command_execution_call"]),
    ("const cp = require('child_process');\ncp.exec('ls');", []),
    ("knex.raw('SELECT ' + x);", ["unsafe_database_execution"]),
    ("db.query(sql);", []),
    ("el.innerHTML = encodeURIComponent(location.hash);", []),
    ("// eval(x)", []),
    ("const password = process.env.P;", []),
]


def test_javascript_rules(rows):
    src = rows([(f"f{i}.js", x[0]) for i, x in enumerate(JAVASCRIPT)], "file_path string, source string")
    got = {}
    for r in J.javascript_signals(src).collect():
        got.setdefault(r["file_path"], []).append(r["signal_type"])
    for i, (text, want) in enumerate(JAVASCRIPT):
        assert got.get(f"f{i}.js", []) == want, text


def test_javascript_functions(rows):
    src = "function a() {}\nconst b = async (x) => x;\nclass K {\n  m(x) {\n  }\n}\n"
    got = J.javascript_functions(rows([("f.js", src)], "file_path string, source string")).orderBy("start_line").collect()
    assert [(r["name"], r["start_line"]) for r in got] == [("a", 1), ("b", 2), ("m", 4)]


PATHS = [
    ("src/app.py", False), ("tests/a.py", True), ("a/Node_Modules/x.js", True), ("x.min.js", True), ("a\\build\\b.py", True),
    ("a/../data/x.py", True), ("data/../a.py", False), ("", False), ("docs/readme.md", True)]


def test_exclusion(rows):
    got = rows([(p,) for p, _ in PATHS], "p string").select(P.excluded("p", ["*.md"])).collect()
    assert [r[0] for r in got] == [w for _, w in PATHS]


def test_reading_sources(spark, tmp_path):
    (tmp_path / "a.py").write_text("x = 1\n")
    (tmp_path / "b.py").write_bytes(b"\x00\x01")
    (tmp_path / "c.py").write_bytes(bytes(range(128, 256)))
    files = spark.read.format("binaryFile").load(str(tmp_path)).withColumnsRenamed({"length": "size"})
    got = {r["path"][-4:]: (r["skip"], r["source"]) for r in P.read_sources(files).collect()}
    assert got == {"a.py": (None, "x = 1\n"), "b.py": ("binary", None), "c.py": ("binary", None)}


def test_texts_of_any_language_are_no_binaries(spark):
    from pyspark.sql import functions as F

    texts = {"a": "çéà ñ".encode(), "b": b"\x00" + "é".encode(), "c": bytes(range(128, 256)), "d": "\x01\x02\x03é".encode(), "e": b"", "f": None}
    df = spark.createDataFrame([(k, 1, bytearray(v) if v is not None else None) for k, v in texts.items()], "path string, size long, content binary")
    got = {r["path"]: (r["skip"], r["source"]) for r in P.read_sources(df, any_language=True).collect()}
    assert got == {"a": (None, "çéà ñ"), "b": ("binary", None), "c": ("binary", None), "d": ("binary", None), "e": (None, ""), "f": (None, None)}
    assert P.read_sources(df).filter("path = 'a'").select(F.col("skip")).collect()[0][0] == "binary"


def test_source_decoding_of_odd_pages(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    pages = [(1, "http://a", "çéàñ" * 9), (2, "1234567", "çéàñ"), (3, "1234567", None), (4, "http://a", None), (5, None, "abc"), (6, "http://a", "x" * 1_000_001), (7, "1234567", "x" * 1_000_001), (8, "1", "")]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = entry.queries()["source_decoding"](spark, str(tmp_path)).collect()
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
        want = con.sql(entry.oracle_sql()["source_decoding"]).fetchall()
    assert sorted(tuple(r) for r in got) == sorted(want) and len(want) == len(pages)


FLOWS = [  # (source, state of the argument of the last call)
    ("def f(a):\n    if a:\n        q = 'x'\n    else:\n        q = 'y'\n    g(q)\n", "STATIC"),
    ("def f(a):\n    q = request.args['q']\n    if a:\n        q = 'x'\n    else:\n        q = 'y'\n    g(q)\n", "STATIC"),
    ("def f(a):\n    q = 'x'\n    if a:\n        q = request.args['q']\n    else:\n        g(q)\n", "STATIC"),
    ("def f(a):\n    q = 'x'\n    if a:\n        q = request.args['q']\n        g(q)\n", "TAINTED"),
    ("def f(a):\n    q = 'x'\n    while a:\n        q = 'y'\n    g(q)\n", "STATIC"),
    ("def f(a):\n    q = 'x'\n    while a:\n        q = request.args['q']\n    g(q)\n", "UNVERIFIED_DYNAMIC"),
    ("def f(a):\n    q = 'x'\n    if a:\n        q = 'y'\n    elif b:\n        q = 'z'\n    g(q)\n", "STATIC"),
    ("def f(a):\n    with a:\n        q = request.args['q']\n    g(q + 'x')\n", "TAINTED"),
    ("def f(a):\n    try:\n        q = 'x'\n    except E:\n        q = request.args['q']\n    g(q)\n", "UNVERIFIED_DYNAMIC"),
    ("def f(a):\n    q = 'x'\n    q = q + request.args['q']\n    g(q)\n", "TAINTED"),
    ("def f(a):\n    g(a)\n", "UNKNOWN"),
    ("def f():\n    g(sys.argv[1])\n", "TAINTED"),
    ("def h(x, y):\n    z = y\n    return 'a' + z\ndef f():\n    g(h(request.args['q'], 'b'))\n", "STATIC"),
    ("def h(x, y):\n    z = y\n    return 'a' + z\ndef f():\n    g(h('b', request.args['q']))\n", "TAINTED"),
    ("def h(x, y):\n    return x\ndef f():\n    g(h(y=request.args['q'], x='b'))\n", "STATIC"),
    ("def h(x):\n    return k(x)\ndef k(x):\n    return m(x)\ndef m(x):\n    return n(x)\ndef n(x):\n    return html.escape(x)\ndef f():\n    g(h(request.args['q']))\n", "SANITIZED"),
    ("def h(x):\n    return k(x)\ndef k(x):\n    return h('c')\ndef f():\n    g(h(request.args['q']))\n", "STATIC"),
    ("def h(x):\n    return x\ndef h(x):\n    return 'a'\ndef f():\n    g(h(request.args['q']))\n", "UNVERIFIED_DYNAMIC"),
    ("def f():\n    g('%s' % request.form.get('a'))\n", "TAINTED"),
    ("def f():\n    g(f'{x} {request.json[\"a\"]}')\n", "TAINTED"),
    ("def f():\n    g(str(int(request.args['a'])))\n", "SANITIZED"),
    ("def f():\n    g([request.args['a']])\n", "UNVERIFIED_DYNAMIC"),
    ("def f():\n    x = y = request.args['a']\n    g(x)\n", "UNVERIFIED_DYNAMIC"),
]


def test_flows(rows):
    src = rows([(f"f{i:02d}.py", x[0]) for i, x in enumerate(FLOWS)], "file_path string, source string")
    facts = C.with_facts(C.with_values(C.python_facts(src))).filter("name = 'f'")
    got = {r["file_path"]: r["s"] for r in facts.select("file_path", F.expr("filter(facts, x -> x.form = 'call' AND x.target = 'g')[0].val.state").alias("s")).collect()}
    assert [(got[f"f{i:02d}.py"], x[0]) for i, x in enumerate(FLOWS)] == [(x[1], x[0]) for x in FLOWS]


def test_many_branches_stay_linear(rows):
    body = "".join(f"    if a{i}:\n        q = q + request.args['p{i % 3}']\n" for i in range(200))
    src = rows([("f.py", f"def f(q):\n    q = 'x'\n{body}    c.execute(q)\n")], "file_path string, source string")
    r = C.with_facts(C.with_values(C.python_facts(src))).filter("name = 'f'").select(F.expr("filter(facts, x -> x.target = 'c.execute')[0].val").alias("v")).first()["v"]
    assert r["state"] == "UNVERIFIED_DYNAMIC" and len(r["sources"]) == 200 and len(r["steps"]) <= 401


def test_nodes_come_after_their_parts():
    from tidewatch.functions.pynodes import flatten

    module, f = flatten("x = 1\ndef f(a, *b, c=2, **d):\n    s = 'ü' + a\n    def g(): return 1\n    return s\n")[:2]
    assert f["params"] == ["a", "c", "*b", "**d"] and f["bound"] == ["a", "c"] and [n["text"] for n in f["outer"]][-1] == "x = 1"
    assert all(k < i and f["nodes"][k]["first"] >= n["first"] for i, n in enumerate(f["nodes"]) for k in n["kids"])
    assert "'ü' + a" in [n["text"] for n in f["nodes"]] and sum(n["kind"] == "Return" for n in f["nodes"]) == 1


SCRIPT = '''const express = require('express'); // it's
app.get('/user', (req, res) => {
    const id = req.query.id;
    const q = "SELECT * FROM users WHERE id = "
      + id
      // note
      + `x
 ${ id }`;
    db.query(
      q,
      { a: 1,
        b: [2,
            3] });
    if (a) { el.innerHTML = id; el.outerHTML = 'x'; }
    switch (x) { case 'a:b': { eval(id) } default: f(/["'(]/g); }
});
/* block (
*/ const T = ({ a }) => (
  <div dangerouslySetInnerHTML={{
     __html: a }} />
);
eval('1'), eval(
  id)
'''


def test_javascript_statements(rows):
    bad = "eval(a\nfoo(;b\n"
    src = rows([("f.js", SCRIPT), ("bad.js", bad), (None, "eval(x)"), ("n.js", None), ("e.js", ""), ("f.js", SCRIPT)], "file_path string, source string")
    got = [(r["file_path"], r["line"], r["code"].replace("\f", "|")) for r in J.statements(src).orderBy("file_path", "seq").collect()]
    assert got == [
        (None, 1, "eval(x)"), ("bad.js", 1, "eval(a"), ("bad.js", 2, "foo(;"), ("bad.js", 2, "b"),
        ("f.js", 1, "const express = require('express');"), ("f.js", 2, "app.get('/user', (req, res) => {"), ("f.js", 3, "const id = req.query.id;"),
        ("f.js", 4, 'const q = "SELECT * FROM users WHERE id = "|+ id|+ `x| ${ id }`;'), ("f.js", 9, "db.query(|q,|{ a: 1,|b: [2,|3] });"),
        ("f.js", 14, "if (a) {"), ("f.js", 14, "el.innerHTML = id;"), ("f.js", 14, "el.outerHTML = 'x';"), ("f.js", 14, "}"), ("f.js", 15, "switch (x) {"),
        ("f.js", 15, "case 'a:b':"), ("f.js", 15, "{"), ("f.js", 15, "eval(id)"), ("f.js", 15, "} default:"), ("f.js", 15, "f(/[\"'(]/g);"), ("f.js", 15, "}"),
        ("f.js", 16, "});"), ("f.js", 18, "const T = ({ a }) => (|<div dangerouslySetInnerHTML={{|__html: a }} />|);"), ("f.js", 22, "eval('1'), eval(|id)")]
    found = {(r["file_path"], r["line"], r["signal_name"], r["taint_state"]) for r in J.javascript_signals(src).collect()}
    assert found == {
        (None, 1, "eval", None), ("bad.js", 1, "eval", None), ("f.js", 9, "db.query", "TAINTED"), ("f.js", 14, "element.innerHTML", "TAINTED"),
        ("f.js", 15, "eval", "TAINTED"), ("f.js", 19, "dangerouslySetInnerHTML", None), ("f.js", 22, "eval", "TAINTED")}
    assert J.javascript_signals(src.limit(0)).count() == 0


JS_STATES = [  # (source, state of the last sink; "none" where there is no signal)
    ("const a = location.hash;\nconst b = 'x';\nel.innerHTML = a + b;", "TAINTED"),
    ("const a = location.hash;\nconst b = 'x';\nel.innerHTML = b + a;", "TAINTED"),
    ("const a = 'y';\nconst b = 'x';\nel.innerHTML = `<p>${a} and ${b}</p>`;", "none"),
    ("const a = encodeURIComponent(location.hash);\nconst b = 'x';\nel.innerHTML = a + b;", "none"),
    ("const a = encodeURIComponent(location.hash);\nconst b = f('x');\nel.innerHTML = a + b;", None),
    ("const b = 'x';\nel.innerHTML = b + o.p;", None),
    ("const a = location.hash;\nel.innerHTML = c ? a : 'x';", "TAINTED"),
    ("let a = location.hash;\na = 'x';\nel.innerHTML = a;", "none"),
    ("const id = req.query.id;\nconst q = \"SELECT \" + Number(id);\ndb.query(q);", "none"),
    ("const id = req.query.id;\nconst q = \"SELECT \" +\n  id;\ndb.query(q);", "TAINTED"),
    ("const cp = require('child_process');\nif (x) { cp.exec('ls'); cp.exec(`ls ${req.body.d}`); }", "TAINTED"),
    ("".join(f"const v{i + 1} = v{i};\n" for i in range(7)).replace("v0", "location.search", 1) + "eval(v7);", "TAINTED"),
]


def test_javascript_states(rows):
    src = rows([(f"f{i:02d}.js", x[0]) for i, x in enumerate(JS_STATES)], "file_path string, source string")
    got = {r["file_path"]: r["taint_state"] for r in J.javascript_signals(src).collect()}
    assert [(got.get(f"f{i:02d}.js", "none"), x[0]) for i, x in enumerate(JS_STATES)] == [(x[1], x[0]) for x in JS_STATES]
