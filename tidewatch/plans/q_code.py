"""Code rule queries (survey 2.11). Sources are rendered from the part table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import coderules as C
from tidewatch.operators import findings as X
from tidewatch.operators import jsrules as J
from tidewatch.plans.registry import query
from tidewatch.sources import bridge as B

# (source, expected signals as (line, type, name, category, severity, confidence, evidence))
PY = [
    ("def load(request, cursor):\n    q = request.args.get('id')\n    cursor.execute(\"SELECT * FROM t WHERE id=\" + q)\n",
     [(3, "unsafe_database_execution", "cursor.execute", "sql_injection", "high", "high",
       "[Taint Flow] Source: request.args (line 2) -> Flow: read source request.args -> q = request.args.get('id') -> Sink: cursor.execute (line 3)")]),
    ("def safe(cursor, v):\n    cursor.execute(\"SELECT * FROM t WHERE id=%s\", (v,))\n", []),
    ("import os\ndef run(cmd):\n    os.system(\"ls \" + cmd)\n",
     [(3, "command_execution_call", "os.system", "command_execution", "critical", "high", "os.system(\"ls \" + cmd)")]),
    ("import os, shlex\ndef run(request):\n    os.system(\"ls \" + shlex.quote(request.args['x']))\n", []),
    ("password = \"hunter22\"\n",
     [(1, "possible_hardcoded_secret", "password", "credential_management", "medium", "medium", "password assigned a string literal")]),
    ("import pickle\nclass A:\n    def m(self, b):\n        return pickle.loads(b)\n",
     [(4, "insecure_deserialization_call", "pickle.loads", "insecure_deserialization", "critical", "high", "pickle.loads(b)")]),
    ("def page(request):\n    n = request.form['n']\n    return \"<b>\" + n + \"</b>\"\n",
     [(3, "reflected_xss_call", "flask.response", "xss", "high", "high",
       "[Taint Flow] Source: request.form (line 2) -> Flow: read source request.form -> n = request.form['n'] -> Sink: flask.response (line 3)")]),
    ("def rd(p):\n    return open(p).read()\n", [(2, "path_traversal_call", "open", "path_traversal", "medium", "medium", "open(p)")]),
    ("def broken(:\n", []),
    ("def e(x):\n    return eval(x)\n", [(2, "dynamic_code_execution", "eval", "dynamic_code_execution", "critical", "high", "eval(x)")]),
    ("def h(api_token):\n    headers = {\"Authorization\": \"Bearer \" + api_token}\n    return headers\n",
     [(2, "credential_propagation_to_authorization_sink", "Authorization header", "credential_handling", "medium", "medium",
       "{\"Authorization\": \"Bearer \" + api_token}")]),
    ("def pick(a):\n    return a\ndef go(request, db):\n    db.execute(pick(request.args['q']))\n",
     [(4, "unsafe_database_execution", "db.execute", "sql_injection", "high", "high",
       "[Taint Flow] Source: request.args (line 4) -> Flow: read source request.args -> call pick(...) -> Sink: db.execute (line 4)")]),
    ("def b(request, c, db):\n    q = \"a\"\n    if c:\n        q = request.args['q']\n    db.execute(q)\n",
     [(5, "unsafe_database_execution", "db.execute", "sql_injection", "medium", "medium", "db.execute(q)")]),
]

JS = [
    ("const u = location.search;\ndocument.getElementById('x').innerHTML = \"<b>\" + u;\n",
     [(2, "dom_xss_call", "element.innerHTML", "xss", "high")]),
    ("el.innerHTML = \"<b>static</b>\";\n", []),
    ("el.outerHTML = DOMPurify.sanitize(req.query.name);\n", []),
    ("const cp = require('child_process');\nfunction f(req) {\n  cp.exec(\"ls \" + req.query.d);\n}\n",
     [(3, "command_execution_call", "cp.exec", "command_execution", "critical")]),
    ("const { execSync } = require('child_process');\nexecSync(userCmd);\n",
     [(2, "command_execution_call", "execSync", "command_execution", "critical")]),
    ("exec(userCmd);\n", []),
    ("eval(code);\neval(\"1\");\n", [(1, "dynamic_code_execution", "eval", "dynamic_code_execution", "critical")]),
    ("db.query(`SELECT ${id}`);\npool.query(\"SELECT ?\", [id]);\n", [(1, "unsafe_database_execution", "db.query", "sql_injection", "high")]),
    ("const q = \"SELECT \" + id;\nconn.execute(q);\n", [(2, "unsafe_database_execution", "conn.execute", "sql_injection", "high")]),
    ("db.query(\"SELECT \" + Number(req.body.id));\n", []),
    ("const apiKey = \"sk-live-12345\";\nlet token = 'test';\n", [(1, "possible_hardcoded_secret", "apiKey", "credential_management", "medium")]),
    ("const V = () => <div dangerouslySetInnerHTML={{ __html: body }} />;\n",
     [(1, "dom_xss_call", "dangerouslySetInnerHTML", "xss", "high")]),
    ("document.write(name);\nel.insertAdjacentHTML('beforeend', `<p>${name}</p>`);\n",
     [(1, "dom_xss_call", "document.write", "xss", "high"), (2, "dom_xss_call", "element.insertAdjacentHTML", "xss", "high")]),
]


def sources(spark, d, templates, ext):
    p = B.spread(B.table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey")
    body = F.element_at(F.array(*[F.lit(t[0]) for t in templates]), (F.col("p_size") % len(templates) + 1).cast("int"))
    return p.select(F.concat(F.lit("src/p"), F.col("p_partkey").cast("string"), F.lit(ext)).alias("file_path"), body.alias("source"))


def _q(s: str) -> str:
    return "'" + str(s).replace("'", "''") + "'"


def expected(templates, ext, width):
    rows = [f"({i}, {s[0]}, {', '.join(_q(x) for x in s[1:width])})" for i, t in enumerate(templates) for s in t[1]]
    names = ["k", "line", "signal_type", "signal_name", "category", "severity", "confidence", "evidence"][: width + 1]
    return f"""WITH e({', '.join(names)}) AS (VALUES {', '.join(rows)}),
      s AS (SELECT 'src/p' || p_partkey || '{ext}' AS file_path, e.* FROM part JOIN e ON e.k = p_size % {len(templates)})"""


def py_facts(spark, d):
    return C.python_facts(sources(spark, d, PY, ".py"))


@query(
    "python_rules",
    expected(PY, ".py", 7) + """ SELECT file_path, line, signal_type, signal_name, severity, confidence, evidence,
      sha256(concat_ws('|', file_path, line, category, signal_type, signal_name, evidence)) AS evidence_id FROM s""",
)
def _(spark, d):
    return C.python_signals(py_facts(spark, d)).select(
        "file_path", "line", "signal_type", "signal_name", "severity", "confidence", "evidence", "evidence_id")


@query(
    "javascript_rules",
    expected(JS, ".js", 5) + " SELECT file_path, line, signal_type, signal_name, category, severity FROM s",
)
def _(spark, d):
    return J.javascript_signals(sources(spark, d, JS, ".js")).select(
        "file_path", "line", "signal_type", "signal_name", "category", "severity")


# What follows a page's own script (which sets t to a string) and the sinks in it, by lines after the script.
PAGE_SCRIPTS = [
    ("if (a) {\n  el.innerHTML = \"<b>\"\n    + t;\n}\n", []),
    ("const u =\n  location.hash;\nel.innerHTML = `<b>\n${u}`; el.outerHTML = t; document.write(\n  u + t\n);\n",
     [(3, "dom_xss_call", "element.innerHTML"), (4, "dom_xss_call", "document.write")]),
    ("get('/x', (req, res) => {\n  const q = 'SELECT '\n    + t\n    + req.query.id;\n  db.query(\n    q, /* ( */\n    [t]);\n});\n",
     [(5, "unsafe_database_execution", "db.query")]),
    ("eval(t), eval(\n  name); eval('1')\n  || eval(t + name)\n",
     [(1, "dynamic_code_execution", "eval"), (3, "dynamic_code_execution", "eval")]),
]


def page_scripts(spark, d):
    return B.table(spark, d, "pages").select("page_id", F.regexp_extract("html", r"(?s)<script>(.*?)</script>", 1).alias("script"))


@query(
    "javascript_page_statements",
    """WITH s AS (SELECT page_id, unnest(string_split(regexp_extract(html, '(?s)<script>(.*?)</script>', 1), ';')) AS x FROM pages)
       SELECT page_id, x || ';' AS code, 1 AS line, count(*) AS n FROM s WHERE x <> '' GROUP BY ALL""",
)
def _(spark, d):
    src = page_scripts(spark, d).select(F.col("page_id").cast("string").alias("file_path"), F.col("script").alias("source"))
    return J.statements(src).groupBy(F.col("file_path").cast("long").alias("page_id"), "code", "line").agg(F.count(F.lit(1)).alias("n"))


@query(
    "javascript_page_rules",
    "WITH e(k, line, signal_type, signal_name) AS (VALUES "
    + ", ".join(f"({i}, {n + 1}, {_q(t)}, {_q(x)})" for i, (_, found) in enumerate(PAGE_SCRIPTS) for n, t, x in found)
    + f") SELECT page_id, e.line, signal_type, signal_name FROM pages JOIN e ON e.k = page_id % {len(PAGE_SCRIPTS)}",
)
def _(spark, d):
    after = F.element_at(F.array(*[F.lit(t) for t, _ in PAGE_SCRIPTS]), (F.col("page_id") % len(PAGE_SCRIPTS) + 1).cast("int"))
    src = page_scripts(spark, d).select(F.col("page_id").cast("string").alias("file_path"), F.concat("script", F.lit("\n"), after).alias("source"))
    return J.javascript_signals(src).select(F.col("file_path").cast("long").alias("page_id"), "line", "signal_type", "signal_name")


@query(
    "code_findings",
    expected(PY, ".py", 7) + """ SELECT CASE signal_type """ + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in X.SIGNAL_TITLES.items())
    + """ END AS title, severity, count(*) AS n FROM s GROUP BY 1, 2""",
)
def _(spark, d):
    f = X.evidence_to_findings(C.python_signals(py_facts(spark, d)).withColumn("line_end", F.col("line")))
    return f.groupBy("title", "severity").agg(F.count(F.lit(1)).alias("n"))


_FN = [len([1 for ln in t[0].splitlines() if ln.strip().startswith("def ")]) if "broken" not in t[0] else 0 for t in PY]


@query(
    "code_summary",
    "SELECT 'src/p' || p_partkey || '.py' AS file_path, CASE WHEN p_size % 13 = 8 THEN 'error' ELSE 'success' END AS parse_status, CASE p_size % 13 "
    + " ".join(f"WHEN {i} THEN {n}" for i, n in enumerate(_FN))
    + """ END AS function_count, CASE WHEN p_size % 13 = 5 THEN 1 ELSE 0 END AS class_count,
      CASE p_size % 13 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 5 THEN 1 ELSE 0 END AS import_count FROM part""",
)
def _(spark, d):
    return C.code_summary(py_facts(spark, d))


@query(
    "python_functions",
    "WITH f(k, name, class_name, start_line, end_line) AS (VALUES (0, 'load', NULL, 1, 3), (1, 'safe', NULL, 1, 2), (2, 'run', NULL, 2, 3), (3, 'run', NULL, 2, 3), "
    "(5, 'm', 'A', 3, 4), (6, 'page', NULL, 1, 3), (7, 'rd', NULL, 1, 2), (9, 'e', NULL, 1, 2), (10, 'h', NULL, 1, 3), (11, 'pick', NULL, 1, 2), (11, 'go', NULL, 3, 4), (12, 'b', NULL, 1, 5)) "
    "SELECT 'src/p' || p_partkey || '.py' AS file_path, name, class_name, start_line, end_line FROM part JOIN f ON f.k = p_size % 13",
)
def _(spark, d):
    return C.functions_table(py_facts(spark, d))


@query("rag_documents")
def _(spark, d):
    facts = py_facts(spark, d)
    return C.rag_documents(facts, C.python_signals(facts))


STATE = "CASE event_type WHEN 'click' THEN 'STATIC' WHEN 'view' THEN 'SANITIZED' WHEN 'signup' THEN 'UNVERIFIED_DYNAMIC' WHEN 'error' THEN 'UNKNOWN' ELSE 'TAINTED' END"


def states(spark, d):
    e = F.col("event_type")
    s = F.when(e == "click", "STATIC").when(e == "view", "SANITIZED").when(e == "signup", "UNVERIFIED_DYNAMIC").when(e == "error", "UNKNOWN").otherwise("TAINTED")
    return B.table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), s.alias("state"))


@query(
    "taint_compose_fold",
    f"""SELECT user_id, CAST(ts AS DATE) AS day, CASE WHEN count(DISTINCT {STATE}) = 1 THEN min({STATE}) WHEN bool_or({STATE} = 'TAINTED') THEN 'TAINTED'
         WHEN bool_and({STATE} IN ('STATIC', 'SANITIZED')) THEN 'SANITIZED' ELSE 'UNVERIFIED_DYNAMIC' END AS state FROM events GROUP BY 1, 2""",
)
def _(spark, d):
    return states(spark, d).groupBy("user_id", "day").agg(C.compose_agg().alias("state"))


@query(
    "taint_branch_join",
    f"""SELECT user_id, CAST(ts AS DATE) AS day, CASE WHEN count(DISTINCT {STATE}) = 1 THEN min({STATE}) ELSE 'UNVERIFIED_DYNAMIC' END AS state FROM events GROUP BY 1, 2""",
)
def _(spark, d):
    return states(spark, d).groupBy("user_id", "day").agg(C.join_agg().alias("state"))
