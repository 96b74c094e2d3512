"""JavaScript rules as Spark joins over statement rows (AST-04, AST-15..20, AST-29).

A source is cut into statements (``jsstatements``); assignments, child-process
bindings and sink calls become small relations, and taint is followed from a sink
argument through assignments by repeated equi joins until no row changes. Every
sink of a statement counts, with the line on which it stands. Everything is keyed by
file, so a large source set spreads over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import text as T
from tidewatch.operators.coderules import finish_signals
from tidewatch.operators.jsstatements import BREAK, statements
from tidewatch.operators.ranking import once

# Sources, sanitizers, sinks and secret words of the rules.
SECRET_WORDS = "password|passwd|secret|api_key|apikey|token|access_token|private_key|credential|auth"
IGNORED_VALUES = ["true", "false", "null", "undefined", "test", "development", "production", "placeholder", "example", "not-a-secret"]
SOURCE = (
    r"\b(?:req|request)\.(?:params|query|body)\b|\b(?:window\.)?location\.(?:search|hash)\b"
    r"|\b(?:e\.target|event\.target|elem|element)\.value\b|getElementById\([^)]*\)\.value\b"
)
SANITIZERS = {
    "xss": r"^(?:DOMPurify\.sanitize|encodeURIComponent)\s*\(.*\)$",
    "sql_injection": r"^(?:Number|parseInt|parseFloat)\s*\(.*\)$",
}
SANITIZED_PART = {
    "xss": r"(?:DOMPurify\.sanitize|encodeURIComponent)\s*\([^()]*\)",
    "sql_injection": r"(?:Number|parseInt|parseFloat)\s*\([^()]*\)",
}
SQL_CALL = r"\b((?:db|database|client|pool|connection|conn|sequelize)\.(?:query|execute)|knex\.raw|prisma\.\$(?:queryRaw|executeRaw))\s*\("
STATIC = r"^(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|`(?:[^`\\$]|\\.|\$(?!\{))*`|-?\d+(?:\.\d+)?|true|false|null)$"
STRING = r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|`(?:[^`\\]|\\.)*`"
ASSIGN = r"^\s*(?:export\s+)?(?:(?:const|let|var)\s+)?([A-Za-z_$][\w$]*)\s*=(?![=>])\s*(.+?);?\s*$"
ARG = r"((?:[^,()\"'`]|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|`(?:[^`\\]|\\.)*`|\((?:[^()\"'`]|\"[^\"]*\"|'[^']*'|`[^`]*`|\([^()]*\))*\))+)"
REQUIRE = r"require\(\s*['\"`]child_process['\"`]\s*\)"
PROPERTY = r"\.(innerHTML|outerHTML)\s*=(?!=)"
HEADS = "|".join([
    PROPERTY, r"\.insertAdjacentHTML\s*\(", r"\bdocument\.(?:write|writeln)\s*\(", r"(?<![\w$.])eval\s*\(", SQL_CALL,
    r"\bdangerouslySetInnerHTML\s*=", REQUIRE + r"\.(?:exec|execSync)\s*\("])
BOUND_CALL = r"(?<![\w$.])[\w$]+(?:\.(?:exec|execSync))?\s*\("
NAME = r"(?<![\w$.])(?!(?:true|false|null|undefined|typeof|void|new|await)\b)([A-Za-z_$][\w$]*)(?![\w$]*\s*[(.\[])(?![\w$])"
UNKNOWN_PART = r"[A-Za-z_$)\]][\w$]*\s*[.(\[]"
KEY = ["file_path", "_id"]


def _get(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.trim(F.regexp_extract(c, pattern, group)), F.lit(""))


def _from_each(stmts: DataFrame, heads: str) -> DataFrame:
    """One row for every place of a statement where a head begins (and its start):
    ``code`` from there on, ``line`` of that place, ``place`` in the statement."""
    rows = once(stmts.filter(F.col("code").rlike(heads)), "_p", F.split("code", f"(?={heads})"))
    rows = rows.select("*", F.posexplode("_p").alias("place", "_x"))
    head = F.array_join(F.slice("_p", F.lit(1), F.col("place")), "")
    rest = F.array_join(F.slice("_p", F.col("place") + 1, F.size("_p")), "")
    down = F.length(F.regexp_replace(head, f"[^{BREAK}]++", ""))
    return rows.select(*KEY, "seq", "place", (F.col("line") + down).cast("int").alias("line"), F.col("code").alias("text"), rest.alias("code"))


def assignments(stmts: DataFrame) -> DataFrame:
    """Single-name declarations and assignments."""
    c = F.col("code")
    rows = once(stmts, "a", F.struct(_get(c, ASSIGN, 1).alias("var"), _get(c, ASSIGN, 2).alias("value")))
    return rows.select(*KEY, "seq", "line", "a.*").filter("var IS NOT NULL AND value IS NOT NULL")


def child_process_bindings(stmts: DataFrame) -> DataFrame:
    """AST-17: names bound to the module ('alias') or to its functions ('function')."""
    c = F.col("code")
    module = r"(?:require\(\s*['\"`]child_process['\"`]\s*\)|['\"]child_process['\"])"
    alias = F.coalesce(
        _get(c, r"(?:const|let|var)\s+([\w$]+)\s*=\s*" + module + r"\s*;?\s*$"),
        _get(c, r"import\s+(?:\*\s+as\s+)?([\w$]+)\s+from\s+" + module))
    names = F.coalesce(_get(c, r"(?:const|let|var)\s*\{([^}]*)\}\s*=\s*" + module), _get(c, r"import\s*\{([^}]*)\}\s*from\s+" + module))
    direct = _get(c, r"(?:const|let|var)\s+([\w$]+)\s*=\s*require\(\s*['\"`]child_process['\"`]\s*\)\.(?:exec|execSync)\b")
    a = stmts.select(*KEY, alias.alias("name"), F.lit("alias").alias("kind"))
    parts = stmts.select(*KEY, F.explode(F.split(names, ",")).alias("p"))
    fn = parts.select(
        *KEY, F.trim(F.regexp_extract("p", r"^\s*(exec|execSync)\s*(?:(?::|as)\s*([\w$]+))?\s*$", 1)).alias("orig"),
        F.regexp_extract("p", r"^\s*(exec|execSync)\s*(?:(?::|as)\s*([\w$]+))?\s*$", 2).alias("renamed"))
    fn = fn.filter("orig <> ''").select(*KEY, F.coalesce(F.nullif("renamed", F.lit("")), "orig").alias("name"), F.lit("function").alias("kind"))
    one = stmts.select(*KEY, direct.alias("name"), F.lit("function").alias("kind"))
    return a.unionByName(fn).unionByName(one).filter("name IS NOT NULL").distinct()


def _sink(name: Column, arg: Column, kind: str, category: str, severity: str, message: str, second: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.when(name.isNotNull() & arg.isNotNull(), F.struct(
        name.alias("target"), arg.alias("arg"), (none if second is None else second).alias("second"), F.lit(kind).alias("signal_type"),
        F.lit(category).alias("category"), F.lit(severity).alias("severity"), F.lit(message).alias("message")))


COMMAND = ("command_execution_call", "command_execution", "critical",
           "Operating system command execution sink is invoked with a dynamic command string.")


def _textual_sinks(c: Column) -> list[Column]:
    """The sink at the start of a text, for sinks that show by themselves."""
    dom = ("dom_xss_call", "xss", "high")
    return [
        _sink(F.concat(F.lit("element."), _get(c, "^" + PROPERTY)), _get(c, "^" + PROPERTY + r"\s*(.+?)[;}]?\s*$", 2), *dom,
              "Dynamic or untrusted content is injected into the DOM without sanitization."),
        _sink(F.when(c.rlike(r"^\.insertAdjacentHTML\s*\("), "element.insertAdjacentHTML"),
              _get(c, r"^\.insertAdjacentHTML\s*\(\s*" + ARG + r"\s*,\s*" + ARG, 2), *dom,
              "Dynamic content is injected into the DOM via insertAdjacentHTML without sanitization."),
        _sink(_get(c, r"^(document\.(?:write|writeln))\s*\("), _get(c, r"^document\.(?:write|writeln)\s*\(\s*" + ARG), *dom,
              "Dynamic content is written directly to the document without sanitization."),
        _sink(F.when(c.rlike(r"^eval\s*\("), "eval"), _get(c, r"^eval\s*\(\s*" + ARG), "dynamic_code_execution",
              "dynamic_code_execution", "critical", "Arbitrary code execution sink eval() is invoked with a dynamic expression."),
        _sink(_get(c, "^" + SQL_CALL), _get(c, "^" + SQL_CALL + r"\s*" + ARG, 2), "unsafe_database_execution", "sql_injection", "high",
              "A database query is dynamically constructed or cannot be verified as parameterized.",
              _get(c, "^" + SQL_CALL + r"\s*" + ARG + r"\s*,\s*" + ARG, 3)),
        _sink(F.when(c.rlike(r"^dangerouslySetInnerHTML\s*="), "dangerouslySetInnerHTML"), _get(c, r"__html\s*:\s*([^},]+)"), *dom,
              "Dynamic content is rendered unsafely through React dangerouslySetInnerHTML."),
        _sink(F.concat(F.lit('require("child_process").'), _get(c, "^" + REQUIRE + r"\.(exec|execSync)\s*\(")),
              _get(c, "^" + REQUIRE + r"\.(?:exec|execSync)\s*\(\s*" + ARG), *COMMAND),
    ]


def sinks(stmts: DataFrame) -> DataFrame:
    """AST-15..19: every sink use of every statement with its sensitive argument.
    Calls of bound names are looked at in files that bind one."""
    cols = [*KEY, "seq", "place", "line", "text", "s.*"]
    c = F.col("code")
    textual = _from_each(stmts, HEADS).withColumn("s", F.explode_outer(F.array(*_textual_sinks(c)))).filter("s IS NOT NULL").select(*cols)
    bind = child_process_bindings(stmts)
    calls = _from_each(stmts.join(bind.select("_id").distinct(), "_id", "left_semi"), BOUND_CALL)
    calls = once(calls, "k", F.struct(
        _get(c, r"^([\w$]+)\.(?:exec|execSync)\s*\(").alias("obj"), _get(c, r"^([\w$]+)\s*\(").alias("fn")))
    named = calls.select("*", F.when(F.col("k.obj").isNotNull(), "alias").otherwise("function").alias("kind"), F.coalesce("k.obj", "k.fn").alias("name"))
    named = named.drop("k").filter("name IS NOT NULL").join(bind, ["_id", "kind", "name"], "left_semi")
    target = F.when(F.col("kind") == "alias", F.concat("name", F.lit("."), _get(c, r"^[\w$]+\.(exec|execSync)\s*\("))).otherwise(F.col("name"))
    bound = once(named, "s", _sink(target, _get(c, r"^[\w$.]+\s*\(\s*" + ARG), *COMMAND)).filter("s IS NOT NULL").select(*cols)
    return textual.unionByName(bound)


def _dynamic_sql(x: Column) -> Column:
    """A template with substitutions, a conditional, or a string joined to something else."""
    bare = F.regexp_replace(x, STRING, '""')
    return x.rlike(r"^`.*\$\{.*`$") | bare.rlike(r"\?.*:") | (bare.contains("+") & bare.contains('""') & F.regexp_replace(bare, r"[\s+]|\"\"", "").rlike("."))


def _unsanitized(x: Column, category: Column) -> Column:
    """The expression with whole sanitizer calls of its category as a zero."""
    for cat, pattern in SANITIZED_PART.items():
        x = F.when(category == cat, F.regexp_replace(x, pattern, "0")).otherwise(x)
    return x


def _local_state(x: Column, category: Column) -> Column:
    """State of an expression from its own text: STATIC, SANITIZED, TAINTED, or NULL
    when it depends on variables. Strings and whole sanitizer calls are taken out
    before looking for sources."""
    rest = _unsanitized(x, category)
    keep_subst = F.regexp_replace(F.regexp_replace(rest, r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'", '""'), r"`(?:[^`\\$]|\\.|\$(?!\{))*`", '""')
    bare = F.regexp_replace(keep_subst, r"[\s+]|\"\"|\b0\b", "")
    whole = F.lit(False)
    for cat, pattern in SANITIZERS.items():
        whole = whole | ((category == cat) & x.rlike(pattern))
    return (
        F.when(x.rlike(STATIC), "STATIC").when(whole, "SANITIZED").when(keep_subst.rlike(SOURCE), "TAINTED")
        .when((bare == "") & (rest != x), "SANITIZED").when(bare == "", "STATIC"))


STATES = ["STATIC", "SANITIZED", None, "TAINTED"]  # the later one decides a combination
OPEN = STATES.index(None)


def _dependencies(x: Column, category: Column) -> Column:
    """Names that an expression reads outside of strings, and whether it has parts
    that cannot be followed (calls, members, places of an array)."""
    rest = _unsanitized(x, category)
    inside = F.array_join(F.regexp_extract_all(rest, F.lit(r"\$\{([^{}]*)\}"), F.lit(1)), " ; ")
    text = F.regexp_replace(F.concat(F.regexp_replace(rest, STRING, '""'), F.lit(" ; "), inside), STRING, '""')
    return F.struct(F.array_distinct(F.regexp_extract_all(text, F.lit(NAME), F.lit(1))).alias("names"), text.rlike(UNKNOWN_PART).alias("unknown"))


def follow(uses: DataFrame, assigns: DataFrame) -> DataFrame:
    """AST-29: state of each sink argument from all the names it reads, each followed to
    its latest earlier assignment until nothing is left to follow. Adds ``state``
    (NULL: some part is not known, none is tainted) and ``dynamic`` (an expression on
    the way builds SQL from parts).

    A round takes every open expression one assignment back, so it ends; an assignment
    that several ways of one use reach in a round is followed once, and only the
    expressions still open are written and joined again."""
    ident = ["_id", "seq", "place", "target", "signal_type"]
    a = assigns.select(F.col("_id").alias("_i"), F.col("var").alias("_v"), F.col("seq").alias("_l"), F.col("value").alias("_x"))
    uses = uses.checkpoint()
    nodes = uses.select(*ident, "category", F.col("arg").alias("x"), F.col("seq").alias("at"))
    facts = []
    while True:
        nodes = once(nodes, "own", _local_state(F.col("x"), F.col("category")))
        nodes = once(nodes, "d", F.when(F.col("own").isNull(), _dependencies(F.col("x"), F.col("category"))))
        closed = F.col("d").isNull() | F.col("d.unknown") | (F.size("d.names") == 0)
        rank = F.coalesce(F.array_position(F.array(*[F.lit(s or "") for s in STATES]), F.col("own")).cast("int") - 1, F.lit(OPEN))
        facts.append(nodes.select(*ident, F.when(closed, rank).alias("rank"), _dynamic_sql(F.col("x")).alias("dynamic")))
        names = nodes.filter("d IS NOT NULL").select(*ident, "category", "at", F.explode("d.names").alias("_n"))
        steps = names.join(a, (F.col("_id") == F.col("_i")) & (F.col("_n") == F.col("_v")) & (F.col("_l") < F.col("at")), "left")
        steps = steps.groupBy(*ident, "category", "at", "_n").agg(F.max("_l").alias("_l"), F.max_by("_x", "_l").alias("x")).checkpoint()
        facts.append(steps.filter("x IS NULL").select(*ident, F.lit(OPEN).alias("rank"), F.lit(False).alias("dynamic")))
        nodes = steps.filter("x IS NOT NULL").select(*ident, "category", "x", F.col("_l").alias("at")).distinct()
        if nodes.isEmpty():
            break
    found = facts[0]
    for more in facts[1:]:
        found = found.unionByName(more)
    found = found.groupBy(*ident).agg(F.max("rank").alias("rank"), F.max("dynamic").alias("dynamic"))
    state = F.element_at(F.array(*[F.lit(s) for s in STATES]), F.col("rank") + 1)
    return uses.join(found, ident).withColumn("state", state).drop("rank")


def javascript_signals(sources: DataFrame) -> DataFrame:
    """AST-15..20: signals of JavaScript sources."""
    st = statements(sources).checkpoint()
    asg = assignments(st)
    use = sinks(st).filter(~F.col("arg").rlike(STATIC))
    rows = follow(use, asg)
    direct = F.col("target").isin("eval", "dangerouslySetInnerHTML")
    sql = F.col("category") == "sql_injection"
    placeholder = F.col("arg").rlike(r"\?|%s|\$\d+|%\(\w+\)s|:\w+") & F.col("second").isNotNull() & F.col("arg").rlike(STATIC)
    keep = direct | (F.coalesce(~F.col("state").isin("STATIC", "SANITIZED"), F.lit(True)) & (~sql | (~placeholder & F.col("dynamic"))))
    out = rows.filter(keep).select(
        "file_path", F.lit(0).alias("fn_seq"), "seq", F.lit(None).cast("string").alias("scope"), "line", "category", "target",
        "signal_type", "severity", F.lit("high").alias("confidence"), "message",
        F.when(F.col("state") == "TAINTED", F.concat(F.lit("[Taint Flow] Sink: "), "target", F.lit(" (line "), F.col("line").cast("string"), F.lit(")"))).otherwise(F.regexp_replace("text", BREAK + r"\s*", " ")).alias("evidence"),
        F.col("state").alias("taint_state"), F.array("target").alias("related"))
    value = F.regexp_extract("value", r"^(?:\"([^\"]*)\"|'([^']*)')$", 0)
    inner = F.regexp_replace(value, r"^['\"]|['\"]$", "")
    secret = asg.filter(F.lower("var").rlike(SECRET_WORDS) & (value != "") & (F.length(inner) >= 8) & ~F.lower(inner).isin(IGNORED_VALUES))
    sec = secret.select(
        "file_path", F.lit(0).alias("fn_seq"), "seq", F.lit(None).cast("string").alias("scope"), "line",
        F.lit("credential_management").alias("category"), F.col("var").alias("target"), F.lit("possible_hardcoded_secret").alias("signal_type"),
        F.lit("medium").alias("severity"), F.lit("medium").alias("confidence"), F.lit("A secret-like variable is assigned a string literal.").alias("message"),
        F.concat("var", F.lit(" assigned a string literal")).alias("evidence"), F.lit(None).cast("string").alias("taint_state"), F.array("var").alias("related"))
    return finish_signals(out.unionByName(sec), "javascript")


def javascript_functions(sources: DataFrame) -> DataFrame:
    """AST-04: names and start lines of functions, methods and arrow functions."""
    c = F.col("code")
    st = statements(sources)
    name = F.coalesce(
        _get(c, r"\bfunction\s*\*?\s*([\w$]+)\s*\("),
        _get(c, r"(?:const|let|var)\s+([\w$]+)\s*=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*=>|[\w$]+\s*=>)"),
        F.when(~c.rlike(r"^\s*(?:if|for|while|switch|catch|return|function)\b"), _get(c, r"^\s*(?:async\s+|static\s+)*([\w$]+)\s*\([^)]*\)\s*\{")),
        F.when(c.rlike(r"\bfunction\s*\(|=>"), "anonymous"))
    return st.select("file_path", name.alias("name"), F.lit(None).cast("string").alias("class_name"), F.col("line").alias("start_line"),
                     c.rlike(r"\basync\b").alias("is_async")).filter("name IS NOT NULL")
