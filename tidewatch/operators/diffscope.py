"""Unified diffs, changed scopes and inline comment planning (AST-30/31, FLT-14/25/26,
JOI-11..15, RNK-03/06/13/14, SET-08)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import text as T
from tidewatch.operators.intervals import blocked
from tidewatch.operators.ranking import once

# The hunk header and the line separators.
HUNK = r"^@@\s+-(\d+)(?:,(\d+))?\s+\+(\d+)(?:,(\d+))?\s+@@"
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
# Words and marks of the patch-only secret test.
SECRET_WORDS = ["jwt_secret", "api_key", "password", "secret"]
MODULE = "<module>"


def text_lines(text: str) -> Column:
    """The lines of a text; a final line break opens no line, no text has none."""
    arr = F.split(F.col(text), LINE_BREAK)
    arr = F.when(F.element_at(arr, -1) == "", F.slice(arr, 1, F.size(arr) - 1)).otherwise(arr)
    return F.when(F.length(text) > 0, arr).otherwise(F.array().cast("array<string>"))


def lines_of(df: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """One row per text line (``pos`` from 0)."""
    return df.filter(F.length(text) > 0).select(*keep, F.posexplode(text_lines(text)).alias("pos", "content"))


_LINE = "struct<segment:bigint,kind:string,new_line:bigint,old_line:bigint,step_new:bigint>"


def hunk_lines(text: str = "patch") -> Column:
    """TXT-32 / RNK-13 / RNK-14: every line of a hunk with its old and new number.

    One fold over the patch's own lines: a header sets both counters and opens a
    hunk, a file marker closes it, and every other line of a hunk moves the
    counter of each side it is on. Nothing leaves the row."""
    number = lambda c, g: F.nullif(F.regexp_extract(c, HUNK, g), F.lit("")).cast("long")
    zero = F.lit(0).cast("long")

    def step(a: Column, c: Column) -> Column:
        header = c.startswith("@@") & c.rlike(HUNK)
        marker = c.startswith("+++") | c.startswith("---") | c.startswith("diff ") | c.startswith("index ")
        plus = c.startswith("+") & (a["room"] > 0)
        minus = c.startswith("-")
        both = ~c.startswith("+") & ~minus & ~c.startswith("\\")
        line = F.struct(
            a["segment"].alias("segment"), F.when(plus, "added").when(minus, "deleted").when(both, "context").otherwise("other").alias("kind"),
            a["new"].alias("new_line"), a["old"].alias("old_line"), (plus | both).cast("long").alias("step_new"))
        opening = F.struct((a["segment"] + 1).alias("segment"), F.lit("header").alias("kind"), number(c, 3).alias("new_line"), number(c, 1).alias("old_line"), zero.alias("step_new"))
        inside = F.struct(
            F.lit(True).alias("open"), a["segment"].alias("segment"), (a["new"] + (plus | both).cast("long")).alias("new"),
            (a["old"] + (minus | both).cast("long")).alias("old"), a["room"].alias("room"), F.concat(a["lines"], F.array(line.cast(_LINE))).alias("lines"))
        opened = F.struct(
            F.lit(True).alias("open"), (a["segment"] + 1).alias("segment"), number(c, 3).alias("new"), number(c, 1).alias("old"),
            F.coalesce(number(c, 4), F.lit(1).cast("long")).alias("room"), F.concat(a["lines"], F.array(opening.cast(_LINE))).alias("lines"))
        closed = F.struct(F.lit(False).alias("open"), (a["segment"] + 1).alias("segment"), a["new"].alias("new"), a["old"].alias("old"), a["room"].alias("room"), a["lines"].alias("lines"))
        return F.when(header, opened).when(marker, closed).when(a["open"], inside).otherwise(a)

    start = F.struct(F.lit(False).alias("open"), zero.alias("segment"), zero.alias("new"), zero.alias("old"), zero.alias("room"), F.array().cast(f"array<{_LINE}>").alias("lines"))
    return F.aggregate(text_lines(text), start, step, lambda a: a["lines"])


def changed_lines_arrays(patches: DataFrame, key: str = "diff_id", text: str = "patch") -> DataFrame:
    """AST-30 / SET-08: sorted distinct added, deleted and affected lines of each
    patch that has any. Affected are the added lines; a pure deletion is
    anchored at the last new-file position reached."""
    rows = once(patches.select(key, text), "_l", hunk_lines(text))
    pick = lambda kind, field: F.array_sort(F.array_distinct(F.transform(F.filter("_l", lambda x: x["kind"] == kind), lambda x: x[field])))
    rows = rows.withColumns({"added_lines": pick("added", "new_line"), "deleted_lines": pick("deleted", "old_line")})
    last = F.element_at("_l", -1)
    anchor = F.array(F.greatest(F.lit(1).cast("long"), last["new_line"] + last["step_new"]))
    affected = F.when(F.size("added_lines") > 0, F.col("added_lines")).when(F.size("deleted_lines") > 0, anchor).otherwise(F.col("added_lines"))
    return rows.withColumn("affected_lines", affected).filter("size(affected_lines) > 0").select(key, "added_lines", "deleted_lines", "affected_lines")


def changed_lines(patches: DataFrame, key: str = "diff_id", text: str = "patch") -> DataFrame:
    """The same as (key, kind, line) rows; no shuffle, one patch is one row."""
    arrays = changed_lines_arrays(patches, key, text)
    marks = lambda kind: F.transform(f"{kind}_lines", lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("line")))
    return arrays.select(key, F.explode(F.concat(*[marks(k) for k in ("added", "deleted", "affected")])).alias("_m")).select(key, "_m.kind", "_m.line")


def scoped_lines(lines: DataFrame, functions: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """JOI-11 / RNK-06: every changed line with its innermost function (shortest
    span, then latest start); NULL outside all functions, no row there with
    ``how="inner"``. A grouped minimum over a join on blocks of lines, so no window
    spans a file; a line is in one block, so its rows already meet in one task."""
    p, i = blocked(lines, functions, "line", "start_line", "end_line")
    p, i = p.alias("p"), i.alias("i")
    same = F.col("p._block") == F.col("i._block")
    for k in keys:
        same = same & (F.col(f"p.{k}") == F.col(f"i.{k}"))
    hits = p.join(i, same & F.col("p.line").between(F.col("i.start_line"), F.col("i.end_line")), how)
    f = F.struct("i.name", "i.class_name", "i.start_line", "i.end_line")
    order = F.when(F.col("i.start_line").isNotNull(), F.struct(
        F.col("i.end_line") - F.col("i.start_line"), -F.col("i.start_line"), F.col("i.name"), F.col("i.class_name")))
    best = hits.groupBy(*[F.col(f"p.{k}") for k in keys], F.col("p._block"), F.col("p.line")).agg(F.min_by(f, order).alias("s"))
    return best.select(*keys, "line", "s.*")


def tightest_scope(lines: DataFrame, functions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The changed lines that lie in a function, with that function."""
    return scoped_lines(lines, functions, keys, "inner")


def changed_scopes(lines: DataFrame, functions: DataFrame, files: DataFrame, keys: Sequence[str]) -> DataFrame:
    """AST-31: scopes touched by a change, with their changed line count and
    bounds. Lines outside every function form one module scope per file.
    ``files`` carries the line total of each file."""
    per = scoped_lines(lines, functions, keys).groupBy(*keys, "name", "class_name", "start_line", "end_line").agg(
        F.count(F.lit(1)).alias("changed"), F.min("line").alias("first_changed"), F.max("line").alias("last_changed"))
    module = F.col("start_line").isNull()
    out = per.join(files.select(*keys, "total_lines"), list(keys), "left")
    return out.select(
        *keys,
        F.when(module, "module").when(F.col("class_name").isNotNull(), "method").otherwise("function").alias("scope_type"),
        F.when(module, MODULE).otherwise(F.concat_ws(".", "class_name", "name")).alias("name"), "class_name",
        F.when(module, 1).otherwise(F.col("start_line")).cast("long").alias("start_line"),
        F.when(module, F.greatest(F.lit(1), F.coalesce("total_lines", F.lit(1)))).otherwise(F.col("end_line")).cast("long").alias("end_line"),
        "changed", "first_changed", "last_changed")


def filter_to_diff(findings: DataFrame, scopes: DataFrame, lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """FLT-14 / JOI-12: keep findings on a changed line or inside a changed
    function; findings without a line, and files without any change record, stay.
    ``scopes`` come from ``lines``, so the files of ``lines`` are all files touched."""
    placed = findings.filter("line IS NOT NULL")
    untouched = placed.join(lines.select(*keys).distinct().hint("merge"), list(keys), "left_anti")
    # a changed line is an interval of length one: one join answers both rules
    spans = scopes.filter("scope_type <> 'module'").select(*keys, F.col("start_line").alias("_s"), F.col("end_line").alias("_e"))
    spans = spans.unionByName(lines.select(*keys, F.col("line").alias("_s"), F.col("line").alias("_e")))
    p, i = blocked(placed, spans, "line", "_s", "_e")
    i = i.withColumnsRenamed({c: f"_i_{c}" for c in (*keys, "_block")})
    same = (F.col("_block") == F.col("_i__block")) & F.col("line").between(F.col("_s"), F.col("_e"))
    for k in keys:
        same = same & (F.col(k) == F.col(f"_i_{k}"))
    inside = p.join(i, same, "left_semi").drop("_block")
    return findings.filter("line IS NULL").unionByName(untouched).unionByName(inside)


def match_changed_file(paths: DataFrame, changed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """JOI-13: changed file of a finding path: equal paths, else the first file (by
    ``file_order``) of which one path ends with the other. A path's suffixes are
    looked up, but only those as long as some path of the other side with the
    same key, so the theta test becomes two equi joins that send one row for each
    length. Frames of such rows look small to Spark, which does not know how many
    rows a path makes, and would fill the driver as broadcasts: they are merged."""
    p = paths.select(*keys, T.normalize_path("file_path").alias("path")).distinct().filter("path <> ''")
    c = changed.select(*keys, T.normalize_path("filename").alias("target"), "file_order")
    c = c.groupBy(*keys, "target").agg(F.min("file_order").alias("file_order"))

    def suffixes(side: DataFrame, x: str, other: DataFrame, y: str) -> DataFrame:
        """Rows of ``side`` with each suffix of ``x``, as ``y``, that has the length of a ``y`` in ``other``."""
        lengths = other.groupBy(*keys).agg(F.collect_set(F.length(y)).alias("_lengths"))
        probes = F.transform(F.filter("_lengths", lambda n: (n > 0) & (n <= F.length(x))), lambda n: F.right(F.col(x), n))
        return side.join(lengths.hint("merge"), list(keys)).withColumn(y, F.explode(probes)).drop("_lengths")

    a = suffixes(p, "path", c, "target").hint("merge").join(c, [*keys, "target"])
    b = suffixes(c, "target", p, "path").hint("merge").join(p, [*keys, "path"])
    cols = [*keys, "path", "target", "file_order"]
    both = a.select(*cols).unionByName(b.select(*cols))
    order = F.struct(F.when(F.col("path") == F.col("target"), 0).otherwise(1), F.col("file_order"))
    return both.groupBy(*keys, "path").agg(F.min_by("target", order).alias("target"))


def inline_commentable(findings: DataFrame, changed: DataFrame, added: DataFrame, keys: Sequence[str]) -> DataFrame:
    """JOI-13 / JOI-14: findings that sit on an added line of a changed file.
    ``added``: (keys, target, line)."""
    f = findings.withColumn("path", T.normalize_path("file_path")).filter(F.col("line") > 0)
    m = match_changed_file(f, changed, keys)
    lines = added.select(*keys, "target", "line").distinct().hint("merge")  # from patches, so far more rows than Spark expects
    return f.join(m, [*keys, "path"]).join(lines, [*keys, "target", "line"], "left_semi")


def posted_fingerprints(comments: DataFrame, body: str = "body", prefix: str = "<!-- finding:", suffix: str = " -->") -> DataFrame:
    """TXT-37: fingerprints found between markers in comment texts."""
    pattern = "\\Q" + prefix + "\\E(.*?)\\Q" + suffix + "\\E"
    fp = F.explode(F.regexp_extract_all(F.col(body), F.lit(pattern), F.lit(1)))
    return comments.select(fp.alias("fingerprint")).select(
        T.strip("fingerprint").alias("fingerprint")).filter("fingerprint <> ''").distinct()


def unposted(planned: DataFrame, posted: DataFrame) -> DataFrame:
    """JOI-15."""
    return planned.join(posted, "fingerprint", "left_anti")


def head_sha(body: str | Column, prefix: str = "<!-- head-sha:", suffix: str = " -->") -> Column:
    """TXT-37: the 40-character commit id in a comment, lower-cased."""
    sha = T.strip(F.regexp_extract(T.col(body), "\\Q" + prefix + "\\E(.*?)\\Q" + suffix + "\\E", 1))
    return F.when(F.length(sha) == 40, F.lower(sha))


def patch_secret(patch: str | Column = "patch") -> Column:
    """FLT-26: secret words together with an assignment mark."""
    p = T.col(patch)
    return F.lower(p).rlike("|".join(SECRET_WORDS)) & p.rlike("[=:]")


def dispatch(files: DataFrame) -> DataFrame:
    """FLT-25: what happens to each changed file of a pull request."""
    from tidewatch.operators.paths import excluded

    name = F.col("filename")
    removed = F.coalesce(F.col("status") == "removed", F.lit(False)) | F.coalesce(name == "", F.lit(True))
    return files.withColumn(
        "action",
        F.when(removed | excluded("filename"), "skipped")
        .when(name.endswith(".py"), "python")
        .when(name.endswith(".js") | name.endswith(".jsx"), "javascript")
        .otherwise("patch_only"),
    )
