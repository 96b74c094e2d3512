"""Line dedup with a tree of log templates.

A line goes down a tree of fixed depth: the number of its tokens, then its
leading tokens, with every token that holds a digit read as a variable. In a
leaf the line met most often is the first pattern; lines that agree with it in
enough places are instances of one template, whose other places are variable.
Of the lines that do not agree, the one met most often is the next pattern, and
so on until no line of the leaf is left. A template seen in several documents is
boilerplate: only the first document keeps it.

Texts stay where they are: what is grouped and joined is a line's 128-bit name
and its sketch, one letter for each token. Two different tokens share a letter
once in 94 times, which moves a line's agreement by about a hundredth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import free_name, written
from tidewatch.operators.ranking import once

#: Leading tokens that the lines of a leaf share.
DEPTH = 3
#: Lines of a leaf that are looked at for patterns in the first round; each round doubles it, up to the second number.
PATTERNS, MOST_PATTERNS = 64, 1024
#: Share of a leaf's places in which a line must agree with the pattern.
SIMILARITY = 0.7
#: Documents from which on a template is boilerplate; long lines need fewer.
MIN_DOCS, MIN_DOCS_LONG, LONG_TOKENS = 5, 2, 20
VARIABLE = "<*>"


def _tokens(text: str) -> str:
    """SQL for the token arrays of the lines of ``text``."""
    return rf"""transform(split({text}, '\n'), x -> if(x rlike '[0-9]',
        transform(filter(split(x, '\\s+'), t -> t <> ''), t -> if(t rlike '[0-9]', '{VARIABLE}', t)), filter(split(x, '\\s+'), t -> t <> '')))"""


_NAME = "concat(lpad(hex(xxhash64(t)), 16, '0'), lpad(hex(xxhash64('second', t)), 16, '0'))"


def line_counts(docs: DataFrame) -> DataFrame:
    """(name, sketch, n, first) of every distinct masked line that has a token:
    how many rows hold it (each counts once), and the smallest doc_id."""
    keys = f"array_distinct(transform(filter({_tokens('text')}, t -> size(t) > 0), t -> concat({_NAME}, array_join(transform(t, w -> char(33 + pmod(hash(w), 94))), ''))))"
    counted = docs.select("doc_id", F.explode(F.expr(keys)).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))
    return counted.select(F.unhex(F.substring("key", 1, 32)).alias("name"), F.expr("substring(key, 33)").alias("sketch"), "n", "first")


def _needed(tokens: Column, min_docs: int, min_docs_long: int, long_tokens: int) -> Column:
    return F.when(tokens >= long_tokens, min_docs_long).otherwise(min_docs)


def _patterns(todo: DataFrame, needed: Column, most: int, fits) -> DataFrame:
    """(leaf, patterns): of the ``most`` lines met most often in a leaf, those
    that fit no earlier one. Leaves with too few lines to recur are left out."""
    best = lambda lines: F.slice(F.sort_array(lines, asc=False), 1, most)
    some = todo.groupBy("leaf", "tokens", F.pmod(F.xxhash64("name"), F.lit(32)).alias("part")).agg(F.sum("n").alias("met"), best(F.collect_list(F.struct("n", "name", "sketch"))).alias("top"))
    top = some.groupBy("leaf", "tokens").agg(F.sum("met").alias("met"), best(F.flatten(F.collect_list("top"))).alias("top")).filter(F.col("met") >= needed)
    none = F.expr("cast(array() as array<struct<n: bigint, name: binary, sketch: string>>)")
    return top.select("leaf", F.aggregate("top", none, lambda acc, x: F.when(F.exists(acc, lambda p: fits(p, x["sketch"])), acc).otherwise(F.concat(acc, F.array(x)))).alias("patterns"))


def templates(lines: DataFrame, needed: Column, depth: int = DEPTH, similarity: float = SIMILARITY, patterns: int = PATTERNS) -> DataFrame:
    """(name, template, n, first, tokens); a template is named by its pattern.

    Patterns are found as if line by line: a line, in the order of falling
    ``n`` (then name), belongs to the first pattern of its leaf that it fits, or
    is the next pattern. A round settles the first lines of each leaf among
    themselves and all lines that fit the patterns among them. Lines of leaves
    whose lines fewer than ``needed`` documents hold in all cannot be part of a
    recurring template and are left out."""
    def fits(p: Column, sketch: Column) -> Column:
        same = F.aggregate(F.zip_with(F.split(sketch, ""), F.split(p["sketch"], ""), lambda a, b: (a == b).cast("int")), F.lit(0), lambda acc, x: acc + x)
        return same >= similarity * F.length(sketch)

    todo = lines.withColumn("tokens", F.length("sketch"))
    todo = written(todo.withColumn("leaf", F.xxhash64("tokens", F.substring("sketch", 1, depth))), "lines")
    full = todo.groupBy("leaf", "tokens").agg(F.sum("n").alias("met")).filter(F.col("met") >= needed).select("leaf")
    todo, done = written(todo.join(full, "leaf", "left_semi"), "leaves"), []
    while not done or not todo.isEmpty():
        found = _patterns(todo, needed, patterns, fits)
        first = F.aggregate("patterns", F.lit(None).cast("binary"), lambda acc, p: F.coalesce(acc, F.when(fits(p, F.col("sketch")), p["name"])))
        fitted = written(todo.join(found, "leaf").select("leaf", "name", "sketch", "n", "first", "tokens", first.alias("template")), "fitted")
        done.append(fitted.filter("template is not null").select("name", "template", "n", "first", "tokens"))
        todo = fitted.filter("template is null").drop("template")
        patterns = min(2 * patterns, max(patterns, MOST_PATTERNS))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def recurring(lines: DataFrame, min_docs: int = MIN_DOCS, min_docs_long: int = MIN_DOCS_LONG, long_tokens: int = LONG_TOKENS) -> DataFrame:
    """(name, template, owner, lines, needed): lines of templates that may be
    boilerplate, the document that keeps them, how many lines the template has
    and how many documents it needs. A template of one line has them; of several
    lines, some may be in one document, which :func:`drop_recurring` counts."""
    needed = _needed(F.col("tokens"), min_docs, min_docs_long, long_tokens)
    found = templates(lines, needed)
    whole = found.groupBy("template").agg(F.sum("n").alias("met"), F.min("first").alias("owner"), F.max("tokens").alias("tokens"), F.count(F.lit(1)).alias("lines"))
    whole = whole.filter((F.col("met") >= needed) & F.col("owner").isNotNull()).select("template", "owner", "lines", needed.alias("needed"))
    return found.select("name", "template").join(whole, "template")


def drop_recurring(docs: DataFrame, min_docs: int = MIN_DOCS, min_docs_long: int = MIN_DOCS_LONG, long_tokens: int = LONG_TOKENS) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, plus n_lines and
    n_dropped.

    The document with a template's smallest doc_id keeps all of its lines of
    that template. Blank lines stay. Null texts stay null and have no lines.
    Rows that repeat a doc_id and text are treated alike (each counts as a
    document). A null doc_id never owns a template that another document has;
    where all are null, none is dropped."""
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    docs = docs.select(*[f"`{c}`" for c in names])
    maybe = recurring(line_counts(docs), min_docs, min_docs_long, long_tokens)
    k1, k2, gone, lines = (free_name(docs, n) for n in ("row_key", "row_key2", "gone", "lines"))
    keyed = docs.withColumns({k1: F.xxhash64("doc_id", "text"), k2: F.xxhash64(F.lit("second"), "text", "doc_id")})
    named = keyed.select("doc_id", k1, k2, F.posexplode(F.expr(f"transform({_tokens('text')}, t -> if(size(t) > 0, unhex({_NAME}), null))")).alias("at", "name"))
    hit = written(named.filter("name is not null").join(maybe, "name").drop("name"), "hits")
    # lines of one template in one document are one; rows that repeat a document are as many as hold one of its places
    once_each = hit.filter("lines > 1").groupBy("template", "needed", k1, k2, "at").agg(F.count(F.lit(1)).alias("rows"))
    once_each = once_each.groupBy("template", "needed", k1, k2).agg(F.max("rows").alias("rows"))
    few = once_each.groupBy("template", "needed").agg(F.sum("rows").alias("docs")).filter("docs < needed").select("template")
    hit = hit.join(few, "template", "left_anti").filter(~F.col("doc_id").eqNullSafe(F.col("owner")))
    places = hit.groupBy(k1, k2).agg(F.collect_set("at").alias(gone))
    joined = once(keyed.join(places, [k1, k2], "left"), lines, F.when(F.col(gone).isNotNull(), F.split("text", "\n")))
    kept = F.expr(f"transform(array_sort(array_except(sequence(0, size({lines}) - 1), {gone})), i -> {lines}[i])")
    text = F.when(F.col(gone).isNotNull(), F.array_join(kept, "\n")).otherwise(F.col("text")).alias("text")
    return joined.select(
        *[text if c == "text" else F.col(f"`{c}`") for c in names],
        F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_dropped"))
