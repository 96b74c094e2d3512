"""JavaScript statements from tokens, by nesting depth (AST-15..20).

A source becomes token rows; a running sum of brackets per file gives the depth, and
the latest opening bracket of that depth is the innermost open one. A statement ends
at a line end or semicolon that lies in no bracket or in a block, at the brace that
opens a block and before the brace that closes it. Line ends in parentheses, square
brackets, object literals, strings and templates do not end it, nor do line ends next
to an operator. Work is keyed by file: one file's tokens meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.ranking import once

BREAK = "\f"  # stands for a line end inside a statement
_QUOTED = r"\"[^\"\\\n]*+(?:\\(?s:.)[^\"\\\n]*+)*+\"|'[^'\\\n]*+(?:\\(?s:.)[^'\\\n]*+)*+'"
_TEMPLATE = r"`[^`\\$]*+(?:(?:\\(?s:.)|\$\{(?:[^{}`]|`[^`]*+`|\{[^{}]*+\})*+\}|\$)[^`\\$]*+)*+`"
_COMMENT = r"//[^\n]*+|/\*(?s:.*?)\*/"
_REGEX = r"(?<=[=(,:!&|?\[;]\s{0,4})/(?![/*])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/[a-z]*+"
_LABEL = r"\bcase\s++(?:" + _QUOTED + r"|[^:\n'\"`{}()]++)\s*+:|\bdefault\s*+:"
_PIECE = _QUOTED + "|" + _TEMPLATE + "|" + _REGEX + r"|(?!case\b|default\b)[\w$.]++|(?!//|/\*)[^\s;(){}\[\]\w$.]|[ \t\r]++"
TOKEN = r"[ \t\r]*+(?:" + _COMMENT + "|" + _LABEL + r"|\n\s*+|(?:" + _PIECE + r"){1,64}+|.)"
_OPENS_LITERAL = r"[=(,:\[?{&|]$|(?:^|\W)(?:return|import|export|const|let|var)$"
_LABELLED = r"^(?s:(?:case|default)\b.*:)$"
_GOES_ON_AFTER = r"(?:=>|[=*%&|^<?,(\[~!:.]|(?<!\+)\+|(?<!-)-|(?<!/.{0,99})/)$"
_GOES_ON_BEFORE = r"^(?:\?\.|\.(?!\.\.)|\+(?!\+)|[*%&|^?:=<>,)\]]|-(?!-))"


def statements(sources: DataFrame) -> DataFrame:
    """Statement rows (file_path, seq, line, code) of (file_path, source).

    ``seq`` orders a file's statements, ``line`` is the 1-based line of the first
    token. Comments are gone and line ends within a statement are form feeds. Files
    whose brackets do not balance are cut at every line end outside of strings and
    templates and at semicolons. A null or empty source gives no row; rows of one
    file_path with different sources are kept apart, equal rows count once.
    """
    src = sources.filter(F.length("source") > 0).select("file_path", "source")
    src = src.withColumn("_id", F.md5(F.concat_ws(":", F.col("file_path").isNull().cast("string"), "file_path", "source")))
    flat = F.regexp_replace("source", r"\r\n?", "\n")
    rows = src.select("file_path", "_id", F.posexplode(F.regexp_extract_all(flat, F.lit(TOKEN), F.lit(0))).alias("pos", "tok"))
    key = ["_id"]
    order = Window.partitionBy(*key).orderBy("pos")
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    word = F.trim(F.regexp_replace("tok", r"^[ \t\r]++", ""))
    rows = once(rows, "t", F.struct(
        F.when(F.col("tok").startswith("\n"), "\n").otherwise(word).alias("word"),
        F.length(F.regexp_replace("tok", r"[^\n]++", "")).alias("breaks"))).select("*", "t.*").drop("t")
    rows = rows.withColumn("twin", F.lag("pos").over(order)).filter("twin IS NULL OR twin <> pos").drop("twin")
    rows = rows.withColumn("line", F.coalesce(F.sum("breaks").over(before), F.lit(0)) + 1)
    rows = rows.filter(~F.col("word").rlike(r"^(?://|/\*)") & (F.col("word") != ""))
    rows = rows.withColumn("prior", F.lag("word").over(order)).filter("NOT (word = '\n' AND (prior IS NULL OR prior = '\n'))")
    rows = rows.withColumns({"prior": F.lag("word").over(order), "next": F.lead("word").over(order)})
    # the last word before an opening brace, looking through one line end
    rows = rows.withColumn("opened_after", F.when(F.col("prior") == "\n", F.lag("word", 2).over(order)).otherwise(F.col("prior")))
    w = F.col("word")
    up, down = w.isin("(", "[", "{"), w.isin(")", "]", "}")
    literal = (w != "{") | F.coalesce(F.col("opened_after").rlike(_OPENS_LITERAL) & ~F.col("opened_after").rlike(_LABELLED), F.lit(False))
    step = F.when(up, 1).when(down, -1).otherwise(0)
    rows = rows.withColumns({"step": step, "depth": F.sum(step).over(upto), "opens": F.when(up, F.when(literal, "literal").otherwise("block"))})
    whole = Window.partitionBy(*key)
    rows = rows.withColumns({
        "even": (F.min("depth").over(whole) >= 0) & (F.sum("step").over(whole) == 0),
        "level": F.col("depth") - F.least("step", F.lit(0))})
    at_level = Window.partitionBy(*key, "level").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("within", F.when(F.col("level") > 0, F.last("opens", ignorenulls=True).over(at_level)))
    free = ~F.col("even") | F.coalesce(F.col("within") != "literal", F.lit(True))
    goes_on = F.col("even") & (F.coalesce(F.col("prior").rlike(_GOES_ON_AFTER), F.lit(False)) | F.coalesce(F.col("next").rlike(_GOES_ON_BEFORE), F.lit(False)))
    ends = free & ((w == ";") | (w.rlike(_LABELLED)) | ((w == "\n") & ~goes_on) | ((w == "{") & F.col("even")))
    closes = (w == "}") & F.col("even") & (F.coalesce("within", F.lit("")) == "block")
    rows = rows.withColumns({"ends": ends, "closes": closes})
    rows = rows.withColumn("starts", F.coalesce(F.lag("ends").over(order), F.lit(True)) | F.col("closes"))
    rows = rows.withColumn("stmt", F.sum(F.col("starts").cast("int")).over(upto))
    part = F.when(w == "\n", F.repeat(F.lit(BREAK), F.col("breaks"))).otherwise(F.regexp_replace("tok", "\n", BREAK))
    one = rows.groupBy("file_path", *key, "stmt").agg(
        F.sort_array(F.collect_list(F.struct("pos", part.alias("text"), "line"))).alias("parts"))
    code = F.regexp_replace(F.array_join(F.col("parts.text"), ""), r"^\s++|\s++$", "")
    one = once(one, "code", code).filter("code <> ''")
    return one.select("file_path", *key, F.col("parts")[0]["pos"].alias("seq"), F.col("parts")[0]["line"].cast("int").alias("line"), "code")
