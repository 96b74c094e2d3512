"""Personal data by bootstrapped contextual extraction.

Checked patterns find sure identifiers, the seeds. The words around them become
lexical patterns; patterns and the identifier-like strings they surround form a
graph. Patterns score by how many of their instances are known, instances by
the patterns they stand in, in turns; what reliable patterns surround is an
identifier as well, even where the checked patterns miss it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import written
from tidewatch.operators.ranking import once

KINDS = ("email", "ip", "card", "phone")
#: Known instances a pattern needs, the share of its instances that must be known, the score that makes an instance known, and the turns.
MIN_SEEDS, MIN_CONFIDENCE, ACCEPT, ROUNDS = 3, 0.75, 0.8, 3

# The first three cannot start inside a run that was already tried from its start; \G allows what follows a match.
# Possessive repeats change nothing, as what follows is never in the repeated class; they keep the work linear.
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
PATTERNS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    "card": (r"[0-9](?:[ -]?[0-9])++", r"[0-9](?:[ -]?[0-9]){12}"),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]"),
}
#: Runs of tokens that hold a digit or @.
MENTION = (r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?: [^\s0-9@]*+[0-9@]\S*+)*+", "[0-9@]")
#: What an instance of a kind must at least look like.
SHAPES = {"email": "@", "ip": r"^[^0-9]*[0-9]+(?:[.:][0-9a-f]*){3,}", "card": r"^(?:[^0-9]*[0-9]){12,19}[^0-9]*$", "phone": r"^(?:[^0-9]*[0-9]){7,15}[^0-9]*$"}
_BLOCK = 64


def _matches(pattern: str, guard: str) -> Column:
    """Matches, and the code points from each match's start back to the last
    one's: the text between, and the match before."""
    found = F.when(F.col("text").rlike(guard), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    parts = F.when(F.col("text").rlike(guard), F.split("text", pattern, -1))
    return F.struct(F.coalesce(found, F.array().cast("array<string>")).alias("found"), F.coalesce(parts, F.array().cast("array<string>")).alias("parts"))


def _placed(k: Column) -> Column:
    """(start, end, text, before, after) of the matches in ``k``: running sums in
    blocks, so the work stays small for texts with very many matches."""
    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0), lambda acc, x: acc + x)

    def place(m: Column, i: Column) -> Column:
        block = (i / _BLOCK).cast("int")
        start = total(F.slice(k["blocks"], 1, block)) + total(F.slice(k["gaps"], block * _BLOCK + 1, i - block * _BLOCK + 1))
        return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("text"), F.get(k["parts"], i).alias("before"), F.get(k["parts"], i + 1).alias("after"))

    return F.transform(k["found"], place)


def _checked(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "card":
        def add(d: Column, i: Column) -> Column:
            x = F.substring(d, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
            return x - F.when(x > 9, 9).otherwise(0)

        luhn = F.get(F.transform(F.array(digits), lambda d: F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda acc, i: acc + add(d, i)) % 10 == 0), F.lit(0))
        return F.length(digits).between(13, 19) & luhn
    return F.lit(True)


def _spans_of_kind(i: int) -> Column:
    good = F.filter(_placed(F.get(F.col("b"), F.lit(i))), lambda s: _checked(KINDS[i], s["text"]))
    return F.transform(good, lambda s: F.struct(F.lit(i).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def _count(i: int) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long").alias(f"n_{KINDS[i]}")


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, base (rank of kind, start, end) and mentions of each
    row; text_key is null where the text holds neither digit nor @."""
    found = once(docs.select("doc_id", "text"), "m", F.array(*[_matches(*PATTERNS[k]) for k in KINDS], _matches(*MENTION)))
    gaps = F.transform("m", lambda k: F.struct(k["found"].alias("found"), k["parts"].alias("parts"), F.transform(
        k["found"], lambda x, i: F.length(F.get(k["parts"], i)) + F.when(i > 0, F.length(F.get(k["found"], i - 1))).otherwise(0)).alias("gaps")))
    found = once(found, "g", gaps)
    blocks = F.transform("g", lambda k: F.struct(k["found"].alias("found"), k["parts"].alias("parts"), k["gaps"].alias("gaps"), F.transform(
        F.sequence(F.lit(0), (F.size(k["gaps"]) / _BLOCK).cast("int")), lambda b: F.aggregate(F.slice(k["gaps"], b * _BLOCK + 1, _BLOCK), F.lit(0), lambda acc, x: acc + x)).alias("blocks")))
    found = once(found.drop("m"), "b", blocks)
    found = once(found, "base", F.concat(*[_spans_of_kind(i) for i in range(len(KINDS))]))

    def mention(s: Column) -> Column:
        lead = F.length(s["text"]) - F.length(F.regexp_replace(s["text"], r"^[(\[\"'<]+", ""))
        body = F.regexp_replace(s["text"], r"^[(\[\"'<]+|[)\]\"'>.,;:!?]+$", "")
        start = s["start"] + lead
        word = r"[\p{L}\p{N}_'-]+"
        left = F.slice(F.reverse(F.regexp_extract_all(F.lower(F.right(s["before"], F.lit(120))), F.lit(word + r"(?=\P{L}{1,3}(?:\S+\s+)?$)|" + word + r"(?=[^\p{L}]*$)"), F.lit(0))), 1, 2)
        right = F.regexp_extract(F.lower(F.left(s["after"], F.lit(80))), r"^\s*(" + word + r")(?=\W)", 1)
        kind = F.get(F.transform(F.filter("base", lambda b: (b["start"] < start + F.length(body)) & (b["end"] > start)), lambda b: b["kind"]), F.lit(0))
        return F.struct(start.alias("start"), (start + F.length(body)).alias("end"), F.lower(body).alias("instance"), left.alias("left"), right.alias("right"), kind.alias("kind"))

    mentions = F.transform(_placed(F.get(F.col("b"), F.lit(len(KINDS)))), mention)
    key = F.when(F.col("text").rlike(MENTION[1]), F.md5(F.col("text").cast("binary")))
    return found.select("doc_id", key.alias("text_key"), "base", mentions.alias("mentions"))


def contexts(mentions: DataFrame) -> DataFrame:
    """(pattern, instance, kind) of the graph's edges; a pattern is the two words
    before, the word before, or the words before and after."""
    one, two = F.get("left", F.lit(0)), F.get("left", F.lit(1))
    patterns = F.array_compact(F.array(
        F.concat(F.lit("2:"), two, F.lit(" "), one), F.concat(F.lit("1:"), one), F.when(F.col("right") != "", F.concat(F.lit("b:"), one, F.lit(" _ "), F.col("right")))))
    return mentions.select(F.explode(patterns).alias("pattern"), "instance", "kind").groupBy("pattern", "instance").agg(F.min("kind").alias("kind"))


def bootstrap(edges: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, confidence: float = MIN_CONFIDENCE, accept: float = ACCEPT) -> DataFrame:
    """(instance, kind) that reliable patterns add to the seeds."""
    edges = written(edges, "pii-edges")
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("size"))
    known = edges.filter("kind is not null").groupBy("instance").agg(F.min("kind").alias("kind")).withColumn("score", F.lit(1.0))
    open_edges = edges.filter("kind is null").select("pattern", "instance")
    added = None
    for _ in range(rounds):
        support = edges.select("pattern", "instance").join(known, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("mass"), F.count(F.lit(1)).alias("seeds"))
        good = support.filter(F.col("seeds") >= min_seeds).join(sizes, "pattern").withColumn("trust", F.col("mass") / F.col("size")).filter(F.col("trust") >= confidence)
        scored = open_edges.join(good.select("pattern", "kind", "trust"), "pattern").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(1.0001 - F.col("trust"))))).alias("score"))
        fits = F.lit(False)
        for i, kind in enumerate(KINDS):
            fits = fits | ((F.col("kind") == i) & F.col("instance").rlike(SHAPES[kind]))
        best = scored.filter((F.col("score") >= accept) & fits).groupBy("instance").agg(F.max(F.struct("score", -F.col("kind"), F.col("kind").alias("k"))).alias("b")).select("instance", F.col("b.k").alias("kind"), "b.score")
        if added is not None:
            best = best.join(added.select("instance"), "instance", "left_anti")
        fresh = written(best, "pii-instances")
        if fresh.isEmpty():
            break
        added = fresh if added is None else added.unionByName(fresh)
        known = known.unionByName(fresh)
    return edges.sparkSession.createDataFrame([], "instance string, kind int") if added is None else added.select("instance", "kind")


def personal_data(docs: DataFrame, **options) -> DataFrame:
    """doc_id, base and spans (arrays of kind rank, start, end) of every row.

    Offsets are code points, ends exclusive. ``base`` are the checked patterns'
    spans, kind by kind; ``spans`` adds the strings that the contexts reveal,
    under the kind of their patterns. Null and empty texts have no spans;
    repeated rows get the same spans; an empty table gives no rows. Null
    doc_ids are kept. Text is read once; what is shuffled are mentions."""
    rows = written(base_spans(docs), "pii-rows")
    mentions = rows.filter("size(mentions) > 0").select("text_key", F.explode("mentions").alias("m")).select("text_key", "m.*").dropDuplicates(["text_key", "start"])
    mentions = written(mentions, "pii-mentions")
    added = bootstrap(contexts(mentions), **options).withColumnRenamed("kind", "to_kind")
    hits = mentions.filter("kind is null").join(added, "instance").groupBy("text_key").agg(F.collect_set(F.struct(F.col("to_kind").alias("kind"), "start", "end")).alias("added"))
    plain = rows.filter("text_key is null").select("doc_id", "base", F.col("base").alias("spans"))
    more = rows.filter("text_key is not null").join(hits, "text_key", "left")
    spans = F.when(F.col("added").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "added")))
    return plain.unionByName(more.select("doc_id", "base", spans.alias("spans")))


def listed(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    return personal_data(docs).select("doc_id", *[_count(i) for i in range(len(KINDS))], F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))
