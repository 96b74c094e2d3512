"""Knowledge curation: exploited-vulnerability lists, fix corpora, weakness catalogs
(SRC-06..08, FLT-20..24, JOI-02/03/10, AGR-13..15, RNK-08/12, SET-02/03, SRT-08, TXT-30/33)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions import text as T
from tidewatch.operators.ranking import beside, once, position_in_group, top_n

# Supported weaknesses of curation and of extraction (the lists differ),
# languages, the static fallback list and bounds.
SUPPORTED = ["CWE-89", "CWE-78", "CWE-798", "CWE-22", "CWE-502", "CWE-79", "CWE-327", "CWE-306", "CWE-352", "CWE-434", "CWE-200", "CWE-476"]
EXTRACTED = ["CWE-20", "CWE-22", "CWE-78", "CWE-79", "CWE-89", "CWE-94", "CWE-287", "CWE-352", "CWE-400", "CWE-502", "CWE-798", "CWE-918"]
LANGUAGES = ["python", "javascript", "typescript"]
TOP_25 = [
    "CWE-79", "CWE-787", "CWE-89", "CWE-352", "CWE-22", "CWE-125", "CWE-78", "CWE-416", "CWE-862", "CWE-434", "CWE-94", "CWE-20",
    "CWE-77", "CWE-287", "CWE-269", "CWE-502", "CWE-200", "CWE-863", "CWE-918", "CWE-119", "CWE-476", "CWE-798", "CWE-190", "CWE-400", "CWE-306",
]
PREFERRED_VIEWS = ["1430", "1425"]
MIN_VIEW_MEMBERS = 20
MAX_CONTENT = 4000
PER_STRATUM = 3
MODERATE = (100, 3000)

KEV_SCHEMA = (
    "cveID string, vendorProject string, product string, vulnerabilityName string, dateAdded string, shortDescription string, "
    "requiredAction string, dueDate string, knownRansomwareCampaignUse string, notes string, cwes string"
)


def read_kev(spark: SparkSession, path: str) -> DataFrame:
    """SRC-07: CSV with a header and a declared schema."""
    return spark.read.schema(KEV_SCHEMA).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def finish(content: Column) -> Column:
    """Scrubbed and bounded content; the bound reads the text three times, so it is bound to a name."""
    return F.get(F.transform(F.array(T.scrub_credentials(content)), lambda x: T.ellipsis_trimmed(x, MAX_CONTENT)), 0)


def kev_associations(kev: DataFrame, position: str = "pos") -> DataFrame:
    """FLT-20 / JOI-10: one row per (record, matched weakness) in list order."""
    tokens = F.filter(F.transform(F.split(F.coalesce("cwes", F.lit("")), "[,;]"), lambda t: F.upper(T.strip(t))), lambda t: t.isin(SUPPORTED))
    return kev.withColumn("cve", F.upper(T.strip("cveID"))).filter("cve <> ''").select(
        "cve", position, F.posexplode(tokens).alias("idx", "cwe"))


def kev_by_cve(kev: DataFrame, position: str = "pos") -> DataFrame:
    """AGR-13: one row per CVE: the first matching record's text and the distinct
    weaknesses in order of appearance. A grouped pass per (CVE, weakness) comes
    first, so a CVE is left with at most twelve rows before its list is built."""
    a = kev_associations(kev, position).groupBy("cve", "cwe").agg(F.min(F.struct(position, "idx")).alias("at"))
    lists = a.groupBy("cve").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "cwe"))), lambda s: s["cwe"]).alias("cwes"), F.min(f"at.{position}").alias("first_pos"))
    text = kev.withColumn("cve", F.upper(T.strip("cveID"))).select(
        "cve", F.col(position).alias("first_pos"),
        *[T.strip(F.coalesce(c, F.lit(""))).alias(c) for c in ("vendorProject", "product", "vulnerabilityName", "shortDescription", "requiredAction", "dateAdded", "notes")])
    return lists.join(text, ["cve", "first_pos"])


def kev_documents(kev: DataFrame, position: str = "pos") -> DataFrame:
    """TXT-33: rendered documents."""
    d = kev_by_cve(kev, position)
    lines = F.concat_ws(
        "\n\n",
        F.concat(F.lit("# "), "cve", F.lit(": "), F.coalesce(F.nullif("vulnerabilityName", F.lit("")), "product")),
        T.strip(F.concat(F.lit("**Vendor/Product**: "), "vendorProject", F.lit(" "), "product")),
        F.concat(F.lit("**CWE Associations**: "), F.array_join("cwes", ", ")),
        F.concat(F.lit("**Date Added to KEV**: "), "dateAdded"),
        F.concat(F.lit("**Description**: "), "shortDescription"),
        F.concat(F.lit("**Required Remediation**: "), "requiredAction"),
        F.when(F.col("notes") != "", F.concat(F.lit("**Notes**: "), "notes")),
    )
    d = once(d, "content", finish(lines))
    return d.select(
        F.concat(F.lit("knowledge_cisa_kev_"), "cve").alias("document_id"), "content", F.get("cwes", 0).alias("cwe_id"), F.col("cve").alias("cve_id"),
        "cwes", F.sha2("content", 256).alias("content_hash"))


def kev_statistics(kev: DataFrame) -> DataFrame:
    """AGR-14: record counters and the matched CVE and association counts."""
    has_cve = T.strip(F.coalesce("cveID", F.lit(""))) != ""
    blank = T.strip(F.coalesce("cwes", F.lit(""))) == ""
    tokens = F.transform(F.split(F.coalesce("cwes", F.lit("")), "[,;]"), lambda t: F.upper(T.strip(t)))
    hit = F.exists(tokens, lambda t: t.isin(SUPPORTED))
    rows = kev.agg(
        F.count(F.lit(1)).alias("total_source_records"),
        F.count_if(has_cve & blank).alias("missing_cwe_records"),
        F.count_if(has_cve & ~blank & ~hit).alias("unsupported_cwe_records"))
    a = kev_associations(kev).groupBy("cve", "cwe").agg(F.lit(1).alias("one"))
    per = a.groupBy("cve").agg(F.count(F.lit(1)).alias("n")).agg(
        F.count(F.lit(1)).alias("distinct_matched_cves"), F.coalesce(F.sum("n"), F.lit(0)).alias("matched_cwe_associations"))
    return beside(rows, per)


def normalize_cwe(c: str | Column) -> Column:
    """FLT-21: ``89`` and ``cwe-89`` become ``CWE-89``; anything else is blank."""
    u = F.upper(T.strip(F.coalesce(T.col(c), F.lit(""))))
    return F.when(u.startswith("CWE-"), u).when(u.rlike("^[0-9]+$"), F.concat(F.lit("CWE-"), u)).otherwise("")


def fix_rows(file_change, fixes, commits, cwe_classification, method_change) -> DataFrame:
    """JOI-02: changes joined to fixes, and optionally commits, weaknesses and methods."""
    return (
        file_change.filter("programming_language IS NOT NULL")
        .join(fixes, "hash")
        .join(commits.select("hash", "msg"), "hash", "left")
        .join(cwe_classification, "cve_id", "left")
        .join(method_change.select("file_change_id", F.col("name").alias("method_name"), F.col("code").alias("method_code"), "before_change"),
              "file_change_id", "left")
    )


def fix_documents(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """RNK-12 / FLT-21 / TXT-33: accepted rows by CVE and change, one per (CVE,
    weakness, change, method), numbered in order from 1; ``limit`` keeps the
    first. Deduplication is a grouped minimum; numbers come from counts per
    range of CVE ids, so no task holds all rows."""
    lang = F.lower(T.strip("programming_language"))
    ok = rows.withColumns({"lang": lang, "cwe": normalize_cwe("cwe_id"), "cve": T.text_or(F.upper(T.strip("cve_id")), "CVE-UNKNOWN"),
                           "method": F.coalesce("method_name", F.lit(""))})
    ok = ok.filter(F.col("lang").isin(LANGUAGES) & F.col("cwe").isin(SUPPORTED))
    body = ["lang", "filename", "msg", "code_before", "code_after", "method_name", "method_code", "before_change"]
    first = ok.groupBy("cve", "cwe", "file_change_id", "method").agg(F.min(F.struct("cve_id", "hash", *body)).alias("b"))
    order = ["b.cve_id", "file_change_id", "b.hash", "cwe", "method"]
    top = first if limit is None else first.orderBy(*order).limit(limit)
    top = position_in_group(top, [], F.left(F.coalesce("b.cve_id", F.lit("")), F.lit(10)), [F.col(c) for c in order], "n").withColumn("n", F.col("n") + 1)
    text = lambda c: F.nullif(T.strip(F.col(f"b.{c}")), F.lit(""))
    fence = lambda label, c: F.concat(F.lit(f"```\n// {label}\n"), c, F.lit("\n```"))
    state = F.when(F.lower("b.before_change").isin("true", "1"), "Before Fix").otherwise("After Fix")
    parts = F.concat_ws(
        "\n\n",
        F.concat(F.lit("# Vulnerability Remediation: "), "cve", F.lit(" ("), "cwe", F.lit(")")),
        F.concat(F.lit("**Language**: "), F.initcap("b.lang")),
        F.concat(F.lit("**File**: "), F.coalesce(F.nullif("b.filename", F.lit("")), F.lit("unknown"))),
        F.concat(F.lit("**Commit Message**: "), text("msg")),
        F.when(F.col("method") != "", F.concat(F.lit("**Method**: "), "method")),
        fence("Vulnerable Context", text("code_before")),
        F.coalesce(fence("Fixed Context", text("code_after")),
                   F.concat(F.lit("```\n// Code ("), state, F.lit(")\n"), text("method_code"), F.lit("\n```"))),
    )
    out = once(top, "content", finish(parts))
    return out.select(
        F.concat(F.lit("knowledge_cvefixes_"), "cve", F.lit("_"), "cwe", F.lit("_"), F.col("n").cast("string")).alias("document_id"), "content",
        F.col("cwe").alias("cwe_id"), F.col("cve").alias("cve_id"), F.col("b.lang").alias("language"), F.sha2("content", 256).alias("content_hash"))


def extraction_rows(fixes, cwe_classification, commits, cve, file_change, repository) -> DataFrame:
    """JOI-03 / FLT-22: the six-way join, every text filter applied before it."""
    full = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    fc = file_change.filter(F.lower("programming_language").isin(LANGUAGES) & full("code_before") & full("code_after") & full("diff"))
    return (
        fc.withColumn("language", F.lower("programming_language")).drop("programming_language")
        .join(commits.filter(full("msg")).select("hash", F.col("msg").alias("commit_msg")), "hash")
        .join(fixes, "hash")
        .join(cwe_classification.filter(F.col("cwe_id").isin(EXTRACTED)), "cve_id")
        .join(cve.filter(full("description")).select("cve_id", F.col("description").alias("cve_desc")), "cve_id")
        .join(repository.select("repo_url", "repo_name"), "repo_url", "left")
    )


def prefer_moderate(rows: DataFrame) -> DataFrame:
    """FLT-24: where a stratum has code pairs of moderate length, only those count.
    The flag is a grouped maximum over at most 36 strata."""
    lo, hi = MODERATE
    fit = F.length("code_before").between(lo, hi) & F.length("code_after").between(lo, hi)
    rows = rows.withColumn("moderate", fit)
    flag = rows.groupBy("language", "cwe_id").agg(F.max("moderate").alias("has_moderate"))
    return rows.join(flag, ["language", "cwe_id"]).filter("moderate OR NOT has_moderate").drop("moderate", "has_moderate")


def stratified_pick(rows: DataFrame) -> DataFrame:
    """RNK-08 / AGR-15: up to three rows per (language, weakness), changes and CVEs
    unique over all strata, a second pass relaxing the CVE rule.

    The greedy walk is sequential, but it picks at most 3 x 36 rows, so only a
    bounded head of each stratum can ever matter: a CVE is passed over only when
    taken before, and so is a change. Spark reduces every stratum to that head
    (grouped minima and pre-limited top-n); the walk sees no more than that."""
    picks = PER_STRATUM * len(EXTRACTED) * len(LANGUAGES)
    key = ["language", "cwe_id"]
    one = rows.groupBy(*key, "cve_id", "file_change_id").agg(F.min("hash").alias("hash"))
    per_cve = top_n(one, [*key, "cve_id"], [F.col("hash"), F.col("file_change_id")], picks + 1)
    cves = top_n(per_cve.select(*key, "cve_id").distinct(), key, [F.col("cve_id")], picks + PER_STRATUM)
    first = per_cve.join(cves, [*key, "cve_id"], "left_semi")
    per_change = one.groupBy(*key, "file_change_id").agg(F.min(F.struct("cve_id", "hash")).alias("s")).select(*key, "s.cve_id", "file_change_id", "s.hash")
    relaxed = top_n(per_change, key, [F.col("cve_id"), F.col("hash"), F.col("file_change_id")], picks + PER_STRATUM)
    head = first.unionByName(relaxed.select(*first.columns)).distinct()

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        taken, changes, known = [], set(), set()
        for _, group in pdf.sort_values(["language", "cwe_id", "cve_id", "hash", "file_change_id"]).groupby(["language", "cwe_id"], sort=True):
            count = 0
            for relaxed_pass in (False, True):
                for row in group.itertuples(index=False):
                    if count >= PER_STRATUM:
                        break
                    if row.file_change_id not in changes and (relaxed_pass or row.cve_id not in known):
                        taken.append(row)
                        changes.add(row.file_change_id)
                        known.add(row.cve_id)
                        count += 1
        return pd.DataFrame(taken, columns=pdf.columns)

    return head.groupBy().applyInPandas(walk, head.schema)


def clean_description(c: str | Column) -> Column:
    """TXT-30: the English value of a stringified list of descriptions."""
    raw = T.strip(F.coalesce(T.col(c), F.lit("")))
    schema = "array<struct<lang:string,value:string>>"
    items = F.from_json(raw, schema, {"allowSingleQuotes": "true"})
    english = F.get(F.filter(items, lambda x: (x["lang"] == "en") & (F.coalesce(x["value"], F.lit("")) != "")), 0)["value"]
    found = T.strip(F.coalesce(english, F.get(items, 0)["value"]))
    return F.when(raw.startswith("[") & raw.endswith("]"), F.coalesce(found, raw)).otherwise(raw)


WEAKNESS_SCHEMA = (
    "_ID string, _Name string, Description string, Extended_Description string, "
    "Potential_Mitigations struct<Mitigation:array<struct<Description:string>>>, "
    "Demonstrative_Examples struct<Demonstrative_Example:array<struct<Intro_Text:string,Example_Code:string>>>"
)
VIEW_SCHEMA = "_ID string, _Name string, Members struct<Has_Member:array<struct<_CWE_ID:string>>>"


def read_weaknesses(spark: SparkSession, path: str) -> DataFrame:
    """SRC-06: catalog rows with a pinned schema, nested markup kept as text."""
    return spark.read.format("xml").option("rowTag", "Weakness").schema(WEAKNESS_SCHEMA).load(path)


def read_views(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", "View").schema(VIEW_SCHEMA).load(path)


def clean_markup(c: str | Column) -> Column:
    """Text of an element: tags dropped, lines trimmed and joined by a blank."""
    bare = F.regexp_replace(F.coalesce(T.col(c), F.lit("")), r"<[^>]+>", "")
    lines = F.filter(F.transform(F.split(bare, r"\R"), T.strip), lambda x: x != "")
    return F.array_join(lines, " ")


def top_25(views: DataFrame) -> DataFrame:
    """SET-03: members of the preferred Top-25 view: fixed preference, else the
    highest view number, else the static list."""
    v = views.filter(F.col("_Name").contains("Top 25") & F.col("_Name").contains("CWE")).select(
        F.col("_ID").alias("id"), F.array_distinct(F.transform("Members.Has_Member", lambda m: F.concat(F.lit("CWE-"), m["_CWE_ID"]))).alias("members"))
    v = v.filter(F.size("members") >= MIN_VIEW_MEMBERS)
    rank = F.when(F.col("id") == PREFERRED_VIEWS[0], F.lit(2)).when(F.col("id") == PREFERRED_VIEWS[1], 1).otherwise(0)
    best = v.agg(F.max_by("members", F.struct(rank.alias("r"), F.coalesce(F.col("id").try_cast("long"), F.lit(0)).alias("n"))).alias("m"))
    return best.select(F.explode(F.coalesce("m", F.array(*[F.lit(x) for x in TOP_25]))).alias("cwe_id"))


def weakness_documents(weaknesses: DataFrame, views: DataFrame, position: str) -> DataFrame:
    """FLT-23 / SET-02 / SRT-08: documents of the supported and Top-25 weaknesses,
    the first catalog entry of each, in numeric order."""
    spark = weaknesses.sparkSession
    top = top_25(views)
    supported = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in SUPPORTED])).alias("cwe_id"))
    target = supported.unionByName(top).distinct()
    w = weaknesses.withColumn("cwe_id", F.concat(F.lit("CWE-"), T.strip("_ID"))).join(F.broadcast(target), "cwe_id", "left_semi")
    cols = [c for c in w.columns if c not in ("cwe_id", position)]
    first = w.groupBy("cwe_id").agg(F.min_by(F.struct(*cols), position).alias("w")).select("cwe_id", "w.*")
    mit = F.filter(F.transform(F.coalesce("Potential_Mitigations.Mitigation", F.array()), lambda m: clean_markup(m["Description"])), lambda x: x != "")
    ex = F.filter(F.transform(F.coalesce("Demonstrative_Examples.Demonstrative_Example", F.array()), lambda e: T.strip(
        F.concat(clean_markup(e["Intro_Text"]), F.lit("\n"), clean_markup(e["Example_Code"])))), lambda x: x != "")
    title = F.concat("cwe_id", F.lit(": "), T.strip("_Name"))
    detail = F.nullif(clean_markup("Extended_Description"), F.lit(""))
    content = F.concat_ws(
        "\n\n", F.concat(F.lit("# "), title), F.concat(F.lit("**Description**: "), clean_markup("Description")), F.concat(F.lit("**Details**: "), detail),
        F.when(F.size(mit) > 0, F.concat(F.lit("**Mitigations**:\n"), F.array_join(F.transform(F.slice(mit, 1, 3), lambda m: F.concat(F.lit("- "), m)), "\n"))),
        F.when(F.size(ex) > 0, F.concat(F.lit("**Example**:\n"), F.get(ex, 0))))
    out = once(first, "content", finish(content)).join(F.broadcast(top.withColumn("is_top_25", F.lit(True))), "cwe_id", "left")
    return out.select(
        F.concat(F.lit("knowledge_mitre_cwe_"), "cwe_id").alias("document_id"), "cwe_id", title.alias("title"), "content",
        F.coalesce("is_top_25", F.lit(False)).alias("is_top_25"), F.col("cwe_id").isin(SUPPORTED).alias("is_supported"),
        F.sha2("content", 256).alias("content_hash")).orderBy(F.split_part("cwe_id", F.lit("-"), F.lit(2)).cast("int"))


def valid_metadata() -> Column:
    """Allow-listed metadata of curated documents; severity must stay empty."""
    return (
        F.col("source").isin("mitre_cwe", "cisa_kev", "cvefixes") & F.col("cwe_id").startswith("CWE-") & F.col("language").isin(LANGUAGES)
        & F.col("doc_type").isin("reference", "threat_intel", "remediation_example") & F.col("severity").isNull())
