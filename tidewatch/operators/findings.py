"""Finding rows: normalize, ground, merge, rank, cap, gate (PRJ-01..06, FLT-15..18,
AGR-08/09/12, RNK-01/02, SRT-06, JOI-08/16).

A finding carries its primary evidence as flat columns; further evidence lives
in rows of its own, keyed by the finding. No operator gathers the evidence of a
group into one array, so a finding merged from a third of all rows is no hot spot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions import text as T
from tidewatch.operators.ranking import join_same, top_n

# Severities and confidences with their ranks, and the report cap.
SEVERITY_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1, "unknown": 0}
CONFIDENCE_RANK = {"high": 2, "medium": 1, "low": 0}
MAX_FINDINGS = 20
MAX_DESCRIPTION = 2000

# Titles of the signal types that become findings.
SIGNAL_TITLES = {
    "unsafe_database_execution": "Potential SQL Injection Vulnerability",
    "command_execution_call": "Command Injection Risk",
    "dynamic_code_execution": "Arbitrary Dynamic Code Execution Risk",
    "possible_hardcoded_secret": "Possible Hardcoded Secret Detected",
    "credential_propagation_to_authorization_sink": "Credential Propagation to Authorization Header",
    "path_traversal_call": "Potential Path Traversal / Unsafe File Access",
    "insecure_deserialization_call": "Insecure Deserialization Risk",
    "dom_xss_call": "Cross-Site Scripting (DOM XSS) Vulnerability",
    "reflected_xss_call": "Reflected Cross-Site Scripting (XSS) Vulnerability",
}
# Display category of each evidence category.
CATEGORY_NAMES = {
    "sql_injection": "Injection",
    "command_execution": "Injection",
    "dynamic_code_execution": "Code Execution",
    "credential_management": "Credential Management",
    "credential_handling": "Credential Management",
    "path_traversal": "File Security",
    "insecure_deserialization": "Deserialization",
    "xss": "Cross-Site Scripting",
}
# Retrieval topic of each signal type.
SIGNAL_TOPICS = {
    "unsafe_database_execution": "sql_injection",
    "database_execution_call": "sql_injection",
    "string_construction": "sql_injection",
    "command_execution_call": "command_execution",
    "dynamic_code_execution": "dynamic_code_execution",
    "dynamic_execution_call": "dynamic_code_execution",
    "possible_hardcoded_secret": "credential_handling",
    "credential_propagation_to_authorization_sink": "credential_handling",
    "weak_cryptography": "weak_cryptography",
    "weak_crypto_call": "weak_cryptography",
    "weak_hash_call": "weak_cryptography",
    "weak_cipher_call": "weak_cryptography",
    "insecure_deserialization": "deserialization",
    "insecure_deserialization_call": "deserialization",
    "path_traversal": "path_traversal",
    "path_traversal_call": "path_traversal",
    "cross_site_scripting": "xss",
    "dom_xss_call": "xss",
    "reflected_xss_call": "xss",
    "missing_authentication": "authentication",
    "cross_site_request_forgery": "csrf",
    "unrestricted_file_upload": "file_upload",
    "sensitive_data_exposure": "sensitive_data_exposure",
    "null_pointer_dereference": "null_reference",
}
# Weakness id of each signal type.
SIGNAL_CWES = {
    "unsafe_database_execution": "CWE-89",
    "database_execution_call": "CWE-89",
    "command_execution_call": "CWE-78",
    "possible_hardcoded_secret": "CWE-798",
    "credential_propagation_to_authorization_sink": "CWE-798",
    "path_traversal_call": "CWE-22",
    "path_traversal": "CWE-22",
    "insecure_deserialization_call": "CWE-502",
    "insecure_deserialization": "CWE-502",
    "dom_xss_call": "CWE-79",
    "reflected_xss_call": "CWE-79",
    "cross_site_scripting": "CWE-79",
    "weak_cryptography": "CWE-327",
    "weak_crypto_call": "CWE-327",
    "weak_hash_call": "CWE-327",
    "weak_cipher_call": "CWE-327",
    "missing_authentication": "CWE-306",
    "cross_site_request_forgery": "CWE-352",
    "unrestricted_file_upload": "CWE-434",
    "sensitive_data_exposure": "CWE-200",
    "null_pointer_dereference": "CWE-476",
}
RECOMMENDATION = "Review this security-sensitive operation and avoid untrusted dynamic input."


def lookup(c: str | Column, table: dict[str, object]) -> Column:
    """JOI-16: small fixed table as a literal map; NULL where absent."""
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.try_element_at(m, T.col(c))


def severity_rank(c: str | Column = "severity") -> Column:
    return F.coalesce(lookup(c, SEVERITY_RANK), F.lit(0))


def confidence_rank(c: str | Column = "confidence") -> Column:
    return F.coalesce(lookup(c, CONFIDENCE_RANK), F.lit(0))


def _name(rank: str | Column, ranks: dict[str, int]) -> Column:
    return lookup(rank, {v: k for k, v in ranks.items()})


def clamp_severity(c: str | Column) -> Column:
    """FLT-17: unknown names become 'unknown' ('info' is one of them)."""
    s = F.lower(T.strip(c))
    return F.when(s.isin(list(SEVERITY_RANK)), s).otherwise("unknown")


def clamp_confidence(c: str | Column) -> Column:
    s = F.lower(T.strip(c))
    return F.when(s.isin(list(CONFIDENCE_RANK)), s).otherwise("low")


def evidence_to_findings(evidence: DataFrame) -> DataFrame:
    """PRJ-06 / FLT-15 / JOI-16: one finding per actionable evidence row."""
    keep = evidence.filter(F.col("signal_type").isin(list(SIGNAL_TITLES)) & (F.length("evidence_id") > 0))
    known = {**CATEGORY_NAMES, **{v: v for v in CATEGORY_NAMES.values()}}
    return keep.withColumns({
        "title": lookup("signal_type", SIGNAL_TITLES),
        "description": F.coalesce("message", F.lit("Security-relevant AST evidence detected.")),
        "severity": F.coalesce("severity", F.lit("medium")),
        "confidence": F.coalesce("confidence", F.lit("medium")),
        "category": F.coalesce(lookup("category", known), F.lit("General Security")),
        "document_id": F.col("evidence_id"),
        "line_start": F.col("line"),
        "line_end": F.coalesce(F.nullif("line_end", F.lit(0)), "line"),
        "signal_name": F.coalesce(F.nullif("signal_name", F.lit("")), F.lit("unknown")),
        "recommendation": F.lit(RECOMMENDATION),
    })


def normalize_findings(findings: DataFrame) -> DataFrame:
    """PRJ-05 / FLT-17: trimmed, masked, bounded and clamped text columns;
    rows without an evidence document are dropped."""
    clean = lambda c, default: T.text_or(T.strip(T.mask_secret(T.text_or(c, default))), default)
    doc = T.strip(F.coalesce("document_id", F.lit("")))
    return findings.filter(doc != "").withColumns({
        "document_id": doc,
        "title": clean("title", "Security Finding"),
        "category": clean("category", "General Security"),
        "description": T.truncate(T.strip(T.mask_secret("description")), MAX_DESCRIPTION),
        "severity": clamp_severity("severity"),
        "confidence": clamp_confidence("confidence"),
        "signal_type": T.strip(T.text_or("signal_type", "unknown")),
        "signal_name": T.strip(T.text_or("signal_name", "unknown")),
    })


def ground(findings: DataFrame, valid_documents: DataFrame) -> DataFrame:
    """FLT-16 / JOI-08: keep findings whose evidence document is known."""
    return findings.join(valid_documents.select("document_id"), "document_id", "left_semi")


def identity(evidence_id: str = "evidence_id") -> Column:
    """Merge identity as one text: the evidence id alone when there is one, else
    category, title, document and signal."""
    eid = F.nullif(T.strip(F.coalesce(evidence_id, F.lit(""))), F.lit(""))
    other = F.concat_ws(
        "\x1f", F.lower(T.strip("category")), F.lower(T.strip("title")), F.coalesce("document_id", F.lit("")),
        F.coalesce("signal_type", F.lit("")), F.coalesce("signal_name", F.lit("")))
    return F.coalesce(F.concat(F.lit("E"), eid), other).alias("identity")


EVIDENCE = ["document_id", "line_start", "line_end", "signal_type", "signal_name"]


def _identity_name(scope: Sequence[str]) -> Column:
    """128-bit name of scope and identity, NULL told apart from any text. Groups
    and joins send it instead of the texts, and it is never NULL."""
    marked = [F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in scope]
    return F.unhex(F.md5(F.concat(*marked, identity()))).alias("_name")


HEAD = ["title", "description", "category", "file_path", "line", *EVIDENCE]


def merge_findings(
    findings: DataFrame, scope: Sequence[str], position: Sequence[str], fields: Sequence[str] | None = None, by_document: Sequence[str] | None = None
) -> DataFrame:
    """AGR-08: one row per identity. Severity and confidence are the strongest
    seen, every other field comes from the first row by ``position``. All are
    grouped maxima and minima, so partial aggregation always runs before the
    shuffle. Each text travels once: the name of scope and identity is the key,
    and the first row is the least struct of the position, then other fields.
    ``fields`` names those that are wanted where not all (and the identity) are;
    Spark cannot drop them from the struct by itself.

    ``by_document`` is for findings whose evidence id is empty or stands for the
    document, and names columns that are one for all rows of a document. They
    join the key, so rows that already lie hashed by them merge where they are.
    Equal documents then lie together, too, and the position goes along only
    where a scope holds several findings on one document: elsewhere nothing ties
    on all that ``finding_order`` reads before it."""
    whole, head = fields is None, HEAD if fields is None else list(fields)
    fixed = [] if by_document is None else list(dict.fromkeys([*by_document, "document_id"]))
    row = [c for c in dict.fromkeys([*position, *head, *(["evidence_id", *HEAD] if whole else [])]) if c not in fixed]
    keyed = findings.select(
        *scope, *[c for c in fixed if c not in scope], _identity_name(scope), severity_rank().alias("_s"), confidence_rank().alias("_c"), F.struct(*row).alias("_row"))
    strongest = [F.max("_s").alias("_sev"), F.max("_c").alias("_conf"), F.count(F.lit(1)).alias("merged_rows"), F.min("_row").alias("_row")]
    place = [c for c in position if c not in fixed]
    first = F.struct(*[F.col(f"_row.{c}").alias(c) for c in place]) if place else F.lit(None)
    if fixed:
        keys = [*scope, *[c for c in fixed if c not in scope]]
        out = keyed.groupBy(*keys, "_name").agg(*strongest)
        first = F.when(F.count(F.lit(1)).over(Window.partitionBy(*keys)) > 1, first)
    else:
        keys = list(scope)
        out = keyed.groupBy("_name").agg(*[F.min(c).alias(c) for c in scope], *strongest)
    of = lambda c: F.col(f"_row.{c}").alias(c)
    flat = out.select("_name", *keys, "_sev", "_conf", "merged_rows", first.alias("_first"), *[of(c) for c in row if c not in keys])
    return flat.select(
        *keys, *([identity()] if whole else []), *[c for c in head if c not in keys], "_first", _name(F.col("_sev"), SEVERITY_RANK).alias("severity"),
        _name(F.col("_conf"), CONFIDENCE_RANK).alias("confidence"), "merged_rows", "_name")


def with_evidence_count(merged: DataFrame, findings: DataFrame, scope: Sequence[str], by_document: Sequence[str] | None = None) -> DataFrame:
    """Number of distinct evidence items of every merged finding, counted by two
    grouped passes and joined back on the key of the merge. ``by_document`` is
    that of the merge, without NULL."""
    key = [*(by_document or []), "_name"]
    items = findings.select(*[c for c in key if c not in ("_name", *EVIDENCE)], _identity_name(scope), *EVIDENCE).distinct()
    n = items.groupBy(*key).agg(F.count(F.lit(1)).alias("evidence_count"))
    return merged.join(n, key).drop("_name")


def merged_evidence(findings: DataFrame, scope: Sequence[str], position: Sequence[str]) -> DataFrame:
    """AGR-08, evidence side: distinct evidence per merged finding as rows, with
    the position at which each was first seen."""
    keyed = findings.select("*", identity())
    return keyed.groupBy(*scope, "identity", *EVIDENCE).agg(F.min(F.struct(*position)).alias("first_seen"))


def finding_order(severity: str | Column | None = None, confidence: str | Column | None = None) -> list[Column]:
    """SRT-06, then first appearance; by the ranks given, or those of the names."""
    return [
        F.desc(severity_rank() if severity is None else severity), F.desc(confidence_rank() if confidence is None else confidence),
        F.col("category"), F.col("title"), F.col("document_id"), F.col("_first"),
    ]


def rank_findings(merged: DataFrame, scope: Sequence[str], cap: int = MAX_FINDINGS, counted: bool = False) -> DataFrame:
    """RNK-02: strongest ``cap`` findings per report, numbered ``finding_1..``.
    ``counted`` adds what the cap hides: ``total_before_cap`` and, for a gate
    that sees every finding, ``gate_before_cap``, from a grouped count."""
    # merged findings are named after their ranks: these travel, the names are put back
    ranks = merged.withColumns({"severity": severity_rank(), "confidence": confidence_rank()})
    top = top_n(ranks, list(scope), finding_order("severity", "confidence"), cap, rank="rank")
    top = top.withColumns({"severity": _name("severity", SEVERITY_RANK), "confidence": _name("confidence", CONFIDENCE_RANK)})
    if counted:
        sev = F.col("severity")
        whole = merged.groupBy(*scope).agg(F.count(F.lit(1)).alias("total_before_cap"), F.count_if(sev == "critical").alias("_c"), F.count_if(sev == "high").alias("_h"), F.count_if(sev == "medium").alias("_m"))
        top = join_same(top, whole.withColumn("gate_before_cap", gate("_c", "_h", "_m")).drop("_c", "_h", "_m"), list(scope))
    return top.withColumn("finding_id", F.concat(F.lit("finding_"), F.col("rank").cast("string")))


def gate(critical: str = "critical_count", high: str = "high_count", medium: str = "medium_count") -> Column:
    """AGR-12: block, review or allow."""
    return F.when((F.col(critical) > 0) | (F.col(high) > 0), "block").when(F.col(medium) > 0, "review").otherwise("allow")


def report_rows(ranked: DataFrame, scope: Sequence[str]) -> DataFrame:
    """PRJ-12 / AGR-09: one report per scope with recounted severities (any
    severity outside the four counts as info) and the gate decision. The nested
    list holds at most the capped number of findings, with the fields there are."""
    sev = F.col("severity")
    four = ["critical", "high", "medium", "low"]
    item = F.struct(*[c for c in (
        "rank", "finding_id", "title", "description", "severity", "confidence", "category", "file_path", "line",
        "document_id", "line_start", "signal_type", "signal_name") if c in ranked.columns])
    out = ranked.groupBy(*scope).agg(
        F.count(F.lit(1)).alias("total_findings"),
        *[F.count_if(sev == s).alias(f"{s}_count") for s in four],
        F.count_if(~sev.isin(four)).alias("info_count"),
        F.array_sort(F.collect_list(item)).alias("findings"),
    )
    return out.withColumn("review_status", gate())


def gate_evaluation(reports: DataFrame) -> DataFrame:
    """AGR-12 over stored reports: decision, exit code and message. Missing or
    negative counters, unknown states and a declared status that contradicts the
    counters are INVALID."""
    counters = ["critical_count", "high_count", "medium_count", "low_count", "info_count"]
    bad = ~F.coalesce(F.col("status").isin("success", "completed"), F.lit(False))
    bad = bad | ~F.coalesce(F.col("review_status").isin("allow", "review", "block"), F.lit(False))
    for c in counters:
        bad = bad | F.col(c).isNull() | (F.col(c) < 0)
    computed = gate()
    decision = F.when(bad | (F.col("review_status") != computed), "INVALID").otherwise(F.upper(computed))
    code = F.when(decision.isin("INVALID", "BLOCK"), 1).when(decision == "REVIEW", 2).otherwise(0)
    return reports.withColumns({"decision": decision, "exit_code": code})


def sanitize_records(findings: DataFrame) -> DataFrame:
    """PRJ-04: persisted form — defaults, lower-cased enums, evidence whitelist."""
    ev = lambda e: F.struct(
        F.coalesce(e["document_id"], F.lit("")).alias("document_id"),
        e["line_start"].alias("line_start"),
        e["line_end"].alias("line_end"),
        F.coalesce(e["signal_type"], F.lit("unknown")).alias("signal_type"),
        F.coalesce(e["signal_name"], F.lit("unknown")).alias("signal_name"),
        e["scope"].alias("scope"),
        e["call_name"].alias("call_name"),
        e["occurrence_index"].alias("occurrence_index"),
    )
    return findings.select(
        "analysis_id",
        F.coalesce("finding_id", F.lit("")).alias("finding_id"),
        F.coalesce("title", F.lit("Security Finding")).alias("title"),
        F.coalesce("description", F.lit("")).alias("description"),
        F.lower(F.coalesce("severity", F.lit("unknown"))).alias("severity"),
        F.lower(F.coalesce("confidence", F.lit("low"))).alias("confidence"),
        F.coalesce("category", F.lit("General Security")).alias("category"),
        F.transform("evidence", ev).alias("evidence"),
    )


def identity_projection(raw: DataFrame) -> DataFrame:
    """PRJ-01..03: identity columns taken from the record, then its repository
    struct, then its summary; author bounded to 100 characters."""
    pick = lambda *cs: F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cs])
    return raw.select(
        "analysis_id",
        pick("owner", "repository_info.owner", "summary.owner").alias("owner"),
        pick("repository", "repository_info.repository", "summary.repository").alias("repository"),
        F.left(T.strip(pick("author", "repository_info.author", "summary.author")), F.lit(100)).alias("author"),
        F.coalesce("summary.total_findings", F.lit(0)).alias("finding_count"),
    )


def structured_query(findings: DataFrame) -> DataFrame:
    """TXT-27: retrieval query of a finding — weakness id, topic, category, eight
    title words and a severity hint, words deduplicated without regard to case
    in order of appearance."""
    cwe = F.coalesce(F.nullif(T.strip("cwe_id"), F.lit("")), lookup(T.strip("signal_type"), SIGNAL_CWES))
    sig = T.strip(F.coalesce("signal_type", F.lit("")))
    topic = F.coalesce(lookup(sig, SIGNAL_TOPICS), F.when((sig != "") & (sig != "unknown"), sig))
    cat = T.strip(F.coalesce("category", F.lit("")))
    cat = F.when(~F.lower(cat).isin("general security", "unknown", ""), cat)
    words = F.array_join(F.slice(F.regexp_extract_all(F.coalesce("title", F.lit("")), F.lit(r"[a-zA-Z0-9_\-]+"), F.lit(0)), 1, 8), " ")
    sev = F.lower("severity")
    hint = F.when(sev.isin("critical", "high"), F.concat(sev, F.lit(" severity")))
    text = F.concat_ws(" ", cwe, topic, cat, words, hint)
    parts = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    first = F.filter(parts, lambda w, i: F.array_position(F.transform(parts, F.lower), F.lower(w)) == i + 1)
    return findings.withColumn("query", T.text_or(F.array_join(first, " "), "general_security"))


def mock_provider(evidence: DataFrame) -> DataFrame:
    """UDF-02: deterministic stand-in for a model: one finding per known signal."""
    return evidence_to_findings(evidence)


def clamp_provider_output(findings: DataFrame, valid_documents: DataFrame, scope: Sequence[str], order: Sequence[Column], cap: int = MAX_FINDINGS) -> DataFrame:
    """UDF-03: clamp, ground, number and cap what a provider returned. Unknown
    severities are not counted as info on this path."""
    rows = ground(normalize_findings(findings), valid_documents)
    top = top_n(rows, list(scope), order, cap, rank="rank")
    return top.groupBy(*scope).agg(
        F.count(F.lit(1)).alias("total_findings"),
        *[F.count_if(F.col("severity") == s).alias(f"{s}_count") for s in ("critical", "high", "medium", "low", "info")],
    )


def restore_authoritative(original: DataFrame, answered: DataFrame, key: Sequence[str]) -> DataFrame:
    """UDF-01: after a provider answered, the five authoritative columns come
    back from the original rows; everything else is kept from the answer."""
    keep = ["title", "severity", "document_id", "finding_id", "category"]
    keep = [c for c in keep if c in original.columns and c not in key]
    return answered.drop(*keep).join(original.select(*key, *keep), list(key))


def explain_with(df: DataFrame, provider, schema: str) -> DataFrame:
    """UDF-01: pluggable provider hook; ``provider`` maps Arrow batches of
    findings to batches of answers."""
    return df.mapInPandas(provider, schema)
