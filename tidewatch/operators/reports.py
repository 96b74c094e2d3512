"""Report rendering (SNK-08..12, TXT-28/29/36, AGR-30, PRJ-13/17/18, SRC-15/21).

Reports are rows of ``findings.report_rows``: counters, a decision and a list of at
most twenty findings. ``product`` is the name shown to readers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import text as T
from tidewatch.operators.findings import lookup
from tidewatch.operators.ranking import once

MARKER = "<!-- security-analysis -->"
# Decision texts and states.
CI_LABEL = {"allow": "ALLOW / Safe to Merge", "review": "REVIEW / Manual Review Required", "block": "BLOCK / Do Not Merge"}
CI_ADVICE = {
    "allow": "Safe to merge. No critical, high, or medium security vulnerabilities were detected.",
    "review": "Manual security review required. Medium severity findings require security review before merging.",
    "block": "Do not merge. High or critical severity security findings were detected. Remediate findings before merging.",
}
COMMENT_LABEL = {"allow": "PASSED / Safe to Merge", "block": "BLOCKED / Do Not Merge", "review": "REVIEW NEEDED / Manual Review Required"}
COMMENT_ACTION = {
    "allow": "No blocking security vulnerabilities detected. Code is safe to merge.",
    "block": "High or critical severity security vulnerabilities were detected. Remediate findings before merging.",
    "review": "Security findings require manual review by a security reviewer before proceeding.",
}
CHECK_CONCLUSION = {"allow": "success", "block": "failure", "review": "action_required", "invalid": "failure"}
COMMIT_STATE = {"allow": "success", "block": "failure", "review": "pending", "invalid": "failure"}
REVIEW_EVENT = {"allow": "APPROVE", "block": "REQUEST_CHANGES", "review": "COMMENT"}
GATE_ICON = {"block": "🔴", "review": "🟡", "allow": "✅"}
GATE_LABEL = {"block": "BLOCKED", "review": "REVIEW REQUIRED", "allow": "PASSED"}
GATE_ACTION = {
    "block": "High or critical severity security vulnerabilities detected.",
    "review": "Manual security review required before merging.",
    "allow": "No blocking security vulnerabilities detected.",
}
SEVERITY_ICON = {"critical": "🔴", "high": "🟠", "medium": "🟡", "low": "🟢", "info": "⚪"}


def _n(c: str) -> Column:
    return F.col(c).cast("string")


def _cat(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def decision(table: dict[str, str], default: str | None = None, status: str = "review_status") -> Column:
    """TXT-36."""
    v = lookup(F.lower(status), table)
    return F.coalesce(v, F.lit(default)) if default is not None else v


def review_event(mode: str = "comment", status: str = "review_status") -> Column:
    """Review event of a decision; only 'enforce' mode ever approves or rejects."""
    return decision(REVIEW_EVENT, "COMMENT", status) if mode.strip().lower() == "enforce" else F.lit("COMMENT")


def key_findings(limit: int = 10) -> Column:
    """Numbered finding lines with the number of those left out (AGR-30)."""
    line = lambda f, i: _cat((i + 1).cast("string"), ". **[", F.upper(f["severity"]), "]** `", f["finding_id"], "` — ", T.strip(f["title"]))
    return F.transform(F.slice("findings", 1, limit), line)


def overflow(limit: int, before: str, after: str) -> Column:
    return F.when(F.size("findings") > limit, _cat(before, (F.size("findings") - limit).cast("string"), after))


def ci_summary(reports: DataFrame, product: str, branch: str = "main") -> DataFrame:
    """SNK-09: Markdown summary of a report."""
    sev = [_cat(f"- **{s.title()}**: `", _n(f"{s}_count"), "`") for s in ("critical", "high", "medium", "low", "info")]
    head = F.array(
        F.lit(MARKER), F.lit(f"## {product} Security Analysis"), _cat("- **Repository**: `", F.col("repository_id"), "`"),
        F.lit(f"- **Branch**: `{branch}`"), _cat("- **Analysis ID**: `", _n("analysis_id"), "`"), F.lit(""),
        _cat("### Security Decision: `", decision(CI_LABEL, CI_LABEL["allow"]), "`"), F.lit(""), F.lit("### Severity Summary"),
        _cat("- **Total Findings**: `", _n("total_findings"), "`"), *sev, F.lit(""), F.lit("### Recommended Action"),
        decision(CI_ADVICE, "Review security findings before merging."), F.lit(""))
    more = F.array_compact(F.array(overflow(10, "\n*...and ", " additional findings.*")))
    body = F.when(F.size("findings") > 0, F.concat(F.array(F.lit("### Key Security Findings")), key_findings(), more, F.array(F.lit("")))).otherwise(
        F.array().cast("array<string>"))
    tail = F.array(F.lit("---"), F.lit(f"*Automated DevSecOps Security Audit generated by {product}.*"))
    return reports.withColumn("markdown", F.array_join(F.concat(head, body, tail), "\n"))


def pr_comment(reports: DataFrame, product: str) -> DataFrame:
    """SNK-10: pull request comment with a commit marker."""
    sha = F.lower(T.strip(F.coalesce("head_sha", F.lit(""))))
    mark = F.when(F.length(sha) == 40, _cat("<!-- head-sha:", sha, " -->\n")).otherwise("")
    text = _cat(
        MARKER, "\n", mark, f"## {product} Security Analysis for **", F.col("repository_id"), "** (PR #", _n("pr_number"), ")\n\n",
        "**Security Gate Verdict**: `", decision(COMMENT_LABEL, COMMENT_LABEL["allow"]), "`\n\n### Summary Telemetry\n- **Analyzed Files**: ", _n("analyzed_files"),
        "\n- **Total Security Findings**: ", _n("total_findings"), "\n- **Critical Severity**: `", _n("critical_count"), "`\n- **High Severity**: `", _n("high_count"),
        "`\n- **Medium Severity**: `", _n("medium_count"), "`\n- **Low Severity**: `", _n("low_count"), "`\n- **Info**: `", _n("info_count"), "`\n\n",
        F.when(F.size("findings") > 0, _cat("### Key Findings\n\n", F.array_join(key_findings(), "\n"), "\n",
                                            F.coalesce(overflow(10, "\n*...and ", " additional findings.*"), F.lit("")), "\n\n")).otherwise(""),
        "### Recommended Next Action\n", decision(COMMENT_ACTION, "Review security findings before merging."), "\n\n---  \n",
        f"*Automated DevSecOps Security Audit generated by {product}.*")
    return reports.withColumn("comment", text)


def check_run(reports: DataFrame, product: str) -> DataFrame:
    """SNK-11: check-run payload and commit status as JSON."""
    verdict = F.upper("review_status")
    summary = _cat(
        "**Review Verdict**: `", verdict, "`\n\n**Telemetry Summary**:\n- Analyzed Files: ", _n("analyzed_files"), "\n- Total Findings: ", _n("total_findings"),
        *[x for s in ("critical", "high", "medium", "low", "info") for x in (f"\n- {s.title()}: ", _n(f"{s}_count"))], "\n")
    line = lambda f: _cat("- **[", F.upper(f["severity"]), "]** `", f["finding_id"], "`: ", f["title"], "\n")
    text = F.when(F.size("findings") > 0, _cat(
        "### Finding Summary\n\n", F.array_join(F.transform(F.slice("findings", 1, 10), line), ""),
        F.coalesce(overflow(10, "\n*...and ", " additional findings.*"), F.lit("")))).otherwise("")
    payload = F.to_json(F.struct(
        F.lit(f"{product} Security Analysis").alias("name"), F.lit("completed").alias("status"),
        F.struct(_cat(f"{product} Security Audit: ", verdict).alias("title"), summary.alias("summary"), text.alias("text")).alias("output"),
        decision(CHECK_CONCLUSION).alias("conclusion")))
    words = _cat(f"{product}: ", verdict, " (", _n("critical_count"), " Critical, ", _n("high_count"), " High, ", _n("medium_count"), " Medium)")
    status = F.to_json(F.struct(decision(COMMIT_STATE).alias("state"), F.lit("security/gate").alias("context"), T.ellipsis(words, 140).alias("description")))
    return reports.withColumns({"check_run": payload, "commit_status": status})


def notification(reports: DataFrame, product: str) -> DataFrame:
    """SNK-12: bounded chat message: five findings, escaped and truncated fields."""
    clean = lambda c, n: T.escape_markup(T.scrub_vendor_tokens(T.ellipsis(c, n)))
    line = lambda f: _cat("• ", F.coalesce(lookup(F.lower(f["severity"]), SEVERITY_ICON), F.lit("⚪")), " *", clean(f["title"], 120), "* — `",
                          clean(f["document_id"], 80), ":", F.coalesce(f["line_start"].cast("string"), F.lit("?")), "`")
    lines = F.concat(F.transform(F.slice("findings", 1, 5), line), F.array_compact(F.array(overflow(5, "• ... and ", " more findings"))))
    text = F.when(F.size("findings") > 0, F.array_join(lines, "\n")).otherwise("✅ No vulnerabilities detected")
    rows = once(reports, "findings_text", F.when(F.length(text) > 1000, _cat(F.substring(text, 1, 985), "\n• ... [truncated]")).otherwise(text))
    title = _cat(decision(GATE_ICON, "⚪"), f" {product} Security Gate: ", decision(GATE_LABEL, "UNKNOWN"), " — PR #", _n("pr_number"), " (", clean("repository_id", 100), ")")
    return rows.withColumns({"headline": title, "action": T.escape_markup(decision(GATE_ACTION, "Security analysis completed."))})


def traceability(stats: DataFrame) -> DataFrame:
    """PRJ-13: counters clamped at zero, duration rounded to two digits."""
    clamp = {c: F.greatest(F.lit(0), F.coalesce(c, F.lit(0))) for c in ("files_considered", "files_analyzed", "files_excluded", "cache_hits", "cache_misses")}
    return stats.withColumns({**clamp, "duration_ms": F.bround(F.greatest(F.lit(0.0), F.coalesce("duration_ms", F.lit(0.0))), 2),
                              "analysis_mode": F.when(F.col("is_incremental"), "incremental").otherwise("full")})


def resolve_cwe(direct: str | Column, signal: str | Column, table: dict[str, str]) -> Column:
    """PRJ-17: explicit weakness id, numeric ones completed, else the signal's."""
    from tidewatch.operators.curation import normalize_cwe

    return F.coalesce(F.nullif(normalize_cwe(direct), F.lit("")), lookup(signal, table))


# Explanation families: title words, weakness id, why it matters, how it is attacked, what to do, a safer form.
FAMILIES = [
    (["sql injection"], "CWE-89",
     "The statement text is put together from values a caller controls, so a caller can change what the database is asked to do and read or alter rows that are none of their business.",
     "A caller closes the quoted value early and appends a condition that is always true, or a second statement, and the database runs it as part of the query.",
     "Keep the statement constant and hand values over as bound parameters. Where names of tables or columns vary, choose them from a fixed list.",
     "db.execute('SELECT name FROM item WHERE id = ?', (item_id,))"),
    (["command injection"], "CWE-78",
     "A shell interprets the command text. Whoever controls a part of that text can start further programs with the rights of this process.",
     "A value that holds a shell separator ends the intended command and starts another one chosen by the caller.",
     "Start the program directly with a list of arguments and without a shell. Check arguments against the values that are expected.",
     "subprocess.run(['tar', '-tf', archive], check=True)"),
    (["path traversal"], "CWE-22",
     "The file name comes from outside, so it can point to any place the process may read or write, not only to the folder that was meant.",
     "A name with parent-folder steps, or an absolute one, leads out of the folder to settings, keys or program code.",
     "Resolve the full path first and refuse it unless it lies below the intended folder. Better still, look names up in a table of known files.",
     "target = (root / name).resolve()\nif not target.is_relative_to(root.resolve()):\n    raise PermissionError(name)"),
    (["deserialization", "pickle"], "CWE-502",
     "The format can name code to be run while objects are rebuilt, so reading bytes of unknown origin is running code of unknown origin.",
     "The sender prepares bytes whose rebuilding calls a function of their choice as soon as they are loaded.",
     "Exchange plain data in a format without code, and check it against a schema. Load object formats only from files this program wrote and signed itself.",
     "record = json.loads(body)"),
    (["secret", "credential"], "CWE-798",
     "A secret in the source is known to everybody who can read a copy of it, stays in the history after it is removed and cannot be changed without a release.",
     "Somebody with read access to the repository, a backup or a build log takes the value and signs in with it.",
     "Take the value out, replace it at the service it belongs to, and read the new one from the environment or a secret store when the program starts.",
     "token = os.environ['SERVICE_TOKEN']"),
    (["xss", "cross-site scripting"], "CWE-79",
     "Text from outside becomes part of a page as markup, so it can bring scripts that act in the name of whoever looks at the page.",
     "A visitor stores or links a value with a script element or an event attribute; the browser of the next reader runs it.",
     "Write values as text, or escape them for the place in the page where they end up. Leave escaping to the template engine wherever there is one.",
     "node.textContent = value;"),
]
# Field bounds of an explanation.
# General advice by weakness, from the families above.
GENERAL_ADVICE = {f[1]: f[4] for f in FAMILIES}
# Fixed value: the note that goes with general advice.
ADVICE_NOTE = "General security guidance — verify against your specific application context and architecture."


def remediation_guidance(remediation: str | Column, recommendation: str | Column, cwe: str | Column, table: dict[str, str] | None = None) -> Column:
    """PRJ-18: the finding's own advice, else that of its weakness, else NULL. An
    empty remediation gives way to the recommendation; a blank one does not."""
    own = F.nullif(T.strip(F.coalesce(F.nullif(T.col(remediation), F.lit("")), T.col(recommendation))), F.lit(""))
    general = lookup(cwe, GENERAL_ADVICE if table is None else table)
    return F.when(own.isNotNull() | general.isNotNull(), F.struct(
        F.coalesce(own, general).alias("text"), own.isNotNull().alias("is_specific"), F.when(own.isNull(), F.lit(ADVICE_NOTE)).alias("note")))


BOUNDS = {"summary": 300, "why_it_matters": 1000, "evidence_explanation": 800, "attack_scenario": 1000, "remediation": 1000, "safer_pattern": 1200, "limitations": 400}
MAX_REFERENCES, MAX_REFERENCE = 5, 120


def bounded(c: Column, size: int, fallback: str | Column = "") -> Column:
    """TXT-29: trimmed, script-free, scrubbed and bounded text with a fallback."""
    t = T.strip(F.coalesce(c, F.lit("")))
    f = fallback if isinstance(fallback, Column) else F.lit(fallback)
    return F.when(t == "", f).otherwise(T.truncate(T.scrub_vendor_tokens(T.redact_scripts(t)), size))


def references(refs: Column, cwe: Column) -> Column:
    """Distinct non-blank references, at most five, else one for the weakness."""
    clean = F.array_distinct(F.filter(F.transform(F.coalesce(refs, F.array().cast("array<string>")), T.strip), lambda r: r != ""))
    kept = F.transform(F.slice(clean, 1, MAX_REFERENCES), lambda r: F.left(r, F.lit(MAX_REFERENCE)))
    return F.when(F.size(kept) > 0, kept).when(cwe.isNotNull() & (cwe != ""), F.array(_cat("OWASP / ", cwe))).otherwise(F.array().cast("array<string>"))


def fallback_explanation(findings: DataFrame) -> DataFrame:
    """TXT-28: explanation built from the finding alone. ``knowledge`` (optional
    column) holds the text of the matched document; its remediation section is
    used by findings outside the known families."""
    title, cat = T.strip(T.text_or("title", "Security Finding")), T.strip(T.text_or("category", "General Security"))
    low, cwe = F.lower(title), F.coalesce("cwe_id", F.lit(""))
    fam = F.lit(-1)
    for i in reversed(range(len(FAMILIES))):
        words, code = FAMILIES[i][0], FAMILIES[i][1]
        hit = F.lower(cwe).contains(code.lower())
        for w in words:
            hit = hit | low.contains(w)
        fam = F.when(hit, i).otherwise(fam)
    rows = once(findings, "_f", fam)
    doc, line = F.coalesce(F.nullif("document_id", F.lit("")), F.nullif("file_path", F.lit("")), F.lit("source file")), F.coalesce("line", F.lit(1)).cast("string")
    sig, name = T.text_or("signal_type", "security_signal"), T.text_or("signal_name", "operation")
    pick = lambda k, other: F.coalesce(*[F.when(F.col("_f") == i, F.lit(x[k])) for i, x in enumerate(FAMILIES)], other)
    section = F.lit(None).cast("string")
    if "knowledge" in findings.columns:
        after = F.when(F.col("knowledge").contains("Secure Fix / Remediation:"), F.split_part("knowledge", F.lit("Secure Fix / Remediation:"), F.lit(2)))
        section = F.nullif(T.strip(F.split_part(after, F.lit("CWE Reference:"), F.lit(1))), F.lit(""))
    known = F.coalesce(F.nullif(cwe, F.lit("")), *[F.when(F.col("_f") == i, F.lit(x[1])) for i, x in enumerate(FAMILIES)])
    texts = {
        "summary": _cat(title, " detected in '", doc, "' at line ", line, "."),
        "why_it_matters": pick(2, _cat("A ", cat, " pattern was found (signal '", sig, "'). It matters if the values that reach it come from outside and are not checked.")),
        "evidence_explanation": _cat("Rule ", sig, " matches '", name, "' in '", doc, "', line ", line, ". The rule reads the syntax tree; the program was not run."),
        "attack_scenario": pick(3, _cat("Whoever controls the input of this ", F.lower(cat), " pattern tries values that the code does not expect.")),
        "remediation": pick(4, F.coalesce(section, F.lit("Check the values before they get here, and use the interface that treats them as data."))),
        "safer_pattern": pick(5, F.coalesce(F.when(section.contains("1."), section), F.lit("Let only checked values reach this operation."))),
        "limitations": F.lit("Written from the rule and its match alone; whether it can be exploited was not tried."),
    }
    refs = F.when(known.isNotNull(), F.array(_cat("OWASP / ", known), _cat("CWE-", F.replace(known, F.lit("CWE-"), F.lit(""))))).otherwise(F.array(F.lit("OWASP Top 10")))
    out = rows.withColumns({k: bounded(v, BOUNDS[k]) for k, v in texts.items()})
    return out.withColumns({"references": references(refs, F.coalesce(known, F.lit(""))), "provenance": F.lit("deterministic_fallback")}).drop("_f")


def validate_explanation(answers: DataFrame) -> DataFrame:
    """TXT-29: a provider's answer (``answer`` JSON text) made safe: every field
    present, bounded and scrubbed, missing ones filled from the finding."""
    schema = ", ".join(f"{k} string" for k in BOUNDS) + ", explanation string, recommendation string, references array<string>"
    rows = answers.withColumn("_a", F.from_json(T.model_json("answer"), schema))
    a = lambda k: F.col(f"_a.{k}")
    title, cat = T.text_or("title", "Security Finding"), T.text_or("category", "General Security")
    fill = {
        "summary": (a("summary"), _cat(title,  " was found by a code rule.")),
        "why_it_matters": (F.coalesce(F.nullif(a("why_it_matters"), F.lit("")), a("explanation")),
                           _cat("It may be a ", cat, " weakness if the input comes from outside.")),
        "evidence_explanation": (a("evidence_explanation"), "A code rule matches the changed lines."),
        "attack_scenario": (a("attack_scenario"), _cat("Prepared input may make the code do something else than meant (", F.lower(cat), ").")),
        "remediation": (F.coalesce(F.nullif(a("remediation"), F.lit("")), a("recommendation")),
                        "Look at the operation: is its input checked, and is there a safer call?"),
        "safer_pattern": (a("safer_pattern"), "Pass values as data, do not build code or commands from them."),
        "limitations": (a("limitations"), "Found without running the code; what is reachable depends on how it is used."),
    }
    out = rows.withColumns({k: bounded(v, BOUNDS[k], f) for k, (v, f) in fill.items()})
    return out.withColumn("references", references(a("references"), F.coalesce("cwe_id", F.lit("")))).drop("_a")
