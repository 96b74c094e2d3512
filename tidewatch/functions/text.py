"""String columns: cleaning, masking, chunking, tokens and relevance (TXT-*, SET-04/05)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLANKS = " \t\n\r\x0b\x0c"

# Markers written in place of removed text.
REDACTED = "[REDACTED_SECRET]"
REDACTED_CREDENTIAL = "[REDACTED_CREDENTIAL]"
REDACTED_SCRIPT = "[REDACTED_SCRIPT]"
TRUNCATED = "...[truncated]"
PLANTED_SECRET = "THIS_SECRET_MUST_NOT_APPEAR"

# Credential patterns, applied in this order (Java regex dialect).
VENDOR_TOKEN = (
    r"(?i)(ghp_[a-zA-Z0-9_]{16,255}|gho_[a-zA-Z0-9_]{16,255}|github_pat_[a-zA-Z0-9_]{16,255}|gsk_[a-zA-Z0-9_]{16,255}"
    r"|bearer\s+[a-zA-Z0-9._\-]+|secret_[a-zA-Z0-9_]{4,}|sess_[a-fA-F0-9]{16,}|session_[a-zA-Z0-9_]{16,})"
)
CREDENTIAL_PATTERNS = [
    (r"(?i)-----BEGIN (?:[A-Z0-9_\-]+ )?PRIVATE KEY-----[\s\S]*?-----END (?:[A-Z0-9_\-]+ )?PRIVATE KEY-----", REDACTED),
    (r"(?i)((?:aws_secret_access_key|aws_access_key|aws_secret)\s*[:=]\s*['\"]?)[A-Za-z0-9/+=]{40}(['\"]?)", f"$1{REDACTED}$2"),
    (r"(?i)(\b[a-zA-Z0-9_]*(?:password|passwd|pwd|api_key|apikey|secret|token)\s*[:=]\s*['\"])[^'\"]{4,}(['\"])", f"$1{REDACTED}$2"),
    (r"\b(AKIA[0-9A-Z]{16})\b", REDACTED),
    (r"\beyJ[a-zA-Z0-9_\-]{10,}\.eyJ[a-zA-Z0-9_\-]{10,}\.[a-zA-Z0-9_\-]{10,}\b", REDACTED),
    (VENDOR_TOKEN, REDACTED),
]
# What a match of the patterns above must hold: lower-cased, and as written.
CREDENTIAL_MARKS = [
    "private key-----", "aws_secret", "aws_access_key", "password", "passwd", "pwd", "api_key", "apikey", "secret", "token",
    "ghp_", "gho_", "github_pat_", "gsk_", "bearer", "sess_", "session_",
]
CREDENTIAL_MARKS_CASED = ["AKIA", "eyJ"]
# Patterns scrubbed from comments.
COMMENT_PATTERNS = [
    (r"(ghp_[A-Za-z0-9_]{20,}|github_pat_[A-Za-z0-9_]{20,}|Bearer\s+[A-Za-z0-9\-_.]+)", REDACTED_CREDENTIAL),
    (r"(?i)(sk-[A-Za-z0-9]{20,}|(?:secret|password|api_key|token)\s*[:=]\s*['\"][^'\"]+['\"])", REDACTED_CREDENTIAL),
    (r"[A-Za-z]:\\[Uu]sers\\[^\\]+\\", "workspace/"),
    (r"/home/[^/]+/", "workspace/"),
]
# Markup patterns.
HTML_TAG = r"</?[a-zA-Z][a-zA-Z0-9]*(?:\s+[^>]*)?>"
SCRIPT_BLOCK = r"(?is)<\s*script[^>]*>.*?<\s*/\s*script\s*>"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """Trim all ASCII white space, not only blanks."""
    return F.btrim(col(c), F.lit(_BLANKS))


def text_or(c: str | Column, default: str) -> Column:
    """Value, or a default when missing or empty."""
    return F.coalesce(F.nullif(col(c), F.lit("")), F.lit(default))


def _replace_all(c: Column, rules: Sequence[tuple[str, str]]) -> Column:
    for pattern, into in rules:
        c = F.regexp_replace(c, F.lit(pattern), F.lit(into))
    return c


def scrub_credentials(c: str | Column) -> Column:
    """TXT-02: the full credential pass. The patterns try many ways at every
    character, so a text is first searched for the words they need; without any
    of them it stays as it is. The one-element array keeps the text in one place."""
    def scrub(x: Column) -> Column:
        marked = F.exists(F.transform(F.array(F.lower(x)), lambda low: F.exists(F.array(*map(F.lit, CREDENTIAL_MARKS)), lambda m: F.contains(low, m))), lambda hit: hit)
        cased = F.exists(F.array(*map(F.lit, CREDENTIAL_MARKS_CASED)), lambda m: F.contains(x, m))
        return F.when(marked | cased, _replace_all(x, CREDENTIAL_PATTERNS)).otherwise(x)

    return F.get(F.transform(F.array(F.coalesce(col(c), F.lit(""))), scrub), 0)


def scrub_vendor_tokens(c: str | Column) -> Column:
    """TXT-03: vendor tokens only."""
    return F.regexp_replace(F.coalesce(col(c), F.lit("")), VENDOR_TOKEN, REDACTED)


def scrub_comment(c: str | Column) -> Column:
    """TXT-04: credentials and home folders in comment text."""
    return _replace_all(F.coalesce(col(c), F.lit("")), COMMENT_PATTERNS)


def mask_secret(c: str | Column) -> Column:
    """TXT-05."""
    return F.replace(F.coalesce(col(c), F.lit("")), F.lit(PLANTED_SECRET), F.lit(REDACTED))


def redact_scripts(c: str | Column) -> Column:
    """TXT-21."""
    return F.regexp_replace(col(c), SCRIPT_BLOCK, REDACTED_SCRIPT)


def has_html(c: str | Column) -> Column:
    """TXT-31."""
    return col(c).rlike(HTML_TAG)


def escape_markup(c: str | Column) -> Column:
    """TXT-22: ampersand first, then the angle brackets."""
    out = F.replace(col(c), F.lit("&"), F.lit("&amp;"))
    out = F.replace(out, F.lit("<"), F.lit("&lt;"))
    return F.replace(out, F.lit(">"), F.lit("&gt;"))


def truncate(c: str | Column, size: int, suffix: str = TRUNCATED) -> Column:
    """TXT-20: keep ``size`` characters and add a suffix beyond them."""
    x = col(c)
    return F.when(F.length(x) > size, F.concat(F.substring(x, 1, size), F.lit(suffix))).otherwise(x)


def ellipsis(c: str | Column, size: int) -> Column:
    """TXT-20: at most ``size`` characters including the three dots."""
    x = col(c)
    return F.when(F.length(x) > size, F.concat(F.substring(x, 1, size - 3), F.lit("..."))).otherwise(x)


def ellipsis_trimmed(c: str | Column, size: int) -> Column:
    """As ``ellipsis`` but white space before the dots is dropped."""
    x = col(c)
    cut = F.rtrim(F.substring(x, 1, size - 3), F.lit(_BLANKS))
    return F.when(F.length(x) > size, F.concat(cut, F.lit("..."))).otherwise(x)


def normalize_path(c: str | Column) -> Column:
    """TXT-23: forward slashes, no leading dots or slashes, single separators."""
    p = F.replace(strip(F.coalesce(col(c), F.lit(""))), F.lit("\\"), F.lit("/"))
    return F.regexp_replace(F.ltrim(p, F.lit("./")), "/{2,}", "/")


def normalize_email(c: str | Column) -> Column:
    """TXT-24: lower-cased address, NULL unless it has an inner ``@``."""
    e = F.lower(strip(c))
    return F.when(F.contains(e, F.lit("@")) & ~e.startswith("@") & ~e.endswith("@"), e)


def reason_token(c: str | Column) -> Column:
    """TXT-25."""
    return F.regexp_replace(F.substring(strip(text_or(c, "failed")), 1, 100), r"[^a-zA-Z0-9_\-]", "_")


def collection_name(c: str | Column) -> Column:
    """TXT-26: safe name for a transient collection, at most 63 characters."""
    clean = F.btrim(F.regexp_replace(text_or(c, "run"), r"[^a-zA-Z0-9_-]", "_"), F.lit("_"))
    name = F.substring(F.concat(F.lit("ast_"), text_or(clean, "run")), 1, 63)
    return F.regexp_replace(name, r"[^a-zA-Z0-9]$", "0")


def chunks(df: DataFrame, doc_id: str, text: str, size: int = 1000, overlap: int = 100) -> DataFrame:
    """TXT-01 / RNK-10: fixed-stride character windows. Adds ``document_id``,
    ``chunk_index`` and ``content``; documents with blank text give no rows and
    bad sizes give none at all."""
    if size <= 0 or overlap < 0 or overlap >= size:
        df = df.filter(F.lit(False))
        size, overlap = 1, 0
    step = size - overlap
    rows = df.filter(F.length(text) > 0).withColumnRenamed(text, "_text")
    n = F.greatest(F.lit(1), F.ceil((F.length("_text") - F.lit(overlap)) / F.lit(step))).cast("int")
    rows = rows.withColumn("_i", F.explode(F.sequence(F.lit(1), n)))
    return rows.select(
        *[c for c in rows.columns if c not in ("_text", "_i")],
        F.concat(F.col(doc_id).cast("string"), F.lit("_chunk_"), F.col("_i").cast("string")).alias("document_id"),
        F.col("_i").alias("chunk_index"),
        F.expr(f"substring(_text, (_i - 1) * {step} + 1, {size})").alias("content"),
    )


def tokens(c: str | Column) -> Column:
    """TXT-06: distinct lower-case ASCII alphanumeric runs and Unicode words."""
    x = F.lower(F.coalesce(col(c), F.lit("")))
    words = F.array_distinct(F.regexp_extract_all(x, F.lit(r"(?U)\w+"), F.lit(0)))
    # ASCII runs lie inside words, and a plain word is its own run: only the other
    # words need a second look
    mixed = F.array_join(F.filter(words, lambda w: w.rlike("[^a-zA-Z0-9]")), " ")
    both = F.array_union(words, F.regexp_extract_all(mixed, F.lit("[a-zA-Z0-9]+"), F.lit(0)))
    # a text of ASCII letters without underscores has plain words only, which a simpler search finds
    plain = (F.octet_length(x) == F.length(x)) & ~F.contains(x, F.lit("_"))
    return F.when(plain, F.array_distinct(F.regexp_extract_all(x, F.lit("[a-z0-9]+"), F.lit(0)))).otherwise(both)


def content_fingerprint(c: str | Column) -> Column:
    """TXT-07: lower-case text without any white space."""
    return F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), r"(?U)\s+", "")


def shared(a: Column, b: Column) -> Column:
    """SET-04: number of tokens two arrays share."""
    return F.size(F.array_intersect(a, b))


def within(a: Column, b: Column) -> Column:
    """SET-05: every element of ``a`` is in ``b``."""
    return F.size(F.array_except(a, b)) == 0


def metadata_completeness(m: str | Column) -> Column:
    """TXT-14: number of non-empty metadata values."""
    return F.coalesce(F.size(F.filter(F.map_values(col(m)), lambda v: v.isNotNull() & (v != ""))), F.lit(0))


def model_json(c: str | Column) -> Column:
    """TXT-38: the outermost JSON object in a model answer, NULL unless it parses."""
    body = F.regexp_extract(col(c), r"(?s)\{.*\}", 0)
    return F.when(F.expr("true") & (F.try_parse_json(body).isNotNull()) & (body != ""), body)
