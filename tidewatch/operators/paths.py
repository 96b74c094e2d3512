"""Path and source-file rules (FLT-10..13, SRC-03/04, SET-06, PRJ-14/19/20, AGR-28, TXT-35)."""

from __future__ import annotations

import fnmatch
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import text as T

# Folders, suffixes and extensions of the scan rules.
EXCLUDED_DIRECTORIES = [
    ".git", "node_modules", "dist", "build", "__pycache__", ".pytest_cache", ".venv", "venv", ".env", ".ds_store",
    "coverage", ".idea", ".vscode", "tests", "test", "scratch", "datasets", "data",
]
EXCLUDED_SUFFIXES = [".pyc", ".pyo", ".pyd", ".so", ".dll", ".exe", ".dylib", ".min.js", ".min.css", ".map"]
DISCOVERY_PRUNED = [
    ".git", ".github", "node_modules", "venv", ".venv", "env", "__pycache__", ".pytest_cache", ".mypy_cache", "dist",
    "build", "target", "coverage", ".idea", ".vscode",
]
EXTENSION_LANGUAGE = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript",
    ".java": "java", ".c": "c_cpp", ".h": "c_cpp", ".cpp": "c_cpp", ".hpp": "c_cpp", ".go": "go", ".rs": "rust",
    ".php": "php", ".rb": "ruby",
}
MAX_FILES, MAX_TOTAL_BYTES = 500, 25_000_000


def slashes(path: str | Column) -> Column:
    return F.replace(T.strip(T.col(path)), F.lit("\\"), F.lit("/"))


def parts(path: str | Column) -> Column:
    """Path components with ``.`` and ``..`` resolved; leading ``..`` are dropped."""
    pieces = F.split(slashes(path), "/")
    done = F.aggregate(
        pieces,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when((p == "") | (p == "."), acc)
        .otherwise(F.concat(acc, F.array(p))),
    )
    return done


def glob_regex(pattern: str) -> str:
    """UDF-05: a shell pattern as a Java regular expression."""
    return fnmatch.translate(pattern.strip()).replace("\\Z", "\\z")


def excluded(path: str | Column, globs: Sequence[str] = ()) -> Column:
    """FLT-10: excluded folder, excluded suffix or a custom pattern on the path
    or the file name. The cheap suffix test comes first."""
    clean = slashes(path)
    low = F.transform(parts(path), F.lower)
    name = F.coalesce(F.try_element_at(low, F.lit(-1)), F.lower(clean))
    hit = F.lit(False)
    for s in EXCLUDED_SUFFIXES:
        hit = hit | name.endswith(s)
    hit = hit | F.arrays_overlap(low, F.array(*[F.lit(x) for x in EXCLUDED_DIRECTORIES]))
    for g in globs:
        if g and g.strip():
            hit = hit | clean.rlike("^" + glob_regex(g)) | name.rlike("^" + glob_regex(g))
    return F.when(clean == "", F.lit(False)).otherwise(F.coalesce(hit, F.lit(False)))


def escapes_root(path: str | Column) -> Column:
    """FLT-11: the path climbs above its root."""
    depth = F.aggregate(
        F.split(slashes(path), "/"),
        F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")),
        lambda a, p: F.struct(
            (a["d"] + F.when(p == "..", -1).when((p == "") | (p == "."), 0).otherwise(1)).alias("d"),
            F.least(a["low"], a["d"] + F.when(p == "..", -1).when((p == "") | (p == "."), 0).otherwise(1)).alias("low"),
        ),
    )
    return (depth["low"] < 0) | slashes(path).startswith("/")


def language(path: str | Column) -> Column:
    """SRC-03: language by extension, NULL when unsupported."""
    ext = F.regexp_extract(F.lower(T.col(path)), r"(\.[^./]+)$", 1)
    m = F.create_map(*[F.lit(x) for kv in EXTENSION_LANGUAGE.items() for x in kv])
    return F.try_element_at(m, ext)


def split_changed(changed: DataFrame, files: DataFrame, globs: Sequence[str] = ()) -> DataFrame:
    """FLT-12 / SET-06: changed paths as (path, state): excluded ones, and included
    ones that exist in ``files``. No included row means full mode."""
    c = changed.select(F.btrim(slashes("path"), F.lit("/")).alias("path")).filter("path <> ''").distinct()
    c = c.withColumn("ex", excluded("path", globs))
    out = c.filter("ex").select("path", F.lit("excluded").alias("state"))
    inc = c.filter("NOT ex").join(files.select("path").distinct(), "path", "left_semi")
    return out.unionByName(inc.select("path", F.lit("included").alias("state")))


def cap_files(files: DataFrame, n: int) -> DataFrame:
    """FLT-13: the first ``n`` files by path."""
    return files.orderBy("path").limit(n)


def limits(files: DataFrame) -> DataFrame:
    """AGR-28: count, bytes and whether the repository bounds are exceeded."""
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).withColumn(
        "over_limit", (F.col("files") > MAX_FILES) | (F.col("bytes") > MAX_TOTAL_BYTES))


def non_text_share(content: Column) -> Column:
    """TXT-35: share of non-text bytes; 1.0 when there is a NUL, 0.0 without bytes."""
    as_text = F.decode(content, "ISO-8859-1")
    odd = F.length(F.regexp_replace(as_text, r"[\t\n\r -~]", ""))
    return F.when(F.coalesce(F.octet_length(content), F.lit(0)) == 0, 0.0).when(as_text.contains("\x00"), 1.0).otherwise(odd / F.octet_length(content))


def control_share(content: Column) -> Column:
    """:func:`non_text_share` for texts of any language: in well-formed UTF-8 only
    control characters are no text; other bytes count as there."""
    text = content.cast("string")
    odd = F.length(F.regexp_replace(text, r"[^\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""))
    well_formed = F.coalesce(F.is_valid_utf8(text) & (F.octet_length(content) > 0) & ~text.contains("\x00"), F.lit(False))
    return F.when(well_formed, odd / F.octet_length(content)).otherwise(non_text_share(content))


def read_sources(files: DataFrame, max_bytes: int | None = None, probe_bytes: int | None = None, any_language: bool = False) -> DataFrame:
    """SRC-04: decode file bytes; ``skip`` says why a file is not read. Expects
    (path, size, content). Bytes that are not UTF-8 become replacement
    characters. All sizes and the whole content count unless bounds are given.
    By default every byte beyond ASCII speaks for a binary file, as in source
    code; with ``any_language`` well-formed UTF-8 does not."""
    probe = F.col("content") if probe_bytes is None else F.substring("content", 1, probe_bytes)
    large = F.lit(None).cast("string") if max_bytes is None else F.when(F.col("size") > max_bytes, "too_large")
    share = control_share(probe) if any_language else non_text_share(probe)
    out = files.withColumn("skip", F.coalesce(large, F.when(share > 0.30, "binary")))
    return out.withColumn("source", F.when(F.col("skip").isNull(), F.make_valid_utf8(F.col("content").cast("string"))))


def scan_statistics(files: DataFrame) -> DataFrame:
    """PRJ-14: counters of a scan over rows with ``skip`` and ``ex`` columns."""
    return files.agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(F.col("ex")).alias("excluded_files"),
        F.count_if(~F.col("ex")).alias("considered_files"),
        F.count_if(~F.col("ex") & F.col("skip").isNull()).alias("analyzed_files"),
        F.count_if(F.col("ex") | F.col("skip").isNotNull()).alias("skipped_files"),
    )


def extensions(files: DataFrame) -> DataFrame:
    """PRJ-19: sorted distinct extensions as rows."""
    ext = F.regexp_extract(F.lower("path"), r"(\.[^./]+)$", 1)
    return files.select(ext.alias("extension")).filter("extension <> ''").distinct().orderBy("extension")


# Identity formats.
OWNER_REPO = r"^[a-zA-Z0-9_.\-]+$"
COMMIT_SHA = r"^[0-9a-fA-F]{40}$"


def identity_errors(owner: str = "owner", repository: str = "repository", pr: str = "pr_number", sha: str = "head_sha") -> Column:
    """PRJ-20: NULL for a valid identity, else what is wrong."""
    number = F.col(pr).try_cast("bigint")
    return (
        F.when(~F.coalesce(T.strip(owner).rlike(OWNER_REPO), F.lit(False)), "owner")
        .when(~F.coalesce(T.strip(repository).rlike(OWNER_REPO), F.lit(False)), "repository")
        .when(~F.coalesce(number.between(1, 1_000_000_000), F.lit(False)), "pr_number")
        .when(~F.coalesce(T.strip(sha).rlike(COMMIT_SHA), F.lit(False)), "head_sha")
    )


def commit_key(owner: str = "owner", repository: str = "repository", pr: str = "pr_number", sha: str = "head_sha") -> Column:
    """TXT-34."""
    return F.lower(F.concat(T.strip(owner), F.lit("/"), T.strip(repository), F.lit(":"), F.col(pr).cast("string"), F.lit(":"), T.strip(sha)))
