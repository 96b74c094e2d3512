"""Suppression matching by id and by fingerprint (JOI-05..07, AGR-10/11, SNK-13/14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions import text as T
from tidewatch.functions.hashing import fingerprint_v1, fingerprint_v2
from tidewatch.operators import predicates as P
from tidewatch.operators.ranking import top_n

# Reason codes, those that need a comment, and the comment bounds.
REASON_CODES = ["FALSE_POSITIVE", "ACCEPTED_RISK", "TEST_OR_MOCK", "EXTERNAL_SANITIZATION", "OTHER"]
REASONS_WITH_COMMENT = ["ACCEPTED_RISK", "EXTERNAL_SANITIZATION", "OTHER"]


def with_fingerprints(findings: DataFrame, repository: str | Column = "repository") -> DataFrame:
    """Both fingerprints of a finding, from its primary evidence."""
    return findings.withColumns({
        "fp_v1": fingerprint_v1(repository, F.coalesce(F.nullif("signal_type", F.lit("")), "category"), "category", "file_path"),
        "fp_v2": fingerprint_v2(repository, "file_path", "signal_type", "category", "scope", "signal_name", F.lit(0)),
    })


def latest_per(records: DataFrame, *keys: str) -> DataFrame:
    """The record that wins for a key: newest, then highest id."""
    return top_n(records, list(keys), [F.desc("created_at"), F.desc("suppression_id")], 1)


def _named(name: str, *keys: str, nulls: bool = False) -> dict[str, Column]:
    """Two 64-bit hashes of a name and several keys, which joins send instead of the texts.
    NULL where a key is NULL, as no join matches it; with ``nulls`` a NULL is a
    value of its own, as in a grouping."""
    parts = [c for k in keys for c in (F.col(k).isNull(), F.col(k))]
    full = F.lit(True)
    for k in [] if nulls else keys:
        full = full & F.col(k).isNotNull()
    return {f"{name}{i}": F.when(full, F.xxhash64(F.lit(i), F.lit(name), *parts)) for i in (1, 2)}


def _by_fingerprint(active: DataFrame, v1: Column) -> tuple[DataFrame, DataFrame]:
    """The records that win for a repository and v2 fingerprint (``r2``), and for a
    repository and v1 fingerprint among those where ``v1`` holds (``r1``), under
    the names of their keys. Both kinds are rows of one table, so that the records
    are made once."""
    new, old = _named("_fp_v2", "repository", "fp_v2"), {n: F.when(v1, c) for n, c in _named("_fp_v1", "repository", "fp_v1").items()}
    kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), *[c.alias(f"_name{i}") for i, c in enumerate(names.values(), 1)]) for kind, names in (("r2", new), ("r1", old))])
    rows = active.select("suppression_id", "created_at", "expires_at", "fingerprint_version", F.inline(kinds)).filter("_name1 IS NOT NULL")
    best = latest_per(rows, "_name1", "_name2").select("kind", "_name1", "_name2", F.struct("suppression_id", "expires_at", "fingerprint_version").alias("r"))
    return tuple(best.filter(F.col("kind") == kind).select(*[F.col(f"_name{i}").alias(n) for i, n in enumerate(names, 1)], F.col("r").alias(kind)) for kind, names in (("r2", new), ("r1", old)))


def _with_direct(findings: DataFrame, active: DataFrame) -> DataFrame:
    """Adds ``r0``, the record of the same analysis and finding id that wins, and
    ``_own``. The records stay among the rows, with NULL as ``_own``, so that a
    window over the analysis has all rows; drop them after it."""
    keys = {k: F.col(k).try_cast(findings.schema[k].dataType) for k in ("analysis_id", "finding_id")}
    direct = active.select(*[c.alias(k) for k, c in keys.items()], F.struct("created_at", "suppression_id", "expires_at", "fingerprint_version").alias("_direct"))
    direct = direct.dropna(subset=list(keys)).repartition("analysis_id")
    rows = findings.withColumn("_own", F.lit(True)).unionByName(direct, allowMissingColumns=True)
    newest = F.max("_direct").over(Window.partitionBy("analysis_id", "finding_id"))  # as in latest_per
    rows = rows.withColumn("_direct", newest)
    return rows.withColumn("r0", F.when(F.col("_direct").isNotNull(), F.struct("_direct.suppression_id", "_direct.expires_at", "_direct.fingerprint_version"))).drop("_direct")


def ambiguity(findings: DataFrame) -> DataFrame:
    """AGR-10: how many findings of one analysis share path, rule and class.
    Counted by a grouped pass and joined back, never by a whole-group window."""
    return findings.groupBy("analysis_id", "file_path", "signal_type", "category").agg(F.count(F.lit(1)).alias("same_rule"))


def resolve(findings: DataFrame, records: DataFrame, now: str) -> DataFrame:
    """JOI-05 / JOI-06: the record that applies to each finding — same analysis
    and finding id first, then the repository's v2 fingerprint, then its v1
    fingerprint among version-1 records — and whether it suppresses the finding.
    A version-1 record is ambiguous, and suppresses nothing, when several
    findings of the analysis share path, rule and class.

    What is counted or matched within an analysis is done by windows that one
    partitioning by analysis serves, so findings that come from a join on it are
    only shuffled for their two fingerprints."""
    active = records.filter(F.upper("status") == "ACTIVE")
    v2, v1 = _by_fingerprint(active, F.col("fingerprint_version") == 1)
    rule, new, old = _named("_rule", "file_path", "signal_type", "category", nulls=True), _named("_fp_v2", "repository", "fp_v2"), _named("_fp_v1", "repository", "fp_v1")
    rows = _with_direct(findings.withColumns({**rule, **new, **old}), active)
    rows = (
        rows.withColumn("same_rule", F.count("_own").over(Window.partitionBy("analysis_id", *rule)) > 1)  # as in ambiguity
        .filter("_own").drop("_own", *rule)
        .join(v2, list(new), "left")
        .join(v1, list(old), "left")
        .withColumn("hit", F.coalesce("r0", "r2", "r1"))
    )
    exp = F.col("hit.expires_at")
    alive = F.col("hit").isNotNull() & (exp.isNull() | (exp > F.lit(now).cast("timestamp_ntz")))
    ambiguous = (F.col("hit.fingerprint_version") == 1) & F.col("same_rule")
    return rows.withColumns({
        "suppression_id": F.col("hit.suppression_id"),
        "matched_by": F.when(F.col("r0").isNotNull(), "id").when(F.col("r2").isNotNull(), "v2").when(F.col("r1").isNotNull(), "v1"),
        "is_expired": F.col("hit").isNotNull() & ~alive,
        "legacy_ambiguous": F.coalesce(ambiguous, F.lit(False)),
        "suppressed": alive & ~F.coalesce(ambiguous, F.lit(False)),
    }).drop("r0", "r1", "r2", "hit", "same_rule", *new, *old)


def is_suppressed(findings: DataFrame, records: DataFrame, now: str) -> DataFrame:
    """JOI-07: boolean form. A v2 match decides alone, even when it has expired;
    the v1 match looks at records of every version."""
    active = records.filter(F.upper("status") == "ACTIVE")
    v2, v1 = _by_fingerprint(active, F.lit(True))
    new, old = _named("_fp_v2", "repository", "fp_v2"), _named("_fp_v1", "repository", "fp_v1")
    # AGR-11: counted by a window, which needs no shuffle of findings that come from a join on their analysis
    alone = F.count(F.lit(1)).over(Window.partitionBy("analysis_id", "fp_v1")) <= 1
    rows = findings.dropna(subset=["analysis_id", "fp_v1"]).withColumns({**new, **old, "alone": alone}).join(v2, list(new), "left").join(v1, list(old), "left")

    def alive(r: str) -> Column:
        e = F.col(f"{r}.expires_at")
        return e.isNull() | (e > F.lit(now).cast("timestamp_ntz"))

    verdict = F.when(F.col("r2").isNotNull(), alive("r2")).when(
        F.col("r1").isNotNull(), F.col("alone") & alive("r1")).otherwise(F.lit(False))
    return rows.withColumn("suppressed", verdict).drop("r1", "r2", "alone", *new, *old)


def validate_reason(records: DataFrame) -> DataFrame:
    """Reason taxonomy as a column: NULL when valid, else what is wrong."""
    code, note = T.strip(T.text_or("reason_code", "FALSE_POSITIVE")), T.strip(F.coalesce("reason", F.lit("")))
    return records.withColumn(
        "reason_error",
        F.when(~code.isin(REASON_CODES), "unknown code")
        .when(F.length(note) > 1000, "comment too long")
        .when(code.isin(REASONS_WITH_COMMENT) & (F.length(note) < 5), "comment required"),
    )


def valid_expiry(now: str, expires: str = "expires_at") -> Column:
    """SCL-02: an ISO expiry must carry a zone and lie in the future; none is fine."""
    raw = F.trim(expires)
    zoned = raw.rlike(r"(?i)(z|[+-]\d{2}:?\d{2})$")
    return F.col(expires).isNull() | F.coalesce(
        F.when(zoned, F.try_to_timestamp(raw)) > F.lit(now).cast("timestamp"), F.lit(False))


def revoke(records: DataFrame, ids: DataFrame, now: str) -> DataFrame:
    """SNK-14: mark the given suppressions revoked and keep their history."""
    hit = ids.select("suppression_id").distinct().withColumn("_hit", F.lit(True))
    out = records.join(hit, "suppression_id", "left")
    return out.withColumns({
        "status": F.when(F.col("_hit"), "REVOKED").otherwise(F.col("status")),
        "updated_at": F.when(F.col("_hit"), F.lit(now).cast("timestamp_ntz")).otherwise(F.col("updated_at")),
    }).drop("_hit")


def live_repository_count(records: DataFrame, now: str) -> DataFrame:
    return records.filter(P.suppression_live(now)).groupBy("repository").agg(F.count(F.lit(1)).alias("n"))
