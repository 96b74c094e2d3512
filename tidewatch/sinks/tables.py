"""Keyed writes on plain Parquet (SNK-01..07, SNK-13..18).

Tables are partitioned by a hash bucket of their key. A write touches only the
buckets of its keys: those are rebuilt (old rows whose key is not written, plus
the new rows) and replaced by dynamic partition overwrite. With a table format
that has MERGE the same calls become one MERGE each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import text as T
from tidewatch.operators.ranking import top_n

BUCKET = "_bucket"
# Collections that cleanup must never drop.
PROTECTED = ["ast_documents", "security_knowledge"]


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored table, or None if nothing is stored there; what cannot be read fails."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        if e.getCondition() == "UNABLE_TO_INFER_SCHEMA" and _has_files(spark, path):
            raise
        return None


def _has_files(spark: SparkSession, path: str) -> bool:
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    return not listed.select("path").limit(1).isEmpty()


def layout(spark: SparkSession, path: str, buckets: int) -> int:
    """The number of buckets the table was made with; a new table stores ``buckets``."""
    side = f"{path.rstrip('/')}/_layout"
    try:
        return spark.read.schema("buckets int").json(side).first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    spark.range(1).select(F.lit(buckets).alias("buckets")).coalesce(1).write.json(side)
    return buckets


def _bucketed(df: DataFrame, keys: Sequence[str], buckets: int) -> DataFrame:
    return df.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def _write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)


def replace(df: DataFrame, path: str, keys: Sequence[str], buckets: int = 64) -> None:
    """SNK-01: idempotent replace: every stored row with one of the new keys goes,
    the new rows come in. Running it again changes nothing."""
    old = read_table(df.sparkSession, path)
    new = _bucketed(df, keys, layout(df.sparkSession, path, buckets))
    if old is not None:
        touched = new.select(BUCKET).distinct()
        kept = old.join(touched, BUCKET, "left_semi").join(new.select(*keys).distinct(), list(keys), "left_anti")
        new = kept.select(*new.columns).unionByName(new)
    _write(new, path)


def upsert(df: DataFrame, path: str, keys: Sequence[str], newest: Sequence[Column], buckets: int = 64) -> None:
    """SNK-02 / SNK-07 / SNK-13 / SNK-17: last write per key wins."""
    replace(top_n(df, list(keys), newest, 1), path, keys, buckets)


def insert_missing(df: DataFrame, path: str, keys: Sequence[str], buckets: int = 64) -> DataFrame:
    """SNK-05 / SNK-06 / JOI-21: add only rows whose key is not stored yet; of
    several new rows of a key the least comes in."""
    old = read_table(df.sparkSession, path)
    sortable = [f.name for f in df.schema if f.dataType.typeName() != "map"]
    df = top_n(df, list(keys), [F.col(c) for c in sortable], 1)
    fresh = df if old is None else df.join(old.select(*keys), list(keys), "left_anti")
    _bucketed(fresh, keys, layout(df.sparkSession, path, buckets)).write.mode("append").partitionBy(BUCKET).parquet(path)
    return fresh


def delete(spark: SparkSession, path: str, ids: DataFrame, keys: Sequence[str], buckets: int = 64) -> None:
    """SNK-15 / SNK-16: drop rows by key, rewriting only their buckets. A bucket
    that becomes empty keeps one empty file, so nothing stale survives."""
    old = read_table(spark, path)
    if old is None:
        return
    gone = _bucketed(ids.select(*keys).distinct(), keys, layout(spark, path, buckets))
    touched = [r[0] for r in gone.select(BUCKET).distinct().collect()]  # at most ``buckets`` numbers
    kept = old.filter(F.col(BUCKET).isin(touched)).join(gone.select(*keys), list(keys), "left_anti")
    survivors = {r[0] for r in kept.select(BUCKET).distinct().collect()}
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    _write(kept, path)
    for b in touched:
        if b not in survivors:
            fs.delete(fs_path(f"{path}/{BUCKET}={b}"), True)


def uniqueness_errors(df: DataFrame, column: str) -> DataFrame:
    """SNK-17: values that would break a unique constraint."""
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def clean_metadata(m: str | Column = "metadata") -> Column:
    """PRJ-10: missing metadata values become empty text."""
    return F.transform_values(T.col(m), lambda k, v: F.coalesce(v.cast("string"), F.lit("")))


def valid_documents(docs: DataFrame) -> DataFrame:
    """SNK-03 / PRJ-11: documents with an id and content, metadata cleaned."""
    ok = docs.filter((F.coalesce("document_id", F.lit("")) != "") & (F.coalesce("content", F.lit("")) != ""))
    return ok.withColumn("metadata", clean_metadata())


def ingest(docs: DataFrame, path: str, newest: Sequence[Column], embed) -> None:
    """SNK-02..04: validate, embed each distinct text once, keep the last row per id, upsert."""
    rows = top_n(valid_documents(docs), ["document_id"], newest, 1).withColumn("content_hash", F.sha2("content", 256))
    texts = rows.groupBy("content_hash").agg(F.min("content").alias("content"))
    vectors = texts.select("content_hash", embed("content").alias("embedding"))
    replace(rows.join(vectors, "content_hash"), path, ["document_id"])


def droppable(names: DataFrame, prefix: str = "ast_") -> DataFrame:
    """SNK-18: transient collections that cleanup may drop."""
    return names.filter(F.col("collection").startswith(prefix) & ~F.col("collection").isin(PROTECTED))


def write_report_json(reports: DataFrame, path: str) -> None:
    """SNK-08: one JSON document per report."""
    reports.write.mode("overwrite").json(path)
