"""Queries over the chunk store: the same documents taken in twice, a third of them changed (survey 2.2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.embedding import embed
from tidewatch.plans.registry import query
from tidewatch.session import shared_dir
from tidewatch.sinks.knowledge import KnowledgeStore
from tidewatch.sources import bridge as B

OLD = " old words" * 120


def taken_in(spark, d):
    """The store after both ingests, and what the second did."""
    store = KnowledgeStore(spark, shared_dir(spark, "knowledge"), embed, buckets=16)
    docs = B.table(spark, d, "documents").filter("text IS NOT NULL")
    new = docs.select(
        F.col("doc_id").cast("string").alias("document_id"), F.col("text").alias("content"), F.create_map(F.lit("lang"), "lang").alias("metadata"))
    old = new.withColumn("content", F.when(F.col("document_id").cast("long") % 3 == 0, F.concat("content", F.lit(OLD))).otherwise(F.col("content")))
    store.ingest(old)
    return store, store.ingest(new)


_CUT = """cut(doc_id, i, content) AS (SELECT doc_id, i, substring(x, CAST((i - 1) * 900 + 1 AS BIGINT), 1000)
     FROM (SELECT doc_id, x, unnest(range(1, CAST(greatest(1, ceil((length(x) - 100) / 900.0)) AS BIGINT) + 1)) AS i FROM {rows} WHERE x <> ''))"""


@query(
    "knowledge_chunks",
    "WITH r AS (SELECT doc_id, text AS x FROM documents WHERE text IS NOT NULL), " + _CUT.format(rows="r")
    + " SELECT CAST(doc_id AS VARCHAR) AS document_id, doc_id || '_chunk_' || i AS chunk_id, sha256(content) AS content_hash, length(content) AS n FROM cut",
)
def _(spark, d):
    return taken_in(spark, d)[0].chunks().select("document_id", "chunk_id", F.sha2("content", 256).alias("content_hash"), F.length("content").cast("long").alias("n"))


@query(
    "knowledge_ingest_counts",
    f"""WITH r AS (SELECT doc_id, text AS x FROM documents WHERE text IS NOT NULL), o AS (SELECT doc_id, x || CASE WHEN doc_id % 3 = 0 THEN '{OLD}' ELSE '' END AS x FROM r),
     {_CUT.format(rows="r")}, {_CUT.format(rows="o").replace("cut(", "was(")}, again AS (SELECT * FROM cut WHERE doc_id % 3 = 0),
     texts AS (SELECT DISTINCT content FROM again), known AS (SELECT content FROM texts WHERE content IN (SELECT content FROM was))
     SELECT (SELECT count(*) FROM r WHERE doc_id % 3 = 0) AS changed, (SELECT count(*) FROM r WHERE doc_id % 3 <> 0) AS unchanged, (SELECT count(*) FROM again) AS chunks,
       (SELECT count(*) FROM texts) - (SELECT count(*) FROM known) AS embedded, (SELECT count(*) FROM known) AS reused""",
)
def _(spark, d):
    did = taken_in(spark, d)[1]
    return spark.range(1).select(*[F.lit(getattr(did, c)).cast("long").alias(c) for c in ("changed", "unchanged", "chunks", "embedded", "reused")])
