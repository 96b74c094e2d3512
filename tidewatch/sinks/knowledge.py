"""Incremental ingest of knowledge documents into a chunk store (SNK-04, JOI-20, PRJ-11, TXT-01).

Documents and their chunks are linked tables. An ingest leaves documents alone whose
content and metadata are those stored, cuts the others into chunks, takes the vectors
of chunk texts that the store knows and embeds each other text once. Documents and
chunks then change by one switch, so chunks that a changed document no longer has
are gone with the old version and only the buckets of changed documents are written.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import text as T
from tidewatch.operators.ranking import top_n
from tidewatch.session import setting
from tidewatch.sinks.linked import LinkedTables
from tidewatch.sinks.positions import FILE, ROW, choose, located
from tidewatch.sinks.tables import clean_metadata

# The type of every knowledge document and the source of those that name none.
DOCUMENT_TYPE = "security_knowledge"
SOURCE_TYPE = "knowledge_base"
LINKS = {"documents": ["document_id"], "chunks": ["document_id"]}


@dataclass(frozen=True)
class Ingested:
    """What an ingest did: valid documents by state, chunks of the changed ones,
    distinct chunk texts embedded and taken from the store."""

    changed: int
    unchanged: int
    chunks: int
    embedded: int
    reused: int


def load_documents(docs: DataFrame, *keep: str) -> DataFrame:
    """PRJ-11: documents with an id, a content (possibly empty) and metadata; metadata
    values that are missing become empty text, the document type is set and a source
    type is added where none is named. Other columns than ``keep`` are left out."""
    ok = docs.filter((F.coalesce("document_id", F.lit("")) != "") & F.col("content").isNotNull() & F.col("metadata").isNotNull())
    own = F.map_filter(clean_metadata(), lambda k, v: k != "document_type")
    source = F.when(F.map_contains_key("metadata", "source_type"), F.expr("map()").cast("map<string,string>")).otherwise(
        F.create_map(F.lit("source_type"), F.lit(SOURCE_TYPE)))
    meta = F.map_concat(own, F.create_map(F.lit("document_type"), F.lit(DOCUMENT_TYPE)), source)
    return ok.select("document_id", "content", meta.alias("metadata"), *keep)


class KnowledgeStore:
    """Documents (document_id, document_hash) and chunks (document_id, chunk_id,
    chunk_index, content, content_hash, metadata, embedding) under one folder.

    ``size`` and ``overlap`` are those of the chunks; a document stored with others
    counts as changed."""

    def __init__(self, spark: SparkSession, root: str, embed: Callable[[str], Column], size: int = 1000, overlap: int = 100, buckets: int = 64):
        self.tables = LinkedTables(spark, root, LINKS, buckets)
        self.embed, self.size, self.overlap = embed, size, overlap

    def documents(self) -> DataFrame | None:
        return self.tables.read("documents")

    def chunks(self) -> DataFrame | None:
        return self.tables.read("chunks")

    def remove(self, ids: DataFrame) -> None:
        """Documents go by id, together with their chunks."""
        self.tables.delete(ids)

    def _hash(self) -> Column:
        entries = F.to_json(F.sort_array(F.map_entries("metadata")))
        return F.sha2(F.concat_ws("\0", F.lit(f"{self.size}/{self.overlap}"), entries, "content"), 256)

    def ingest(self, docs: DataFrame, newest: Sequence[Column] = ()) -> Ingested:
        """Take in (document_id, content, metadata). Of several rows of an id the first
        by ``newest`` counts, then the smallest hash; ``newest`` may use any column.
        A document without content is kept without chunks. Running it again changes
        nothing and embeds nothing; an empty table changes nothing.

        Texts are written beside the store as they come, in compressed files; joins
        and groups see ids, hashes and positions, and texts are picked by position.
        Only the chunks of changed documents are shuffled, once, into their buckets."""
        work = f"{self.tables.root}/work/{uuid.uuid4().hex}"
        try:
            # each step's shuffle files go with it
            with setting(self.tables.spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
                return self._ingest(docs, newest, work)
        finally:
            self.tables.remove(work)

    def _ingest(self, docs: DataFrame, newest: Sequence[Column], work: str) -> Ingested:
        spark, at = self.tables.spark, F.struct(FILE, ROW)

        def staged(name: str, rows: DataFrame) -> DataFrame:
            rows.write.option("compression", "zstd").parquet(f"{work}/{name}")
            return spark.read.schema(rows.schema).parquet(f"{work}/{name}")

        def picked(rows: DataFrame, chosen: DataFrame, name: str) -> DataFrame:
            return choose(located(rows), chosen, f"{work}/{name}_bits")

        order = F.struct(F.lit(0).alias("_0"), *[c.alias(f"_{i}") for i, c in enumerate(newest, 1)])
        rows = staged("rows", load_documents(docs.withColumn("_order", order), "_order").withColumn("document_hash", self._hash()))
        # the positions break ties of rows that are equal throughout
        first = top_n(located(rows).select("document_id", "document_hash", "_order", FILE, ROW), ["document_id"], [F.col("_order"), F.col("document_hash"), F.col(FILE), F.col(ROW)], 1)
        first = staged("first", first.drop("_order"))
        known = self.documents()
        changed = first if known is None else staged("changed", first.join(known.select("document_id", "document_hash"), ["document_id", "document_hash"], "left_anti"))
        total, fresh = first.count(), changed.count()
        if not fresh:
            return Ingested(0, total, 0, 0, 0)
        cut = T.chunks(picked(rows, changed, "rows").withColumnRenamed("document_id", "_parent"), "_parent", "content", self.size, self.overlap)
        extra = F.create_map(F.lit("parent_document_id"), F.col("_parent"), F.lit("chunk_index"), F.col("chunk_index").cast("string"))
        own = F.map_filter("metadata", lambda k, v: ~k.isin("parent_document_id", "chunk_index"))
        cut = staged("cut", cut.select(
            F.col("_parent").alias("document_id"), F.col("document_id").alias("chunk_id"), "chunk_index", "content",
            F.sha2("content", 256).alias("content_hash"), F.map_concat(own, extra).alias("metadata")))
        self.tables.remove(f"{work}/rows")
        texts = staged("texts", located(cut).groupBy("content_hash").agg(F.min(at).alias("_at")).select("content_hash", "_at.*"))
        stored, parts = self.chunks(), []
        misses = texts
        if stored is not None and stored.inputFiles():
            hits = located(stored).select("content_hash", FILE, ROW).join(texts.select("content_hash"), "content_hash", "left_semi")
            hits = staged("hits", hits.groupBy("content_hash").agg(F.min(at).alias("_at")).select("content_hash", "_at.*"))
            parts.append(picked(stored, hits, "hits").select("content_hash", "embedding"))
            misses = texts.join(hits.select("content_hash"), "content_hash", "left_anti")
        new = staged("vectors", picked(cut, misses, "misses").select("content_hash", self.embed("content").alias("embedding")))
        vectors = new
        for part in parts:
            vectors = vectors.unionByName(part)
        embedded, distinct = new.count(), texts.count()
        ends = staged("ends", cut.select("document_id", "chunk_id", "content_hash").join(vectors, "content_hash").select("document_id", "chunk_id", "embedding"))
        for name in ("texts", "vectors"):
            self.tables.remove(f"{work}/{name}")
        self.tables.save({"chunks": (ends, ["document_id", "chunk_id"])}, documents=changed.select("document_id", "document_hash"), chunks=cut)
        return Ingested(fresh, total - fresh, cut.count(), embedded, distinct - embedded)
