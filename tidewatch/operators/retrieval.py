"""Retrieval: exact nearest neighbours, deduplication, relevance ranking, quotas
(JOI-17..20/24, SET-01, SRT-07/11, RNK-04/05/07, TXT-08..13, AGR-31/32)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions import text as T
from tidewatch.operators.ranking import top_n

# Largest query set shipped to every task; larger sets take the blocked plan.
QUERY_BOUND = 2048
BLOCK_ROWS = 65536

# Context bounds and scored metadata fields.
MAX_CONTEXT = 20
MAX_CONTENT = 4000
SCORED_FIELDS = [
    "cwe_id", "signal_type", "signal_name", "document_type", "security_topic", "function_name", "class_name",
    "category", "title",
]
AST_TYPES = ["security_evidence", "function_structure", "module_structure"]

_OUT = "query_id string, collection string, document_id string, distance double"


def _nearest(q: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Exact ``k`` nearest rows of ``v`` per row of ``q`` by squared L2, ties by id.
    Matrix products select candidates with a safety margin; the kept distances
    are recomputed directly."""
    approx = (q * q).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2.0 * (q @ v.T)
    for i in range(len(q)):
        row = approx[i]
        if len(row) > k:
            bound = np.partition(row, k - 1)[k - 1]
            pick = np.flatnonzero(row <= bound + 1e-6 * (1.0 + abs(bound)))
        else:
            pick = np.arange(len(row))
        exact = ((v[pick] - q[i]) ** 2).sum(1)
        order = np.lexsort((ids[pick], exact))[:k]
        yield i, ids[pick][order], exact[order]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, dtype=np.float64) for x in column])


def knn(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """JOI-19 / SRT-11: exact ``k`` nearest documents per query and collection.

    ``queries``: (query_id, embedding); ``vectors``: (collection, document_id,
    embedding). Up to ``QUERY_BOUND`` queries travel with the tasks and every
    partition of vectors sends on only its own ``k`` best per query. Larger query
    sets are cut into blocks, as are the vectors, and each pair of blocks is one
    task of bounded size. Either way only ``k`` rows per query and task reach the
    final ranking.
    """
    if k <= 0:
        return queries.sparkSession.createDataFrame([], _OUT)
    head = queries.select(F.col("query_id").cast("string"), "embedding").limit(QUERY_BOUND + 1).toPandas()
    vec = vectors.select("collection", F.col("document_id").cast("string").alias("document_id"), "embedding")
    if len(head) <= QUERY_BOUND:
        part = _knn_small(head, vec, k)
    else:
        part = _knn_blocked(queries, vec, k)
    best = top_n(part, ["query_id", "collection"], [F.col("distance"), F.col("document_id")], k)
    return best


def _knn_small(head: pd.DataFrame, vec: DataFrame, k: int) -> DataFrame:
    names = head["query_id"].to_numpy()
    q = _matrix(head["embedding"]) if len(head) else np.zeros((0, 1))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not len(names):
            return
        best: dict[tuple[int, str], tuple[np.ndarray, np.ndarray]] = {}
        for pdf in batches:
            for coll, g in pdf.groupby("collection"):
                ids, v = g["document_id"].to_numpy(dtype=str), _matrix(g["embedding"])
                for i, found, dist in _nearest(q, v, ids, k):
                    if (i, coll) in best:
                        old_ids, old_d = best[i, coll]
                        found, dist = np.concatenate([old_ids, found]), np.concatenate([old_d, dist])
                        order = np.lexsort((found, dist))[:k]
                        found, dist = found[order], dist[order]
                    best[i, coll] = (found, dist)
        for (i, coll), (found, dist) in best.items():
            yield pd.DataFrame({"query_id": names[i], "collection": coll, "document_id": found, "distance": dist})

    return vec.mapInPandas(scan, _OUT)


def _knn_blocked(queries: DataFrame, vec: DataFrame, k: int) -> DataFrame:
    nq = -(-queries.count() // QUERY_BOUND)
    nv = -(-vec.count() // BLOCK_ROWS)
    q = queries.select(F.col("query_id").cast("string").alias("query_id"), "embedding").withColumn(
        "qb", F.pmod(F.xxhash64("query_id"), F.lit(nq)))
    q = q.withColumn("vb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nv - 1).cast("long"))))
    v = vec.withColumn("vb", F.pmod(F.xxhash64("document_id"), F.lit(nv))).withColumn(
        "qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nq - 1).cast("long"))))

    def block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(left) and len(right):
            names, mat = left["query_id"].to_numpy(), _matrix(left["embedding"])
            for coll, g in right.groupby("collection"):
                for i, found, dist in _nearest(mat, _matrix(g["embedding"]), g["document_id"].to_numpy(dtype=str), k):
                    parts.append(pd.DataFrame(
                        {"query_id": names[i], "collection": coll, "document_id": found, "distance": dist}))
        return pd.concat(parts) if parts else pd.DataFrame(columns=["query_id", "collection", "document_id", "distance"])

    return q.groupBy("qb", "vb").cogroup(v.groupBy("qb", "vb")).applyInPandas(block, _OUT)


def source_category(default: Column, meta: str = "metadata") -> Column:
    """TXT-08."""
    m = lambda k: F.lower(F.coalesce(F.try_element_at(F.col(meta), F.lit(k)), F.lit("")))
    knowledge = (m("document_type") == "security_knowledge") | (m("source_type") == "knowledge_base") | (
        m("source") == "local_security_knowledge")
    ast = (m("source") == "ast_engine") | m("document_type").isin(AST_TYPES)
    return F.when(knowledge, "security_knowledge").when(ast, "ast").otherwise(default)


def source_priority(meta: str = "metadata") -> Column:
    """TXT-09."""
    kind = F.lower(F.coalesce(F.try_element_at(F.col(meta), F.lit("document_type")), F.lit("")))
    signal = F.coalesce(F.try_element_at(F.col(meta), F.lit("signal_type")), F.lit("")) != ""
    return (
        F.when((kind == "security_evidence") | signal, 3.0)
        .when(kind == "function_structure", 2.0)
        .when(kind == "module_structure", 1.5)
        .when(kind == "security_knowledge", 1.0)
        .otherwise(0.5)
    )


def relevance(query_tokens: str = "query_tokens", content_tokens: str = "content_tokens", meta: str = "metadata") -> Column:
    """TXT-10..13: priority + 0.5 per shared token + 0.25 per matching metadata
    field + 1.0 for the weakness id. Every term is a multiple of 0.25."""
    q = F.col(query_tokens)
    field = lambda k: F.coalesce(F.try_element_at(F.col(meta), F.lit(k)), F.lit(""))
    overlap = T.shared(q, F.col(content_tokens)) * 0.5
    fields = sum(F.when(F.arrays_overlap(q, T.tokens(field(k))), 0.25).otherwise(0.0) for k in SCORED_FIELDS)
    cwe = F.lower(T.strip(field("cwe_id")))
    cwe_hit = (cwe != "") & (
        T.within(T.tokens(cwe), q)
        | F.array_contains(F.transform(q, lambda t: F.replace(t, F.lit("-"), F.lit(""))), F.replace(cwe, F.lit("-"), F.lit("")))
    )
    return F.round(source_priority(meta) + overlap + fields + F.when(cwe_hit, 1.0).otherwise(0.0), 4)


def keep_best(df: DataFrame, keys: Sequence[str | Column], position: Sequence[Column], meta: str = "metadata") -> DataFrame:
    """RNK-04 / RNK-05: per key the row with the most complete metadata, the first on ties."""
    return top_n(df, list(keys), [F.desc(T.metadata_completeness(meta)), *position], 1)


def deduplicate(df: DataFrame, scope: Sequence[str], position: Sequence[Column]) -> DataFrame:
    """By document id, then by white-space-free content; empty content falls
    back to the id."""
    one = keep_best(df, [*scope, "document_id"], position)
    fp = T.content_fingerprint("content")
    # the text itself is not shuffled as a key: its hash and length are
    key = F.when(fp == "", F.concat(F.lit("id_fp_"), "document_id")).otherwise(F.concat(F.sha2(fp, 256), F.length(fp).cast("string")))
    return keep_best(one.withColumn("_fp", key), [*scope, "_fp"], position).drop("_fp")


def rank_context(candidates: DataFrame, scope: Sequence[str], position: Sequence[Column], top_k: int = 10) -> DataFrame:
    """RNK-01 over deduplicated candidates: score, priority, id."""
    rows = deduplicate(candidates, scope, position).withColumns({
        "source_category": source_category(F.col("default_category")),
        "relevance_score": relevance(),
        "source_priority": source_priority(),
    })
    order = [F.desc("relevance_score"), F.desc("source_priority"), F.col("document_id")]
    return top_n(rows, list(scope), order, top_k, rank="rank")


def balanced(ranked: DataFrame, scope: Sequence[str], top_k: int) -> DataFrame:
    """RNK-07: half of the slots per category; slots one side leaves go to the
    other, code evidence first; then re-ranked by score. Groups hold at most the
    ranked candidates of one query."""
    q = min(top_k, MAX_CONTEXT // 2)
    order = [F.col("rank")]
    ast = F.col("source_category") == "ast"
    kn = F.col("source_category") == "security_knowledge"
    per = Window.partitionBy(*scope)
    rows = ranked.withColumns({
        "_na": F.count_if(ast).over(per), "_nk": F.count_if(kn).over(per),
        "_cr": F.row_number().over(Window.partitionBy(*scope, "source_category").orderBy(*order)),
    })
    a, n = F.least("_na", F.lit(q)), F.least("_nk", F.lit(q))
    left = F.lit(MAX_CONTEXT) - a - n
    more_a = F.least(F.col("_na") - a, left)
    more_n = F.least(F.col("_nk") - n, left - more_a)
    keep = rows.filter((ast & (F.col("_cr") <= a + more_a)) | (kn & (F.col("_cr") <= n + more_n))).drop("_na", "_nk", "_cr", "rank")
    return top_n(keep, list(scope), [F.desc("relevance_score"), F.col("document_id")], MAX_CONTEXT, rank="rank")


def sections(context: DataFrame, meta: str = "metadata") -> DataFrame:
    """Bounded content and the section each document belongs to."""
    kind = F.lower(F.coalesce(F.try_element_at(F.col(meta), F.lit("document_type")), F.lit("unknown")))
    signal = F.coalesce(F.try_element_at(F.col(meta), F.lit("signal_type")), F.lit("")) != ""
    cat = F.col("source_category")
    section = (
        F.when((kind == "security_evidence") | ((cat == "ast") & signal), "security_evidence")
        .when((kind == "security_knowledge") | (cat == "security_knowledge"), "security_knowledge")
        .otherwise("code_structure")
    )
    return context.withColumns({"content": T.truncate("content", MAX_CONTENT), "section": section})


def hybrid_context(queries: DataFrame, vectors: DataFrame, documents: DataFrame, top_k: int = 5) -> DataFrame:
    """The whole retrieval: two kNN probes per query, ranking, quota, sections.

    ``queries``: (query_id, query_text, embedding); ``documents``: (collection,
    document_id, content, metadata). Only the nearest candidates are joined to
    texts, so the texts of a query's candidates, never all pairs, are scored."""
    q = queries.select(F.col("query_id").cast("string").alias("query_id"), T.tokens("query_text").alias("query_tokens"))
    rows = candidates(queries, vectors, documents, top_k).join(q, "query_id").withColumns({
        "content_tokens": T.tokens("content"),
        "default_category": F.when(F.col("collection") == "knowledge", "security_knowledge").otherwise("ast"),
    })
    pos = [F.when(F.col("collection") == "knowledge", 1).otherwise(0), F.col("distance"), F.col("document_id")]
    ranked = rank_context(rows, ["query_id"], pos, MAX_CONTEXT * 2)
    return sections(balanced(ranked, ["query_id"], top_k))


def candidates(queries: DataFrame, vectors: DataFrame, documents: DataFrame, top_k: int) -> DataFrame:
    """The nearest documents of every query with their texts, before ranking."""
    d = documents.withColumn("document_id", F.col("document_id").cast("string"))
    return knn(queries, vectors, top_k).join(d, ["collection", "document_id"])


def retrieval_counters(found: DataFrame, scope: Sequence[str], position: Sequence[Column], meta: str = "metadata") -> DataFrame:
    """AGR-32: per scope the results of each collection before duplicates go, and how
    many stay by id and then by text (``deduplicate``). One pass: the rows of an id,
    then the ids of a text, then the texts of a scope are counted; ``position`` must
    be ascending."""
    code = (F.col("collection") != "knowledge").cast("int")
    fp = T.content_fingerprint("content")
    key = F.when(fp == "", F.concat(F.lit("id_fp_"), "document_id")).otherwise(F.concat(F.sha2(fp, 256), F.length(fp).cast("string")))
    rows = found.select(*scope, "document_id", code.alias("_code"), key.alias("_fp"), F.struct(-T.metadata_completeness(meta), *position).alias("_order"))
    ids = rows.groupBy(*scope, "document_id").agg(F.sum("_code").alias("_code"), F.count(F.lit(1)).alias("_all"), F.min_by("_fp", "_order").alias("_fp"))
    texts = ids.groupBy(*scope, "_fp").agg(F.sum("_code").alias("_code"), F.sum("_all").alias("_all"))
    return texts.groupBy(*scope).agg(
        F.sum("_code").alias("ast_result_count"), F.sum(F.col("_all") - F.col("_code")).alias("knowledge_result_count"),
        F.count(F.lit(1)).alias("deduplicated_count"))


def evidence_documents(documents: DataFrame, findings: DataFrame, scope: Sequence[str], position: Sequence[Column], cap: int = MAX_CONTEXT) -> DataFrame:
    """JOI-09: documents whose evidence id a finding of their scope has, the first
    ``cap`` of each scope by ``position``; ids that are null or empty match nothing."""
    keys = findings.filter(F.coalesce("evidence_id", F.lit("")) != "").select(*scope, "evidence_id")
    return top_n(documents.join(keys, [*scope, "evidence_id"], "left_semi"), list(scope), list(position), cap)


def context_counts(context: DataFrame) -> DataFrame:
    """AGR-31: documents per query and source category."""
    cat = F.col("source_category")
    return context.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("context_document_count"),
        F.count_if(cat == "ast").alias("ast_context_count"),
        F.count_if(cat == "security_knowledge").alias("security_knowledge_context_count"),
    )


def cached_embedding_join(incoming: DataFrame, cache: DataFrame, text: str = "content") -> DataFrame:
    """JOI-20: look texts up in an embedding cache by content hash. The cache
    holds one row per hash, so the join never multiplies rows."""
    c = cache.select("content_hash", F.col("embedding").alias("cached"))
    return incoming.withColumn("content_hash", F.sha2(text, 256)).join(c, "content_hash", "left")


def exact_curated(findings: DataFrame, catalog: DataFrame, position: str) -> DataFrame:
    """JOI-17: the first catalog document with the finding's weakness id."""
    first = catalog.groupBy(F.upper(T.strip("cwe_id")).alias("cwe_key")).agg(
        F.min_by("document_id", F.col(position)).alias("curated_id"))
    return findings.withColumn("cwe_key", F.upper(T.strip("cwe_id"))).join(first, "cwe_key", "left").drop("cwe_key")


def curated_by_cwe_or_topic(findings: DataFrame, catalog: DataFrame, position: str) -> DataFrame:
    """JOI-18: the first catalog document that has the weakness id, or whose topic
    contains, or is contained in, the signal type. The either-way substring test
    becomes two equi joins: every substring of a distinct signal, the empty one
    too, is looked up among topics, and every substring of a topic among
    signals. A document without a topic thus fits every signal."""
    sigs = findings.select("signal_type", "cwe_id").distinct()
    low = F.lower("signal_type")
    cat = catalog.groupBy(F.col("cwe_id").alias("c_cwe"), F.coalesce(F.lower("security_topic"), F.lit("")).alias("topic")).agg(
        F.min(position).alias("pos"), F.min_by("document_id", position).alias("document_id"))

    def substrings(c: Column) -> Column:
        n = F.length(c)
        starts = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
        return F.array_distinct(F.flatten(F.transform(starts, lambda s: F.transform(
            F.sequence(F.lit(1), F.greatest(n - s + 1, F.lit(1))), lambda m: F.substring(c, s, m)))))

    by_cwe = sigs.join(cat, F.col("cwe_id") == F.col("c_cwe")).select("signal_type", "cwe_id", "pos", "document_id")
    inside = sigs.withColumn("part", F.explode(F.array_distinct(F.concat(substrings(F.coalesce(low, F.lit(""))), F.array(F.lit("")))))).join(cat, F.col("part") == F.col("topic")).select(
        "signal_type", "cwe_id", "pos", "document_id")
    around = cat.withColumn("part", F.explode(substrings(F.col("topic")))).join(
        sigs.withColumn("low", low), F.col("part") == F.col("low")).select("signal_type", "cwe_id", "pos", "document_id")
    first = by_cwe.unionByName(inside).unionByName(around).groupBy("signal_type", "cwe_id").agg(
        F.min_by("document_id", "pos").alias("curated_id"))
    f = first.select(F.col("signal_type").alias("s"), F.col("cwe_id").alias("c"), "curated_id")
    return findings.join(f, F.col("signal_type").eqNullSafe(F.col("s")) & F.col("cwe_id").eqNullSafe(F.col("c")), "left").drop("s", "c")
