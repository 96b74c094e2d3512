"""Incremental ingest: only changed documents are cut, only unknown texts are embedded."""

import os
import random

from pyspark.sql import functions as F

from tidewatch.functions.embedding import embed
from tidewatch.session import shared_dir
from tidewatch.sinks.knowledge import Ingested, KnowledgeStore, load_documents

SCHEMA = "document_id string, content string, metadata map<string,string>, at int, chunk_id string"


def plain(text, size, overlap):
    out, start = [], 0
    while start < len(text):
        out.append(text[start:start + size])
        if start + size >= len(text):
            break
        start += size - overlap
    return out


def stored(store):
    return sorted((r["document_id"], r["chunk_id"], r["content"]) for r in store.chunks().collect())


def want(texts):
    return sorted((d, f"{d}_chunk_{i + 1}", c) for d, t in texts.items() for i, c in enumerate(plain(t, 10, 2)))


def test_incremental_ingest(spark, rows):
    store = KnowledgeStore(spark, shared_dir(spark, "knowledge-test"), embed, 10, 2, 4)
    texts = {"a": "abcdefghijklmnopqrstuvwxyz", "b": "abcdefghij", "c": "same text!", "d": "same text!", "e": ""}
    first = [(d, t, {"k": None}, 1, "clash") for d, t in texts.items()]
    odd = [(None, "x", {}, 1, ""), ("", "x", {}, 1, ""), ("f", None, {}, 1, ""), ("g", "x", None, 1, ""), ("b", "an older text", {}, 9, ""), first[0]]
    # a has three chunks, of which the first is also b's text; c and d share one text
    assert store.ingest(rows(first + odd, SCHEMA), [F.col("at")]) == Ingested(5, 0, 6, 4, 0)
    assert stored(store) == want(texts)
    number = store.tables.snapshot().number
    assert store.ingest(rows(first[::-1], SCHEMA), [F.col("at")]) == Ingested(0, 5, 0, 0, 0) and store.tables.snapshot().number == number
    assert store.ingest(rows([], SCHEMA)) == Ingested(0, 0, 0, 0, 0)
    # a shrinks to its first chunk and one new text, e gets a known text, c changes its metadata only
    texts |= {"a": "abcdefghij12", "e": "same text!"}
    again = [("a", texts["a"], {"k": None}, 1, ""), ("b", texts["b"], {"k": ""}, 1, ""), ("e", texts["e"], {"k": None}, 1, ""), ("c", texts["c"], {"k": "v"}, 1, "")]
    assert store.ingest(rows(again, SCHEMA)) == Ingested(3, 1, 4, 1, 2)
    assert stored(store) == want(texts)
    meta = {r["chunk_id"]: r["metadata"] for r in store.chunks().collect()}
    assert meta["c_chunk_1"] == {"k": "v", "document_type": "security_knowledge", "source_type": "knowledge_base", "parent_document_id": "c", "chunk_index": "1"}
    vectors = store.chunks().select("embedding", embed("content").alias("made")).collect()
    assert all(r["embedding"] == r["made"] for r in vectors)
    store.remove(rows([("a",), ("zz",)], "document_id string"))
    del texts["a"]
    assert stored(store) == want(texts) and store.documents().count() == 4


def test_other_chunk_sizes_count_as_changed(spark, rows):
    root = shared_dir(spark, "knowledge-size")
    docs = rows([("a", "abcdefghijklmnop", {}, 1, "")], SCHEMA)
    assert KnowledgeStore(spark, root, embed, 10, 2, 2).ingest(docs) == Ingested(1, 0, 2, 2, 0)
    store = KnowledgeStore(spark, root, embed, 8, 0, 2)
    # the second chunk has the text of an earlier one
    assert store.ingest(docs) == Ingested(1, 0, 2, 1, 1) and [c for _, _, c in stored(store)] == ["abcdefgh", "ijklmnop"]


def test_defaults_of_documents(rows):
    docs = rows([("a", "t", {"source_type": "own", "document_type": "other", "n": None}, 1, ""), ("b", "", {}, 1, "")], SCHEMA)
    got = {r["document_id"]: r["metadata"] for r in load_documents(docs).collect()}
    assert got == {"a": {"source_type": "own", "document_type": "security_knowledge", "n": ""},
                   "b": {"source_type": "knowledge_base", "document_type": "security_knowledge"}}


def written(folder):
    return sum(os.path.getsize(os.path.join(p, f)) for p, _, names in os.walk(folder) for f in names)


def test_ingest_writes_less_than_the_texts(spark, rows):
    rand, root = random.Random(5), shared_dir(spark, "knowledge-size")
    words = ["".join(rand.choices("abcdefghijklmnopqrstuvwxyz", k=rand.randint(2, 9))) for _ in range(400)]
    texts = {str(i): " ".join(rand.choices(words, k=3000)) for i in range(120)}
    shared, store = spark.conf.get("spark.checkpoint.dir"), KnowledgeStore(spark, root, embed, 1000, 100, 4)
    before = written(shared)
    store.ingest(rows([(d, t, {"k": "v"}, 1, "") for d, t in texts.items()], SCHEMA))
    texts = {d: t if int(d) % 3 else t[:900] + " changed" for d, t in texts.items()}
    did = store.ingest(rows([(d, t, {"k": "v"}, 1, "") for d, t in texts.items()] * 2, SCHEMA))
    assert (did.changed, did.unchanged, did.embedded) == (40, 80, 40)
    # both versions of the store, compressed, and nothing besides
    assert written(shared) - before < 1.3 * sum(map(len, texts.values())) and not [d for d in os.listdir(f"{root}/work")]
    want = sorted((d, f"{d}_chunk_{i + 1}", c) for d, t in texts.items() for i, c in enumerate(plain(t, 1000, 100)))
    assert stored(store) == want and store.chunks().filter("embedding IS NULL OR metadata IS NULL OR content_hash IS NULL").isEmpty()
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None
