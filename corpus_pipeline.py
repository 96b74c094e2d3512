"""A corpus pipeline: language ID, line dedup, near-dedup, decontamination, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor
kept; :func:`run` writes each stage's rows to the shared folder and reads them
again, so a lost executor costs no more than the stage at hand. All stages but
the last return the columns of documents. Null or empty texts end in the first
stage, which finds no language in them; an empty table stays empty. Rows that
repeat a doc_id are rows of their own in every stage but near-dedup, whose
docstring says which of them stay. Stages that shorten texts count ``n_chars``
anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import bpe, decontam, langid, line_templates, neardup
from tidewatch.llm.common import table, written
from tidewatch.llm.queries import tokenizer


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars``, where the table has it, counts the text as it is now."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with one clear language. The classifiers learn from the
    labelled rows of the documents at hand; without any, nothing is ambiguous."""
    found = langid.identify(docs, langid.fit(langid.sample(docs)))
    return found.filter("lang_pred <> 'und' and not ambiguous").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes recurring line templates out of the texts; every document stays."""
    return _counted(line_templates.drop_recurring(docs).select(*docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays (five-word shingles, 0.8)."""
    return neardup.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages out; documents that mostly consist of them go."""
    return _counted(decontam.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids, and whether they decode to the text."""
    return bpe.verified(docs, *tokenizer())


STAGES = [
    ("language ID", language), ("line dedup", lines), ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination), ("byte-level BPE", tokens),
]

#: No SQL: classifiers, templates and token ids are not SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, "stage")
    return docs
