"""Nested JSON of unknown depth (FLT-19, SCL-13, SCL-15): VARIANT values, no Python.

Key stripping opens containers level by level, but only those whose text names a
forbidden key, and each different container once: what it becomes depends on its
text alone, so equal payloads share the work. Containers are put together again
from the deepest level upwards."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.session import shared_dir

# Fields that hold source text.
RAW_SOURCE_FIELDS = ("source_code", "raw_source", "full_source", "original_source", "code", "raw_code")

#: Levels put together in one job; more of them would make its plan long.
STORED_EACH = 6


def _stored(df: DataFrame, purpose: str) -> DataFrame:
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _holds(text: Column, names: Sequence[str]) -> Column:
    """Whether a container's text has one of the keys somewhere. Quotes inside
    strings are escaped, so a string value cannot look like a key."""
    found = F.lit(False)
    for n in names:
        found = found | F.contains(text, F.lit(f"{json.dumps(n, ensure_ascii=False)}:"))
    return F.left(text, F.lit(1)).isin("{", "[") & found


def _name(text: Column) -> Column:
    return F.sha2(text, 256)


def strip_keys(df: DataFrame, column: str, names: Sequence[str] = RAW_SOURCE_FIELDS) -> DataFrame:
    """FLT-19: ``column`` (JSON text) without the named keys, at any depth and
    inside arrays; keys come out in alphabetical order, without blanks. NULL
    stays NULL, text that is no JSON (or repeats a key in an object) becomes
    NULL, since nothing can be said about its fields; an object that loses all
    keys stays as an empty one. Names are compared exactly."""
    rows = df.withColumn(column, F.expr(f"to_json(try_parse_json(`{column}`))"))
    level = rows.filter(_holds(F.col(column), names)).select(F.col(column).alias("text")).distinct()
    levels, more = [], not level.isEmpty()
    while more:
        opened = level.select("text", F.expr("try_parse_json(text)").alias("v"))
        opened.createOrReplaceTempView("_opened")
        parts = df.sparkSession.sql(
            "SELECT sha2(text, 256) AS parent, left(text, 1) AS kind, e.pos, e.key, to_json(e.value) AS json FROM _opened LEFT JOIN LATERAL variant_explode(v) e")
        parts = parts.filter(F.col("key").isNull() | ~F.col("key").isin(list(names))).withColumn("open", F.coalesce(_holds(F.col("json"), names), F.lit(False)))
        whole = level.select(_name(F.col("text")).alias("parent"), F.left("text", F.lit(1)).alias("kind"))
        parts = _stored(parts, "nested")
        df.sparkSession.catalog.dropTempView("_opened")
        levels.append((whole, parts))
        deeper = parts.filter("open").select(F.col("json").alias("text"))
        level, more = deeper.distinct(), not deeper.isEmpty()
    below = None
    for i, (whole, parts) in enumerate(reversed(levels)):
        ready = parts.filter("not open and json is not null").select("parent", "pos", "key", "json")
        if below is not None:
            deep = parts.filter("open").withColumn("child", _name(F.col("json"))).drop("json")
            ready = ready.unionByName(deep.join(below.select(F.col("parent").alias("child"), F.col("clean").alias("json")), "child").select("parent", "pos", "key", "json"))
        quoted = F.to_json(F.array("key"))  # ["key"]
        label = F.when(F.col("key").isNotNull(), F.concat(F.substring(quoted, F.lit(2), F.length(quoted) - 2), F.lit(":"))).otherwise("")
        items = ready.groupBy("parent").agg(F.array_sort(F.collect_list(F.struct("pos", F.concat(label, "json").alias("item")))).alias("items"))
        inner = F.coalesce(F.array_join(F.transform("items", lambda x: x["item"]), ","), F.lit(""))
        made = whole.join(items, "parent", "left").select("parent", F.when(F.col("kind") == "{", F.concat(F.lit("{"), inner, F.lit("}"))).otherwise(F.concat(F.lit("["), inner, F.lit("]"))).alias("clean"))
        below = _stored(made, "nested") if i % STORED_EACH == STORED_EACH - 1 else made
    if below is None:
        return rows
    dirty = _holds(F.col(column), names)
    found = below.select(F.col("parent").alias("_parent"), F.col("clean").alias("_clean"))
    mended = rows.filter(dirty).join(found, _name(F.col(column)) == F.col("_parent")).withColumn(column, F.col("_clean")).select(*df.columns)
    return rows.filter(~F.coalesce(dirty, F.lit(False))).select(*df.columns).unionByName(mended)


def repository_name(summary: str) -> Column:
    """SCL-13: the repository of a JSON summary whose ``_repository`` is either
    text or an object with owner and repository: "owner/repository", or the one
    that is there; empty for anything else."""
    v = f"try_parse_json(`{summary}`)"
    get = lambda path: F.coalesce(F.expr(f"try_variant_get({v}, '$._repository{path}', 'string')"), F.lit(""))
    kind = F.coalesce(F.expr(f"schema_of_variant(try_variant_get({v}, '$._repository', 'variant'))"), F.lit(""))
    owner, name = get(".owner"), get(".repository")
    both = F.when((owner != "") & (name != ""), F.concat(owner, F.lit("/"), name)).when(name != "", name).otherwise(owner)
    return F.when(kind.startswith("OBJECT"), both).when(kind == "STRING", get("")).otherwise(F.lit(""))


def int_or(column: str, default: int = 0) -> Column:
    """SCL-15: a whole number, or the default for NULL and for anything else."""
    return F.coalesce(F.expr(f"try_cast(`{column}` AS INT)"), F.lit(default))
