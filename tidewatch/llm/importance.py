"""Importance resampling towards a target by hashed word runs, with shared lines
counted once.

Texts are cut into lines at newlines, which separate words anyway. The features
of each distinct line are hashed once and kept as a short byte string; corpus
counts multiply them by the line's occurrences, and weights of documents sum the
weights of their lines. Runs of words that cross a line end belong to no line
and are added document by document."""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.llm.common import by_slices, written

#: Bytes of words as they are, A-Z lowered, newlines kept and all others blank.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b == 10 or 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: A line with at least one part in so many of all lines is joined by broadcast; so many exist at most.
FREQUENT = 4096
#: Slices of the score range; only those that hold drawn rows are ordered.
SLICES = 256


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").translate(_BYTES).split()


def features(ws: list[bytes], buckets: int) -> tuple[list[int], list[int], list[int]]:
    """Buckets of all runs of one, two and three words, by first word. The
    checksum of a longer run goes on from that of the shorter one."""
    spaced = [b" " + w for w in ws]
    one = list(map(crc32, ws))
    two = list(map(crc32, spaced[1:], one))
    three = list(map(crc32, spaced[2:], two))
    return tuple([c % buckets for c in run] for run in (one, two, three))


def packed(found: list[int]) -> bytes:
    """Sorted buckets as steps: small numbers, which files compress well."""
    return np.diff(np.sort(np.array(found, dtype=np.int32)), prepend=np.int32(0)).astype("<u4").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, dtype="<u4"), dtype=np.int64)


def crossing(text: str | None, buckets: int) -> tuple[int, list[int]]:
    """Number of words, and the buckets of the runs that cross a line end."""
    lines = [ws for line in (text or "").encode("utf-8").translate(_BYTES).split(b"\n") if (ws := line.split())]
    found: list[int] = []
    starts, total = [], 0
    for ws in lines:
        starts.append(total)
        total += len(ws)
    if len(lines) > 1:
        # only the last two words before a line end and the first two after it meet in such runs
        flat: list[bytes] = []
        owner: list[int] = []
        at: list[int] = []
        for i, ws in enumerate(lines):
            for j in range(len(ws)) if len(ws) < 5 else (0, 1, len(ws) - 2, len(ws) - 1):
                flat.append(ws[j])
                owner.append(i)
                at.append(starts[i] + j)
        _, two, three = features(flat, buckets)
        found += [b for i, b in enumerate(two) if owner[i] != owner[i + 1] and at[i + 1] - at[i] == 1]
        found += [b for i, b in enumerate(three) if owner[i] != owner[i + 2] and at[i + 2] - at[i] == 2]
    return total, found


def _name(column: str) -> list:
    return [F.xxhash64(column).alias("a"), F.xxhash64(F.lit(1), column).alias("b")]


def line_table(texts: DataFrame, buckets: int) -> DataFrame:
    """Distinct lines that are not empty: their names a and b (128 bits), the
    number n of occurrences, and their buckets. Lines are counted before the
    shuffle. Written out, as it is used twice."""
    lines = texts.select(F.explode(F.split("text", "\n")).alias("line")).filter("line <> ''")
    counted = lines.groupBy("line").agg(F.count(F.lit(1)).alias("n")).select(*_name("line"), "n", "line")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data = [packed(sum(features(words(t), buckets), [])) for t in batch.column("line").to_pylist()]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "b", "n")), pa.array(data, pa.binary())], names=["a", "b", "n", "found"])

    return written(counted.mapInArrow(by_slices(run, 1024), "a long, b long, n long, found binary"), "lines", compression="zstd")


def row_table(texts: DataFrame, buckets: int) -> DataFrame:
    """Per row: uid (a number of its own), its columns other than the text, the
    number of words, the buckets of runs across lines and the names of its
    lines. Written out, so that uid stays the same."""
    names = F.transform(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x != ""), lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b")))
    kept = [c for c in texts.columns if c != "text"]
    source = texts.select(*kept, names.alias("names"), "text")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        both = [crossing(t, buckets) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in (*kept, "names")), pa.array([n for n, _ in both], pa.int64()), pa.array([packed(f) for _, f in both], pa.binary())],
            names=[*kept, "names", "n_words", "found"])

    made = source.mapInArrow(by_slices(run), f"{ddl}, n_words long, found binary")
    return written(made.withColumn("uid", F.monotonically_increasing_id()), "rows", compression="zstd")


def bucket_counts(lines: DataFrame, rows: DataFrame, buckets: int) -> np.ndarray:
    """Features of the whole table by bucket: lines times their occurrences, and
    runs across lines. Each task sends one count per bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for data, n in zip(batch.column("found").to_pylist(), batch.column("n").to_pylist()):
                total += n * np.bincount(unpacked(data), minlength=buckets) if len(data) > 4 * buckets else 0
                if len(data) <= 4 * buckets:
                    np.add.at(total, unpacked(data), n)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "k"])

    both = lines.select("found", "n").unionByName(rows.select("found", F.lit(1).cast("long").alias("n")))
    out = np.zeros(buckets, dtype=np.int64)
    for r in both.mapInArrow(run, "bucket int, k long").groupBy("bucket").agg(F.sum("k").alias("k")).collect():
        out[r["bucket"]] = r["k"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(p/q)) by bucket, with one added to every count."""
    all_source, all_target, b = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((t + 1) * (all_source + b) / ((s + 1) * (all_target + b)))) for s, t in zip(source.tolist(), target.tolist())], dtype=np.int64)


def _weighed(df: DataFrame, gain: np.ndarray) -> DataFrame:
    """``df`` with the sum of gains in place of the buckets."""
    kept = [c for c in df.columns if c != "found"]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [int(gain[unpacked(data)].sum()) for data in batch.column("found").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sums, pa.int64())], names=[*kept, "w"])

    return df.mapInArrow(run, f"{ddl}, w long")


def row_weights(lines: DataFrame, rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, uid, n_words and weight of every row. A line's weight is taken
    once and joined by the line's name: frequent lines (at most ``FREQUENT``) by
    broadcast, so that no name of the shuffled join holds many rows."""
    total = lines.agg(F.sum("n")).first()[0] or 0
    own = _weighed(lines.select("a", "b", "n", "found"), gain)
    often = F.broadcast(own.filter(F.col("n") * FREQUENT >= total).select("a", "b", F.col("w").alias("hot")))
    pairs = rows.select("uid", F.explode("names").alias("x")).select("uid", "x.a", "x.b").join(often, ["a", "b"], "left")
    rest = pairs.filter("hot is null").select("uid", "a", "b").join(own.filter(F.col("n") * FREQUENT < total).select("a", "b", "w"), ["a", "b"])
    none = rows.sparkSession.createDataFrame([], rows.select("doc_id").schema)
    void = [F.lit(None).cast(none.schema["doc_id"].dataType).alias("doc_id"), F.lit(None).cast("long").alias("n_words")]
    parts = _weighed(rows.select("uid", "doc_id", "n_words", "found"), gain).select("uid", "w", "doc_id", "n_words")
    parts = parts.unionByName(pairs.filter("hot is not null").select("uid", F.col("hot").alias("w"), *void)).unionByName(rest.select("uid", "w", *void))
    return parts.groupBy("uid").agg(F.sum("w").alias("weight"), F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"))


def drawn(scored: DataFrame, percent: int, min_words: int) -> DataFrame:
    """``scored`` plus rank: of the N rows with enough words the first
    floor(percent N / 100) by falling score, then doc_id (null last), get 1, 2,
    3...; the others null. Slices of the score range are counted first, and only
    slices with drawn rows are ordered, each in a task of its own."""
    able = scored.filter(F.col("n_words") >= min_words)
    n = able.count()
    last = n * percent // 100
    if not last:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    share = last / n
    # some edges below the last drawn row, so that an inexact quantile cannot leave it in the large rest
    edges = sorted(set(able.approxQuantile("score", [max(0.0, 1 - share * i / SLICES) for i in range(1, SLICES * 5 // 4)], 1 / (64 * SLICES))), reverse=True)
    part = F.expr(f"size(filter(array({', '.join(f'{e}D' for e in edges)}), e -> score < e))")  # 0 holds the highest scores
    cut = scored.withColumn("slice", F.when(F.col("n_words") >= min_words, part))
    sizes = {r["slice"]: r["count"] for r in cut.filter("slice is not null").groupBy("slice").count().collect()}
    starts, before = {}, 0
    for s in sorted(sizes):
        starts[s], before = before, before + sizes[s]
    full = [s for s in starts if starts[s] < last]
    offset = F.element_at(F.create_map(*[F.lit(x) for s in full for x in (s, starts[s])]), F.col("slice"))
    numbered = cut.filter(F.col("slice") <= max(full)).withColumn(
        "rank", F.row_number().over(Window.partitionBy("slice").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))) + offset)
    numbered = numbered.withColumn("rank", F.when(F.col("rank") <= last, F.col("rank")).cast("long"))
    others = cut.filter(F.col("slice").isNull() | (F.col("slice") > max(full))).withColumn("rank", F.lit(None).cast("long"))
    return numbered.unionByName(others).drop("slice")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, buckets: int = 10_000, seed: int = 42) -> DataFrame:
    """One row per document row: doc_id, n_words, n_features, weight, score, rank.

    Importance resampling without replacement: weight is the sum of gains of all
    runs of one to three words, and score adds Gumbel noise that doc_id alone
    decides. Null and empty texts have no features and weight 0; a text of any
    length is taken whole. A null doc_id hashes as an empty one. Rows that repeat
    a doc_id each have their score; equal scores go by doc_id, and equal rows
    take neighbouring ranks in any order. Empty tables: an empty corpus gives no
    rows, an empty target leaves the add-one counts. Other columns are not
    read."""
    texts, goal = docs.select("doc_id", "text"), target.select("text")
    lines, rows = line_table(texts, buckets), row_table(texts, buckets)
    gain = gains(bucket_counts(lines, rows, buckets), bucket_counts(line_table(goal, buckets), row_table(goal, buckets), buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")
    n = F.col("n_words")
    scored = row_weights(lines, rows, gain).select(
        "doc_id", "n_words", (n + F.greatest(n - 1, F.lit(0)) + F.greatest(n - 2, F.lit(0))).alias("n_features"), "weight", (F.col("weight") + noise).alias("score"))
    return drawn(written(scored, "scores"), percent, min_words)
