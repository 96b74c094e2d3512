"""Point-in-interval joins as equi joins (JOI-11, JOI-12).

Every interval is cut into few aligned blocks of size 1, 4, 16, ...; a point lies
in exactly one block per size. Joining on (key, level, block) finds precisely the
intervals that contain the point, without a range condition and without listing
the lines of long intervals. Blocks also spread a hot key over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOP = 11  # highest level; blocks there cover 4**11 positions, repeated as often as needed
#: For lines of source files: blocks of up to 1,024 lines; longer spans take several.
LINES_TOP = 5
#: Lines of a block where each interval is listed in all blocks it touches.
LINE_BLOCK = 256


def _run(lo: str, hi: str) -> str:
    """Block numbers lo..hi, empty when lo > hi."""
    return f"CASE WHEN {lo} <= {hi} THEN sequence({lo}, {hi}) ELSE CAST(array() AS array<bigint>) END"


def _blocks(start: str, end: str, top: int) -> Column:
    """Aligned blocks that make up start..end: at each level those inside the
    interval whose parent block is not inside it."""
    s, e = f"CAST({start} AS BIGINT)", f"CAST({end} AS BIGINT)"
    lo = f"shiftright({s} + shiftleft(1L, 2 * l) - 1, 2 * l)"
    hi = f"(shiftright({e} + 1, 2 * l) - 1)"
    plo = f"shiftright({s} + shiftleft(1L, 2 * l + 2) - 1, 2 * l + 2)"
    phi = f"(shiftright({e} + 1, 2 * l + 2) - 1)"
    ids = (
        f"CASE WHEN l < {top} AND {plo} <= {phi} THEN concat({_run(lo, f'{plo} * 4 - 1')}, {_run(f'{phi} * 4 + 4', hi)}) "
        f"ELSE {_run(lo, hi)} END"
    )
    return F.expr(f"flatten(transform(sequence(0, {top}), l -> transform({ids}, b -> struct(l AS level, b AS block))))")


def containing(
    points: DataFrame, intervals: DataFrame, keys: Sequence[str], point: str, start: str, end: str, how: str = "inner", top: int = TOP
) -> DataFrame:
    """Join points with every interval of the same key that contains them. With
    ``how="left"`` a point also appears once per level it found nothing at, with
    empty interval columns. ``top`` is the highest level: fewer levels make fewer
    copies of a point and more blocks of a very long interval."""
    at = F.expr(f"transform(sequence(0, {top}), l -> struct(l AS level, shiftright(CAST({point} AS BIGINT), 2 * l) AS block))")
    p = points.select("*", F.explode(at).alias("_at")).select("*", F.col("_at.level").alias("_level"), F.col("_at.block").alias("_block")).drop("_at")
    i = intervals.filter(F.col(start) <= F.col(end)).select("*", F.explode_outer(_blocks(start, end, top)).alias("_in")).select(
        "*", F.col("_in.level").alias("_level"), F.col("_in.block").alias("_block")).drop("_in")
    return p.join(i, [*keys, "_level", "_block"], how).drop("_level", "_block")


def blocked(points: DataFrame, intervals: DataFrame, point: str, start: str, end: str, width: int = LINE_BLOCK) -> tuple[DataFrame, DataFrame]:
    """Points and intervals with ``_block``, for a join on it and on a key, with the
    range as a further condition: a point is one row, an interval one row for each
    block of ``width`` positions it touches. For lines of source files, whose
    spans rarely leave a block. The rows of intervals are made here, so Spark
    takes them for fewer than they are: they are merged, never broadcast."""
    p = points.withColumn("_block", F.floor(F.col(point) / width).cast("long"))
    i = intervals.filter(F.col(start) <= F.col(end)).withColumn(
        "_block", F.explode(F.sequence(F.floor(F.col(start) / width).cast("long"), F.floor(F.col(end) / width).cast("long"))))
    return p, i.hint("merge")
