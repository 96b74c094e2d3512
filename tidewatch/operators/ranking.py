"""Ranking helpers whose work splits even when one group holds most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_n(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column], n: int, rank: str | None = None) -> DataFrame:
    """First ``n`` rows per group. The filter sits directly on the window, so
    Spark adds a group limit before the shuffle: each task sends at most ``n``
    rows per group and a hot group never arrives whole in one task."""
    name = rank or "_rn"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= n)
    return out if rank else out.drop(name)


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where NULL equals NULL, as in a grouping, so that no
    row with a NULL key is lost; the keys of ``left`` stay."""
    own = [f"_same{i}" for i in range(len(keys))]
    side = right.withColumnsRenamed(dict(zip(keys, own)))
    on = F.lit(True)
    for k, o in zip(keys, own):
        on = on & F.col(k).eqNullSafe(F.col(o))
    return left.join(side, on, how).drop(*own)


def ranked_limit(df: DataFrame, order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """Global top ``n`` with 1-based ranks: a distributed top-k first, then the
    window runs over at most ``n`` rows."""
    top = df.orderBy(*order).limit(n)
    return top.withColumn(rank, F.row_number().over(Window.orderBy(*order)).cast("int"))


def position_in_group(
    df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], name: str
) -> DataFrame:
    """0-based position of every row in its group, for groups of any size.

    ``bucket`` must grow with ``order`` (for instance ``floor(line / 1024)``).
    Rows are numbered inside (group, bucket); the start of each bucket comes
    from a running sum over one pre-aggregated row per bucket, so only those
    counts, never the rows, are brought together per group.
    """
    b = df.withColumn("_bucket", bucket)
    starts = b.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    local = b.withColumn("_pos", F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order)) - 1)
    cond = None
    starts = starts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_kb"), "_start")
    for i, k in enumerate(keys):
        part = F.col(k).eqNullSafe(F.col(f"_k{i}"))
        cond = part if cond is None else cond & part
    same_bucket = F.col("_bucket").eqNullSafe(F.col("_kb"))
    cond = same_bucket if cond is None else cond & same_bucket
    joined = local.join(starts, cond)
    return joined.withColumn(name, (F.col("_pos") + F.col("_start")).cast("long")).drop(
        "_pos", "_start", "_bucket", "_kb", *[f"_k{i}" for i in range(len(keys))]
    )


def exact_quantiles(df: DataFrame, key: str, value: str, probs: dict[str, float], width: float = 1.0) -> DataFrame:
    """Interpolated quantiles per key for groups of any size.

    Values are counted first. Each (key, bucket of ``width``) is numbered on its
    own and starts where a running sum over the bucket totals says, so no task
    holds all distinct values of a key. The two order statistics around each
    quantile are then picked by a grouped maximum."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(key).alias("_k"), F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_b", F.floor(F.col("_v") / width))
    totals = counts.groupBy("_k", "_b").agg(F.sum("_n").alias("_t"))
    by_bucket = Window.partitionBy("_k").orderBy("_b")
    totals = totals.withColumns({
        "_start": F.coalesce(F.sum("_t").over(by_bucket.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_all": F.sum("_t").over(Window.partitionBy("_k")),
    }).drop("_t")
    inside = Window.partitionBy("_k", "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = counts.withColumn("_to", F.sum("_n").over(inside)).join(totals, ["_k", "_b"])
    rows = rows.withColumn("_to", F.col("_to") + F.col("_start"))  # exclusive end of this value's positions
    picks = []
    for name, p in probs.items():
        at = (F.col("_all") - 1) * F.lit(p)
        for side, pos in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            hit = (pos < F.col("_to")) & (pos >= F.col("_to") - F.col("_n"))
            picks.append(F.max(F.when(hit, F.col("_v"))).alias(f"_{name}_{side}"))
        picks.append(F.max(at - F.floor(at)).alias(f"_{name}_f"))
    out = rows.groupBy("_k").agg(*picks)
    return out.select(F.col("_k").alias(key), *[
        (F.col(f"_{n}_lo") + F.col(f"_{n}_f") * (F.col(f"_{n}_hi") - F.col(f"_{n}_lo"))).alias(n) for n in probs])


def beside(*parts: DataFrame) -> DataFrame:
    """One-row counter frames put into one row: stacked, then summed column by
    column, so no cross join is needed."""
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p, allowMissingColumns=True)
    return stacked.agg(*[F.sum(c).alias(c) for c in stacked.columns])


def once(df: DataFrame, name: str, column: Column) -> DataFrame:
    """Add a column that is computed once per row. The optimizer would otherwise
    copy a long expression into every later use of it, and into filters on it;
    a one-element generator keeps it in one place."""
    return df.select("*", F.explode_outer(F.array(column)).alias(name))
