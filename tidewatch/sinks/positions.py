"""Rows of Parquet files by their position (SNK-01, SNK-15).

A choice of rows is kept as one bit per row and file block. A scan of the files
then keeps or drops rows by their bit, so that their texts are not shuffled for
a join. The bits are a small table: Spark's own size check sends it to the
tasks, or joins by file block where it is too large for that."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILE, ROW = "_file", "_row"


def located(rows: DataFrame) -> DataFrame:
    """Rows as read from Parquet files, with file and position in it."""
    return rows.select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW))


def choose(rows: DataFrame, chosen: DataFrame, path: str, keep: bool = True) -> DataFrame:
    """The ``located`` rows whose position is (``keep``) or is not in ``chosen``,
    without their positions. The bits are written to ``path``, which must live as
    long as the result is read."""
    block, bit = F.bitmap_bucket_number(F.col(ROW)), F.bitmap_bit_position(F.col(ROW))
    bits = chosen.groupBy(F.col(FILE).alias("_in"), block.alias("_block")).agg(F.bitmap_construct_agg(bit).alias("_bits"))
    bits.write.parquet(path)
    bits = rows.sparkSession.read.schema("_in string, _block long, _bits binary").parquet(path)
    byte = F.conv(F.hex(F.substring("_bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))
    met = rows.join(bits, (F.col(FILE) == F.col("_in")) & (block == F.col("_block")), "inner" if keep else "left")
    return met.filter(hit if keep else ~hit).drop(FILE, ROW, "_in", "_block", "_bits")
