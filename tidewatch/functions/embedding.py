"""Offline embedding of text (UDF-04): counts of distinct tokens in 64 hash bins.

Tokens and their bins are computed by Spark; only the counting of bins is an
Arrow batch function. Counts are small integers, so distances are exact."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from tidewatch.functions.text import tokens

BINS = 64


def token_bins(c: str | Column) -> Column:
    """Hash bin of every distinct token: first byte of its MD5, modulo 64."""
    return F.transform(tokens(c), lambda t: F.pmod(F.conv(F.substring(F.md5(t), 1, 2), 16, 10).cast("int"), F.lit(BINS)))


@F.pandas_udf(ArrayType(FloatType()))
def _count_bins(bins: pd.Series) -> pd.Series:
    return pd.Series([np.bincount(np.asarray(b, dtype=np.int64), minlength=BINS).astype(np.float32) for b in bins])


def embed(c: str | Column) -> Column:
    return _count_bins(token_bins(c))
