"""Text of numbers where a file format asks for it; the engine itself keeps doubles."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


@F.pandas_udf(StringType())
def float_text(values: pd.Series) -> pd.Series:
    """The shortest text that reads back as the same double: 1e-07, 10000000.0, nan."""
    return values.map(lambda v: None if v is None else repr(float(v)), na_action=None)


@F.pandas_udf(StringType())
def fixed3(values: pd.Series) -> pd.Series:
    """Three decimals of the exact binary value, ties to even."""
    return values.map(lambda v: None if pd.isna(v) else f"{v:.3f}")


def python_round2(col):
    """Two decimals by the exact binary value, as a double."""
    return _round2(col)


@F.pandas_udf(DoubleType())
def _round2(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if pd.isna(v) else round(float(v), 2))
