"""Vectors as the bytes that an engine stores them in (ARR-01)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.BinaryType())
def to_blob(vectors: pd.Series) -> pd.Series:
    """Four bytes for each number, the lowest first; null stays null."""
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def of_blob(blobs: pd.Series) -> pd.Series:
    """The numbers of whole groups of four bytes; bytes behind the last one are passed over."""
    return blobs.map(lambda b: None if b is None else np.frombuffer(b[: len(b) // 4 * 4], "<f4"))
