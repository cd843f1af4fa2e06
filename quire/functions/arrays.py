"""Running sums over an array column."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.ArrayType(T.LongType()))
def starts(lengths: pd.Series) -> pd.Series:
    """Where each piece starts, given the lengths of all: the sum of those before it.

    Only the lengths cross to Python, in Arrow batches; the built-in array
    functions would copy the whole array at every step.
    """
    return lengths.map(lambda a: None if a is None else np.concatenate(([0], np.cumsum(a[:-1], dtype=np.int64))) if len(a) else [])
