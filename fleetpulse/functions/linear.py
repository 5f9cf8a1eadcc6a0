"""Small dense linear algebra on wide rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Above this many matrix entries the generated expression gets too long to compile.
EXPRESSION_ENTRIES = 256


def squared_norm(df: DataFrame, columns: Sequence[str], mean: Sequence[float], matrix: np.ndarray, name: str) -> DataFrame:
    """Squared length of ``matrix @ (x - mean)`` per row.

    Narrow rows use plain column arithmetic; wide rows go to NumPy in Arrow batches.
    """
    m = np.asarray(matrix, dtype=float)
    if m.size <= EXPRESSION_ENTRIES:
        total = F.lit(0.0)
        for row in m:
            dot = None
            for c, mu, a in zip(columns, mean, row):
                if a == 0.0:
                    continue
                term = F.lit(float(a)) * (F.col(c) - F.lit(float(mu)))
                dot = term if dot is None else dot + term
            if dot is not None:
                total = total + dot * dot
        return df.withColumn(name, total)

    center = np.asarray(mean, dtype=float)

    @F.pandas_udf("double")
    def norm(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for cols in batches:
            x = np.column_stack([c.to_numpy(dtype=float) for c in cols]) - center
            y = x @ m.T
            yield pd.Series(np.einsum("ij,ij->i", y, y))

    return df.withColumn(name, norm(*columns))
