from __future__ import annotations

import pathlib
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def trajectories(spark):
    """Three units in two splits; one unit has most of the rows."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(7)
    parts = []
    for split, unit, n in (("dev", 1, 900), ("dev", 2, 37), ("test", 3, 120)):
        parts.append(pd.DataFrame({
            "split": split, "unit_id": unit, "seq": np.arange(1, n + 1), "cycle": np.arange(n) // 7,
            "Xs_T48": rng.normal(size=n), "Xs_P2": rng.normal(size=n) * 3,
            "final_anomaly_score": rng.uniform(size=n) ** 2,
            "root_cause_pattern": rng.choice(["a", "b", "c"], size=n),
        }))
    return spark.createDataFrame(pd.concat(parts, ignore_index=True)).cache()


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def same(a, b, keys=("split", "unit_id", "seq"), tol=1e-9):
    """Both tables hold the same rows, numbers within a tolerance."""
    import numpy as np

    assert sorted(a.columns) == sorted(b.columns)
    cols = sorted(a.columns)
    x = a.select(cols).toPandas().sort_values(list(keys)).reset_index(drop=True)
    y = b.select(cols).toPandas().sort_values(list(keys)).reset_index(drop=True)
    assert len(x) == len(y)
    for c in cols:
        if x[c].dtype.kind == "f":
            assert np.allclose(x[c], y[c], atol=tol, equal_nan=True), c
        else:
            assert [str(v) for v in x[c]] == [str(v) for v in y[c]], c
