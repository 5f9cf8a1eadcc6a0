"""Makes the package importable on executors."""

from __future__ import annotations

import pathlib
import shutil
import tempfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers of this application, once."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = pathlib.Path(__file__).resolve().parent
    base = pathlib.Path(tempfile.mkdtemp(prefix="fleetpulse-package-")) / "fleetpulse_package"
    spark.sparkContext.addPyFile(shutil.make_archive(str(base), "zip", root.parent, root.name))
    _shipped.add(app)
