"""Python functions of this package on the executors."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand the package to the executors as a zip, once an application."""
    name = spark.sparkContext.applicationId
    if name in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    out = Path(tempfile.mkdtemp(), f"{package.name}-package.zip")  # the driver's file server hands it out from there
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(package.rglob("*.py")):
            z.write(path, path.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(out))
    _shipped.add(name)


def on_workers(spark: SparkSession, module: str, function: str, *args) -> Callable:
    """A function of Arrow data that calls ``module.function(data, *args)``; only the name and the arguments travel."""
    ship(spark)

    def run(data):
        import importlib

        return getattr(importlib.import_module(module), function)(data, *args)

    return run
