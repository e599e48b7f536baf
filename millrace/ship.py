"""Makes the package importable where Python code runs on executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once for each application. Spark's own file server hands
    it out, so executors need neither the repository nor a shared folder for it."""
    context = spark.sparkContext
    if getattr(context, "_millrace_shipped", False):
        return
    package = Path(__file__).parent
    archive = os.path.join(tempfile.mkdtemp(prefix="millrace-"), "millrace.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(package.rglob("*.py")):
            z.write(path, path.relative_to(package.parent))
    context.addPyFile(archive)
    context._millrace_shipped = True


def shipped(f: Callable) -> Callable:
    """The same function of (spark, ...), after the package has been sent."""

    @wraps(f)
    def run(spark: SparkSession, *rest):  # noqa: ANN002, ANN202
        ship(spark)
        return f(spark, *rest)

    return run
