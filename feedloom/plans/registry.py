"""All registered queries and their SQL."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from feedloom.plans import details, feed, feeds, profiles, scalars, stored

MODULES = [feed, stored, scalars, details, feeds, profiles]
_SHIPPED: set[str] = set()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}


def ship(spark: SparkSession, root: str) -> None:
    """Sends this package to the Python workers, once for each application, unless their path has it already."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or root in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    where = tempfile.mkdtemp(prefix="feedloom-code-")
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(where, "feedloom"), "zip", root, "feedloom"))
    _SHIPPED.add(app)
