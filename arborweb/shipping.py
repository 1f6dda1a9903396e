"""Sends this package to the executors, so that Python workers can import it anywhere."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package's sources to the session's Python files, once per application."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="arborweb-src-"), "arborweb_src.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
    _sent.add(app)


def series_udf(fn: Callable, returns: T.DataType) -> Callable[..., Column]:
    """``fn`` over pandas series as a column function of the session at hand. Made anew for
    each use: a function that is kept would belong to the session it was first used in."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        ship(spark)
    return F.pandas_udf(fn, returns)
