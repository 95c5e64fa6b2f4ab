"""Gives the package to Python workers that can't import it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, unless they find it by PYTHONPATH (or, in local
    mode, in the working folder)."""
    here = os.path.dirname(os.path.abspath(__file__))
    root = os.path.realpath(os.path.dirname(here))
    found = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if spark.sparkContext.master.startswith("local["):
        found.append(os.path.realpath(os.getcwd()))
    name = spark.sparkContext.applicationId
    if root in found or name in _shipped:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="veerline-"), "veerline.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(path)
    _shipped.add(name)
