"""Paths in the folder that all executors share, removed when the application ends."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where the setting is absent in local mode (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="veerline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path that nothing has used yet."""
    if not _made:
        atexit.register(_clean)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: plans that read it more than once don't work it out anew."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _made[:] = [x for x in _made if x[1] != str(path)]


def made() -> set[str]:
    """Paths that are in use."""
    return {path for _, path in _made}


def remove_but(spark: SparkSession, keep: set[str]) -> None:
    """Removes all paths but those to keep, when nothing reads the others any more."""
    for path in made() - keep:
        remove(spark, path)


def _clean() -> None:
    for spark, path in list(_made):
        with contextlib.suppress(Exception):  # the engine may be gone
            if spark.sparkContext._jsc is not None:
                remove(spark, path)
