"""What the operators share: the folder that all executors see, staged tables, word rules."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..folders import new_folder, remove, shared_dir  # noqa: F401

#: White space that parts words: space and the characters 9 to 13.
SPACE = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACE}]+"
#: Rows of texts that are in a Python worker at once.
BATCH_ROWS = 1000


_kept: dict[str, dict] = {}


def kept(kind: str) -> dict:
    """What a Python worker keeps from one task to the next for tasks of a kind. What was kept for others goes back to the
    system, so that a worker which serves several stages holds the memos of one of them."""
    others = [k for k in _kept if k != kind]
    for other in others:
        del _kept[other]
    if others:
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
        if trim is not None:
            trim(0)
    return _kept.setdefault(kind, {})


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: short lineage that survives lost executors.

    The schema is passed to the reader, so that an empty table can be read too."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    df.write.parquet(path)
    back = spark.read.options(**READ).schema(df.schema).parquet(path)
    back._staged_path = path
    return back


def drop_staged(*tables: DataFrame) -> None:
    """Removes staged tables that no later plan reads."""
    for df in tables:
        remove(df.sparkSession, df._staged_path)


def make_folder(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)


#: Each thread of Parquet's vectored reads keeps a direct buffer as large as the largest column chunk it has read, outside
#: the heap, so they are off.
READ = {"parquet.hadoop.vectored.io.enabled": "false"}


def bounded_batches(spark: SparkSession) -> None:
    """Holds the Arrow batches of a session to BATCH_ROWS rows where nobody has set them: Spark has no setting of a plan."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(rows)) == 10_000:
        spark.conf.set(rows, str(BATCH_ROWS))


def bounded_reads(spark: SparkSession) -> None:
    """For tables that a caller has opened: READ for the whole session, where nobody has set it, as they take no options any more."""
    bounded_batches(spark)
    for key, value in READ.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, if it is a small table in fewer files and row groups than there are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores or df.select(F.spark_partition_id().alias("p")).distinct().count() >= cores:
        return df
    return df.repartition(cores)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spread(spark.read.options(**READ).parquet(f"{sf_dir}/{name}.parquet"))


def word_count(text):
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def partitions_for(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
