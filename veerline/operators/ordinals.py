"""Ordered operators over streams of any size: places, running sums and minima in two levels.

A window without a bound on its partition is one task. Here an order is dealt by ranges, or by blocks of event_index;
each part is summed on its own, and starts from a carry, which is a running sum over one row a part."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..folders import new_folder

#: Events in a block.
BLOCK = 1 << 18


def numbered_by_ranges(records: DataFrame, stream: tuple[str, ...], order: tuple[str, ...], parts: int | None = None) -> DataFrame:
    """records with event_index, from 0, within each stream (of all records, if stream is empty).

    The order must be total. Ranges are written once, in the shared folder, so that they stay as they are."""
    spark = records.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = records.repartitionByRange(parts, *stream, *order).withColumn("_part", F.spark_partition_id())
    path = new_folder(spark, "ordinals")
    ranged.write.parquet(path)
    rows = spark.read.schema(ranged.schema).parquet(path)
    sizes = rows.groupBy(*stream, "_part").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*(stream or (F.lit(0),))).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*stream, "_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_start"))
    here = Window.partitionBy(*stream, "_part").orderBy(*order)
    placed = rows.withColumn("_i", F.row_number().over(here)).join(starts, [*stream, "_part"])
    return placed.withColumn("event_index", (F.col("_start") + F.col("_i") - 1).cast("long")).drop("_part", "_i", "_start")


def running(rows: DataFrame, stream: tuple[str, ...], value: str, name: str, how: str = "sum", block: int | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """rows (with event_index) with name: the running sum or min of value in each stream. ties: what orders rows of one place.

    With block, in blocks of so many events."""
    f = {"sum": F.sum, "min": F.min}[how]
    upto = lambda keys: Window.partitionBy(*keys).orderBy("event_index", *ties).rowsBetween(Window.unboundedPreceding, 0)
    if block is None:
        return rows.withColumn(name, f(value).over(upto(stream)))
    rows = rows.withColumn("_b", F.floor(F.col("event_index") / block))
    keys = (*stream, "_b")
    ends = rows.groupBy(*keys).agg(f(value).alias("_end"))
    w = Window.partitionBy(*(stream or (F.lit(0),))).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*keys, f("_end").over(w).alias("_carry"))
    both = rows.withColumn("_own", f(value).over(upto(keys))).join(carry, list(keys))
    out = F.col("_own") + F.coalesce("_carry", F.lit(0.0)) if how == "sum" else F.least("_own", "_carry")
    return both.withColumn(name, out).drop("_b", "_own", "_carry")


def segments_of(rows: DataFrame, stream: tuple[str, ...], version: tuple[str, ...], block: int | None = None) -> DataFrame:
    """rows (with event_index) with segment: maximal runs of one version in each stream.

    With block, an event's predecessor in the block before is looked up by its place."""
    v = F.struct(*version)
    if block is None:
        before = F.lag(v).over(Window.partitionBy(*stream).orderBy("event_index"))
        marked = rows.withColumn("_new", F.coalesce(v != before, F.lit(True)).cast("long"))
    else:
        rows = rows.withColumn("_b", F.floor(F.col("event_index") / block))
        last = rows.groupBy(*stream, "_b").agg(F.max_by(v, "event_index").alias("_last")).withColumn("_b", F.col("_b") + 1)
        own = F.lag(v).over(Window.partitionBy(*stream, "_b").orderBy("event_index"))
        marked = rows.withColumn("_own", own).join(last, [*stream, "_b"], "left")
        before = F.when(F.col("event_index") % block == 0, F.col("_last")).otherwise(F.col("_own"))
        marked = marked.withColumn("_new", F.coalesce(v != before, F.lit(True)).cast("long")).drop("_own", "_last", "_b")
    out = running(marked, stream, "_new", "segment", block=block)
    return out.withColumn("segment", (F.col("segment") - 1).cast("long")).drop("_new")
