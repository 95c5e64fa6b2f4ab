"""Exact ranks of values (medians, quartiles) in groups of any size.

Equal values are counted first, so that a value that many rows hold is one row. The distinct values are dealt by ranges of (group, value),
which makes a histogram: values in each range, summed to the place where a range starts. It tells which range holds a rank; only those
ranges are read again, and within them the rank is a running sum. No task holds a group, and no aggregate keeps its values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..folders import written

#: Places (from 0) among n sorted values.
QUARTILE, UPPER, THIRD_QUARTILE = (lambda n: F.floor(n / 4)), (lambda n: F.floor(n / 2)), (lambda n: F.floor(n * 3 / 4))
LOWER = lambda n: F.floor((n - 1) / 2)


def picked(values: DataFrame, keys: tuple[str, ...], value: str, ranks: dict[str, Callable[[Column], Column]], parts: int | None = None, weight: str | None = None) -> DataFrame:
    """keys, n and a column for each of ranks: the value at that place (a function of n, from 0) of the group's sorted values.

    Null values don't count, and groups without others have no row; null keys are a group; NaN is the largest value. weight: how many
    values a row stands for."""
    spark = values.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    group = F.struct(*keys) if keys else F.struct(F.lit(0).alias("_all"))
    counts = values.where(F.col(value).isNotNull()).groupBy(group.alias("_g"), F.col(value).alias("_v")).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("_c"))
    dealt = written(counts.repartitionByRange(parts, "_g", "_v").withColumn("_part", F.spark_partition_id()), "selection")
    sizes = dealt.groupBy("_g", "_part").agg(F.sum("_c").alias("_m"))
    whole = Window.partitionBy("_g")
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_start", F.coalesce(F.sum("_m").over(before), F.lit(0))).withColumn("_n", F.sum("_m").over(whole))
    here = lambda r: (r >= F.col("_start")) & (r < F.col("_start") + F.col("_m"))
    asks = F.array(*(F.when(here(rank(F.col("_n"))), F.struct(F.lit(name).alias("name"), (rank(F.col("_n")) - F.col("_start")).alias("at"))) for name, rank in ranks.items()))
    asked = sizes.select("_g", "_part", "_n", F.filter(asks, lambda x: x.isNotNull()).alias("_asks")).where(F.size("_asks") > 0)
    upto = Window.partitionBy("_g", "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    rows = dealt.join(asked, ["_g", "_part"]).withColumn("_upto", F.sum("_c").over(upto))
    hits = rows.select("_g", "_n", "_v", F.explode(F.filter("_asks", lambda x: (x["at"] < F.col("_upto")) & (x["at"] >= F.col("_upto") - F.col("_c")))).alias("_a"))
    out = hits.groupBy("_g").agg(F.first("_n").alias("n"), *(F.max(F.when(F.col("_a.name") == name, F.col("_v"))).alias(name) for name in ranks))
    return out.select(*(F.col(f"_g.{k}").alias(k) for k in keys), "n", *ranks)


def medians(values: DataFrame, keys: tuple[str, ...], value: str, name: str = "median", weight: str | None = None, **others: Callable[[Column], Column]) -> DataFrame:
    """keys, n, name: the mean of the two middle values; and others, as in picked()."""
    found = picked(values, keys, value, {"_low": LOWER, "_high": UPPER} | others, weight=weight)
    middle = F.when(F.col("_low") == F.col("_high"), F.col("_low").cast("double")).otherwise(F.col("_low") + (F.col("_high") - F.col("_low")) / 2)
    return found.select(*keys, "n", middle.alias(name), *others)
