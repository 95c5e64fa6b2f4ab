"""A join of rows with a large table of unique keys of which a few may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..folders import written

#: A key is hot if it has more than a HOT-th of a task's even share of the rows: fewer than HOT keys a task can be.
HOT = 4


def hot_keys(rows: DataFrame, keys: tuple[str, ...], parts: int) -> DataFrame:
    """keys that hold more than 1 / (HOT * parts) of the rows each: fewer than HOT * parts of them, whatever the data."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    least = rows.agg((F.count(F.lit(1)) / (HOT * parts)).alias("_least"))
    return counts.crossJoin(F.broadcast(least)).where("_n > _least").select(*keys)  # least is one row


def joined_apart(rows: DataFrame, found: DataFrame, keys: tuple[str, ...], parts: int | None = None) -> DataFrame:
    """rows with the other columns of found (null where it lacks a key): a left join whose hot keys don't meet in one task.

    Entries of hot keys are broadcast, as their number is bounded; rows of all other keys are shuffled, where no key has more than
    a fraction of a task's share. Rows with a null key meet nothing, and aren't shuffled."""
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    hot = written(hot_keys(rows.where(known), keys, parts), "hot-keys")
    near = rows.join(F.broadcast(hot.join(found, list(keys), "left")), list(keys))
    far = rows.where(known).join(F.broadcast(hot), list(keys), "left_anti").repartition(parts, *keys).join(found, list(keys), "left")
    names = [*rows.columns, *(c for c in found.columns if c not in keys)]
    none = rows.where(~known).select("*", *(F.lit(None).cast(found.schema[c].dataType).alias(c) for c in found.columns if c not in keys))
    return near.select(names).unionByName(far.select(names)).unionByName(none)
