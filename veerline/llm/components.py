"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_staged, staged


#: Tasks over which the links of one node are dealt when they meet its minimum.
SALTS = 8


def _with_least(e: DataFrame, least: DataFrame) -> DataFrame:
    """e (u, v) with m of its u: a hub's links are dealt over SALTS tasks, and its minimum goes to each of them."""
    salted = e.withColumn("_s", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    # repeated rows look small to the planner: they aren't to be broadcast
    return salted.hint("merge").join(least.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["u", "_s"]).drop("_s")


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _with_least(both.where(F.col("v") > F.col("u")), least).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(F.col("u") != F.col("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = _with_least(down, least).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def _digest(e: DataFrame) -> tuple:
    return tuple(e.select(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())


def components(edges: DataFrame) -> DataFrame:
    """(u, v): each node u that isn't the smallest of its component, with the smallest as v. edges: (u, v) of numbers.

    Each round ends in a staged table; a hub's minimum is combined before the shuffle, and its links meet
    one row of that minimum in a join that can be split. Rounds grow as the logarithm of the longest chain."""
    now = staged(edges.select("u", "v").where(F.col("u") != F.col("v")).distinct(), "links")
    was = _digest(now)
    while was[0]:
        after = staged(_small_star(_large_star(now)).distinct(), "links")
        drop_staged(now)
        now, seen = after, _digest(after)
        if seen == was:
            break
        was = seen
    return now
