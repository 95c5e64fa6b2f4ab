"""Distributions of tools and what compares them. Distributions are long tables (keys, tool, p)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-9
#: Probability of a tool that a baseline has never seen.
FLOOR = 1e-4


def tool_distribution(records: DataFrame, keys: tuple[str, ...] = (), weight: str | None = None) -> DataFrame:
    """Relative frequency of each tool, within each value of keys. weight: how many records a row stands for."""
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = records.groupBy(*keys, "tool").agg(n.alias("n"))
    if not keys:
        total = records.agg(n.alias("_all"))  # one row
        return counts.crossJoin(F.broadcast(total)).select("tool", (F.col("n") / F.col("_all")).alias("p"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    return counts.select(*keys, "tool", (F.col("n") / total).alias("p"))


def entropy(p) -> Column:
    """Aggregate: bits of a distribution."""
    p = F.col(p) if isinstance(p, str) else p
    return F.coalesce(-F.sum(F.when(p > 0, p * F.log2(p))), F.lit(0.0))


def kl_term(p: Column, q: Column, eps: float = EPS) -> Column:
    return F.when(p > 0, p * F.log2((p + eps) / (q + eps))).otherwise(F.lit(0.0))


def js_term(p: Column, q: Column, eps: float = EPS) -> Column:
    """One tool's part of the Jensen-Shannon divergence."""
    m = (p + q) / 2
    return (kl_term(p, m, eps) + kl_term(q, m, eps)) / 2


def _paired(p: DataFrame, q: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return p.withColumnRenamed("p", "_p").join(q.withColumnRenamed("p", "_q"), [*keys, "tool"], "full").select(
        *keys, "tool", F.coalesce("_p", F.lit(0.0)).alias("_p"), F.coalesce("_q", F.lit(0.0)).alias("_q"))


def kl_divergence(p: DataFrame, q: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return _paired(p, q, keys).groupBy(*keys).agg(F.coalesce(F.sum(kl_term(F.col("_p"), F.col("_q"))), F.lit(0.0)).alias("kl"))


def js_divergence(p: DataFrame, q: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Bits between p and q over the union of their tools, within each value of keys that either has."""
    return _paired(p, q, keys).groupBy(*keys).agg(F.coalesce(F.sum(js_term(F.col("_p"), F.col("_q"))), F.lit(0.0)).alias("jsd"))


def js_of_pairs(pairs: DataFrame, dists: DataFrame, key: str, left: str = "a", right: str = "b") -> DataFrame:
    """jsd of each row of pairs (left, right and others) between the distributions of two values of key.

    Both sides' tools come as rows, and a tool that both have meets in the grouping: no join on tools."""
    sides = [pairs.join(dists.withColumnRenamed(key, side), side).select(*pairs.columns, "tool", *(
        (F.col("p") if s == side else F.lit(0.0)).alias(f"_{k}") for k, s in (("p", left), ("q", right)))) for side in (left, right)]
    by_tool = sides[0].unionByName(sides[1]).groupBy(*pairs.columns, "tool").agg(F.sum("_p").alias("_p"), F.sum("_q").alias("_q"))
    return by_tool.groupBy(*pairs.columns).agg(F.sum(js_term(F.col("_p"), F.col("_q"))).alias("jsd"))


def surprisal(p) -> Column:
    return -F.log2(F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit(FLOOR)))


def mean_surprisal(records: DataFrame, dist: DataFrame, keys: tuple[str, ...] = ("run_id",), on: tuple[str, ...] = ()) -> DataFrame:
    """Mean bits a record of each run under a distribution (of the same values of on)."""
    counts = records.groupBy(*dict.fromkeys([*keys, *on]), "tool").agg(F.count(F.lit(1)).alias("n"))
    scored = counts.join(dist, [*on, "tool"], "left")
    return scored.groupBy(*keys).agg((F.sum(F.col("n") * surprisal("p")) / F.sum("n")).alias("score"))


def leave_one_out(records: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    """Mean surprisal of each run under the distribution of all other runs (of its group): totals less its own counts.

    A tool that only the run itself has counts as unseen."""
    own = records.groupBy(*group, "run_id", "tool").agg(F.count(F.lit(1)).alias("n"))
    by_tool = own.groupBy(*group, "tool").agg(F.sum("n").alias("tool_n"))
    if group:
        total = own.groupBy(*group).agg(F.sum("n").alias("all_n"))
        rows = own.join(by_tool, [*group, "tool"]).join(total, list(group))
    else:
        rows = own.join(by_tool, "tool").crossJoin(F.broadcast(own.agg(F.sum("n").alias("all_n"))))
    runs = rows.withColumn("run_n", F.sum("n").over(Window.partitionBy(*group, "run_id")))
    rest = F.col("all_n") - F.col("run_n")
    p = F.when((F.col("tool_n") > F.col("n")) & (rest > 0), (F.col("tool_n") - F.col("n")) / rest)
    return runs.groupBy(*group, "run_id").agg((F.sum(F.col("n") * surprisal(p)) / F.sum("n")).alias("score"))
