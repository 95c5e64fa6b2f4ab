"""The frozen baseline: four small tables and two counts, with a fingerprint."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import step_bin
from .distributions import tool_distribution

MIN_SUPPORT = 0.8


def by_run(records: DataFrame, order: tuple[str, ...] = ("step_index",)) -> DataFrame:
    """records with run_goal: the goal of each run's first record."""
    first = Window.partitionBy("run_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return records.withColumn("run_goal", F.first("goal_id").over(first))


def presence(records: DataFrame, order: tuple[str, ...] = ("step_index",)) -> DataFrame:
    """goal_id, tool, n_with, n_runs: runs of each goal, and those that have each tool."""
    rows = by_run(records, order).select("run_id", F.col("run_goal").alias("goal_id"), "tool").distinct()
    runs = rows.select("run_id", "goal_id").distinct().groupBy("goal_id").agg(F.count(F.lit(1)).alias("n_runs"))
    return rows.groupBy("goal_id", "tool").agg(F.count(F.lit(1)).alias("n_with")).join(runs, "goal_id")


def bad(status="status") -> Column:
    return F.col(status).isin("error", "abort")


def error_rates(records: DataFrame) -> DataFrame:
    """bin, err, n: failed calls and calls by step bin."""
    return records.groupBy(step_bin("step_index").alias("bin")).agg(F.sum(bad().cast("long")).alias("err"), F.count(F.lit(1)).alias("n"))


@dataclass(frozen=True)
class Baseline:
    tools: DataFrame
    tools_by_goal: DataFrame
    expected: DataFrame
    error_rates: DataFrame
    counts: DataFrame

    def contents(self) -> dict:
        """The baseline as nested dictionaries, for vocabularies that fit the driver; fingerprint() doesn't need them."""
        by_goal: dict = {}
        for x in self.tools_by_goal.collect():
            by_goal.setdefault(x["goal_id"], {})[x["tool"]] = x["p"]
        expected: dict = {g: [] for g in by_goal}
        for x in self.expected.orderBy("goal_id", "tool").collect():
            expected[x["goal_id"]].append(x["tool"])
        n = self.counts.first()
        return {
            "tool_dist": {x["tool"]: x["p"] for x in self.tools.collect()},
            "tool_dist_by_goal": by_goal,
            "expected_tools_by_goal": expected,
            "error_rate_by_length_bin": {str(x["bin"]): [x["err"], x["n"]] for x in self.error_rates.collect()},
            "n_records": n["n_records"],
            "n_runs": n["n_runs"],
        }

    def _json(self) -> Iterator[str]:
        """json.dumps(contents(), sort_keys=True), in pieces: sorted tables come to the driver a partition at a time."""
        text = json.dumps

        def members(df: DataFrame, key: str, value: Callable, also: tuple[str, ...] = ()) -> Iterator[str]:
            for i, x in enumerate(df.orderBy(key, *also).toLocalIterator()):
                yield (", " if i else "") + text(x[key]) + ": " + value(x)

        def groups(df: DataFrame, inner: str, value: Callable, ends: tuple[str, str]) -> Iterator[str]:
            last, first = None, True
            for x in df.orderBy("goal_id", inner).toLocalIterator():
                if first or x["goal_id"] != last:
                    yield ("" if first else ends[1] + ", ") + text(x["goal_id"]) + ": " + ends[0]
                    last, first, n = x["goal_id"], False, 0
                piece = value(x)
                if piece is not None:
                    yield (", " if n else "") + piece
                    n += 1
            yield "" if first else ends[1]

        n = self.counts.first()
        yield '{"error_rate_by_length_bin": {'
        yield from members(self.error_rates.withColumn("bin", F.col("bin").cast("string")), "bin", lambda x: text([x["err"], x["n"]]))
        yield '}, "expected_tools_by_goal": {'
        goals = self.tools_by_goal.select("goal_id").distinct()
        yield from groups(goals.join(self.expected, "goal_id", "left"), "tool", lambda x: None if x["tool"] is None else text(x["tool"]), ("[", "]"))
        yield f'}}, "n_records": {n["n_records"]}, "n_runs": {n["n_runs"]}, "tool_dist": {{'
        yield from members(self.tools, "tool", lambda x: text(x["p"]))
        yield '}, "tool_dist_by_goal": {'
        yield from groups(self.tools_by_goal, "tool", lambda x: text(x["tool"]) + ": " + text(x["p"]), ("{", "}"))
        yield "}}"

    def fingerprint(self) -> str:
        """16 digits of the SHA-256 of the contents as JSON with sorted keys."""
        h = hashlib.sha256()
        for piece in self._json():
            h.update(piece.encode())
        return h.hexdigest()[:16]


def freeze(records: DataFrame, min_support: float = MIN_SUPPORT, order: tuple[str, ...] = ("step_index",)) -> Baseline:
    goals = by_run(records, order)
    expected = presence(records, order).where(F.col("n_with") / F.col("n_runs") >= min_support).select("goal_id", "tool")
    return Baseline(
        tools=tool_distribution(records),
        tools_by_goal=tool_distribution(goals.select(F.col("run_goal").alias("goal_id"), "tool"), ("goal_id",)),
        expected=expected,
        error_rates=error_rates(records),
        counts=records.agg(F.count(F.lit(1)).alias("n_records"), F.count_distinct("run_id").alias("n_runs")),
    )
