"""Detectors over whole tables: context decay, version drift, omission, goal persistence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .baseline import error_rates, presence
from .distributions import js_of_pairs, tool_distribution
from .ordinals import BLOCK, numbered_by_ranges, segments_of


def proportion_z(e1, n1, e2, n2) -> Column:
    """z of two proportions with pooled standard error, (e2, n2) against (e1, n1)."""
    e1, n1, e2, n2 = (F.col(c) if isinstance(c, str) else c for c in (e1, n1, e2, n2))
    p = (e1 + e2) / (n1 + n2)
    se = F.sqrt(p * (1 - p) * (F.lit(1.0) / n1 + F.lit(1.0) / n2))
    return (e2 / n2 - e1 / n1) / F.when(se == 0, 1e-12).otherwise(se)


def context_decay(observed: DataFrame, baseline_rates: DataFrame, min_calls: int = 30) -> DataFrame:
    """bin, baseline_rate, observed_rate, z, n_observed of the bins that both have; z above a threshold is a finding."""
    now = error_rates(observed).where(F.col("n") >= min_calls).select("bin", F.col("err").alias("e"), F.col("n").alias("n_observed"))
    both = now.join(baseline_rates.where("n > 0"), "bin")
    return both.select("bin", (F.col("err") / F.col("n")).alias("baseline_rate"), (F.col("e") / F.col("n_observed")).alias("observed_rate"),
                       proportion_z("err", "n", "e", "n_observed").alias("z"), "n_observed")


def segments(records: DataFrame, order: tuple[str, ...], version: tuple[str, ...] = ("model", "model_version"), stream: tuple[str, ...] = ("agent_id",), block: int | None = None) -> DataFrame:
    """records with event_index and segment: maximal runs of one version within each stream; with an empty stream, of all
    records in their order. With block, in two levels, for streams that are too large for a task."""
    if block is None and stream:
        rows = records.withColumn("event_index", F.row_number().over(Window.partitionBy(*stream).orderBy(*order)).cast("long") - 1)
    else:
        rows = numbered_by_ranges(records, stream, order)
    return segments_of(rows, stream, version, block or (None if stream else BLOCK))


def version_drift(records: DataFrame, order: tuple[str, ...], version: tuple[str, ...] = ("model", "model_version"), stream: tuple[str, ...] = ("agent_id",), min_segment: int = 50, block: int | None = None) -> DataFrame:
    """Divergence of each two adjacent segments that both have min_segment records: stream, segment (the later one),
    from and to versions, boundary_index, jsd. A threshold on jsd makes findings of them."""
    rows = segments(records, order, version, stream, block)
    seg = rows.groupBy(*stream, "segment").agg(F.count(F.lit(1)).alias("n"), F.min("event_index").alias("start"), F.first(F.struct(*version)).alias("v"))
    w = Window.partitionBy(*(stream or (F.lit(0),))).orderBy("segment")  # a row a segment
    pairs = seg.withColumn("n0", F.lag("n").over(w)).withColumn("v0", F.lag("v").over(w)).where((F.col("n") >= min_segment) & (F.col("n0") >= min_segment))
    key = lambda s: F.struct(*stream, s.alias("segment"))
    pairs = pairs.select(*stream, "segment", F.col("v0").alias("from_version"), F.col("v").alias("to_version"), F.col("start").alias("boundary_index"),
                         key(F.col("segment") - 1).alias("a"), key(F.col("segment")).alias("b"))
    dists = tool_distribution(rows, (*stream, "segment")).select(key(F.col("segment")).alias("seg"), "tool", "p")
    return js_of_pairs(pairs, dists, "seg").drop("a", "b")


def omission(observed: DataFrame, baseline_presence: DataFrame, min_support: float = 0.8, min_runs: int = 10, order: tuple[str, ...] = ("step_index",)) -> DataFrame:
    """goal_id, tool, baseline_presence (1.0 by definition), baseline_presence_actual, observed_presence, n_runs of the
    tools that the baseline expects, for goals that were observed min_runs times."""
    expected = baseline_presence.select("goal_id", "tool", (F.col("n_with") / F.col("n_runs")).alias("baseline_presence_actual")).where(F.col("baseline_presence_actual") >= min_support)
    now = presence(observed, order)
    goals = now.select("goal_id", "n_runs").distinct().where((F.col("n_runs") >= min_runs) & (F.col("n_runs") > 0))
    rows = expected.join(goals, "goal_id").join(now.select("goal_id", "tool", "n_with"), ["goal_id", "tool"], "left")
    return rows.select("goal_id", "tool", F.lit(1.0).alias("baseline_presence"), "baseline_presence_actual",
                       (F.coalesce("n_with", F.lit(0)) / F.col("n_runs")).alias("observed_presence"), "n_runs")


def goal_persistence(records: DataFrame, specs: DataFrame, order: tuple[str, ...] = ("step_index",)) -> DataFrame:
    """run_id, goal_id, kind, detail of the four violations that can be counted. Runs without a contract are skipped."""
    first = Window.partitionBy("run_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = records.select("run_id", "tool", "params_hash", "status", F.first("goal_id").over(first).alias("goal_id"), F.struct(*order).alias("_o"))
    rows = rows.join(specs, "goal_id")
    spec = [c for c in specs.columns if c != "goal_id"]
    calls = rows.groupBy("run_id", "goal_id", "tool", "params_hash", "max_duplicate_calls").agg(F.count(F.lit(1)).alias("c"))
    twice = calls.where(F.col("c") > F.col("max_duplicate_calls")).select(
        "run_id", "goal_id", F.lit("duplicate_submission").alias("kind"), F.format_string("%s with identical params called %dx", "tool", "c").alias("detail"))
    done = F.max(((F.col("tool") == F.col("terminal_tool")) & (F.col("status") == "ok")).cast("int")) == 1
    runs = rows.groupBy("run_id", "goal_id", *spec).agg(F.count(F.lit(1)).alias("n"), F.max_by("status", "_o").alias("last"), done.alias("done"))
    found = F.array(
        F.when((F.col("last") == "abort") & (F.col("n") < F.col("min_steps")), F.struct(F.lit("premature_abort").alias("kind"), F.format_string("aborted after %d steps (min %d)", "n", "min_steps").alias("detail"))),
        F.when((F.col("last") == "ok") & ~F.col("done"), F.struct(F.lit("false_success").alias("kind"), F.format_string("run ended ok but terminal tool '%s' never succeeded", "terminal_tool").alias("detail"))),
        F.when((F.col("n") > F.col("max_steps")) & ~F.col("done"), F.struct(F.lit("missing_progress").alias("kind"), F.format_string("%d steps without terminal tool '%s'", "n", "terminal_tool").alias("detail"))))
    others = runs.select("run_id", "goal_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f")).select("run_id", "goal_id", "f.*")
    return twice.unionByName(others)
