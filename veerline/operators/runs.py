"""Texts of runs, pattern verdicts against labels, localisers, and window lookups over a run's steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from .rules import matches

PREDICTORS = ("first", "third", "middle", "last", "first_error", "before_first_error", "before_first_apology", "first_worker", "second_worker", "first_worker_local")


def run_texts(content: DataFrame, column: str, sep: str = "\n", dedup: bool = False, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """keys, text: a run's texts in step order, empty ones left out; with dedup, each once, at its first place."""
    parts = F.transform(F.array_sort(F.collect_list(F.when(F.col(column) != "", F.struct("step_index", F.col(column).alias("x"))))), lambda s: s["x"])
    parts = F.array_distinct(parts) if dedup else parts
    return content.groupBy(*keys).agg(F.array_join(parts, sep).alias("text"))


def verdicts(labels: DataFrame, texts: DataFrame, family: dict[str, str], least: int = 1, flags: str = P.FLAGS) -> DataFrame:
    """labels with matched, flagged and dev. Runs without a text have an empty one."""
    rows = labels.join(texts, "run_id", "left").withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("matched", T.matched("text", family, flags))
    return rows.withColumn("flagged", F.size("matched") >= least).withColumn("dev", T.is_dev("run_id")).drop("text")


def run_verdicts(labels: DataFrame, content: DataFrame, column: str, family: dict[str, str], least: int = 1, sep: str = "\n", dedup: bool = False, flags: str = P.FLAGS) -> DataFrame:
    """verdicts() on the texts of runs of any length, which are never put together."""
    rows = labels.join(matches(content, column, family, sep, dedup, flags=flags), "run_id", "left").withColumn("matched", F.coalesce("matched", F.array().cast("array<string>")))
    return rows.withColumn("flagged", F.size("matched") >= least).withColumn("dev", T.is_dev("run_id"))


def rates(rows: DataFrame, positive: str, keys: tuple[str, ...] = (), rollup: bool = False) -> DataFrame:
    """keys, n_positive, n_negative, detection and fpr of the column flagged; null where there is nothing to divide by.

    With rollup, the totals over keys from the right are rows too, with null keys."""
    yes, no = F.col(positive), ~F.col(positive)
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    g = rows.rollup(*keys) if rollup else rows.groupBy(*keys)
    out = g.agg(count(yes).alias("n_positive"), count(no).alias("n_negative"), count(yes & F.col("flagged")).alias("tp"), count(no & F.col("flagged")).alias("fp"))
    return out.select(*keys, "n_positive", "n_negative", F.try_divide("tp", "n_positive").alias("detection"), F.try_divide("fp", "n_negative").alias("fpr"))


def coverage(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, pattern, n: rows that each pattern matched."""
    return rows.select(*keys, F.explode("matched").alias("pattern")).groupBy(*keys, "pattern").agg(F.count(F.lit(1)).alias("n"))


def localised(steps: DataFrame, error: str = P.MESSAGE_ERROR, apology: str = P.MESSAGE_APOLOGY, flags: str = P.FLAGS) -> DataFrame:
    """run_id, predictor, predicted (a step_index) of steps (run_id, step_index, label, text).

    Positions are ranks within a run, as step_index may have holes."""
    w = Window.partitionBy("run_id").orderBy("step_index")
    rows = steps.select("run_id", "step_index", (F.row_number().over(w) - 1).alias("i"), F.count(F.lit(1)).over(Window.partitionBy("run_id")).alias("n"), F.lag("step_index").over(w).alias("before"),
                        T.holds(F.coalesce("text", F.lit("")), error, flags).alias("err"), T.holds(F.coalesce("text", F.lit("")), apology, flags).alias("sorry"),
                        T.is_worker("label").alias("worker"), T.is_local_worker("label").alias("local"))
    step = F.col("step_index")
    # rank among the workers
    rows = rows.withColumn("k", F.sum(F.col("worker").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    at = lambda i: F.max(F.when(F.col("i") == i, step))
    first = lambda c, what=step: F.min_by(F.when(c, what), F.when(c, F.col("i")))
    earlier = F.coalesce("before", step)
    g = rows.groupBy("run_id").agg(
        at(0).alias("first"), at(F.least(F.lit(2), F.col("n") - 1)).alias("third"), at(F.floor(F.col("n") / 2)).alias("middle"), at(F.col("n") - 1).alias("last"),
        first(F.col("err")).alias("first_error"), first(F.col("err"), earlier).alias("before_first_error"), first(F.col("sorry"), earlier).alias("before_first_apology"),
        first(F.col("worker")).alias("first_worker"), first(F.col("worker") & (F.col("k") == 2)).alias("second_worker"), first(F.col("local")).alias("first_worker_local"))
    named = {p: F.coalesce(p, "first") for p in PREDICTORS} | {"second_worker": F.coalesce("second_worker", "first_worker", "first")}
    return g.select("run_id", *(c.alias(p) for p, c in named.items())).unpivot("run_id", list(PREDICTORS), "predictor", "predicted")


def localiser_scores(predicted: DataFrame, truth: DataFrame, labels: DataFrame) -> DataFrame:
    """predictor, n, step_hits (exact), near_hits (two steps off at most), agent_hits. truth: run_id, mistake_step,
    mistake_agent; labels: run_id, step_index, label of each step."""
    who = labels.select("run_id", F.col("step_index").alias("predicted"), "label")
    rows = predicted.join(truth, "run_id").join(who, ["run_id", "predicted"], "left")
    hit = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    return rows.groupBy("predictor").agg(
        F.count(F.lit(1)).alias("n"), hit(F.col("predicted") == F.col("mistake_step")).alias("step_hits"),
        hit(F.abs(F.col("predicted") - F.col("mistake_step")) <= 2).alias("near_hits"), hit(T.speaker("label") == F.col("mistake_agent")).alias("agent_hits"))


def prompt_delta(spans: DataFrame) -> DataFrame:
    """spans (run_id, step_index, kind, l1_text) with covered: whether the first prompt after a span shows more
    execution failures than the last one up to it: an as-of lookup in both directions."""
    w = Window.partitionBy("run_id").orderBy("step_index")
    rows = spans.withColumn("_c", T.prompt_failures("kind", "l1_text"))
    before = F.last("_c", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_c", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return rows.withColumn("covered", F.coalesce(after > F.coalesce(before, F.lit(0)), F.lit(False))).drop("_c")


def downstream(spans: DataFrame, hit: str, steps: int = 3) -> DataFrame:
    """spans with near: whether hit holds for a span or one of the next steps."""
    w = Window.partitionBy("run_id").orderBy("step_index").rowsBetween(0, steps)
    return spans.withColumn("near", F.max(F.col(hit).cast("int")).over(w) == 1)


def unacknowledged(steps: DataFrame, error: str = P.RESULT_ERROR, ack: str = P.ACKNOWLEDGED, flags: str = P.FLAGS) -> DataFrame:
    """run_id, final_message, flagged: a tool result shows an error that the last non-blank message doesn't own up to."""
    spoken = F.col("l3_text").rlike(r"\S")
    g = steps.groupBy("run_id").agg(
        F.max((F.coalesce(F.col("l2_text"), F.lit("")).rlike(r"\S") & T.holds("l2_text", error, flags)).cast("int")).alias("_e"),
        F.coalesce(F.max_by(F.when(spoken, F.col("l3_text")), F.when(spoken, F.col("step_index"))), F.lit("")).alias("final_message"))
    return g.select("run_id", "final_message", ((F.col("_e") == 1) & ~T.holds("final_message", ack, flags)).alias("flagged"))


def error_density(spans: DataFrame, by, hit: str, least: int = 20) -> DataFrame:
    """bin, n, errors, rate of the bins with least spans or more."""
    g = spans.groupBy(by.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(hit).cast("long")).alias("errors"))
    return g.where(F.col("n") >= least).withColumn("rate", F.col("errors") / F.col("n"))
