"""Trials: shuffled runs, calibration on some, verdicts on others. All trials of all groups are one plan, with the
trial as a column.

Runs are shuffled by a hash of trial and run; any other order will do that is given as a table (trial, run_id, pos)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..folders import written
from ..operators import channels as C
from ..operators import distributions as S
from ..operators.ordinals import numbered_by_ranges, running

CHANNELS = ("divergence", "cusum")
#: The part of a trial that isn't one of its benign runs.
ATTACK = 3


def hashed(ids: DataFrame, trials: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, trial, run_id, pos: ids (keys, run_id) in the order of a hash of trial and run. Places are those in ranges of the order, so
    that a trial may have any number of runs."""
    rows = ids.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    rows = rows.withColumn("_order", F.md5(F.concat_ws(":", F.col("trial").cast("string"), "run_id")))
    return numbered_by_ranges(rows, (*keys, "trial"), ("_order", "run_id")).withColumnRenamed("event_index", "pos").drop("_order")


def counted(runs: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """runs with _n: the number of rows of each value of by."""
    return runs.join(runs.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")), list(by))


def per_run_trials(records: DataFrame, benign: DataFrame, injected: DataFrame, margin: float = 1.2, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, trial, threshold, n_benign, n_injected, fp, tp.

    benign: keys, trial, run_id, pos. The first half of it gives the distribution, and its leave-one-out scores the
    threshold; the second half and injected (keys, run_id) are scored."""
    by = (*keys, "trial")
    split = counted(benign, by).withColumn("reference", F.col("pos") < F.floor(F.col("_n") / 2)).drop("_n")
    tools = records.select(*keys, "run_id", "tool")
    reference = split.where("reference").select(*by, "run_id").join(tools, [*keys, "run_id"])
    threshold = S.leave_one_out(reference, by).groupBy(*by).agg((F.max("score") * margin).alias("threshold"))
    dist = S.tool_distribution(reference, by)
    cases = split.where("NOT reference").select(*by, "run_id", F.lit(False).alias("bad")).unionByName(
        injected.select(*keys, "run_id").join(split.select(*by).distinct(), list(keys)).select(*by, "run_id", F.lit(True).alias("bad")) if keys
        else injected.select("run_id").crossJoin(F.broadcast(split.select("trial").distinct())).select("trial", "run_id", F.lit(True).alias("bad")))
    scores = S.mean_surprisal(cases.join(tools, [*keys, "run_id"]), dist, (*by, "run_id", "bad"), by)
    flag = F.col("score") > F.col("threshold")
    count = lambda c: F.sum(c.cast("long"))
    return scores.join(threshold, list(by)).groupBy(*by, "threshold").agg(
        count(~F.col("bad")).alias("n_benign"), count(F.col("bad")).alias("n_injected"), count(~F.col("bad") & flag).alias("fp"), count(F.col("bad") & flag).alias("tp"))


def _placed(runs: DataFrame, counts: DataFrame, by: tuple[str, ...], own: tuple[str, ...]) -> DataFrame:
    """runs (by, run_id, pos) with n and start: a run's records, and those of the runs before it. Runs without records are left out, and
    a trial may have any number of runs."""
    sizes = counts.groupBy(*own, "run_id").agg(F.sum("n").alias("n"))
    rows = runs.join(sizes, [*own, "run_id"]).withColumnRenamed("pos", "event_index")
    ends = running(rows, by, "n", "_end", block=C.BLOCK, ties=("run_id",))
    return ends.withColumn("start", F.col("_end").cast("long") - F.col("n")).drop("_end", "event_index")


def stream_trials(records: DataFrame, benign: DataFrame, injected: DataFrame, window: int = 50, margin: float = 2.0, keys: tuple[str, ...] = (), div: C.Divergence = C.Divergence(), block: int | None = None) -> DataFrame:
    """keys, trial, channel, false_alarm, first_alarm (of the stream of calibration and attack, from the attack's start;
    negative in the calibration part), detected, delay, detected_after_onset, horizon, div_threshold: swept_trials() of one window."""
    return swept_trials(records, benign, injected, (window,), margin, keys, div, block).drop("window")


def swept_trials(records: DataFrame, benign: DataFrame, injected: DataFrame, windows: tuple[int, ...], margin: float = 2.0, keys: tuple[str, ...] = (), div: C.Divergence = C.Divergence(), block: int | None = None) -> DataFrame:
    """window and the columns of stream_trials(), for several windows in one pass over the streams.

    benign and injected: keys, trial, run_id, pos. Half of the benign runs give the baseline, a quarter the thresholds,
    a quarter the null stream; the attack stream is as long as the null stream at most. detected looks at a channel's
    first alarm only: one in the calibration part masks later ones. detected_after_onset doesn't have that blind spot.
    block: events of a stream that one task takes, for trials that are too large for one; by default BLOCK where a stream has more.
    Trials whose calibration or null stream can't fill a window are left out for that window."""
    by = (*keys, "trial")
    part = F.when(F.col("pos") < F.floor(F.col("_n") / 2), 0).when(F.col("pos") < F.floor(3 * F.col("_n") / 4), 1).otherwise(2)
    runs = counted(benign, by).withColumn("part", part.cast("int")).drop("_n").unionByName(injected.withColumn("part", F.lit(ATTACK)))
    # places, lengths and baselines follow from runs and their counts; records are read once, for the streams that are scored
    own = tuple(c for c in by if c in records.columns)
    counts = written(records.groupBy(*own, "run_id", "tool").agg(F.count(F.lit(1)).alias("n")), "run-tools")
    placed = written(_placed(runs, counts, (*by, "part"), own), "trial-runs")
    length = lambda k, name: F.sum(F.when(F.col("part") == k, F.col("n")).otherwise(0)).alias(name)
    sizes = placed.groupBy(*by).agg(length(1, "onset"), length(2, "horizon")).where((F.col("onset") > min(windows)) & (F.col("horizon") > min(windows)))
    # trials go by numbers from here on, which sort faster than names
    sizes = written(sizes.withColumn("stream_id", F.monotonically_increasing_id()), "trial-sizes")
    known = placed.join(sizes, list(by))
    reference = known.where("part = 0").select(*own, "stream_id", "run_id").join(counts, [*own, "run_id"])
    dist = written(S.tool_distribution(reference, ("stream_id",), "n"), "trial-tools")
    # the attack stream starts with the calibration, whose scores give the thresholds, and ends with the horizon
    attack = F.col("part") == ATTACK
    used = known.where("part > 0").select(
        *own, "run_id", "stream_id", (F.col("part") != 2).alias("_bad"), F.when(attack, F.col("start") + F.col("onset")).otherwise(F.col("start")).alias("_at"),
        F.when(attack, F.least(F.col("n"), F.col("horizon") - F.col("start"))).otherwise(F.col("n")).alias("_most")).where("_most > 0")
    ranked = records.select(*own, "run_id", "tool", (F.row_number().over(Window.partitionBy(*own, "run_id").orderBy("step_index")) - 1).alias("_rank"))
    events = ranked.join(used, [*own, "run_id"]).where("_rank < _most").select("stream_id", "_bad", (F.col("_at") + F.col("_rank")).alias("event_index"), "tool")
    if block is None and (most := used.agg(F.max(F.col("_at") + F.col("_most"))).first()[0]) is not None and most > max(C.BLOCK, *windows):
        block = max(C.BLOCK, *windows)
    streams, hot = ("stream_id", "_bad"), dist.count() > C.MOST_VOCABULARY
    if hot:  # the streams are read more than once
        events = written(events, "trial-streams")
    emas = [f"ema_{w}" for w in windows]
    scores = C.swept(events, dist, streams, windows, div.alpha, on=("stream_id",), block=block, hot=hot)
    scores = written(scores.select(*streams, "event_index", "stat", *emas), "trial-scores")
    top = lambda c: F.greatest(F.lit(0.0), F.coalesce(F.max(c), F.lit(0.0))) * margin
    limits = scores.where("_bad").join(sizes, "stream_id").where("event_index < onset").groupBy("stream_id", *by, "onset", "horizon").agg(
        *(F.least(top(e), F.lit(C.CAP)).alias(f"_limit_{e}") for e in emas), top("stat").alias("cusum_threshold"))
    limits = written(limits, "trial-limits")
    hits, names = scores.join(limits.drop(*by, "horizon"), "stream_id"), []
    for e in emas:
        hits = C.patience(hits, streams, f"_limit_{e}", div.patience, e, block).withColumnRenamed("alarmed", f"_over_{e}")
        names.append(F.when(F.col(f"_over_{e}"), F.struct(F.lit(int(e[4:])).alias("window"), F.lit("divergence").alias("channel"))))
    names += [F.when(F.col("stat") > F.col("cusum_threshold"), F.struct(F.lit(w).alias("window"), F.lit("cusum").alias("channel"))) for w in windows]
    hits = hits.select(*streams, "event_index", "onset", F.explode(F.filter(F.array(*names), lambda x: x.isNotNull())).alias("_h"))
    bad = F.col("_bad")
    found = hits.groupBy("stream_id", "_h.window", "_h.channel").agg(
        F.max((~bad).cast("int")).alias("_null"), F.min(F.when(bad, F.col("event_index") - F.col("onset"))).alias("_first"), F.max((bad & (F.col("event_index") >= F.col("onset"))).cast("int")).alias("_after"))
    swept = F.explode(F.array(*(F.struct(F.lit(w).alias("window"), F.col(f"_limit_ema_{w}").alias("div_threshold")) for w in windows)))
    cells = limits.select("stream_id", *by, "onset", "horizon", swept.alias("_w")).select("stream_id", *by, "onset", "horizon", "_w.*")
    cells = cells.where((F.col("onset") > F.col("window")) & (F.col("horizon") > F.col("window"))).withColumn("channel", F.explode(F.array(*map(F.lit, CHANNELS))))
    at = F.col("_first")
    return cells.join(found, ["stream_id", "window", "channel"], "left").select(
        "window", *by, "channel", F.coalesce(F.col("_null") == 1, F.lit(False)).alias("false_alarm"), at.alias("first_alarm"), F.coalesce(at >= 0, F.lit(False)).alias("detected"),
        F.when(at >= 0, at).alias("delay"), F.coalesce(F.col("_after") == 1, F.lit(False)).alias("detected_after_onset"), "horizon", "div_threshold")


def per_run_rates(cells: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return cells.groupBy(*keys).agg(F.try_divide(F.sum("tp"), F.sum("n_injected")).alias("detection"), F.try_divide(F.sum("fp"), F.sum("n_benign")).alias("fpr"), F.count(F.lit(1)).alias("cells"))


def stream_rates(cells: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, channel, cells, detection, false_alarm, median_delay (truncated), div_threshold_median, n_capped (thresholds at the cap)."""
    return cells.groupBy(*keys, "channel").agg(
        F.count(F.lit(1)).alias("cells"), F.avg(F.col("detected").cast("double")).alias("detection"), F.avg(F.col("false_alarm").cast("double")).alias("false_alarm"), F.floor(F.median("delay")).alias("median_delay"),
        F.median("div_threshold").alias("div_threshold_median"), F.sum((F.col("div_threshold") >= C.CAP).cast("long")).alias("n_capped"))


def split_half_decay(records: DataFrame, order: DataFrame, z: float = 3.0, min_calls: int = 30) -> DataFrame:
    """trial, flags: bins that context decay finds between two halves of the same runs: all of them are false."""
    from ..functions.text import step_bin
    from ..operators.baseline import bad
    from ..operators.detectors import proportion_z

    half = counted(order, ("trial",)).withColumn("half", (F.col("pos") >= F.floor(F.col("_n") / 2)).cast("int")).drop("_n")
    counts = half.join(records, "run_id").groupBy("trial", "half", step_bin("step_index").alias("bin")).agg(F.sum(bad().cast("long")).alias("e"), F.count(F.lit(1)).alias("n"))
    sides = [counts.where(F.col("half") == k).select("trial", "bin", F.col("e").alias(f"e{k}"), F.col("n").alias(f"n{k}")) for k in (0, 1)]
    both = sides[0].join(sides[1], ["trial", "bin"]).where(F.col("n1") >= min_calls)
    flags = both.where(proportion_z("e0", "n0", "e1", "n1") > z).groupBy("trial").agg(F.count(F.lit(1)).alias("flags"))
    return order.select("trial").distinct().join(flags, "trial", "left").select("trial", F.coalesce("flags", F.lit(0)).alias("flags"))
