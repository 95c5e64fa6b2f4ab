"""The two channels over ordered streams, as batch plans, and the two-regime detector.

Streams are the unit of parallelism: stream columns partition every window, so that a task holds one stream's order.
The change-point statistic is a closed form of running sums, and so is the smoothed divergence within blocks. Both
stay in built-in expressions. Streams that are too large for a task are scored in blocks (see ordinals)."""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .distributions import EPS, FLOOR, entropy, js_term, kl_term, surprisal
from .ordinals import numbered_by_ranges, running
from .skew import joined_apart


#: Highest threshold of a divergence, which is one at most.
CAP = 0.9
#: Blocks before that a smoothed score takes in.
CARRIED = 3
#: Tools of a vocabulary that may be broadcast, and events of a stream that one task takes where a plan knows their number.
MOST_VOCABULARY, BLOCK = 100_000, 1 << 18


@dataclass(frozen=True)
class Divergence:
    """Sliding-window divergence from the baseline, exponentially smoothed."""

    window: int = 50
    alpha: float = 0.1
    threshold: float = 0.15
    patience: int = 5

    def verdicts(self, events: DataFrame, dist: DataFrame, stream: tuple[str, ...], on: tuple[str, ...] = (), block: int | None = None) -> DataFrame:
        """events with score and alarmed."""
        s = smoothed(window_scores(events, dist, stream, self.window, on, block), stream, self.alpha, block)
        return patience(s, stream, self.threshold, self.patience, block=block).withColumnRenamed("ema", "score")


@dataclass(frozen=True)
class Cusum:
    """One-sided cumulative sum of surprisal beyond its mean and a slack."""

    slack: float = 0.5
    threshold: float = 8.0
    floor: float = FLOOR

    def verdicts(self, events: DataFrame, dist: DataFrame, stream: tuple[str, ...], on: tuple[str, ...] = (), block: int | None = None) -> DataFrame:
        """events with score and alarmed."""
        s = cusum_scores(events, dist, stream, self.slack, on, block).withColumnRenamed("stat", "score")
        return s.withColumn("alarmed", F.col("score") > self.threshold)


class Channel(Protocol):
    """What regimes() needs of a channel: a verdict on each event of each stream."""

    def verdicts(self, events: DataFrame, dist: DataFrame, stream: tuple[str, ...], on: tuple[str, ...] = (), block: int | None = None) -> DataFrame: ...


def numbered(records: DataFrame, stream: tuple[str, ...], order: tuple[str, ...], ranges: int | None = None) -> DataFrame:
    """records with event_index, from 0, within each stream. With ranges, in so many ranges of the order, for streams that are
    too large for a task."""
    if ranges is not None:
        return numbered_by_ranges(records, stream, order, ranges)
    return records.withColumn("event_index", F.row_number().over(Window.partitionBy(*stream).orderBy(*order)).cast("long") - 1)


def _beside(events: DataFrame, one: DataFrame, on: tuple[str, ...]) -> DataFrame:
    """events with the columns of one, which has a row for each value of on, or a single row."""
    return events.join(one, list(on)) if on else events.crossJoin(F.broadcast(one))


def with_probabilities(events: DataFrame, dist: DataFrame, on: tuple[str, ...] = (), hot: bool = False) -> DataFrame:
    """events with _q: each tool's probability in dist, null if it has none. hot: the vocabulary is too large to be
    broadcast, so tools that hold much of the events are joined apart."""
    dist, keys = dist.select(*on, "tool", F.col("p").alias("_q")), (*on, "tool")
    return joined_apart(events, dist, keys) if hot else events.join(dist, list(keys), "left")


def overlapped(rows: DataFrame, block: int, before: int) -> DataFrame:
    """rows with _b: the block of so many events that each belongs to, and once more in the next one if it is among the last before of its block."""
    own = F.floor(F.col("event_index") / block)
    again = F.when(F.col("event_index") % block >= block - before, own + 1)
    return rows.withColumn("_b", F.explode(F.filter(F.array(own, again), lambda x: x.isNotNull())))


def windows_scores(known: DataFrame, dist: DataFrame, stream: tuple[str, ...], windows: tuple[int, ...], on: tuple[str, ...] = (), block: int | None = None) -> DataFrame:
    """known (events with event_index and _q) with jsd_<w> for each of windows: between the last w tools and dist; null until the
    window is full.

    Each event enters all windows at its own place and leaves each one w places later: rows of +1 and -1, so that a tool's
    count in a window is a running sum, for any vocabulary and for all windows in one order. The divergence is that of the tools within
    the window, plus what dist has elsewhere, which is a constant less the parts of those within. The events themselves ride on the rows by which they enter,
    so that they are dealt by stream once and nothing is joined.

    With block, a stream is dealt in blocks of so many events, each with the events before it that its windows reach to."""
    eps = EPS
    alone = lambda q: kl_term(q, q / 2, eps) / 2  # noqa: E731  a tool's part if the window lacks it
    rest = dist.groupBy(*on).agg(F.coalesce(F.sum(alone(F.col("p"))), F.lit(0.0)).alias("_rest"))
    rows = _beside(known, rest, on)
    keys, start = stream, F.lit(0)
    if block is not None:
        if block < max(windows):
            raise ValueError("a block has as many events as a window at least")
        rows, keys = overlapped(rows, block, max(windows) - 1), (*stream, "_b")
        start = F.greatest(F.lit(0), F.col("_b") * block - (max(windows) - 1))
    rows = rows.repartition(*keys)
    others = [c for c in rows.columns if c not in (*keys, "event_index")]
    enter = F.struct(F.col("event_index").alias("at"), F.struct(*others).alias("event"), *(F.lit(1).alias(f"d{w}") for w in windows))
    none = F.lit(None).cast(rows.select(F.struct(*others).alias("e")).schema["e"].dataType)
    leave = [F.struct((F.col("event_index") + w).alias("at"), none.alias("event"), *(F.lit(-1 if v == w else 0).alias(f"d{v}") for v in windows)) for w in windows]
    steps = rows.select(*keys, "tool", F.coalesce("_q", F.lit(0.0)).alias("_p"), F.explode(F.array(enter, *leave)).alias("_s"))
    own = Window.partitionBy(*keys, "tool").orderBy("_s.at").rowsBetween(Window.unboundedPreceding, 0)

    def part(count, window):
        p, q = count / window, F.col("_p")
        return F.when(count > 0, js_term(p, q, eps) - alone(q)).otherwise(F.lit(0.0))

    steps = steps.select("*", *(F.sum(f"_s.d{w}").over(own).alias(f"_n{w}") for w in windows))
    change = lambda w: F.sum(part(F.col(f"_n{w}"), w) - part(F.col(f"_n{w}") - F.col(f"_s.d{w}"), w)).alias(f"_c{w}")
    folded = steps.groupBy(*keys, F.col("_s.at").alias("event_index")).agg(F.first("_s.event", ignorenulls=True).alias("_event"), *(change(w) for w in windows)).where("_event IS NOT NULL")
    upto = Window.partitionBy(*keys).orderBy("event_index").rowsBetween(Window.unboundedPreceding, 0)
    scored = folded.select(*keys, "event_index", "_event.*", *(F.sum(f"_c{w}").over(upto).alias(f"_t{w}") for w in windows))
    out = scored.select(*keys, "event_index", *(c for c in others if c != "_rest"), *(
        F.when(F.col("event_index") >= start + w - 1, F.col("_rest") + F.col(f"_t{w}")).alias(f"jsd_{w}") for w in windows))
    return out if block is None else out.where(F.col("_b") == F.floor(F.col("event_index") / block)).drop("_b")


def window_scores(events: DataFrame, dist: DataFrame, stream: tuple[str, ...], window: int = 50, on: tuple[str, ...] = (), block: int | None = None, hot: bool = False) -> DataFrame:
    """events (with event_index) with jsd, as in windows_scores(). on: columns of stream by which dist has several distributions."""
    return windows_scores(with_probabilities(events, dist, on, hot), dist, stream, (window,), on, block).withColumnRenamed(f"jsd_{window}", "jsd").drop("_q")


def smoothed(scores: DataFrame, stream: tuple[str, ...], alpha: float = 0.1, block: int | None = None, of: dict[str, str] | None = None) -> DataFrame:
    """scores (with event_index and jsd) with ema: the first score, then alpha of each and the rest of what was. Scores are null
    only before a stream's first one. of: other columns to smooth, by the names that the results get.

    The recursion is a weighted sum. It is taken in parts of a stream, within which the weights stay in a double's range as running
    sums; a part starts from the sums of the parts before, of which CARRIED matter to a double's precision. With block, the blocks of a stream overlap by these."""
    of = {"jsd": "ema"} if of is None else of
    if alpha >= 1:
        return scores.select("*", *(F.col(c).alias(name) for c, name in of.items()))
    keep = 1 - alpha
    size = max(1, int(27 / -math.log(keep)))  # weights of 1e12 at most
    rows, keys = scores, stream
    if block is not None:
        block = max(block, (CARRIED + 2) * size)
        rows, keys = overlapped(rows, block, (CARRIED + 1) * size), (*stream, "_b")
    rows = rows.withColumn("_i", F.floor(F.col("event_index") / size)).withColumn("_j", F.col("event_index") % size)
    order = Window.partitionBy(*keys).orderBy("event_index")
    # the first score of a stream, not of an overlap, counts in full
    starts = F.lit(True) if block is None else (F.col("event_index") < block) | (F.col("event_index") >= F.col("_b") * block)
    full = {c: F.lag(c).over(order).isNull() & starts for c in of}
    rows = rows.select("*", *(full[c].alias(f"_f_{c}") for c in of))
    rows = rows.select("*", *((F.col(c) * F.when(F.col(f"_f_{c}"), 1.0).otherwise(alpha) * F.pow(F.lit(keep), -F.col("_j"))).alias(f"_x_{c}") for c in of))
    here = Window.partitionBy(*keys, "_i").orderBy("event_index").rowsBetween(Window.unboundedPreceding, 0)
    back = lambda k: Window.partitionBy(*keys).orderBy("_i").rangeBetween(-k, -k)
    past = {c: sum((F.coalesce(F.sum(f"_x_{c}").over(back(k)), F.lit(0.0)) * keep ** (size - 1 + (k - 1) * size) for k in range(1, CARRIED + 1)), F.lit(0.0)) for c in of}
    rows = rows.select("*", *(F.sum(f"_x_{c}").over(here).alias(f"_l_{c}") for c in of), *(past[c].alias(f"_c_{c}") for c in of))
    ema = lambda c: F.when(F.col(c).isNotNull(), F.pow(F.lit(keep), F.col("_j")) * F.col(f"_l_{c}") + F.pow(F.lit(keep), F.col("_j") + 1) * F.col(f"_c_{c}"))
    rows = rows if block is None else rows.where(F.col("_b") == F.floor(F.col("event_index") / block))
    return rows.select(*scores.columns, *(ema(c).alias(name) for c, name in of.items()))


def patience(scores: DataFrame, stream: tuple[str, ...], threshold, n: int = 5, score: str = "ema", block: int | None = None) -> DataFrame:
    """scores with alarmed: the last n scores all above the threshold. With block, by the last place that wasn't above it."""
    over = F.coalesce(F.col(score) > (F.col(threshold) if isinstance(threshold, str) else F.lit(threshold)), F.lit(False))
    if block is None:
        w = Window.partitionBy(*stream).orderBy("event_index").rowsBetween(-(n - 1), 0)
        return scores.withColumn("alarmed", (F.sum(over.cast("int")).over(w) == n))
    rows = running(scores.withColumn("_under", F.when(~over, -F.col("event_index"))), stream, "_under", "_last", "min", block)
    return rows.withColumn("alarmed", F.col("event_index") + F.coalesce("_last", F.lit(1)) >= n).drop("_under", "_last")


def cusum_scores(events: DataFrame, dist: DataFrame, stream: tuple[str, ...], slack: float = 0.5, on: tuple[str, ...] = (), block: int | None = None, hot: bool = False) -> DataFrame:
    """events with stat: the cumulative sum less its smallest value so far (and zero)."""
    return _cusum(with_probabilities(events, dist, on, hot), dist, stream, slack, on, block).drop("_q")


def _cusum(known: DataFrame, dist: DataFrame, stream: tuple[str, ...], slack: float, on: tuple[str, ...], block: int | None) -> DataFrame:
    mean = dist.groupBy(*on).agg(entropy("p").alias("_mean"))
    known = _beside(known, mean, on).withColumn("_x", surprisal("_q") - F.col("_mean") - slack)
    keys = stream if block is None else (*stream, "_b")
    if block is not None:
        known = known.withColumn("_b", F.floor(F.col("event_index") / block))
    upto = Window.partitionBy(*keys).orderBy("event_index").rowsBetween(Window.unboundedPreceding, 0)
    known = known.withColumn("_c", F.sum("_x").over(upto)).withColumn("_least", F.min("_c").over(upto))
    sum_, least = F.col("_c"), F.least(F.lit(0.0), F.col("_least"))
    if block is not None:
        # a block starts from the sum of those before it, and from the smallest value that any of them had
        ends = known.groupBy(*keys).agg(F.sum("_x").alias("_e"), F.min("_c").alias("_m"))
        before = Window.partitionBy(*stream).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.withColumn("_at", F.coalesce(F.sum("_e").over(before), F.lit(0.0)))
        ends = ends.withColumn("_low", F.coalesce(F.min(F.col("_at") + F.col("_m")).over(before), F.lit(0.0)))
        known = known.join(ends.select(*keys, "_at", "_low"), list(keys))
        sum_, least = F.col("_at") + F.col("_c"), F.least(F.lit(0.0), F.col("_low"), F.col("_at") + F.col("_least"))
    return known.withColumn("stat", sum_ - least).drop("_mean", "_x", "_c", "_least", "_b", "_at", "_low")


def scored(events: DataFrame, dist: DataFrame, stream: tuple[str, ...], div: Divergence = Divergence(), cus: Cusum = Cusum(), on: tuple[str, ...] = (), block: int | None = None, hot: bool = False) -> DataFrame:
    """events with jsd, ema and stat. dist is broadcast where Spark finds it small enough. block: events of a stream that
    one task takes, for streams that are too large for one."""
    w = div.window
    return swept(events, dist, stream, (w,), div.alpha, cus.slack, on, block, hot).withColumnRenamed(f"jsd_{w}", "jsd").withColumnRenamed(f"ema_{w}", "ema")


def swept(events: DataFrame, dist: DataFrame, stream: tuple[str, ...], windows: tuple[int, ...], alpha: float = 0.1, slack: float = 0.5, on: tuple[str, ...] = (), block: int | None = None, hot: bool = False) -> DataFrame:
    """events with jsd_<w> and ema_<w> for each of windows, and stat: all windows in one pass over the streams."""
    known = windows_scores(with_probabilities(events, dist, on, hot), dist, stream, windows, on, block)
    # the windows of the statistic are in the order that the scores come in; smoothing sorts by parts
    known = _cusum(known, dist, stream, slack, on, block).drop("_q")
    return smoothed(known, stream, alpha, block, {f"jsd_{w}": f"ema_{w}" for w in windows})


def calibrated(events: DataFrame, dist: DataFrame, stream: tuple[str, ...], window: int = 50, margin: float = 2.0, cap: float = CAP, on: tuple[str, ...] = (), block: int | None = None) -> DataFrame:
    """stream, div_threshold, cusum_threshold: the channels' largest scores times a margin, the first capped."""
    return thresholds(scored(events, dist, stream, Divergence(window=window), on=on, block=block), stream, margin, cap)


def thresholds(scores: DataFrame, stream: tuple[str, ...], margin: float = 2.0, cap: float = CAP) -> DataFrame:
    """The same of scores (with ema and stat)."""
    top = lambda c: F.greatest(F.lit(0.0), F.coalesce(F.max(c), F.lit(0.0))) * margin
    return scores.groupBy(*stream).agg(F.least(top("ema"), F.lit(cap)).alias("div_threshold"), top("stat").alias("cusum_threshold"))


def first_alarms(scores: DataFrame, stream: tuple[str, ...], div_threshold=0.15, cusum_threshold=8.0, n: int = 5, block: int | None = None) -> DataFrame:
    """stream, channel, event_index, score: the first alarm of each channel. Thresholds: numbers or columns."""
    at = lambda t: F.col(t) if isinstance(t, str) else F.lit(t)
    s = patience(scores, stream, div_threshold, n, block=block)
    hits = s.select(*stream, "event_index", F.explode(F.filter(F.array(
        F.struct(F.lit("divergence").alias("channel"), F.col("alarmed").alias("hit"), F.coalesce("ema", F.lit(0.0)).alias("score")),
        F.struct(F.lit("cusum").alias("channel"), (F.col("stat") > at(cusum_threshold)).alias("hit"), F.col("stat").alias("score"))), lambda x: x["hit"])).alias("_h"))
    first = hits.groupBy(*stream, F.col("_h.channel").alias("channel")).agg(F.min(F.struct("event_index", F.col("_h.score").alias("score"))).alias("_f"))
    return first.select(*stream, "channel", F.col("_f.event_index").alias("event_index"), F.col("_f.score").alias("score"))


def regimes(events: DataFrame, dist: DataFrame, stream: tuple[str, ...], channels: dict[str, Channel], on: tuple[str, ...] = (), block: int | None = None) -> DataFrame:
    """stream, channel, event_index, score: the first alarm of each of any channels, by the names that they are given."""
    out = None
    for name, channel in channels.items():
        hits = channel.verdicts(events, dist, stream, on, block).where("alarmed")
        first = hits.groupBy(*stream).agg(F.min(F.struct("event_index", F.coalesce("score", F.lit(0.0)).alias("score"))).alias("_f"))
        first = first.select(*stream, F.lit(name).alias("channel"), "_f.event_index", "_f.score")
        out = first if out is None else out.unionByName(first)
    if out is None:
        raise ValueError("no channels")
    return out


def two_regime(events: DataFrame, dist: DataFrame, stream: tuple[str, ...], div: Divergence = Divergence(), cus: Cusum = Cusum(), on: tuple[str, ...] = (), block: int | None = None) -> DataFrame:
    """First alarm of each channel in each stream. Order for reading: event_index, divergence before cusum."""
    return first_alarms(scored(events, dist, stream, div, cus, on, block), stream, div.threshold, cus.threshold, div.patience, block)


def persistence(events: DataFrame, dist: DataFrame, stream: tuple[str, ...], div: Divergence = Divergence(), on: tuple[str, ...] = (), block: int | None = None) -> DataFrame:
    """stream, shifted, persistent, first_alarm_index, final_score."""
    s = patience(smoothed(window_scores(events, dist, stream, div.window, on, block), stream, div.alpha, block), stream, div.threshold, div.patience, block=block)
    last = s.groupBy(*stream).agg(F.min(F.when(F.col("alarmed"), F.col("event_index"))).alias("first_alarm_index"), F.max_by("ema", "event_index").alias("final_score"))
    shifted = F.col("first_alarm_index").isNotNull()
    return last.select(*stream, shifted.alias("shifted"), (shifted & F.coalesce(F.col("final_score") > div.threshold, F.lit(False))).alias("persistent"), "first_alarm_index", "final_score")
