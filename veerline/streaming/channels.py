"""The two channels over unbounded streams: one state a stream, a constant amount of work an event.

State of a stream: the window's tools by their slots and their counts, and a few numbers: the smoothed divergence, how long it has been above the threshold,
the cumulative sum, what has fired. A window of up to WHOLE tools is part of the one value that a batch reads and writes; tools and counts of a longer one are
entries of their own, so that an event rewrites two or three of them however long the window is. Scores equal those of the batch plans in operators.channels.

Without an event time, records are expected in order within a stream; those of one micro-batch are sorted. With one, they may come in any order within
the watermark: rows wait in a list until a timer tells that the watermark has passed them, are released in order, and scored then. Rows older than the watermark are dropped: by Spark, which counts them in its progress (numRowsDroppedByWatermark), and
those that reach the operator nonetheless are counted in late. The last rows of a stream wait for the watermark, too: a heartbeat (a later row of any other stream) moves it on. idle: event time without a row after which a stream's state goes."""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Callable, Iterator, MutableMapping
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.channels import Cusum, Divergence
from ..operators.distributions import EPS

#: Events after which the running divergence is summed anew, so that rounding can't pile up.
RESYNC = 4096
#: Longest window that is read and written whole: what a stream's state costs is calls, not bytes.
WHOLE = 256
OUTPUT = "stream string, event_index long, tool string, ema double, stat double, alarm string, late long"
STATE = "value string"


def _kl(p: float, q: float) -> float:
    return p * math.log2((p + EPS) / (q + EPS)) if p > 0 else 0.0


class Channels(Protocol):
    """What a streaming operator needs of an object that scores one stream: Scorer is one, others may stand in for it."""

    n: int

    def update(self, tool: str) -> tuple[float | None, float, list[str]]: ...

    def dump(self) -> str: ...

    def load(self, raw: str) -> None: ...


class Scorer:
    """Both channels over one stream of tools."""

    def __init__(self, dist: dict[str, float], div: Divergence = Divergence(), cus: Cusum = Cusum()):
        self.dist, self.div, self.cus = dist, div, cus
        self.mean = -sum(p * math.log2(p) for p in dist.values() if p > 0)
        self.rest = sum(self._alone(p) for p in dist.values())
        self.ring: MutableMapping[int, str] = {}
        self.counts: MutableMapping[str, int] = {}
        self.attached = False
        self.sum, self.ema, self.over, self.stat, self.n = 0.0, None, 0, 0.0, 0
        self.fired: list[str] = []

    @property
    def apart(self) -> bool:
        """Whether the window is too long to be written whole."""
        return self.div.window > WHOLE

    def attach(self, ring: MutableMapping[int, str], counts: MutableMapping[str, int]) -> None:
        """Window and counts that are kept elsewhere; dump() and load() leave them out then."""
        self.ring, self.counts, self.attached = ring, counts, True

    @staticmethod
    def _alone(q: float) -> float:
        return _kl(q, q / 2) / 2

    def _part(self, tool: str) -> float:
        """What a tool within the window adds to the divergence of an empty window."""
        n = self.counts.get(tool, 0)
        if not n:
            return 0.0
        p, q = n / self.div.window, self.dist.get(tool, 0.0)
        return (_kl(p, (p + q) / 2) + _kl(q, (p + q) / 2)) / 2 - self._alone(q)

    def _change(self, tool: str, by: int) -> None:
        self.sum -= self._part(tool)
        n = self.counts.get(tool, 0) + by
        if n:
            self.counts[tool] = n
        else:
            del self.counts[tool]
        self.sum += self._part(tool)

    def update(self, tool: str) -> tuple[float | None, float, list[str]]:
        """Smoothed divergence (None until the window is full), cumulative sum, and the channels that fire now."""
        slot = self.n % self.div.window
        leaves = self.ring[slot] if self.n >= self.div.window else None
        self.ring[slot] = tool
        self._change(tool, 1)
        if leaves is not None:
            self._change(leaves, -1)
        self.n += 1
        if self.n % RESYNC == 0:
            self.sum = sum(map(self._part, list(self.counts)))
        now: list[str] = []
        if self.n >= self.div.window:
            score = self.rest + self.sum
            self.ema = score if self.ema is None else self.div.alpha * score + (1 - self.div.alpha) * self.ema
            self.over = self.over + 1 if self.ema > self.div.threshold else 0
            if self.over >= self.div.patience:
                now.append("divergence")
        self.stat = max(0.0, self.stat - math.log2(self.dist.get(tool, self.cus.floor)) - self.mean - self.cus.slack)
        if self.stat > self.cus.threshold:
            now.append("cusum")
        new = [c for c in now if c not in self.fired]
        self.fired += new
        return self.ema, self.stat, new

    def dump(self) -> str:
        own = [] if self.attached else [list(self.ring.items())]
        return json.dumps([self.sum, self.ema, self.over, self.stat, self.n, self.fired, *own])

    def load(self, raw: str) -> None:
        self.sum, self.ema, self.over, self.stat, self.n, self.fired, *own = json.loads(raw)
        if own:
            self.ring = {slot: tool for slot, tool in own[0]}
            self.counts = dict(Counter(self.ring.values()))


class StateMap(MutableMapping):
    """A map state of Spark as a mapping of single values: entries are read when they are asked for, and flush() writes those that have changed."""

    def __init__(self, state):
        self.state, self.held, self.changed = state, {}, set()

    def __getitem__(self, key):
        if key not in self.held:
            self.held[key] = self.state.getValue((key,))[0] if self.state.containsKey((key,)) else None
        if self.held[key] is None:
            raise KeyError(key)
        return self.held[key]

    def __setitem__(self, key, value) -> None:
        self.held[key] = value
        self.changed.add(key)

    def __delitem__(self, key) -> None:
        self[key] = None

    def __iter__(self):
        stored = {k[0] for k in self.state.keys()} if self.state.exists() else set()
        return iter([k for k in stored | set(self.held) if self.held.get(k, 0) is not None])

    def __len__(self) -> int:
        return len(list(iter(self)))

    def flush(self) -> None:
        for key in self.changed:
            if self.held[key] is not None:
                self.state.updateValue((key,), (self.held[key],))
            elif self.state.containsKey((key,)):
                self.state.removeKey((key,))
        self.changed = set()


class ChannelProcessor(StatefulProcessor):
    """Scores each record of a stream; alarm names the channels that fire for the first time."""

    def __init__(self, make: Callable[[], Channels], order: tuple[str, ...], waiting: str | None = None, idle: int | None = None):
        """waiting: schema of rows that wait for the watermark; None, if they are scored as they come. idle: milliseconds."""
        self.make, self.order, self.waiting, self.idle = make, list(order), waiting, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("scorer", STATE)
        self.ring, self.counts = handle.getMapState("ring", "slot int", "tool string"), handle.getMapState("counts", "tool string", "n long")
        self.late = handle.getValueState("late", "n long, last long")
        if self.waiting is not None:
            self.rows = handle.getListState("waiting", self.waiting)

    def _scored(self, key, tools: list[str], late: int) -> Iterator[pd.DataFrame]:
        if not tools:
            return
        scorer = self.make()
        maps = [StateMap(self.ring), StateMap(self.counts)] if getattr(scorer, "apart", hasattr(scorer, "attach")) else []
        if maps:
            scorer.attach(*maps)
        if (held := self.state.get()) is not None:
            scorer.load(held[0])
        first, out = scorer.n, [scorer.update(tool) for tool in tools]
        self.state.update((scorer.dump(),))
        for m in maps:
            m.flush()
        n = len(tools)
        yield pd.DataFrame({
            "stream": np.full(n, key[0], object), "event_index": np.arange(first, first + n, dtype=np.int64), "tool": np.array(tools, object), "ema": np.array([x[0] for x in out], np.float64),
            "stat": np.array([x[1] for x in out], np.float64), "alarm": np.array([",".join(x[2]) for x in out], object), "late": np.full(n, late, np.int64)}, copy=False)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        columns, parts = [*(["event_time"] if self.waiting is not None else []), *self.order, "tool"], list(rows)
        # frames of one key are small: lists cost less than operations on frames
        values = {c: [x for p in parts for x in (p[c].to_numpy().astype("datetime64[ms]").astype(np.int64) if c == "event_time" else p[c]).tolist()] for c in columns}
        if self.waiting is None:
            place = sorted(range(len(values["tool"])), key=lambda i: tuple(values[c][i] for c in self.order))
            yield from self._scored(key, [values["tool"][i] for i in place], 0)
            return
        mark = timerValues.getCurrentWatermarkInMs()
        at = values["event_time"]
        new = [i for i, t in enumerate(at) if t >= mark]
        if len(new) < len(at) or self.idle is not None:
            late, last = self.late.get() or (0, 0)
            self.late.update((late + len(at) - len(new), max(last, *at)))
        if new:
            self.rows.appendList([(at[i], values["tool"][i], *(values[c][i] for c in self.order)) for i in new])
            self.handle.registerTimer(min(at[i] for i in new) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Releases rows that the watermark has passed: no earlier ones can come."""
        mark = timerValues.getCurrentWatermarkInMs()
        held = list(self.rows.get())
        done = sorted((r for r in held if r[0] < mark), key=lambda r: tuple(r[2:]))
        left = [tuple(r) for r in held if r[0] >= mark]
        late, last = self.late.get() or (0, 0)
        if done and left:
            self.rows.put(left)
        elif done:
            self.rows.clear()
        if left:
            self.handle.registerTimer(min(r[0] for r in left) + 1)
        elif self.idle is not None and mark >= last + self.idle:
            for state in (self.state, self.ring, self.counts, self.late):
                state.clear()
        elif self.idle is not None:
            self.handle.registerTimer(last + self.idle)
        yield from self._scored(key, [r[1] for r in done], late)

    def close(self) -> None:
        pass


def scored_stream(events: DataFrame, dist: dict[str, float], stream: str = "agent_id", order: tuple[str, ...] = ("ord",), div: Divergence = Divergence(), cus: Cusum = Cusum(), event_time: str | None = None, late: str = "10 minutes", make: Callable[[], Channels] | None = None, idle: int | None = None) -> DataFrame:
    """A streaming table of scores (OUTPUT). events: stream, tool and the order columns; needs the RocksDB state store.

    dist is the frozen baseline, of the size of the vocabulary. make: gives other channels than these two. event_time: rows come out of order, late at most;
    order must agree with it. idle: milliseconds of event time."""
    make = make or (lambda: Scorer(dist, div, cus))
    columns, waiting = [F.col(stream).alias("stream"), "tool", *order], None
    if event_time is not None:
        waiting = ", ".join(["at long", "tool string", *(f"{c} {t}" for c, t in events.select(*order).dtypes)])
        events = events.withColumn("event_time", F.col(event_time)).withWatermark("event_time", late)
        columns.append("event_time")
    rows = events.select(*columns).groupBy("stream")
    return rows.transformWithStateInPandas(statefulProcessor=ChannelProcessor(make, order, waiting, idle), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime" if event_time is not None else "None")


#: What a session needs for scored_stream().
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
