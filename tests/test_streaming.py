"""The streaming operators: equal to the batch plans over several micro-batches, and late rows."""

import json

import pytest

from tests import sequential as Q
from veerline.operators import channels as C
from veerline.streaming.channels import STATE_STORE, Scorer, StateMap, scored_stream


@pytest.mark.parametrize("window", [5, 25])
def test_scorer(window):
    base, tools = Q.zipf_tools(4000), Q.zipf_tools(6000, seed=2) + ["new"] * 50
    dist = Q.distribution(base)
    s = Scorer(dist, C.Divergence(window=window, threshold=0.4))
    want, fired = Q.channel_scores(tools, dist, window), {}
    for i, t in enumerate(tools):
        ema, stat, new = s.update(t)
        fired |= {c: i for c in new}
        assert ema == (None if want[i][1] is None else pytest.approx(want[i][1], abs=1e-9)) and stat == pytest.approx(want[i][2], abs=1e-7)
        if i % 997 == 0:  # the state survives a restart
            again = Scorer(dist, C.Divergence(window=window, threshold=0.4))
            again.load(json.loads(json.dumps(s.dump())))
            s = again
    assert fired == Q.alarms(want, 0.4)


def write(spark, path, rows):
    spark.createDataFrame(rows, "agent_id string, ord long, tool string, at timestamp").coalesce(1).write.mode("append").parquet(path)


def run(spark, path, tmp_path, name, **how):
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        events = spark.readStream.schema("agent_id string, ord long, tool string, at timestamp").option("maxFilesPerTrigger", 1).parquet(path)
        q = scored_stream(events, **how).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.table(name)


def test_stream_equals_batch(spark, tmp_path):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    dist = Q.distribution(Q.zipf_tools(500, 6))
    rows = [(u, i, t, t0 + dt.timedelta(seconds=i)) for u, seed in (("a", 2), ("b", 3)) for i, t in enumerate(Q.zipf_tools(90, 6, seed) + ["new"] * 20)]
    path = str(tmp_path / "in")
    for k in range(3):
        write(spark, path, [r for r in rows if r[1] * 3 // 110 == k])
    got = {(r["stream"], r["event_index"]): r for r in run(spark, path, tmp_path, "plain", dist=dist, div=C.Divergence(window=10)).collect()}
    events = C.numbered(spark.createDataFrame(rows, "agent_id string, ord long, tool string, at timestamp"), ("agent_id",), ("ord",))
    d = spark.createDataFrame(list(dist.items()), "tool string, p double")
    batch = C.scored(events, d, ("agent_id",), C.Divergence(window=10)).collect()
    assert len(batch) == len(got) == 220
    for r in batch:
        g = got[r["agent_id"], r["event_index"]]
        assert g["tool"] == r["tool"] and g["stat"] == pytest.approx(r["stat"], abs=1e-9)
        assert (r["ema"] is None) == (g["ema"] is None or g["ema"] != g["ema"]) and (r["ema"] is None or g["ema"] == pytest.approx(r["ema"], abs=1e-9))
    alarms = {(s, c): i for (s, i), r in got.items() for c in filter(None, r["alarm"].split(","))}
    assert alarms == {(r["agent_id"], r["channel"]): r["event_index"] for r in C.two_regime(events, d, ("agent_id",), C.Divergence(window=10)).collect()}


def test_disorder_within_the_watermark(spark, tmp_path):
    """Rows that come in any order within the watermark get the scores of the batch plan, each once."""
    import datetime as dt
    import random

    rng = random.Random(5)
    t0 = dt.datetime(2024, 1, 1)
    dist = Q.distribution(Q.zipf_tools(500, 6))
    rows = [(u, i, t, t0 + dt.timedelta(seconds=i)) for u, seed in (("a", 2), ("b", 3)) for i, t in enumerate(Q.zipf_tools(90, 6, seed) + ["new"] * 20)]
    path, batches = str(tmp_path / "in"), {}
    for r in rows:
        batches.setdefault((r[1] + rng.randint(0, 40)) // 30, []).append(r)
    for _, batch in sorted(batches.items()):
        rng.shuffle(batch)
        write(spark, path, batch)
    write(spark, path, [("heartbeat", 0, "x", t0 + dt.timedelta(days=1))])
    got = {(r["stream"], r["event_index"]): r for r in run(spark, path, tmp_path, "disorder", dist=dist, div=C.Divergence(window=10), event_time="at", late="80 seconds").collect()}
    events = C.numbered(spark.createDataFrame(rows, "agent_id string, ord long, tool string, at timestamp"), ("agent_id",), ("ord",))
    batch = C.scored(events, spark.createDataFrame(list(dist.items()), "tool string, p double"), ("agent_id",), C.Divergence(window=10)).collect()
    assert len(batch) == len(got) == 220 and all(r["late"] == 0 for r in got.values())
    for r in batch:
        g = got[r["agent_id"], r["event_index"]]
        assert g["tool"] == r["tool"] and g["stat"] == pytest.approx(r["stat"], abs=1e-9)
        assert r["ema"] is None or g["ema"] == pytest.approx(r["ema"], abs=1e-9)


def test_late_rows_and_idle_streams(spark, tmp_path):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    path = str(tmp_path / "late")
    # one row is late; a day later the stream starts anew, as its state has gone
    for k, minutes in enumerate(([0, 60], [61], [1], [62], [1440 * 2], [1440 * 2 + 1], [1440 * 5])):
        who = "other" if minutes[0] == 1440 * 5 else "a"
        write(spark, path, [(who, 100 * k + i, "x", t0 + dt.timedelta(minutes=m)) for i, m in enumerate(minutes)])
    write(spark, path, [("other", 1000, "x", t0 + dt.timedelta(days=9))])
    how = {"dist": {"x": 1.0}, "event_time": "at"}
    kept = run(spark, path, tmp_path, "timed", **how).where("stream = 'a'").orderBy("event_index").collect()
    assert [r["event_index"] for r in kept] == [0, 1, 2, 3, 4, 5] and kept[-1]["late"] <= 1
    gone = run(spark, path, tmp_path, "idle", idle=86_400_000, **how).where("stream = 'a'").collect()
    assert sorted(r["event_index"] for r in gone) in ([0, 0, 1, 1, 2, 3], [0, 1, 2, 3, 4, 5])


def test_scorer_with_maps_kept_elsewhere():
    class Store(dict):
        """What a map state offers."""

        writes = 0

        def getValue(self, key):
            return self[key]

        def containsKey(self, key):
            return key in self

        def updateValue(self, key, value):
            Store.writes += 1
            self[key] = value

        def removeKey(self, key):
            del self[key]

        def exists(self):
            return bool(self)

    base, tools = Q.zipf_tools(1000), Q.zipf_tools(5000, seed=4)
    dist, ring, counts, raw = Q.distribution(base), Store(), Store(), None
    want = Q.channel_scores(tools, dist, 400)
    for k in range(0, 5000, 20):  # a batch of twenty events
        s = Scorer(dist, C.Divergence(window=400))
        maps = StateMap(ring), StateMap(counts)
        s.attach(*maps)
        if raw is not None:
            s.load(raw)
        for i in range(k, k + 20):
            ema, stat, _ = s.update(tools[i])
            assert ema == (None if want[i][1] is None else pytest.approx(want[i][1], abs=1e-9)) and stat == pytest.approx(want[i][2], abs=1e-7)
        raw, before = s.dump(), Store.writes
        for m in maps:
            m.flush()
        assert Store.writes - before <= 60 and len(raw) < 300  # not the whole window
    assert len(ring) == 400 and sum(n for n, in counts.values()) == 400


def test_other_channels(spark, tmp_path):
    import datetime as dt

    class EveryOther:
        """A channel of one's own: fires at each second event."""

        def __init__(self):
            self.n = 0

        def update(self, tool):
            self.n += 1
            return None, float(self.n), ["even"] if self.n % 2 == 0 else []

        def dump(self):
            return str(self.n)

        def load(self, raw):
            self.n = int(raw)

    path = str(tmp_path / "mine")
    for k in range(3):
        write(spark, path, [("a", k, "x", dt.datetime(2024, 1, 1))])
    got = run(spark, path, tmp_path, "own", dist={}, make=EveryOther).orderBy("event_index").collect()
    assert [(r["stat"], r["alarm"]) for r in got] == [(1.0, ""), (2.0, "even"), (3.0, "")]


def test_a_short_window_is_one_value_of_state():
    """Two calls for a batch of any number of rows; no entry is read or written for a tool."""
    from veerline.streaming.channels import ChannelProcessor, Scorer

    class Value:
        def __init__(self):
            self.value, self.calls = None, 0

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls += 1
            self.value = value

        exists = None  # one call more, not needed

    p = ChannelProcessor(lambda: Scorer({"a": 0.5, "b": 0.5}), ("ord",))
    p.state, p.ring, p.counts = Value(), None, None
    tools = ["a", "b", "b", "c"] * 100
    parts = [x for k in (0, 150, 151) for x in p._scored(("u",), tools[k : {0: 150, 150: 151, 151: 400}[k]], 0)]
    assert p.state.calls == 6 and list(p._scored(("u",), [], 0)) == [] and p.state.calls == 6
    whole = Scorer({"a": 0.5, "b": 0.5})
    want = [whole.update(t) for t in tools]
    assert [e for x in parts for e in x["event_index"]] == list(range(400))
    assert [s for x in parts for s in x["stat"]] == [w[1] for w in want]
    assert [e for x in parts for e in x["ema"]][60:] == pytest.approx([w[0] for w in want][60:])
