"""Two-level order against one window: places, running values, segments, and whole channels in small blocks."""

import random

import pytest
from pyspark.sql import functions as F

from tests import sequential as Q
from veerline.operators import channels as C
from veerline.operators import detectors as D
from veerline.operators import ordinals as O


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = [(u, i, rng.choice("ab"), rng.uniform(-1, 1)) for u, n in (("a", 130), ("b", 1), ("c", 47)) for i in rng.sample(range(1000), n)]
    return spark.createDataFrame(data, "s string, at long, v string, x double").persist()


@pytest.mark.parametrize("stream", [("s",), ()])
def test_places(rows, stream):
    got = {(r["s"], r["at"]): r["event_index"] for r in O.numbered_by_ranges(rows, stream, ("at", "s"), 5).collect()}
    key = (lambda r: (r["s"], r["at"])) if stream else (lambda r: (r["at"], r["s"]))
    want, seen = {}, {}
    for r in sorted(rows.collect(), key=key):
        g = r["s"] if stream else ""
        want[r["s"], r["at"]] = seen.get(g, 0)
        seen[g] = seen.get(g, 0) + 1
    assert got == want


@pytest.mark.parametrize("how", ["sum", "min"])
def test_running(rows, how):
    e = C.numbered(rows, ("s",), ("at",))
    a = O.running(O.running(e, ("s",), "x", "one", how), ("s",), "x", "two", how, 7)
    assert a.count() == rows.count() and a.where(F.abs(F.col("one") - F.col("two")) > 1e-12).count() == 0


def test_segments(rows):
    one = lambda **k: sorted((r["s"], r["at"], r["event_index"], r["segment"]) for r in D.segments(rows, ("at",), ("v",), ("s",), **k).collect())
    assert one() == one(block=6)
    flat = D.segments(rows, ("at", "s"), ("v",), ())
    want, last = -1, None
    for r in flat.orderBy("event_index").collect():
        want, last = want + (r["v"] != last), r["v"]
        assert r["segment"] == want
    drift = D.version_drift(rows.withColumn("tool", F.col("v")), ("at", "s"), ("v",), (), 1)
    assert drift.count() == want and drift.where("jsd < 0.999").count() == 0


def test_channels_in_blocks(spark):
    dist = Q.distribution(Q.zipf_tools(800, 20))
    tools = {"a": Q.zipf_tools(400, 20, 2) + ["new"] * 40, "b": Q.zipf_tools(30, 20, 3)}
    e = spark.createDataFrame([(s, i, t) for s, ts in tools.items() for i, t in enumerate(ts)], "s string, event_index long, tool string")
    d = spark.createDataFrame(list(dist.items()), "tool string, p double")
    got = {(r["s"], r["event_index"]): r for r in C.scored(e, d, ("s",), C.Divergence(window=12), block=17).collect()}
    for s, ts in tools.items():
        for i, (score, ema, stat) in enumerate(Q.channel_scores(ts, dist, 12)):
            r = got[s, i]
            assert r["stat"] == pytest.approx(stat, abs=1e-9)
            assert (r["ema"], r["jsd"]) == ((None, None) if score is None else (pytest.approx(ema, abs=1e-9), pytest.approx(score, abs=1e-9)))
