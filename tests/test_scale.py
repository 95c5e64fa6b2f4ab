"""Operators for groups, streams and keys of any size: ranks, pairs by blocks, windows in one pass, hot keys."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tests import sequential
from veerline.operators import channels as C
from veerline.operators import pairs, skew
from veerline.operators import selection as Q
from veerline.operators import timelines as L


def test_picked(spark):
    rng = random.Random(8)
    groups = {"a": [rng.choice([0.0, -0.0, 1.5, -2.0, 1e300]) for _ in range(500)], "b": [rng.random() for _ in range(301)], "one": [3.0], None: [1.0, 2.0, 2.0, 9.0]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("a", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, jsd double").repartition(5)
    ranks = {"first": lambda n: F.lit(0), "q1": Q.QUARTILE, "upper": Q.UPPER, "last": lambda n: n - 1}
    got = {r["g"]: r for r in Q.picked(df, ("g",), "jsd", ranks, parts=7).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        v, n = sorted(vs), len(vs)
        assert (got[g]["n"], got[g]["first"], got[g]["q1"], got[g]["upper"], got[g]["last"]) == (n, v[0], v[n // 4], v[n // 2], v[-1])
    whole = [v for _, v in rows if v is not None]
    assert Q.medians(df, (), "jsd").collect()[0]["median"] == statistics.median(whole)
    quartiles = {r["g"]: r for r in L.quartiles(df, ("g",)).collect()}
    assert all(math.isclose(quartiles[g]["median"], statistics.median(vs)) and quartiles[g]["q3"] == sorted(vs)[3 * len(vs) // 4] for g, vs in groups.items())
    assert Q.medians(df.where("false"), ("g",), "jsd").collect() == []


def test_all_pairs(spark):
    """In blocks of four, and tools that one, both or many of a pair have."""
    rng = random.Random(9)
    dists = {f"u{i}": sequential.distribution(rng.choices([f"t{k}" for k in range(rng.choice([1, 3, 30]))], k=40)) for i in range(23)}
    df = spark.createDataFrame([(u, t, p) for u, d in dists.items() for t, p in d.items()], "agent_id string, tool string, p double")
    for block in (4, 256):
        got = [(r["a"], r["b"], r["jsd"]) for r in pairs.js_of_all_pairs(df, "agent_id", block).collect()]
        assert sorted((a, b) for a, b, _ in got) == [(a, b) for a in sorted(dists) for b in sorted(dists) if a < b]
        assert all(math.isclose(x, sequential.js(dists[a], dists[b]), abs_tol=1e-9) for a, b, x in got)
    assert pairs.js_of_all_pairs(df.where("agent_id = 'u1'"), "agent_id").collect() == []
    assert pairs.js_of_all_pairs(df.where("false"), "agent_id").collect() == []


@pytest.mark.parametrize("block", [None, 60])
def test_windows_in_one_pass(spark, block, monkeypatch):
    """Several windows, two streams with baselines of their own, also in blocks."""
    rng = random.Random(10)
    tools = [f"t{i}" for i in range(12)]
    streams = {"a": rng.choices(tools, weights=range(1, 13), k=700), "b": rng.choices(tools[3:] + ["new"], k=333), "c": rng.choices(tools, k=4)}
    dists = {k: sequential.distribution(rng.choices(tools, k=200)) for k in streams}
    events = spark.createDataFrame([(s, i, t, f"{s}{i}") for s, ts in streams.items() for i, t in enumerate(ts)], "s string, event_index long, tool string, other string")
    dist = spark.createDataFrame([(s, t, p) for s, d in dists.items() for t, p in d.items()], "s string, tool string, p double")
    for hot in (False, True):
        got = {(r["s"], r["event_index"]): r for r in C.swept(events.repartition(3), dist, ("s",), (5, 20, 50), on=("s",), block=block, hot=hot).collect()}
        assert len(got) == sum(map(len, streams.values())) and all(got[k]["other"] == f"{k[0]}{k[1]}" for k in got)
        for s, ts in streams.items():
            for w in (5, 20, 50):
                for i, (jsd, ema, stat) in enumerate(sequential.channel_scores(ts, dists[s], w)):
                    r = got[s, i]
                    assert math.isclose(r["stat"], stat, abs_tol=1e-6)
                    for name, want in ((f"jsd_{w}", jsd), (f"ema_{w}", ema)):
                        assert r[name] is None if want is None else math.isclose(r[name], want, abs_tol=1e-8)


def test_smoothing_in_blocks(spark):
    rng = random.Random(11)
    scores = [None] * 9 + [rng.random() for _ in range(6000)]
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(scores)], "s string, event_index long, jsd double")
    ema = None
    for r, x in zip(C.smoothed(df, ("s",), 0.1, block=1300).orderBy("event_index").collect(), scores, strict=True):
        ema = x if ema is None else 0.1 * x + 0.9 * ema
        assert r["ema"] is None if ema is None else math.isclose(r["ema"], ema, abs_tol=1e-9)


def test_joined_apart(spark):
    rows = [("hot", i) for i in range(900)] + [(f"k{i % 60}", i) for i in range(100)] + [(None, i) for i in range(50)]
    table = [("hot", 1.0), *((f"k{i}", float(i)) for i in range(0, 60, 2)), ("other", 5.0)]
    a, b = spark.createDataFrame(rows, "tool string, i long").repartition(4), spark.createDataFrame(table, "tool string, p double")
    got = skew.joined_apart(a, b, ("tool",), 8)
    found = dict(table)
    assert sorted(((r["tool"], r["i"], r["p"]) for r in got.collect()), key=str) == sorted(((t, i, found.get(t)) for t, i in rows), key=str)
    assert [r["tool"] for r in skew.hot_keys(a, ("tool",), 2).collect()] == ["hot"]
    # what is shuffled has no key with more than a fraction of a task's share
    far = a.where("tool <> 'hot'").repartition(8, "tool").withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert max(r["count"] for r in far) <= 100


def test_pairs_of_classes_stand_for_all_pairs(spark):
    """Users of one distribution are compared once; their pairs count in ranks as if each were a row."""
    from veerline.operators import selection as Q
    from veerline.operators.pairs import classes, js_of_all_pairs, js_of_classes

    rows = [(f"u{i}", t, p) for i in range(60) for t, p in (("x", (i % 3 + 1) / 4), ("y", 1 - (i % 3 + 1) / 4))]
    d = spark.createDataFrame(rows, "k string, tool string, p double")
    assert classes(d, "k").select("_class").distinct().count() == 3
    short, whole = js_of_classes(d, "k").collect(), js_of_all_pairs(d, "k").collect()
    assert len(short) == 6 and sum(r["n"] for r in short) == 60 * 59 // 2 == len(whole) == len({(r["a"], r["b"]) for r in whole if r["a"] < r["b"]})
    kind = {r["k"]: r["_class"] for r in classes(d, "k").collect()}
    by = {tuple(sorted((r["a"], r["b"]))): r["jsd"] for r in short}
    assert all(abs(r["jsd"] - by[tuple(sorted((kind[r["a"]], kind[r["b"]])))]) < 1e-12 for r in whole)
    got = Q.medians(js_of_classes(d, "k"), (), "jsd", weight="n", q1=Q.QUARTILE).first()
    values = sorted(r["jsd"] for r in whole)
    assert got["n"] == 1770 and abs(got["median"] - (values[884] + values[885]) / 2) < 1e-12 and abs(got["q1"] - values[442]) < 1e-12


def test_divergences_of_classes_are_rounded_before_they_are_pairs_of_members(spark, monkeypatch):
    """Also in lists of four: 40 members of each of two classes, each pair once."""
    from pyspark.sql import functions as F

    from veerline.operators.pairs import js_of_all_pairs
    from veerline.plans.queries import QUERIES

    monkeypatch.setattr(pairs, "MEMBERS", 4)
    rows = [(f"u{i}", t, p) for i in range(80) for t, p in (("x", (i % 2 + 1) / 3), ("y", 1 - (i % 2 + 1) / 3))]
    d = spark.createDataFrame(rows, "k string, tool string, p double")
    got = js_of_all_pairs(d, "k", value=lambda jsd: F.round(F.abs(jsd), 2)).collect()
    want = round(sequential.js({"x": 1 / 3, "y": 2 / 3}, {"x": 2 / 3, "y": 1 / 3}), 2)
    assert {(r["a"], r["b"]): r["jsd"] for r in got} == {(f"u{i}", f"u{j}"): want if (i + j) % 2 else 0.0 for i in range(80) for j in range(80) if f"u{i}" < f"u{j}"}
    assert len(got) == 80 * 79 // 2
    plan = QUERIES["between_user_jsd"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(_mb" in plan and "round(" not in plan[:plan.index("Generate explode(_mb")]


def test_smoothing_of_streams_beyond_a_doubles_range(spark):
    """0.9 ** -k is infinite from k = 6737 on: 9000 scores, against the recursion."""
    from veerline.operators import channels as C

    scores = [((i * 7919) % 1000) / 1000 for i in range(9000)]
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(scores)], "agent_id string, event_index long, jsd double")
    want, ema = [], None
    for x in scores:
        ema = x if ema is None else 0.1 * x + 0.9 * ema
        want.append(ema)
    for block in (None, 2048):
        got = [r["ema"] for r in C.smoothed(df, ("agent_id",), block=block).orderBy("event_index").collect()]
        assert max(abs(a - b) for a, b in zip(got, want, strict=True)) < 1e-9


def test_places_of_trials_follow_from_runs(spark, monkeypatch):
    """Starts of runs in blocks of four places are those of a loop; runs without records are left out."""
    from veerline.plans import trials

    monkeypatch.setattr(C, "BLOCK", 4)
    rng = random.Random(12)
    sizes = {f"r{i}": rng.choice([0, 1, 3, 9]) for i in range(30)}
    counts = spark.createDataFrame([("k", r, t, 1) for r, n in sizes.items() for t in range(n)], "k string, run_id string, tool string, n long")
    order = {t: rng.sample(sorted(sizes), 30) for t in range(2)}
    runs = spark.createDataFrame([("k", t, r, i) for t, rs in order.items() for i, r in enumerate(rs)], "k string, trial int, run_id string, pos long")
    got = {(r["trial"], r["run_id"]): (r["start"], r["n"]) for r in trials._placed(runs, counts, ("k", "trial"), ("k",)).collect()}
    want = {}
    for t, rs in order.items():
        at = 0
        for r in rs:
            if sizes[r]:
                want[t, r] = (at, sizes[r])
            at += sizes[r]
    assert got == want


def test_versions_of_submissions_are_scored_once(spark):
    """No trials of the other query, and no table of placed events beside that of the scores."""
    from veerline import folders
    from veerline.plans import trial_queries

    before = folders.made()
    assert trial_queries.submission_versions(spark, "/root/testdata/sf0.001").columns == ["old", "new", "jsd", "channel", "cells", "detection", "median_delay"]
    names = [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in folders.made() - before]
    assert names.count("trial-scores") == 1 and "trial-events" not in names and "trial-streams" not in names


def test_timelines_of_versions_are_scored_once(spark):
    """Calibration and stream are one pass, over the records of the runs that it needs alone."""
    from veerline import folders
    from veerline.plans import trial_queries

    before = folders.made()
    found = trial_queries.timeline_versions(spark, "/root/testdata/sf0.01")
    made = {p.rsplit("/", 1)[1].rsplit("-", 1)[0]: p for p in folders.made() - before}
    assert len([p for p in folders.made() - before if "timeline-scores" in p]) == 1
    scores, used = spark.read.parquet(made["timeline-scores"]), spark.read.parquet(made["timeline-used"])
    assert scores.count() == used.agg(F.sum("_most")).first()[0] > 0
    assert found.select("agent_id", "pair").distinct().count() * 2 == found.count()
