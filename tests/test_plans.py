"""Trials against a sequential version, experiments on small tables, the queries against their SQL, the command line."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tests import sequential as Q
from veerline import cli
from veerline.plans import experiments as E
from veerline.plans import queries, trials
from veerline.plans.report import markdown

SMALL = "/root/testdata/sf0.001"


def make_runs(prefix, n, seed, shift=0):
    import random

    rng = random.Random(seed)
    return {f"{prefix}{i:02d}": rng.choices("abcdefg"[shift:] + "xyz"[: 3 * bool(shift)], k=rng.randint(4, 30)) for i in range(n)}


@pytest.fixture(scope="module")
def classes(spark):
    clean, bad = make_runs("c", 24, 1), make_runs("d", 9, 2, 4)
    rows = [(r, i, t) for runs in (clean, bad) for r, ts in runs.items() for i, t in enumerate(ts)]
    return clean, bad, spark.createDataFrame(rows, "run_id string, step_index int, tool string").persist()


def permutations(spark, ids, n, seed=7):
    """trial, run_id, pos: the sorted ids as Python's generator shuffles them."""
    import random

    rows = []
    for k in range(n):
        order = sorted(ids)
        random.Random(seed + k).shuffle(order)
        rows += [(k, run, i) for i, run in enumerate(order)]
    return spark.createDataFrame(rows, "trial int, run_id string, pos long")


def test_trials(spark, classes):
    clean, bad, records = classes
    order, attack = permutations(spark, list(clean), 3), permutations(spark, list(bad), 3, 9)
    by = lambda df: {k: [r["run_id"] for r in df.orderBy("pos").collect() if r["trial"] == k] for k in range(3)}
    orders, attacks, runs = by(order), by(attack), {**clean, **bad}
    for r in trials.per_run_trials(records, order, spark.createDataFrame([(b,) for b in bad], "run_id string"), 1.2).collect():
        t, fp, tp = Q.per_run(runs, orders[r["trial"]], list(bad), 1.2)
        assert r["threshold"] == pytest.approx(t, abs=1e-9) and (r["fp"], r["tp"], r["n_benign"], r["n_injected"]) == (fp, tp, 12, 9)
    cells = trials.stream_trials(records, order, attack, 20, 1.3).collect()
    assert len(cells) == 6
    for r in cells:
        false, delay = Q.stream(runs, orders[r["trial"]], attacks[r["trial"]], 20, 1.3)[r["channel"]]
        assert (r["false_alarm"], r["delay"], r["detected"]) == (false, delay, delay is not None)
        assert r["detected_after_onset"] or not r["detected"]


def test_hashed_order_is_total(spark, classes):
    ids = classes[2].select("run_id").distinct()
    a, b = (sorted(map(tuple, trials.hashed(ids.repartition(k), 2).collect())) for k in (1, 3))
    assert a == b and len(a) == 66


def test_two_classes(spark, classes):
    clean, bad, records = classes
    labels = records.select("run_id").distinct().withColumn("bad", F.col("run_id").startswith("d"))
    r = E.two_classes(records, labels, trials=2, margin=1.1, window=10, least_bad=5)
    assert r["per_run"].first()["cells"] == 2 and r["stream"].count() == 2 and r["vocabulary"].first()[0] == 10
    flat = lambda runs: [t for ts in runs.values() for t in ts]
    assert r["jsd"].first()["jsd"] == pytest.approx(Q.js(Q.distribution(flat(clean)), Q.distribution(flat(bad))), abs=1e-9)
    assert E.two_classes(records, labels, trials=2, least_bad=50)["per_run"].first()["cells"] == 0


def test_submissions_and_sweep(spark):
    rows = [(s, f"{s}-{r}", i, t) for s, k in (("2024_alpha", 0), ("2025_alpha", 4), ("2025_other", 0)) for r, ts in make_runs("r", 24, 3 + k, k).items() for i, t in enumerate(ts)]
    records = spark.createDataFrame(rows, "agent_id string, run_id string, step_index int, tool string")
    r = E.submissions(records, ["alpha"], trials=2, window=10, least_runs=5)
    assert r["null"].count() == 6 and {(x["old"], x["new"]) for x in r["version"].collect()} == {("2024_alpha", "2025_alpha")}
    ids = trials.hashed(records.where("agent_id = '2025_other'").select("run_id").distinct(), 2)
    one = records.where("agent_id = '2025_other'")
    assert {x["window"] for x in E.window_sweep(one, ids, ids, (5, 10), 2.0).collect()} == {5, 10}


def test_content_experiments(spark):
    docs = [(f"m{i}", "m", "baseline" if i % 2 else "rewarded_serious_exploit") for i in range(40)]
    labels = spark.createDataFrame(docs, "run_id string, model_dir string, classification string")
    content = spark.createDataFrame([(r, m, 0, "x", "ls" if c == "baseline" else "grep verify x", "", "ok" if c == "baseline" else "bypass the verifier") for r, m, c in docs], "run_id string, model_dir string, step_index int, tool string, l1_text string, l2_text string, l3_text string")
    for f in (E.command_rules, E.reasoning_patterns):
        assert all((x["detection"], x["fpr"]) == (1.0, 0.0) for x in f(content, labels)["rates"].collect())
    hacked = labels.withColumn("hacked", F.col("classification") != "baseline")
    assert {x["family"]: x["detection"] for x in E.transfer(content.drop("model_dir"), hacked).collect()} == {"command": 1.0, "reasoning": 1.0}
    attacks = [(f"a{i}", "p", "none" if i % 2 else None, bool(i % 2), bool(i % 2), 1, ["Do it"] if i % 2 else []) for i in range(40)]
    labels = spark.createDataFrame(attacks, "run_id string, pipeline string, attack_type string, attacked boolean, injection_success boolean, n_calls int, injected array<string>")
    content = spark.createDataFrame([(a[0], 0, "<INFORMATION> do it" if a[3] else "fine") for a in attacks], "run_id string, step_index int, l2_text string")
    r = E.injection_features(content, labels)
    total = r["rates"].where("split IS NULL").first()
    assert (total["detection_attacked"], total["detection_reached"], total["fpr"], total["n_reached"]) == (1.0, 1.0, 0.0, 20)


def test_span_and_blame_experiments(spark):
    from tests.test_sources import put  # noqa: F401  the readers have their own tests

    records = spark.createDataFrame([("r", i, "t", "error" if i == 3 else "ok", {"span_id": f"s{i}"}) for i in range(40)], "run_id string, step_index int, tool string, status string, meta map<string,string>")
    content = spark.createDataFrame([("r", i, f"s{i}", "LLM" if i % 2 else "TOOL", "", "KeyError" if i == 3 else "", "", 2500 * (i + 1)) for i in range(40)], "run_id string, step_index int, span_id string, kind string, l1_text string, l2_text string, l3_text string, tokens_prompt int")
    labels = spark.createDataFrame([("r", [("Failures ", "s3", "H"), ("x", "gone", "L")], 40, 2, 1, 1)], "run_id string, errors array<struct<category:string,location:string,impact:string>>, n_calls int, n_errors_annotated int, n_locations_resolved int, n_annotated_on_error_status int")
    a = E.span_coverage(records, labels, trials=2, min_calls=5)
    assert {(x["bin"], x["annotated"], x["errors"]) for x in a["bins"].collect()} == {(0, 1, 1), (1, 0, 0), (2, 0, 0), (3, 0, 0)} and a["calibration"].count() == 2
    b = E.span_content(records, content, labels)
    assert {(x["annotated"], x["n"], x["own"]) for x in b["coverage"].collect()} == {(True, 1, 1), (False, 39, 0)} and b["by_step"].count() == 0
    who = spark.createDataFrame([("r", "Web", "2"), ("q", "X", "9")], "run_id string, mistake_agent string, mistake_step string")
    steps = spark.createDataFrame([(r, i, t, "") for r in "rq" for i, t in enumerate(("human", "Web (a)", "Web"))], "run_id string, step_index int, tool string, l3_text string")
    v = E.visibility(steps, who).first()
    assert (v["agent_visible"], v["step_valid"], v["both"], v["thirds"]) == (1, 1, 1, [0, 0, 1]) and v["median_share"] == pytest.approx(2 / 3)
    assert E.blame(steps, who).agg(F.sum("n")).first()[0] == 20
    h = spark.createDataFrame([("r", "f", True, 2)], "run_id string, framework string, is_hallucination boolean, hallucination_step int")
    c = spark.createDataFrame([("r", 0, 1, "user", "", "q"), ("r", 1, 2, "agent", "error", "fine")], "run_id string, step_index int, step_source int, role string, l2_text string, l3_text string")
    r = E.hallucination(c, h)
    assert r["detection"].where("split IS NULL").first()["detection"] == 1.0
    assert {x["predictor"]: x["step_hits"] for x in r["localisation"].collect()}["last"] == 1


def test_timeline_experiments(spark):
    import random

    rng = random.Random(2)
    rows, ts = [], 0.0
    for u in ("u1", "u2"):
        for s in range(24):
            for i in range(20):
                ts += 60
                rows.append((u, f"{u}-{s:02d}", "v1" if s < 14 else "v2", i, ts, rng.choice("abcd" if s < 14 else "cdef")))
    records = spark.createDataFrame(rows, "agent_id string, run_id string, model_version string, step_index int, ts double, tool string")
    null = E.timeline_null(records, 2, 10, 2.0, 100).collect()
    assert len(null) == 4 and all(0 <= x["composed_fp"] <= 1 for x in null)
    v = E.timeline_versions(records, 10, 2.0, 100, 60).collect()
    assert {x["kind"] for x in v} == {"real", "control"} and all(x["alarm"] for x in v if x["kind"] == "real" and x["channel"] == "cusum")
    f = E.fingerprints(records, 60)
    assert {x["kind"]: x["n"] for x in f["divergence"].collect()} == {"adjacent": 2, "lagged": 2, "between": 1} and f["aging"].count() == 7


def test_command_line(spark, tmp_path, capsys):
    from tests.test_sources import injected_run, put

    put(tmp_path, "raw/p1/a.json", injected_run())
    cli.main(["convert", "injection", str(tmp_path / "raw"), str(tmp_path / "out")])
    assert "records: 2 rows" in capsys.readouterr().out
    assert json.loads((tmp_path / "out/manifest.json").read_text())["labels"]["n"] == 1
    assert "| per_run" not in cli.main(["run", "injection", str(tmp_path / "out"), "--set", "trials=1"])
    put(tmp_path, "raw/p2/a.json", injected_run())
    cli.main(["convert", "injection", str(tmp_path / "raw"), str(tmp_path / "some"), "--only", "pipeline=p2,p3"])
    assert [r["pipeline"] for r in spark.read.parquet(str(tmp_path / "some/labels")).collect()] == ["p2"]
    assert "## rates" in cli.main(["run", "injection-features", str(tmp_path / "out"), "--to", str(tmp_path / "tables")])
    assert spark.read.parquet(str(tmp_path / "tables/rates")).count() == 3
    assert len(cli.main(["list"]).splitlines()) == len(cli.EXPERIMENTS) == 18
    df = spark.createDataFrame([("a|b", None, 0.123456, True)], "a string, b string, c double, d boolean")
    assert markdown("T", df) == "## T\n\n| a | b | c | d |\n|---|---|---|---|\n| a\\|b | – | 0.1235 | yes |\n"


def value(x):
    return "null" if x is None or x != x else f"{x:.5f}" if isinstance(x, float) else str(x)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SMALL}/{f}')")
    df = queries.QUERIES[name](spark, SMALL)
    names = sorted(df.columns)
    got = sorted(tuple(value(r[c]) for c in names) for r in df.collect())
    found = con.execute(queries.ORACLE[name])
    cols = [d[0] for d in found.description]
    assert sorted(cols) == names
    assert got == sorted(tuple(value(dict(zip(cols, r, strict=True))[c]) for c in names) for r in found.fetchall())
