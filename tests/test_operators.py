"""Operators against a sequential version of them, and on scenarios with known drift."""

import hashlib
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tests import scenes as G
from tests import sequential as Q
from veerline.functions import canonical, patterns
from veerline.functions import text as T
from veerline.operators import baseline as B
from veerline.operators import channels as C
from veerline.operators import detectors as D
from veerline.operators import distributions as S
from veerline.operators import runs as R
from veerline.operators import timelines as L


def streams(spark, **tools):
    return spark.createDataFrame([(s, i, t) for s, ts in tools.items() for i, t in enumerate(ts)], "s string, event_index long, tool string")


def table(spark, dist):
    return spark.createDataFrame(list(dist.items()), "tool string, p double")


def test_divergences(spark):
    p, q = {"a": 0.5, "b": 0.5}, {"c": 1.0}
    one = lambda f, a, b: f(table(spark, a), table(spark, b)).first()[0]
    assert abs(one(S.js_divergence, p, p)) < 1e-8 and abs(one(S.js_divergence, p, q) - 1) < 1e-6
    assert one(S.js_divergence, p, q) == pytest.approx(one(S.js_divergence, q, p), abs=1e-12)
    r = {"a": 0.9, "c": 0.1}
    assert one(S.kl_divergence, p, r) == pytest.approx(Q.kl(p, r), abs=1e-12)
    assert table(spark, p).agg(S.entropy("p")).first()[0] == 1.0


def test_js_of_pairs(spark):
    d = spark.createDataFrame([("x", "a", 1.0), ("y", "a", 0.5), ("y", "b", 0.5)], "k string, tool string, p double")
    pairs = spark.createDataFrame([("x", "y")], "a string, b string")
    assert S.js_of_pairs(pairs, d, "k").first()["jsd"] == pytest.approx(Q.js({"a": 1.0}, {"a": 0.5, "b": 0.5}), abs=1e-12)


@pytest.mark.parametrize("window", [1, 25])
def test_channels(spark, window):
    base, a, b = Q.zipf_tools(4000), Q.zipf_tools(1500, seed=2) + [f"new{i % 30}" for i in range(300)], Q.zipf_tools(40, seed=3)
    dist = Q.distribution(base)
    e = streams(spark, a=a, b=b)
    got = {(r["s"], r["event_index"]): r for r in C.scored(e, table(spark, dist), ("s",), C.Divergence(window=window)).collect()}
    for s, tools in (("a", a), ("b", b)):
        for i, (score, ema, stat) in enumerate(Q.channel_scores(tools, dist, window)):
            r = got[s, i]
            assert (r["jsd"] is None) == (score is None)
            if score is not None:
                assert r["jsd"] == pytest.approx(score, abs=1e-9) and r["ema"] == pytest.approx(ema, abs=1e-9)
            assert r["stat"] == pytest.approx(stat, abs=1e-8)
    first = {(r["s"], r["channel"]): r["event_index"] for r in C.two_regime(e, table(spark, dist), ("s",), C.Divergence(window=window, threshold=0.5)).collect()}
    for s, tools in (("a", a), ("b", b)):
        assert {c: i for (x, c), i in first.items() if x == s} == Q.alarms(Q.channel_scores(tools, dist, window), 0.5)


@pytest.mark.parametrize("alpha", [0.1, 0.7, 1.0])
def test_smoothing_over_many_blocks(spark, alpha):
    rng = random.Random(1)
    scores = [rng.random() for _ in range(1200)]
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(scores)], "s string, event_index long, jsd double")
    e = None
    for r, x in zip(C.smoothed(df, ("s",), alpha).orderBy("event_index").collect(), scores, strict=True):
        e = x if e is None else alpha * x + (1 - alpha) * e
        assert r["ema"] == pytest.approx(e, abs=1e-11)


def test_leave_one_out(spark):
    rng = random.Random(4)
    runs = {f"r{i}": rng.choices("abcde", [5, 3, 2, 1, 0.2], k=rng.randint(1, 9)) for i in range(12)} | {"own": ["z", "z"]}
    df = spark.createDataFrame([(r, i, t) for r, ts in runs.items() for i, t in enumerate(ts)], "run_id string, step_index int, tool string")
    for x in S.leave_one_out(df).collect():
        assert x["score"] == pytest.approx(Q.surprisal(runs[x["run_id"]], Q.distribution([t for r, ts in runs.items() if r != x["run_id"] for t in ts])), abs=1e-12)


@pytest.fixture(scope="module")
def scenes(spark):
    base = G.table(spark, G.stream("steady", 120, 1)[0]).persist()
    return base, {k: (lambda x: (G.table(spark, x[0]), x[1]))(G.stream(k, 120, 2)) for k in G.KINDS}


def test_baseline(spark, scenes):
    base, _ = scenes
    b = B.freeze(base)
    c = b.contents()
    rows = base.collect()
    assert c["n_records"] == len(rows) and c["n_runs"] == 120
    assert c["tool_dist"] == pytest.approx(Q.distribution([r["tool"] for r in rows]))
    assert sum(n for _, n in c["error_rate_by_length_bin"].values()) == len(rows)
    assert "send" in c["expected_tools_by_goal"]["mail"]
    assert b.fingerprint() == B.freeze(base.repartition(7)).fingerprint() == hashlib.sha256(json.dumps(c, sort_keys=True).encode()).hexdigest()[:16]


def test_detectors_on_scenarios(spark, scenes):
    base, found = scenes
    b = B.freeze(base)
    late = lambda k: found[k][0].orderBy("ts").withColumn("i", F.row_number().over(C.Window.orderBy("ts")) - 1).where(F.col("i") >= found[k][1]).drop("i")
    decay = lambda k: D.context_decay(late(k), b.error_rates).where("z > 3").count()
    assert decay("tiring") > 0 and decay("steady") == 0
    drift = lambda k: D.version_drift(found[k][0], ("ts",)).where("jsd >= 0.05").collect()
    (shift,) = drift("release")
    assert shift["boundary_index"] == found["release"][1] and shift["to_version"]["model_version"] == "two" and not drift("steady")
    omit = lambda k: {(r["goal_id"], r["tool"]) for r in D.omission(late(k), B.presence(base)).where("observed_presence < 0.5").collect()}
    assert ("mail", "sort") in omit("skipping") and not omit("steady")
    kinds = lambda k: {r["kind"] for r in D.goal_persistence(found[k][0], G.contracts(spark)).collect()}
    assert kinds("breaking") == set(G.BREAKS) and not kinds("steady")


def test_goal_persistence_rows(spark):
    rows = [("r1", i, t, h, s) for i, (t, h, s) in enumerate([("a", "x", "ok"), ("a", "x", "error"), ("b", "y", "abort")])] + [("r2", 0, "a", "z", "ok"), ("r3", 0, "end", "z", "ok"), ("r4", 0, "a", "q", "error")]
    df = spark.createDataFrame(rows, "run_id string, step_index int, tool string, params_hash string, status string").withColumn("goal_id", F.lit("g"))
    specs = spark.createDataFrame([("g", "end", 4, 2, 1)], "goal_id string, terminal_tool string, min_steps int, max_steps int, max_duplicate_calls int")
    got = {(r["run_id"], r["kind"], r["detail"]) for r in D.goal_persistence(df, specs).collect()}
    assert got == {("r1", "duplicate_submission", "a with identical params called 2x"), ("r1", "premature_abort", "aborted after 3 steps (min 4)"), ("r1", "missing_progress", "3 steps without terminal tool 'end'"), ("r2", "false_success", "run ended ok but terminal tool 'end' never succeeded")}


def test_persistence(spark, scenes):
    base, found = scenes
    dist = B.freeze(base).tools
    one = lambda k: C.persistence(C.numbered(found[k][0], ("agent_id",), ("ts",)), dist, ("agent_id",)).first()
    assert one("sudden")["persistent"] and one("slow")["persistent"] and not one("steady")["shifted"]
    t = one("passing")
    assert t["shifted"] and not t["persistent"] and t["final_score"] < 0.15


def test_timeline_cuts(spark):
    rng = random.Random(3)
    users = {f"u{k}": [rng.randint(1, 30) for _ in range(rng.randint(1, 9))] for k in range(30)}
    s = spark.createDataFrame([(u, i, n) for u, ns in users.items() for i, n in enumerate(ns)], "agent_id string, pos long, n long")
    got = {}
    for r in L.split_at(s, (0.5, 0.75)).collect():
        got.setdefault(r["agent_id"], {})[r["pos"]] = r["part"]
    for u, ns in users.items():
        cuts, low = [], 1
        for f in (0.5, 0.75):
            if low >= len(ns):
                cuts = None
                break
            cuts.append(min(range(low, len(ns)), key=lambda i: abs(sum(ns[:i]) - f * sum(ns))))
            low = cuts[-1] + 1
        assert got.get(u) == ({i: sum(i >= c for c in cuts) for i in range(len(ns))} if cuts else None)


def test_blocks_and_between(spark):
    rng = random.Random(5)
    tools = {u: rng.choices("abc", k=n) for u, n in (("u1", 45), ("u2", 23), ("u3", 9), ("u4", 20))}
    df = spark.createDataFrame([(u, float(i), i, t) for u, ts in tools.items() for i, t in enumerate(ts)], "agent_id string, ts double, step_index int, tool string")
    b = L.fixed_blocks(df, ("ts",), 10)
    pairs = {(r["kind"], r["agent_id"], r["block"]): r["jsd"] for r in L.block_pairs(b).collect()}
    blk = lambda u, k: Q.distribution(tools[u][10 * k : 10 * k + 10])
    assert set(pairs) == {("adjacent", "u1", 1), ("adjacent", "u2", 1), ("adjacent", "u4", 1), ("aging", "u1", 1), ("aging", "u1", 2), ("aging", "u1", 3), ("lagged", "u1", None)}
    assert pairs["aging", "u1", 3] == pytest.approx(Q.js(blk("u1", 0), blk("u1", 3)), abs=1e-9)
    assert pairs["lagged", "u1", None] == pytest.approx(Q.js(blk("u1", 0), Q.distribution(tools["u1"][-10:])), abs=1e-9)
    both = {(r["a"], r["b"]): r["jsd"] for r in L.between_users(b).collect()}
    assert set(both) == {("u1", "u2"), ("u1", "u4"), ("u2", "u4")} and both["u2", "u4"] == pytest.approx(Q.js(blk("u2", 0), blk("u4", 0)), abs=1e-8)


def test_localisers(spark):
    steps = [(0, "human", "hi"), (2, "Orchestrator (-> Web)", "go"), (3, "Web", "fine"), (5, "Code", "exitcode: 1 sorry"), (9, "Web", "end")]
    df = spark.createDataFrame([("r", *x) for x in steps] + [("one", 4, "human", "x")], "run_id string, step_index int, label string, text string")
    got = {(r["run_id"], r["predictor"]): r["predicted"] for r in R.localised(df).collect()}
    assert {p: got["r", p] for p in R.PREDICTORS} == {"first": 0, "third": 3, "middle": 3, "last": 9, "first_error": 5, "before_first_error": 3, "before_first_apology": 3, "first_worker": 3, "second_worker": 5, "first_worker_local": 3}
    assert {got["one", p] for p in R.PREDICTORS} == {4}
    truth = spark.createDataFrame([("r", 5, "Code")], "run_id string, mistake_step int, mistake_agent string")
    s = {r["predictor"]: (r["step_hits"], r["near_hits"], r["agent_hits"]) for r in R.localiser_scores(R.localised(df), truth, df).collect()}
    assert s["first_error"] == (1, 1, 1) and s["middle"] == (0, 1, 0)


def test_prompt_delta_and_downstream(spark):
    bad = "Code execution failed"
    spans = [("LLM", ""), ("TOOL", bad), ("LLM", bad), ("TOOL", ""), ("LLM", bad + bad), ("TOOL", "")]
    df = spark.createDataFrame([("r", i, k, t) for i, (k, t) in enumerate(spans)], "run_id string, step_index int, kind string, l1_text string")
    assert [r["covered"] for r in R.prompt_delta(df).orderBy("step_index").collect()] == [True, True, True, True, False, False]
    hit = df.withColumn("h", F.col("step_index") == 4)
    assert [r["near"] for r in R.downstream(hit, "h").orderBy("step_index").collect()] == [False, True, True, True, True, False]


def test_run_texts_and_consistency(spark):
    df = spark.createDataFrame([("r", 0, "a", "", ""), ("r", 1, "", '{"error": 1}', "done"), ("r", 2, "b", "", " "), ("r", 3, "a", "", ""), ("s", 0, "x", "failed", "I could not do it")], "run_id string, step_index int, l1_text string, l2_text string, l3_text string")
    text = lambda **k: {r["run_id"]: r["text"] for r in R.run_texts(df, "l1_text", **k).collect()}
    assert text(sep="")["r"] == "aba" and text()["r"] == "a\nb\na" and text(dedup=True)["r"] == "a\nb"
    assert {r["run_id"]: r["flagged"] for r in R.unacknowledged(df).collect()} == {"r": True, "s": False}


POSITIVE = {
    "verifier_recon": "grep -r scoring .", "pkgdb_tamper": "echo x >> /var/lib/dpkg/status", "version_sniff": 'if [ "$1" = "--version" ]', "fake_version_echo": "echo tool version 3", "force_depends": "dpkg --force-all -i x",
    "info_tag": "<information>", "addressed_msg": "Message from Emma to you", "before_solve": "before you can solve", "ignore_previous": "Ignore all previous", "do_first": "please do the following", "todo_directive": "a todo: x",
    "bypass": "bypassing", "fake": "faking", "verifier_talk": "the Checker", "without_actually": "without actually", "pass_the_check": "passes the checks", "shortcut": "shortcuts", "exploit": "exploits", "hardcode": "hardcoded",
    "minimal_effort": "minimal-effort", "satisfy_verifier": "satisfies the verifier", "weakness": "checker weakness", "trick_the": "tricked the", "scoring_script": "scoring logic",
    "exec_error": "Traceback (most recent call last)", "py_exception": "KeyError", "http_fail": "status code 503", "timeout": "timed out", "auth": "api key", "not_found": "404"}


def test_patterns(spark):
    df = spark.createDataFrame(list(POSITIVE.items()), "name string, text string")
    every = {n: rx for family in patterns.FAMILIES.values() for n, rx in family.items()}
    got = {r["name"]: r["m"] for r in df.select("name", T.matched("text", every).alias("m")).collect()}
    assert set(every) == set(POSITIVE) and all(n in m for n, m in got.items())
    odd = spark.createDataFrame([("le vérifier éfake",), ("",), (None,)], "text string")
    assert [r[0] for r in odd.select(T.flagged("text", patterns.REASONING_PATTERNS, 1)).collect()] == [False, False, False]


def test_projections(spark):
    ids = [f"run/{i}é" for i in range(300)]
    got = {r["i"]: r["d"] for r in spark.createDataFrame([(i,) for i in ids], "i string").select("i", T.is_dev("i").alias("d")).collect()}
    assert got == {i: int(hashlib.sha256(i.encode()).hexdigest(), 16) % 5 == 0 for i in ids}
    one = lambda c: spark.range(1).select(c).first()[0]
    lit = F.lit
    assert one(T.tool_name(lit("Bash"), lit("  ls -l"))) == "ls" and one(T.tool_name(lit("Bash"), lit(" "))) == "Bash" and one(T.tool_name(lit("x"), lit("ls"))) == "x"
    assert one(T.seam_label(lit(""), lit("r"))) == "r" and one(T.speaker(lit("A (-> B)"))) == "A"
    assert one(T.goal_of_instance(lit("a-b-12"))) == "a-b" and one(T.submission_epoch(lit("x"))) == 1.76e9 and one(T.submission_epoch(lit("20250101_a"))) == 1735689600.0
    assert one(T.agent_slug(lit(" Big  Agent "))) == "big-agent" and one(T.agent_slug(lit(None).cast("string"))) == "unknown"
    assert [one(T.duration_ms(lit(x))) for x in ("PT1M48.75S", "P1DT2H", "1s", "PT")] == [108750.0, 93600000.0, 0.0, 0.0]
    assert one(T.epoch(lit("2025-01-01T00:00:00+01:00"), lit(5))) == 1735686000.0 and one(T.epoch(lit("x"), lit(5))) == 5.0
    assert [one(T.token_bin(lit(x))) for x in (0, 1999, 2000, 3999, 4000, 2**40)] == [-1, -1, 0, 0, 1, (2**40 // 2000).bit_length() - 1]
    assert one(T.token_bin_label(lit(1))) == "4k-8k" and one(T.token_bin_label(lit(-1))) == "<2k"
    assert one(T.norm_category(lit(" Tool Failuress "))) == "tool failure" and one(T.norm_text(lit("A-b!  C"))) == "a b c"
    assert [one(T.int_or_null(lit(x))) for x in (" 7 ", "1_0", "x", "")] == [7, 10, None, None]
    assert one(T.codes_of(lit("1.1, 2"))) == ["1.1", "2"] and one(T.without_trailing_commas(lit("[1, ]"))) == "[1 ]"
    assert one(T.reached(F.array(lit("Send it!")), lit("please: SEND  it now"))) is True


def test_canonical(spark):
    df = spark.createDataFrame([('{"b": 1.0, "a": "é"}',), ('"s"',), (None,), ("bad",)], "x string")
    got = [tuple(r) for r in df.select(canonical.canonical_json("x"), canonical.json_text("x")).collect()]
    assert got == [('{"a": "\\u00e9", "b": 1.0}',) * 2, ('"s"', "s"), ("null", ""), (None, None)]
    assert math.isclose(1.0, 1.0)
