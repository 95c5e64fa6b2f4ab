"""Composite experiments: each takes the tables of a corpus and returns small tables of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..folders import written
from ..functions import patterns as P
from ..functions import text as T
from ..functions.shell import command_tokens
from ..operators import baseline as B
from ..operators import channels as C
from ..operators import detectors as D
from ..operators import distributions as S
from ..operators import runs as R
from ..operators import selection as Q
from ..operators import timelines as L
from . import trials as X

# --- two classes of runs: injection, reward hacking ---


def two_classes(records: DataFrame, classes: DataFrame, trials: int = 10, margin: float = 2.0, window: int = 50, keys: tuple[str, ...] = (), least_clean: int = 8, least_bad: int = 10) -> dict[str, DataFrame]:
    """classes: keys, run_id, bad (boolean). per_run and stream rates, and the classes' divergence, of the keys that have
    enough runs of both. records: keys, run_id, step_index, tool."""
    used = classes.join(records.select(*keys, "run_id").distinct(), [*keys, "run_id"], "left_semi")
    n = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    used = used.withColumn("_bad", F.sum(F.col("bad").cast("long")).over(n)).withColumn("_clean", F.sum((~F.col("bad")).cast("long")).over(n))
    used = used.where((F.col("_bad") >= least_bad) & (F.col("_clean") >= least_clean)).select(*keys, "run_id", "bad")
    clean, bad = used.where("NOT bad").drop("bad"), used.where("bad").drop("bad")
    benign, attacks = X.hashed(clean, trials, keys), X.hashed(bad, trials, keys)
    both = used.join(records, [*keys, "run_id"])
    d = S.tool_distribution(both, (*keys, "bad"))
    side = lambda b: d.where(F.col("bad") == b).drop("bad")
    return {
        "per_run": X.per_run_rates(X.per_run_trials(records, benign, bad, margin, keys), keys),
        "stream": X.stream_rates(X.stream_trials(records, benign, attacks, window, margin, keys), keys),
        "jsd": S.js_divergence(side(False), side(True), keys),
        "vocabulary": both.groupBy(*keys).agg(F.count_distinct("tool").alias("vocabulary")),
    }


def injection(records: DataFrame, labels: DataFrame, **how) -> dict[str, DataFrame]:
    """Per pipeline and suite: benign runs against successful injections."""
    used = labels.where("n_calls > 0 AND (NOT attacked OR injection_success)")
    classes = used.select("pipeline", "suite", "run_id", F.col("injection_success").alias("bad"))
    rows = records.join(labels.select("run_id", "pipeline", "suite"), "run_id")
    return two_classes(rows, classes, keys=("pipeline", "suite"), **how)


#: Classes of terminal runs.
CLEAN_CLASS, HACKED_CLASS = "baseline", "rewarded_serious_exploit"


def terminal(records: DataFrame, labels: DataFrame, **how) -> dict[str, DataFrame]:
    """Per model: clean runs against rewarded exploits."""
    classes = labels.where(F.col("classification").isin(CLEAN_CLASS, HACKED_CLASS)).select("model_dir", "run_id", (F.col("classification") == HACKED_CLASS).alias("bad"))
    rows = records.withColumnRenamed("agent_id", "model_dir")
    return two_classes(rows, classes, keys=("model_dir",), **({"least_clean": 40, "least_bad": 30} | how))


def exported(records: DataFrame, labels: DataFrame, **how) -> dict[str, DataFrame]:
    return two_classes(records, labels.select("run_id", F.col("hacked").alias("bad")), **({"least_clean": 40, "least_bad": 30} | how))


def token_records(records: DataFrame, content: DataFrame, others: tuple[str, ...] = ()) -> DataFrame:
    """A record for each word of each call's command: run_id, step_index (from 0 anew), tool (the word). A call without
    content stands for itself."""
    rows = records.join(content.select(*others, "run_id", "step_index", F.lit(True).alias("_has"), "l1_text"), [*others, "run_id", "step_index"], "left")
    words = F.when(F.col("_has"), command_tokens("l1_text", "tool")).otherwise(F.array("tool"))
    each = rows.select(*others, "run_id", "step_index", F.posexplode(words).alias("k", "word"))
    w = Window.partitionBy(*others, "run_id").orderBy("step_index", "k")
    return each.select(*others, "run_id", (F.row_number().over(w) - 1).alias("step_index"), F.col("word").alias("tool"))


def window_sweep(records: DataFrame, benign: DataFrame, injected: DataFrame, windows: tuple[int, ...] = (50, 200, 800, 3200), margin: float = 2.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """Stream trials for several windows, in one pass over the streams: window and the columns of stream_rates."""
    cells = X.swept_trials(records, benign, injected, windows, margin, keys)
    return X.stream_rates(cells, (*keys, "window"))


# --- submissions: stability, and drift between versions of a family ---


def submissions(records: DataFrame, families: list[str], trials: int = 10, margin: float = 1.2, window: int = 50, least_runs: int = 100) -> dict[str, DataFrame]:
    """null: false alarms of each submission against its own runs; version: divergence and detection between each two
    successive submissions of a family."""
    found = submission_runs(records, least_runs)
    return {"null": submission_null(*found, trials, margin, window), "version": submission_versions(*found, families, trials, margin, window)}


def submission_runs(records: DataFrame, least_runs: int = 100) -> tuple[DataFrame, DataFrame]:
    """Records and runs (agent_id, run_id) of the submissions that have enough runs."""
    records = written(records.select("agent_id", "run_id", "step_index", "tool"), "submissions")
    ids = written(records.select("agent_id", "run_id").distinct(), "submission-runs")
    enough = ids.groupBy("agent_id").agg(F.count("run_id").alias("n_runs")).where(F.col("n_runs") >= least_runs).select("agent_id")
    enough = written(enough, "submission-names")
    return records.join(enough, "agent_id"), ids.join(enough, "agent_id")


def submission_null(rows: DataFrame, ids: DataFrame, trials: int = 10, margin: float = 1.2, window: int = 50) -> DataFrame:
    order = X.hashed(ids, trials, ("agent_id",))
    null = X.stream_trials(rows, order, order.where("false"), window, margin, ("agent_id",))
    return null.groupBy("agent_id", "channel").agg(F.count(F.lit(1)).alias("cells"), F.avg(F.col("false_alarm").cast("double")).alias("fp"), F.floor(F.median("horizon")).alias("median_horizon"))


def submission_versions(rows: DataFrame, ids: DataFrame, families: list[str], trials: int = 10, margin: float = 1.2, window: int = 50) -> DataFrame:
    named = ids.select("agent_id").distinct().withColumn("family", T.family_of("agent_id", families)).where("family IS NOT NULL")
    pairs = named.withColumn("new", F.lead("agent_id").over(Window.partitionBy("family").orderBy("agent_id"))).where("new IS NOT NULL").select("family", F.col("agent_id").alias("old"), "new")
    pairs = written(pairs, "submission-pairs")
    jsd = S.js_of_pairs(pairs, S.tool_distribution(rows, ("agent_id",)), "agent_id", "old", "new")
    # runs of the new submission as the attack on the old one's baseline; the pair names the stream
    side = lambda what, s: pairs.join(what.withColumnRenamed("agent_id", s), s).select("old", "new", F.concat_ws("/", F.lit(s), "run_id").alias("run_id"), *(c for c in what.columns if c not in ("agent_id", "run_id")))
    both = side(rows, "old").unionByName(side(rows, "new"))
    runs = lambda s: X.hashed(side(ids, s), trials, ("old", "new"))
    cells = X.stream_trials(both, runs("old"), runs("new"), window, margin, ("old", "new"))
    rates = X.stream_rates(cells, ("old", "new")).select("old", "new", "channel", "cells", "detection", "median_delay")
    return jsd.join(rates, ["old", "new"], "left")


# --- span traces ---


def span_coverage(records: DataFrame, labels: DataFrame, trials: int = 10, z: float = 3.0, min_calls: int = 30) -> dict[str, DataFrame]:
    """totals, bins (calls, failed and annotated by step bin), calibration (false flags of split halves)."""
    notes = labels.select("run_id", F.explode_outer("errors").alias("e")).select("run_id", F.col("e.location").alias("span_id")).where("span_id IS NOT NULL")
    spans = records.withColumn("span_id", F.try_element_at("meta", F.lit("span_id")))
    noted = notes.join(spans.select("run_id", "span_id", "step_index"), ["run_id", "span_id"]).groupBy(T.step_bin("step_index").alias("bin")).agg(F.count(F.lit(1)).alias("annotated"))
    bins = spans.groupBy(T.step_bin("step_index").alias("bin")).agg(F.count(F.lit(1)).alias("calls"), F.sum((F.col("status") == "error").cast("long")).alias("errors")).where(F.col("calls") >= min_calls)
    bins = bins.join(noted, "bin", "left").withColumn("annotated", F.coalesce("annotated", F.lit(0))).withColumn("status_error_rate", F.col("errors") / F.col("calls")).withColumn("annotated_rate", F.col("annotated") / F.col("calls"))
    totals = labels.agg(F.count(F.lit(1)).alias("n_runs"), *(F.sum(c).alias(c) for c in ("n_calls", "n_errors_annotated", "n_locations_resolved", "n_annotated_on_error_status")))
    order = X.hashed(records.select("run_id").distinct(), trials)
    return {"totals": totals, "bins": bins, "calibration": X.split_half_decay(records, order, z, min_calls)}


def span_content(records: DataFrame, content: DataFrame, labels: DataFrame) -> dict[str, DataFrame]:
    """coverage (by split and whether a span is annotated), categories (eval split), by_tokens and by_step densities."""
    rows = content.join(records.select("run_id", "step_index", "status"), ["run_id", "step_index"])
    rows = rows.withColumn("own", F.size(T.matched(T.output_text("l2_text", "l3_text"), P.FAILURE_SIGNATURES)) > 0)
    rows = R.prompt_delta(R.downstream(rows, "own"))
    notes = labels.select("run_id", F.explode_outer("errors").alias("e")).select("run_id", F.col("e.location").alias("span_id"), F.col("e.category").alias("category"))
    here = notes.join(rows, ["run_id", "span_id"])
    rest = rows.join(notes.select("run_id", "span_id").distinct(), ["run_id", "span_id"], "left_anti")
    count = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    both = here.select("run_id", "own", "near", "covered", "status", F.lit(True).alias("annotated")).unionByName(rest.select("run_id", "own", "near", "covered", "status", F.lit(False).alias("annotated")))
    coverage = both.groupBy(F.when(T.is_dev("run_id"), "dev").otherwise("eval").alias("split"), "annotated").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("status") == "error").cast("long")).alias("on_status"), count("own"), count("near"), count("covered"))
    categories = here.where(~T.is_dev("run_id")).groupBy(T.norm_category("category").alias("category")).agg(F.count(F.lit(1)).alias("n"), count("own"), count("near"), count("covered"))
    prompts = rows.where("kind = 'LLM' AND tokens_prompt > 0").join(notes.select("run_id", "span_id").distinct().withColumn("hit", F.lit(True)), ["run_id", "span_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    by_tokens = R.error_density(prompts, T.token_bin("tokens_prompt"), "hit", 1).withColumn("label", T.token_bin_label("bin"))
    upper = Q.picked(prompts.withColumn("bin", T.step_bin("step_index")), ("bin",), "tokens_prompt", {"median_tokens": Q.UPPER}).drop("n")
    by_step = R.error_density(prompts, T.step_bin("step_index"), "hit", 20).join(upper, "bin")
    return {"coverage": coverage, "categories": categories, "by_tokens": by_tokens, "by_step": by_step}


# --- patterns in texts of runs ---


def command_rules(content: DataFrame, labels: DataFrame, sep: str = "") -> dict[str, DataFrame]:
    """Reward hacking in commands, per model; the separator of the commands is part of what the patterns see."""
    return _patterns(content, labels, "l1_text", sep, False, P.COMMAND_RULES, P.LEAST["command"])


def reasoning_patterns(content: DataFrame, labels: DataFrame) -> dict[str, DataFrame]:
    return _patterns(content, labels, "l3_text", "\n", True, P.REASONING_PATTERNS, P.LEAST["reasoning"])


def _patterns(content, labels, column, sep, dedup, family, least):
    used = labels.where(F.col("classification").isin(CLEAN_CLASS, HACKED_CLASS)).withColumn("bad", F.col("classification") == HACKED_CLASS)
    content = content.withColumn("run_id", F.concat_ws("//", "model_dir", "run_id"))
    rows = R.run_verdicts(used.withColumn("_run", F.col("run_id")).withColumn("run_id", F.concat_ws("//", "model_dir", "run_id")), content, column, family, least, sep, dedup)
    rows = rows.withColumn("dev", T.is_dev("_run")).withColumn("split", F.when(F.col("dev"), "dev").otherwise("eval"))
    return {"rates": R.rates(rows, "bad", ("model_dir", "split")), "coverage": R.coverage(rows, ("bad",))}


def transfer(content: DataFrame, labels: DataFrame) -> DataFrame:
    """family, detection, fpr of the frozen families on exported trajectories."""
    out = None
    for name, column, dedup in (("command", "l1_text", False), ("reasoning", "l3_text", True)):
        rows = R.run_verdicts(labels, content, column, P.FAMILIES[name], P.LEAST[name], dedup=dedup)
        part = R.rates(rows, "hacked").select(F.lit(name).alias("family"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def injection_features(content: DataFrame, labels: DataFrame) -> dict[str, DataFrame]:
    """rates by pipeline and split, with totals; attacks (eval split); benign (features that benign runs of it match)."""
    rows = R.run_verdicts(labels.where("n_calls > 0"), content, "l2_text", P.INJECTION_FEATURES, P.LEAST["injection"])
    texts = R.run_texts(content.join(labels.where("attacked").select("run_id"), "run_id", "left_semi"), "l2_text", "\n")
    rows = rows.join(texts, "run_id", "left").withColumn("reached", F.col("attacked") & T.reached("injected", F.coalesce("text", F.lit("")))).drop("text")
    rows = rows.withColumn("split", F.when(F.col("dev"), "dev").otherwise("eval"))
    n = lambda c: F.sum(c.cast("long"))
    hit = F.col("flagged")
    rate = lambda c: F.try_divide(n(c & hit), n(c))
    rates = rows.rollup("split", "pipeline").agg(
        n(~F.col("attacked")).alias("n_benign"), n(F.col("attacked")).alias("n_attacked"), n(F.col("injection_success")).alias("n_success"), n(F.col("reached")).alias("n_reached"),
        rate(F.col("attacked")).alias("detection_attacked"), rate(F.col("injection_success")).alias("detection_success"), rate(F.col("reached")).alias("detection_reached"), rate(~F.col("attacked")).alias("fpr"))
    held = rows.where("split = 'eval'")
    attacks = held.where("attacked").groupBy("attack_type").agg(F.count(F.lit(1)).alias("n"), n(hit).alias("flagged"))
    return {"rates": rates, "attacks": attacks, "benign": R.coverage(held.where("NOT attacked"))}


# --- localisation ---


def visibility(records: DataFrame, labels: DataFrame) -> DataFrame:
    """n_runs, agent_visible, step_valid, both, thirds (of valid steps), median_share of the blamed agent's messages.

    A step is valid below the number of records, though steps may have holes."""
    own = labels.select("run_id", F.lower(F.coalesce("mistake_agent", F.lit(""))).alias("agent"), T.int_or_null("mistake_step").alias("step"))
    who = own.join(records.select("run_id", T.speaker("tool").alias("who")), "run_id", "left")
    g = who.groupBy("run_id", "agent", "step").agg(F.count("who").alias("n"), F.sum((F.lower("who") == F.col("agent")).cast("long")).alias("k"))
    g = g.withColumn("visible", F.coalesce(F.col("k") > 0, F.lit(False))).withColumn("valid", F.coalesce((F.col("step") >= 0) & (F.col("step") < F.col("n")), F.lit(False)))
    third = F.least(F.lit(2), F.floor(F.col("step") / F.col("n") * 3))
    n = lambda c: F.sum(c.cast("long"))
    counts = g.agg(F.count(F.lit(1)).alias("n_runs"), n(F.col("visible")).alias("agent_visible"), n(F.col("valid")).alias("step_valid"), n(F.col("visible") & F.col("valid")).alias("both"),
                   F.array(*(n(F.coalesce(F.col("valid") & (third == k), F.lit(False))) for k in range(3))).alias("thirds"))
    share = Q.medians(g.where("visible").withColumn("share", F.col("k") / F.col("n")), (), "share", "median_share").drop("n")
    return counts.join(F.broadcast(share), F.lit(True), "left")  # one row each


def blame(content: DataFrame, labels: DataFrame) -> DataFrame:
    """split, predictor, n, step_hits, near_hits, agent_hits, and expected (of a random step)."""
    steps = content.select("run_id", "step_index", F.col("tool").alias("label"), F.col("l3_text").alias("text"))
    n = steps.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    truth = labels.select("run_id", T.int_or_null("mistake_step").alias("mistake_step"), F.col("mistake_agent")).where("mistake_step IS NOT NULL").join(n, "run_id")
    out = None
    for split, keep in (("dev", T.is_dev("run_id")), ("eval", ~T.is_dev("run_id"))):
        part = truth.where(keep)
        scored = R.localiser_scores(R.localised(steps), part, steps).select(F.lit(split).alias("split"), "*").crossJoin(F.broadcast(part.agg(F.avg(1 / F.col("n")).alias("expected"))))
        out = scored if out is None else out.unionByName(scored)
    return out


def hallucination(content: DataFrame, labels: DataFrame) -> dict[str, DataFrame]:
    """detection by split and framework with totals; localisation by framework and predictor, in steps of the source."""
    flags = R.unacknowledged(content).select("run_id", "flagged")
    rows = labels.join(flags, "run_id").withColumn("split", F.when(T.is_dev("run_id"), "dev").otherwise("eval"))
    detection = R.rates(rows, "is_hallucination", ("split", "framework"), rollup=True)
    steps = content.select("run_id", "step_index", F.col("role").alias("label"), F.col("l3_text").alias("text"))
    truth = labels.where("is_hallucination AND hallucination_step IS NOT NULL").select("run_id", "framework", "hallucination_step")
    source = content.select("run_id", F.col("step_index").alias("predicted"), "step_source")
    known = truth.join(source.select("run_id", F.col("step_source").alias("hallucination_step")).distinct(), ["run_id", "hallucination_step"], "left_semi")
    found = R.localised(steps).join(known, "run_id").join(source, ["run_id", "predicted"], "left")
    hit = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    localisation = found.groupBy("framework", "predictor").agg(
        F.count(F.lit(1)).alias("n"), hit(F.col("step_source") == F.col("hallucination_step")).alias("step_hits"), hit(F.abs(F.col("step_source") - F.col("hallucination_step")) <= 2).alias("near_hits"))
    return {"detection": detection, "localisation": localisation}


# --- timelines of users ---


def _timeline(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What timelines need of records, and agent_id, run_id, tool, n, first and last time of each run's tools."""
    records = written(records.select("agent_id", "run_id", "step_index", "tool", "ts", "model_version"), "timeline-records")
    counts = records.groupBy("agent_id", "run_id", "tool").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return records, written(counts, "run-tools")


def _verdict(placed: DataFrame, records: DataFrame, counts: DataFrame, window: int, margin: float, cap: int, keys: tuple[str, ...]) -> DataFrame:
    """keys, channel, alarm, delay, horizon of placed (keys, run_id, pos, n, part: 0 admission, 1 calibration, 2 stream).

    Lengths, places and baselines follow from runs and their counts. Records are read once, for calibration and stream of the keys
    that have enough of both, which are scored in one pass."""
    runs = ["agent_id", "run_id"]
    upto = Window.partitionBy(*keys, "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = written(placed.select(*dict.fromkeys([*keys, *runs]), "part", "n", (F.sum("n").over(upto) - F.col("n")).alias("start")), "timeline-runs")
    length = lambda k: F.sum(F.when(F.col("part") == k, F.col("n")).otherwise(0))
    sizes = placed.groupBy(*keys).agg(length(1).alias("c"), F.least(F.lit(cap), length(2)).alias("horizon")).where((F.col("c") > window) & (F.col("horizon") > window)).drop("c")
    sizes = written(sizes.withColumn("stream_id", F.monotonically_increasing_id()), "timeline-sizes")
    known = placed.join(sizes.select(*keys, "stream_id"), list(keys)).select("stream_id", *runs, "part", "n", "start")
    dist = written(S.tool_distribution(known.where("part = 0").select("stream_id", *runs).join(counts, runs), ("stream_id",), "n"), "timeline-tools")
    most = F.when(F.col("part") == 2, F.least(F.col("n"), F.lit(cap) - F.col("start"))).otherwise(F.col("n"))
    used = written(known.where("part > 0").select("stream_id", *runs, "part", "start", most.alias("_most")).where("_most > 0"), "timeline-used")
    own = records.select(*runs, "step_index", "tool").join(used.select(*runs).distinct(), runs, "left_semi")
    ranked = own.withColumn("_rank", F.row_number().over(Window.partitionBy(*runs).orderBy("step_index")) - 1)
    events = ranked.join(used, runs).where("_rank < _most").select("stream_id", "part", (F.col("start") + F.col("_rank")).alias("event_index"), "tool")
    scores = C.scored(events, dist, ("stream_id", "part"), C.Divergence(window=window), on=("stream_id",))
    scores = written(scores.select("stream_id", "part", "event_index", "ema", "stat"), "timeline-scores")
    limits = C.thresholds(scores.where("part = 1"), ("stream_id",), margin)
    first = C.first_alarms(scores.where("part = 2").join(limits, "stream_id"), ("stream_id",), "div_threshold", "cusum_threshold").select("stream_id", "channel", F.col("event_index").alias("delay"))
    cells = sizes.withColumn("channel", F.explode(F.array(*map(F.lit, X.CHANNELS))))
    return cells.join(first, ["stream_id", "channel"], "left").withColumn("alarm", F.col("delay").isNotNull()).drop("stream_id")


def timeline_null(records: DataFrame, trials: int = 10, window: int = 50, margin: float = 2.0, least: int = 400, cap: int = 2000) -> DataFrame:
    """agent_id, channel, real_fp (sessions in their own order) and composed_fp (mean over shuffled orders), of each
    user's longest block of one known version."""
    records, counts = _timeline(records)
    blocks = written(L.version_blocks(L.sessions(records)), "timeline-sessions")
    block = L.longest_block(blocks, least).select("agent_id", "run_id", "session", "n")
    three = written(block.withColumn("_k", F.count(F.lit(1)).over(Window.partitionBy("agent_id"))).where("_k >= 3").drop("_k"), "timeline-blocks")
    # sessions in an order, cut at a half and three quarters
    cells = lambda order, keys: _verdict(L.split_at(order, (0.5, 0.75), keys), records, counts, window, margin, cap, keys)
    real = three.withColumn("pos", F.row_number().over(Window.partitionBy("agent_id").orderBy("session")).cast("long") - 1).drop("session")
    a = cells(real, ("agent_id",)).select("agent_id", "channel", F.col("alarm").alias("real_fp"), F.col("horizon").alias("real_horizon"))
    mixed = X.hashed(three.drop("session"), trials, ("agent_id",))
    b = cells(mixed, ("agent_id", "trial")).groupBy("agent_id", "channel").agg(F.avg(F.col("alarm").cast("double")).alias("composed_fp"), F.count(F.lit(1)).alias("composed_cells"))
    return a.join(b, ["agent_id", "channel"])


def timeline_versions(records: DataFrame, window: int = 50, margin: float = 2.0, least_old: int = 300, least_new: int = 150, cap: int = 2000) -> DataFrame:
    """agent_id, pair, kind (real or control), channel, alarm, delay, jsd, gap_days: borders between adjacent blocks of
    known versions, and false borders near 60 % of single blocks."""
    records, counts = _timeline(records)
    s = written(L.version_blocks(L.sessions(records)), "timeline-sessions")
    sizes = s.groupBy("agent_id", "block").agg(F.sum("n").alias("size"), F.first("version").alias("version"), F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy("agent_id").orderBy("block")
    nxt = sizes.withColumn("size1", F.lead("size").over(w)).withColumn("version1", F.lead("version").over(w))
    real = nxt.where((F.col("version") != "") & (F.col("version1") != "") & (F.col("size") >= least_old) & (F.col("size1") >= least_new))
    real = real.select("agent_id", F.concat(F.lit("real-"), F.col("block")).alias("pair"), F.col("block"), (F.col("block") + 1).alias("next"))
    sides = lambda col, part: real.alias("r").join(s.alias("s"), (F.col("r.agent_id") == F.col("s.agent_id")) & (F.col(f"r.{col}") == F.col("s.block"))).select("r.agent_id", "r.pair", "s.run_id", "s.session", "s.n", F.lit(part).alias("side"))
    rows = sides("block", 0).unionByName(sides("next", 1))
    big = sizes.where((F.col("version") != "") & (F.col("size") >= least_old + least_new) & (F.col("k") >= 3)).select("agent_id", "block")
    one = s.join(big, ["agent_id", "block"]).withColumn("pair", F.concat(F.lit("control-"), F.col("block")))
    one = one.withColumn("pos", F.row_number().over(Window.partitionBy("agent_id", "pair").orderBy("session")).cast("long") - 1)
    cut = L.split_at(one.select("agent_id", "pair", "run_id", "session", "n", "pos"), (0.6,), ("agent_id", "pair"))
    enough = cut.groupBy("agent_id", "pair").agg(F.sum(F.when(F.col("part") == 0, F.col("n"))).alias("o"), F.sum(F.when(F.col("part") == 1, F.col("n"))).alias("e")).where((F.col("o") >= least_old) & (F.col("e") >= least_new))
    rows = rows.unionByName(cut.join(enough.select("agent_id", "pair"), ["agent_id", "pair"]).select("agent_id", "pair", "run_id", "session", "n", F.col("part").alias("side")))
    keys = ("agent_id", "pair")
    rows = written(rows, "timeline-sides")
    old = rows.where("side = 0").withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy("session")).cast("long") - 1)
    parts = L.split_at(old, (2 / 3,), keys).unionByName(rows.where("side = 1").withColumn("pos", F.col("session")).withColumn("part", F.lit(2)))
    cells = _verdict(parts, records, counts, window, margin, cap, keys)
    tools = written(rows.drop("n").join(counts, ["agent_id", "run_id"]), "timeline-pairs")
    d = S.tool_distribution(tools, (*keys, "side"), "n")
    jsd = S.js_divergence(d.where("side = 0").drop("side"), d.where("side = 1").drop("side"), keys)
    gap = tools.groupBy(*keys).agg(((F.min(F.when(F.col("side") == 1, F.col("first"))) - F.max(F.when(F.col("side") == 0, F.col("last")))) / 86400.0).alias("gap_days"))
    return cells.join(jsd, list(keys)).join(gap, list(keys)).withColumn("kind", F.split("pair", "-")[0])


def fingerprints(records: DataFrame, size: int = 400, order: tuple[str, ...] = ("session", "step_index")) -> dict[str, DataFrame]:
    """within and between users: n, median, quartiles; aging: by block, n and medians."""
    s = L.sessions(records).select("agent_id", "run_id", "session")
    blocked = written(L.fixed_blocks(records.join(s, ["agent_id", "run_id"]), order, size).select("agent_id", "block", "n_blocks", "in_last", "tool", "ts"), "blocks")
    pairs = written(L.block_pairs(blocked), "block-pairs")
    within = L.quartiles(pairs.where("kind IN ('adjacent', 'lagged')"), ("kind",))
    between = L.quartiles(L.between_classes(blocked).withColumn("kind", F.lit("between")), ("kind",), weight="n")
    aging = pairs.where("kind = 'aging'")
    aging = Q.medians(aging, ("block",), "jsd", "median_jsd").join(Q.medians(aging, ("block",), "lag_days", "median_lag_days").drop("n"), "block")
    return {"divergence": within.unionByName(between), "aging": aging}
