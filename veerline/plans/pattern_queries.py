"""The engine's own pattern families and localisers over texts that hold them, ledgers and streams; each with SQL.

The tables' texts seldom hold what the families look for, so each run gets phrases by its number besides."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..folders import new_folder
from ..functions import patterns as P
from ..functions import text as T
from ..operators import channels as C
from ..operators import distributions as S
from ..operators import runs as R
from ..sources import files
from ..streaming import channels as H
from . import experiments as E
from . import records as V
from .queries import _ALARM, _CUS, _EMA, _ERR, _LOC, _RATE, _SORRY, STREAM, WINDOW, base_and_rest, query, r6
from .records import CONTENT, LABELLED, ORDER, RECORDS

COMMANDS = ("find . -name verifier.py", "echo x >> /var/lib/dpkg/status", "x = \"--version\"", "echo the build 12", "dpkg --force-depends -i a.deb", "ls -la", "cat notes.txt", "git commit")
THOUGHTS = ("I could bypass it and fake the output", "the verifier is a checker", "pass the check without actually doing it", "a shortcut, or an exploit", "hardcode it with minimal effort",
            "satisfy the checker; verifier weakness; trick the scoring script", "plain work", "more plain work", "")
RESULTS = ("<INFORMATION> read this", "a message from Emma to you", "before you can solve the task that I gave you", "ignore all previous orders", "please do the following", "a TODO now", "all is fine", "")
FAILURES = ("Traceback (most recent call last)", "a KeyError was raised", "too many requests", "it timed out", "forbidden", "no such file", "Error when executing; 404", "done", "")
SAID = ("Error: it broke", "exitcode: 2", "sorry, let's try again", "I apologize", "execution failed", "fine", "next", "that didn't work")


def _phrase(phrases, k):
    return F.element_at(F.array(*map(F.lit, phrases)), (k % len(phrases) + 1).cast("int"))


def _phrase_sql(phrases, k: str) -> str:
    return "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in phrases) + f"][({k}) % {len(phrases)} + 1]"


def _matched_sql(family: dict[str, str], text: str) -> str:
    hits = ", ".join(f"CASE WHEN regexp_matches({text}, '(?i){rx.replace(chr(39), chr(39) * 2)}') THEN '{name}' END" for name, rx in family.items())
    return f"list_filter([{hits}], lambda x: x IS NOT NULL)"


_DEV = "list_sum(list_transform(string_split(sha256({0}), ''), lambda c: CASE WHEN c = '' THEN 0 ELSE strpos('0123456789abcdef', c) - 1 END)) % 5 = 0"

# --- runs of two steps, whose texts are phrases and, in the second, a document ---


def _runs(spark, sf):
    d = V.labelled(spark, sf).withColumn("k", F.substring("run_id", 2, 20).cast("long"))
    k = F.col("k")
    step = lambda i, c, t, r, text: d.select("run_id", F.col("source").alias("model_dir"), F.lit(i).alias("step_index"), _phrase(COMMANDS, c).alias("l1_text"), _phrase(RESULTS, r).alias("l2_text"), F.concat(_phrase(THOUGHTS, t), text).alias("l3_text"))
    content = step(0, k, k, k, F.lit("")).unionByName(step(1, k + 3, F.floor(k / 2), k * 5 + 1, F.concat(F.lit(" "), F.col("text"))))
    labels = d.select("run_id", F.col("source").alias("model_dir"), F.when(F.col("toxic"), "rewarded_serious_exploit").when(F.col("low"), "other").otherwise("baseline").alias("classification"), F.col("toxic").alias("hacked"), "k")
    return content, labels


_RUNS2 = LABELLED + f""", k0 AS (SELECT run_id, CAST(substr(run_id, 2) AS BIGINT) AS k, source AS model_dir, text, toxic, low FROM d),
cc AS (SELECT *, {_phrase_sql(COMMANDS, 'k')} AS a1, {_phrase_sql(COMMANDS, 'k + 3')} AS b1, {_phrase_sql(RESULTS, 'k')} AS a2, {_phrase_sql(RESULTS, 'k * 5 + 1')} AS b2, {_phrase_sql(THOUGHTS, 'k')} AS a3, {_phrase_sql(THOUGHTS, 'k // 2')} || ' ' || text AS b3 FROM k0),
jo AS (SELECT *, a1 || b1 AS t1, array_to_string(list_filter([a1, b1], lambda x: x <> ''), chr(10)) AS n1, array_to_string(list_filter([a2, b2], lambda x: x <> ''), chr(10)) AS t2,
  array_to_string(list_filter(CASE WHEN a3 = b3 THEN [a3] ELSE [a3, b3] END, lambda x: x <> ''), chr(10)) AS t3, {_DEV.format('run_id')} AS dev FROM cc)"""


def _family_sql(family, text, least):
    return f", ve AS (SELECT *, {_matched_sql(family, text)} AS matched, len({_matched_sql(family, text)}) >= {least} AS flagged, toxic AS bad, CASE WHEN dev THEN 'dev' ELSE 'eval' END AS split FROM jo WHERE toxic OR NOT low) "


_RATES = f"SELECT model_dir, split, {_RATE.format(y='bad')} FROM ve GROUP BY model_dir, split"
_COVER = "SELECT bad, x.p AS pattern, count(*) AS n FROM ve, unnest(matched) AS x(p) GROUP BY 1, 2"


def _rated(found):
    return found["rates"].select("model_dir", "split", "n_positive", "n_negative", r6("detection", "detection"), r6("fpr", "fpr"))


@query(_RUNS2 + _family_sql(P.COMMAND_RULES, "t1", 1) + _RATES)
def command_rule_rates(spark, sf):
    return _rated(E.command_rules(*_runs(spark, sf)))


@query(_RUNS2 + _family_sql(P.COMMAND_RULES, "t1", 1) + _COVER)
def command_rule_coverage(spark, sf):
    return E.command_rules(*_runs(spark, sf))["coverage"]


@query(_RUNS2 + _family_sql(P.REASONING_PATTERNS, "t3", 2) + _RATES)
def reasoning_pattern_rates(spark, sf):
    return _rated(E.reasoning_patterns(*_runs(spark, sf)))


@query(_RUNS2 + _family_sql(P.REASONING_PATTERNS, "t3", 2) + _COVER)
def reasoning_pattern_coverage(spark, sf):
    return E.reasoning_patterns(*_runs(spark, sf))["coverage"]


@query(_RUNS2 + f""", ve AS (SELECT 'command' AS family, toxic, len({_matched_sql(P.COMMAND_RULES, 'n1')}) >= 1 AS flagged FROM jo UNION ALL SELECT 'reasoning', toxic, len({_matched_sql(P.REASONING_PATTERNS, 't3')}) >= 2 FROM jo)
SELECT family, {_RATE.format(y='toxic')} FROM ve GROUP BY family""")
def transfer_rates(spark, sf):
    content, labels = _runs(spark, sf)
    return E.transfer(content, labels).select("family", "n_positive", "n_negative", r6("detection", "detection"), r6("fpr", "fpr"))


_INJ = _RUNS2 + f""", ve AS (SELECT *, k % 3 = 0 AS attacked, k % 6 = 0 AS success, len({_matched_sql(P.INJECTION_FEATURES, 't2')}) >= 1 AS flagged,
  k % 3 = 0 AND contains(trim(regexp_replace(lower(t2), '[^a-z0-9]+', ' ', 'g')), 'message from emma') AS reached, CASE WHEN dev THEN 'dev' ELSE 'eval' END AS split, 'p' || (k % 2) AS pipeline FROM jo)"""


def _injections(spark, sf):
    content, labels = _runs(spark, sf)
    k = F.col("k")
    labels = labels.select("run_id", F.lit(2).alias("n_calls"), (k % 3 == 0).alias("attacked"), (k % 6 == 0).alias("injection_success"), F.concat(F.lit("p"), k % 2).alias("pipeline"),
                           F.when(k % 3 == 0, F.concat(F.lit("a"), k % 4)).alias("attack_type"), F.array(F.lit("Message, from Emma")).alias("injected"))
    return E.injection_features(content, labels)


@query(_INJ + """ SELECT coalesce(split, 'all') AS split, coalesce(pipeline, 'all') AS pipeline, CAST(sum((NOT attacked)::INT) AS BIGINT) AS n_benign, CAST(sum(attacked::INT) AS BIGINT) AS n_attacked, CAST(sum(reached::INT) AS BIGINT) AS n_reached,
round(sum((attacked AND flagged)::INT) / nullif(sum(attacked::INT), 0)::DOUBLE, 6) AS detection_attacked, round(sum((success AND flagged)::INT) / nullif(sum(success::INT), 0)::DOUBLE, 6) AS detection_success,
round(sum((reached AND flagged)::INT) / nullif(sum(reached::INT), 0)::DOUBLE, 6) AS detection_reached, round(sum((NOT attacked AND flagged)::INT) / nullif(sum((NOT attacked)::INT), 0)::DOUBLE, 6) AS fpr FROM ve GROUP BY ROLLUP (split, pipeline)""")
def injection_feature_rates(spark, sf):
    every = lambda c: F.coalesce(c, F.lit("all")).alias(c)
    return _injections(spark, sf)["rates"].select(every("split"), every("pipeline"), "n_benign", "n_attacked", "n_reached", *(r6(c, c) for c in ("detection_attacked", "detection_success", "detection_reached", "fpr")))


@query(_INJ + " SELECT 'a' || (k % 4) AS attack_type, count(*) AS n, CAST(sum(flagged::INT) AS BIGINT) AS flagged FROM ve WHERE attacked AND split = 'eval' GROUP BY 1")
def injection_attacks(spark, sf):
    return _injections(spark, sf)["attacks"]


# --- messages: failures, localisers, apologies, all by the engine's own patterns ---


def _messages(spark, sf, phrases):
    c = V.content(spark, sf)
    k = F.substring("run_id", 2, 20).cast("long") * 3 + F.col("step_index") * 7
    return c.withColumn("text", F.concat("text", F.lit(" "), _phrase(phrases, k), F.lit(".")))


def _said(phrases) -> str:
    return CONTENT.replace("text FROM", "text || ' ' || " + _phrase_sql(phrases, "conv_id * 3 + turn * 7") + " || '.' AS text FROM")


@query(_said(FAILURES) + f"SELECT run_id, step_index, array_to_string({_matched_sql(P.FAILURE_SIGNATURES, chr(39) + chr(39) + ' || chr(10) || text')}, ',') AS matched FROM c")
def failure_signatures(spark, sf):
    c = _messages(spark, sf, FAILURES)
    return c.select("run_id", "step_index", F.array_join(T.matched(T.output_text(F.lit(None).cast("string"), "text"), P.FAILURE_SIGNATURES), ",").alias("matched"))


_QUOTED = lambda rx: rx.replace("'", "''")
_LOC2 = _LOC.replace(CONTENT, _said(SAID)).replace(_ERR, _QUOTED(P.MESSAGE_ERROR)).replace(_SORRY, _QUOTED(P.MESSAGE_APOLOGY))


@query(_LOC2 + f""", n AS (SELECT run_id, count(*) AS n FROM c GROUP BY 1), tr AS (SELECT run_id, n, arg_max(step_index, length(text) * 1000 - step_index) AS mistake_step, arg_max(label, length(text) * 1000 - step_index) AS mistake_agent FROM c JOIN n USING (run_id) GROUP BY run_id, n),
pr AS (SELECT run_id, unnest(['first', 'third', 'middle', 'last', 'first_error', 'before_first_error', 'before_first_apology', 'first_worker', 'second_worker', 'first_worker_local']) AS predictor,
  unnest([first, third, middle, last, coalesce(fe, first), coalesce(bfe, first), coalesce(bfa, first), coalesce(fw, first), coalesce(sw, fw, first), coalesce(fl, first)]) AS predicted FROM g),
sp AS (SELECT *, CASE WHEN {_DEV.format('run_id')} THEN 'dev' ELSE 'eval' END AS split FROM tr), ex AS (SELECT split, avg(1.0::DOUBLE / n) AS expected FROM sp GROUP BY split)
SELECT split, predictor, count(*) AS n, CAST(sum((predicted = mistake_step)::INT) AS BIGINT) AS step_hits, CAST(sum((abs(predicted - mistake_step) <= 2)::INT) AS BIGINT) AS near_hits, CAST(sum((c.label = mistake_agent)::INT) AS BIGINT) AS agent_hits, round(any_value(expected), 6) AS expected
FROM pr JOIN sp USING (run_id) JOIN ex USING (split) LEFT JOIN c ON c.run_id = pr.run_id AND c.step_index = pr.predicted GROUP BY split, predictor""")
def blame_scores(spark, sf):
    c = _messages(spark, sf, SAID)
    key = F.length("text") * 1000 - F.col("step_index")
    labels = c.groupBy("run_id").agg(F.max_by("step_index", key).cast("string").alias("mistake_step"), F.max_by("label", key).alias("mistake_agent"))
    found = E.blame(c.select("run_id", "step_index", F.col("label").alias("tool"), F.col("text").alias("l3_text")), labels)
    return found.select("split", "predictor", "n", "step_hits", "near_hits", "agent_hits", r6("expected", "expected"))


@query(_said(SAID) + f""", g AS (SELECT run_id, bool_or(label = 'user' AND regexp_matches(text, '\\S') AND regexp_matches(text, '(?i){_QUOTED(P.RESULT_ERROR)}')) AS e, arg_max(text, step_index) FILTER (label <> 'user' AND regexp_matches(text, '\\S')) AS m FROM c GROUP BY 1)
SELECT run_id, e AND NOT regexp_matches(coalesce(m, ''), '(?i){_QUOTED(P.ACKNOWLEDGED)}') AS flagged FROM g""")
def unowned_errors(spark, sf):
    c = _messages(spark, sf, SAID)
    side = lambda user: F.when((F.col("label") == "user") == user, F.col("text")).otherwise("")
    return R.unacknowledged(c.select("run_id", "step_index", side(True).alias("l2_text"), side(False).alias("l3_text"))).select("run_id", "flagged")


@query(CONTENT + """, tr AS (SELECT run_id, arg_max(step_index, length(text) * 1000 - step_index) AS step, arg_max(label, length(text) * 1000 - step_index) AS agent FROM c GROUP BY run_id),
g AS (SELECT run_id, any_value(CASE WHEN step % 2 = 0 THEN agent ELSE 'nobody' END) AS agent, any_value(step) + any_value(step) % 3 * 2 AS step FROM tr GROUP BY run_id),
w AS (SELECT run_id, g.step, count(*) AS n, sum((lower(label) = agent)::INT) AS k FROM c JOIN g USING (run_id) GROUP BY run_id, g.step),
v AS (SELECT *, k > 0 AS visible, step >= 0 AND step < n AS valid, CAST(least(2, floor(step / n::DOUBLE * 3)) AS INT) AS third FROM w)
SELECT count(*) AS n_runs, CAST(sum(visible::INT) AS BIGINT) AS agent_visible, CAST(sum(valid::INT) AS BIGINT) AS step_valid, CAST(sum((visible AND valid)::INT) AS BIGINT) AS "both",
  sum((valid AND third = 0)::INT) || ',' || sum((valid AND third = 1)::INT) || ',' || sum((valid AND third = 2)::INT) AS thirds, round(median(k / n::DOUBLE) FILTER (visible), 6) AS median_share FROM v""")
def visibility(spark, sf):
    c = V.content(spark, sf)
    key = F.length("text") * 1000 - F.col("step_index")
    t = c.groupBy("run_id").agg(F.max_by("step_index", key).alias("step"), F.max_by("label", key).alias("agent"))
    step = F.col("step")
    labels = t.select("run_id", F.when(step % 2 == 0, F.col("agent")).otherwise("nobody").alias("mistake_agent"), (step + step % 3 * 2).cast("string").alias("mistake_step"))
    found = E.visibility(c.select("run_id", "step_index", F.col("label").alias("tool")), labels)
    return found.select("n_runs", "agent_visible", "step_valid", "both", F.array_join(F.transform("thirds", lambda x: x.cast("string")), ",").alias("thirds"), r6("median_share", "median_share"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN split_part(o_orderpriority, ' ', 1) ELSE o_orderstatus END AS tool, CAST(epoch(CAST(o_orderdate AS TIMESTAMP)) AS DOUBLE) AS submitted,
CAST(epoch(CAST(o_orderdate AS TIMESTAMP)) + o_orderkey % 86400 // 3600 * 3600 AS DOUBLE) AS at, '[' || o_orderkey || ', {"a": 1 } ]' AS clean FROM orders""")
def call_projections(spark, sf):
    o = V.table(spark, sf, "orders")
    day = lambda f: F.date_format("o_orderdate", f)
    function = F.when(F.col("o_orderstatus") == "F", "Bash").otherwise(F.col("o_orderstatus"))
    hour = F.lpad(F.floor(F.col("o_orderkey") % 86400 / 3600).cast("string"), 2, "0")
    return o.select("o_orderkey", T.tool_name(function, F.concat(F.lit(" "), "o_orderpriority")).alias("tool"), T.submission_epoch(F.concat(day("yyyyMMdd"), F.lit("_x"))).alias("submitted"),
                    T.epoch(F.concat(day("yyyy-MM-dd"), F.lit("T"), hour, F.lit(":00:00Z")), F.lit(0)).alias("at"), T.without_trailing_commas(F.concat(F.lit("["), "o_orderkey", F.lit(', {"a": 1, }, ]'))).alias("clean"))


# --- ledgers: written as JSON lines, read back strictly, and met by a sidecar of equal rows ---


@query(RECORDS + "SELECT run_id, CAST(step_index AS INTEGER) AS step_index, agent_id, goal_id, tool, params_hash, status, round(ts, 6) AS ts, event_id, CAST(event_id AS VARCHAR) AS noted FROM r")
def ledger_round_trip(spark, sf):
    r = V.records(spark, sf)
    records = r.select("ts", "run_id", "agent_id", "model", "model_version", "goal_id", F.col("step_index").cast("int").alias("step_index"), "tool", "params_hash", "status", F.lit(0.0).alias("duration_ms"),
                       F.create_map(F.lit("event"), F.col("event_id").cast("string")).alias("meta"))
    path = new_folder(spark, "ledger")
    files.write_ledger(records, path)
    side = r.select("run_id", F.col("step_index").cast("int").alias("step_index"), F.col("event_id").cast("string").alias("noted"))
    back = files.aligned(files.read_ledger(spark, path), side, "noted")
    return back.select("run_id", "step_index", "agent_id", "goal_id", "tool", "params_hash", "status", r6("ts", "ts"), F.col("meta")["event"].cast("long").alias("event_id"), "noted")


@query(RECORDS + "SELECT run_id, CAST(step_index AS INTEGER) AS step_index, tool, event_id, 'n' || event_id AS noted FROM r")
def sidecar_lockstep(spark, sf):
    """A sidecar met line by line: by places that don't depend on how the files are split, with the keys checked."""
    r = V.records(spark, sf)
    step = F.col("step_index").cast("int").alias("step_index")
    records = r.select("ts", "run_id", "agent_id", "model", "model_version", "goal_id", step, "tool", "params_hash", "status", F.lit(0.0).alias("duration_ms"),
                       F.create_map(F.lit("event"), F.col("event_id").cast("string")).alias("meta"))
    ledger, side = new_folder(spark, "ledger"), new_folder(spark, "sidecar")
    files.write_ledger(records, ledger)
    noted = r.select("run_id", step, F.concat(F.lit("n"), F.col("event_id").cast("string")).alias("noted")).orderBy("run_id", "step_index")
    noted.select(F.to_json(F.struct("*"))).write.text(side)
    both = files.lockstep(files.read_ledger(spark, ledger), files.read_sidecar(spark, side, "run_id string, step_index int, noted string"))
    return both.select("run_id", "step_index", "tool", F.col("meta")["event"].cast("long").alias("event_id"), "noted")


# --- the channels over a stream of files ---


def _streamed(spark, sf, disorder=False):
    """The scores of all events, read as a stream until none are left. disorder: a third of them arrives a day late, another two days."""
    _, base, _ = base_and_rest(spark, sf)
    dist = {x["tool"]: x["p"] for x in S.tool_distribution(base).collect()}
    source, sink, state = (new_folder(spark, n) for n in ("events", "scores", "offsets"))
    rows, how, files_at_once = V.records(spark, sf).select("agent_id", "us", "event_id", "tool", F.timestamp_seconds("ts").alias("at")), {}, 1000
    if disorder:
        rows = rows.withColumn("arrives", F.floor((F.floor(F.col("us") / 86_400_000_000) + F.col("event_id") % 3) / 8)).persist()
        for k in range(rows.agg(F.max("arrives")).first()[0] + 1):
            rows.where(F.col("arrives") == k).drop("arrives").write.mode("append").parquet(source)
        end = rows.agg(F.lit("heartbeat").alias("agent_id"), F.lit(0).cast("long").alias("us"), F.lit(0).cast("long").alias("event_id"), F.lit("view").alias("tool"), (F.max("at") + F.expr("INTERVAL 99 DAYS")).alias("at"))
        end.write.mode("append").parquet(source)
        # a batch takes about what arrives together, however many files hold it: the number of batches doesn't grow
        n_files, n_times = len(spark.read.parquet(source).inputFiles()), rows.agg(F.max("arrives")).first()[0] + 1
        how, files_at_once = {"event_time": "at", "late": "11 days"}, max(4, -(-n_files // n_times))
        rows.unpersist()
    else:
        rows.write.parquet(source)
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, H.STATE_STORE[provider])
    try:
        events = spark.readStream.schema("agent_id string, us long, event_id long, tool string, at timestamp").option("maxFilesPerTrigger", files_at_once).parquet(source)
        scored = H.scored_stream(events, dist, "agent_id", ORDER, C.Divergence(window=WINDOW), C.Cusum(slack=0.0, threshold=1.0), **how)
        scored.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(sink).awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.schema(H.OUTPUT).parquet(sink).where("stream <> 'heartbeat'").withColumnRenamed("stream", STREAM[0])


@query(_EMA + _CUS.format(slack="0.0")[len(_EMA.split(", wn AS")[0]):] + " SELECT c.agent_id, CAST(c.event_index AS BIGINT) AS event_index, round(ema, 6) AS ema, round(stat, 6) AS stat FROM c LEFT JOIN we ON we.agent_id = c.agent_id AND we.event_index = c.event_index")
def stream_scores(spark, sf):
    return _streamed(spark, sf).select("agent_id", "event_index", r6("ema", "ema"), r6(F.abs("stat"), "stat"))


@query(_EMA + _CUS.format(slack="0.0")[len(_EMA.split(", wn AS")[0]):] + " SELECT c.agent_id, CAST(c.event_index AS BIGINT) AS event_index, round(ema, 6) AS ema, round(stat, 6) AS stat FROM c LEFT JOIN we ON we.agent_id = c.agent_id AND we.event_index = c.event_index")
def disordered_stream_scores(spark, sf):
    """The same scores when events arrive out of order."""
    return _streamed(spark, sf, True).select("agent_id", "event_index", r6("ema", "ema"), r6(F.abs("stat"), "stat"))


@query(_ALARM + "SELECT agent_id, channel, CAST(event_index AS BIGINT) AS event_index FROM fa")
def stream_alarms(spark, sf):
    return _streamed(spark, sf).where("alarm <> ''").select("agent_id", F.explode(F.split("alarm", ",")).alias("channel"), "event_index")
