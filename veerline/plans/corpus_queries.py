"""The eight raw corpora, made of the conversations, written as the files that each corpus has, and read again: records, content and labels,
and the experiments on spans, submissions and hallucinations over them. Each with SQL over the table itself.

A conversation is a run; what the table doesn't have (tools, statuses, annotations) follows from the numbers of conversation and turn."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..folders import new_folder, written
from ..functions import patterns as P
from ..sources import corpora, datasource
from . import experiments as E
from . import records as V
from .pattern_queries import FAILURES, _phrase, _phrase_sql
from .queries import query, r6

C = "WITH c AS (SELECT conv_id AS k, turn AS t, role, text FROM conversations)"
#: 2025-10-09, where corpora without a clock begin.
T0 = 1_760_000_000


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """k, t, role, text of the conversations."""
    return V.table(spark, sf, "conversations").select(F.col("conv_id").alias("k"), F.col("turn").alias("t"), "role", "text")


def gathered(rows: DataFrame, **values) -> DataFrame:
    """k and an array in the order of turns for each of values: a document is one text, however many turns it has."""
    by_turn = lambda a, b: F.when(a["_t"] < b["_t"], -1).when(a["_t"] > b["_t"], 1).otherwise(0)
    ordered = lambda v: F.transform(F.array_sort(F.collect_list(F.struct(F.col("t").alias("_t"), v.alias("_v"))), by_turn), lambda x: x["_v"])
    return rows.groupBy("k").agg(*(ordered(v).alias(n) for n, v in values.items()))


def name(*parts):
    return F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))


def stored(docs: DataFrame, rel, doc) -> str:
    """The folder that holds a file rel with the JSON of doc for each row of docs."""
    root = new_folder(docs.sparkSession, "corpus")
    datasource.write_documents(docs.select(rel.alias("rel"), F.to_json(doc).alias("text")), root)
    return root


def opened(spark: SparkSession, kind: str, root: str, **only) -> DataFrame:
    return datasource.corpus(spark, kind, root, **only)


def cols():
    """Conversation, turn, and whether an assistant says it."""
    return F.col("k"), F.col("t"), F.col("role") == "assistant"


# --- tool-using runs under injection ---


def injection_docs(spark, sf):
    k, t, said = cols()
    calls = F.array(F.struct(name("f", t % 3).alias("function"), F.struct(t.alias("n")).alias("args"), name("k", t).alias("id")))
    no_calls = F.lit(None).cast("array<struct<function:string,args:struct<n:bigint>,id:string>>")
    no = F.lit(None).cast("string")
    turn = F.struct(F.when(said, "assistant").otherwise("user").alias("role"), F.col("text").alias("content"), F.when(said, calls).otherwise(no_calls).alias("tool_calls"), no.alias("tool_call_id"), no.alias("error"))
    result = F.struct(F.lit("tool").alias("role"), name("r", t).alias("content"), no_calls.alias("tool_calls"), name("k", t).alias("tool_call_id"), F.when(t % 4 == 3, "refused").alias("error"))
    d = gathered(turns(spark, sf), m=F.when(said, F.array(turn, result)).otherwise(F.array(turn)))
    doc = F.struct(F.lit("s").alias("suite_name"), name("p", k % 3).alias("pipeline_name"), name("u", k % 5).alias("user_task_id"), F.lit("i1").alias("injection_task_id"), F.when(k % 2 == 0, "x").alias("attack_type"),
                   F.struct(name("do ", k).alias("a")).alias("injections"), (k % 3 == 0).alias("utility"), (k % 4 == 0).alias("security"), F.lit(2.0).alias("duration"), F.flatten("m").alias("messages"))
    return stored(d, name("p", k % 3, "/s/t", k, ".json"), doc)


@query(C + f""", d AS (SELECT DISTINCT k, 'p' || k % 3 || '/s/t' || k AS run_id, 'p' || k % 3 AS agent_id FROM c WHERE k % 3 <> 1),
x AS (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY run_id || '.json') - 1 AS run_index FROM d),
a AS (SELECT c.*, row_number() OVER (PARTITION BY k ORDER BY t) - 1 AS step, count(*) OVER (PARTITION BY k) AS n FROM c WHERE role = 'assistant')
SELECT run_id, CAST(step AS INTEGER) AS step_index, agent_id, 's/u' || k % 5 AS goal_id, 'f' || t % 3 AS tool, CASE WHEN t % 4 = 3 THEN 'error' ELSE 'ok' END AS status, round(2000.0 / n, 6)::DOUBLE AS duration_ms,
  ({T0} + run_index * 1000 + step)::DOUBLE AS ts, substr(sha256('{{"n": ' || t || '}}'), 1, 12) AS params_hash, '{{"n": ' || t || '}}' AS l1_text, 'r' || t AS l2_text, md5(text) AS said FROM a JOIN x USING (k)""")
def injection_corpus(spark, sf):
    """Of two pipelines of three: the files of the third aren't opened."""
    root = injection_docs(spark, sf)
    docs = opened(spark, "injection", root, pipeline=["p0", "p2"])
    c = corpora.injection_runs(spark, root, docs)
    r = c.records.join(c.content.drop("tool"), ["run_id", "step_index"])
    return r.select("run_id", "step_index", "agent_id", "goal_id", "tool", "status", r6("duration_ms", "duration_ms"), "ts", "params_hash", "l1_text", "l2_text", F.md5("l3_text").alias("said"))


@query(C + """SELECT 'p' || k % 3 || '/s/t' || k AS run_id, 'p' || k % 3 AS pipeline, 'u' || k % 5 AS user_task, CASE WHEN k % 2 = 0 THEN 'x' END AS attack_type, k % 2 = 0 AS attacked, k % 4 = 0 AS injection_success, k % 3 = 0 AS utility,
count(*) FILTER (role = 'assistant') AS n_calls, CASE WHEN k % 2 = 0 THEN 'do ' || k ELSE '' END AS injected FROM c GROUP BY k""")
def injection_labels(spark, sf):
    labels = corpora.injection_runs(spark, root := injection_docs(spark, sf), opened(spark, "injection", root)).labels
    return labels.select("run_id", "pipeline", "user_task", "attack_type", "attacked", "injection_success", "utility", "n_calls", F.array_join("injected", ",").alias("injected"))


# --- coding submissions ---

_SUB = "CASE k % 4 WHEN 0 THEN '20240102_a' WHEN 1 THEN '20240203_b' WHEN 2 THEN 'chat_c' ELSE 'none_d' END"


def coding_docs(spark, sf):
    k, t, said = cols()
    sub = F.when(k % 4 == 0, "20240102_a").when(k % 4 == 1, "20240203_b").when(k % 4 == 2, "chat_c").otherwise("none_d")
    call = lambda tool, arguments: F.array(F.struct(F.lit("function").alias("type"), F.struct(tool.alias("name"), arguments.alias("arguments")).alias("function")))
    message = lambda role, calls: F.struct(role.alias("role"), calls.alias("tool_calls"))
    calls = call(name("f", t % 3), name('{"t": ', t, "}"))
    d = gathered(turns(spark, sf), act=F.struct(F.when(said, "  ").otherwise(name("  ", F.col("role"), " -x ", t, "\n")).alias("action")), msg=message(F.when(said, "assistant").otherwise("user"), F.when(said & (k % 4 == 2), calls)))
    done = message(F.lit("assistant"), F.when(k % 4 == 2, call(F.lit("done"), F.lit(""))))
    text = F.when(k % 4 < 2, F.to_json(F.struct(F.col("act").alias("trajectory")))).otherwise(F.to_json(F.concat("msg", F.array(done))))
    root = new_folder(spark, "corpus")
    datasource.write_documents(d.select(name(sub, "/trajs/repo__x-", k, F.when(k % 4 < 2, ".traj").otherwise(".json")).alias("rel"), text.alias("text")), root)
    return root


_CODING = C + f""", f AS (SELECT DISTINCT k, {_SUB} AS sub, 'repo__x-' || k AS run_id, CASE WHEN k % 4 < 2 THEN '.traj' ELSE '.json' END AS ext FROM c),
x AS (SELECT *, row_number() OVER (PARTITION BY sub ORDER BY run_id || ext) - 1 AS run_index FROM f),
a AS (SELECT k, t, role AS tool, role || ' -x ' || t AS payload FROM c WHERE k % 4 < 2 AND role <> 'assistant' UNION ALL SELECT k, t, 'f' || t % 3, '{{"t": ' || t || '}}' FROM c WHERE k % 4 = 2 AND role = 'assistant'
  UNION ALL SELECT DISTINCT k, 1000000, 'done', '' FROM c WHERE k % 4 = 2),
s AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t) - 1 AS step FROM a JOIN x USING (k)) """


@query(_CODING + f"""SELECT sub AS agent_id, run_id, CAST(step AS INTEGER) AS step_index, tool, 'repo__x' AS goal_id, (CASE k % 4 WHEN 0 THEN 1704153600 WHEN 1 THEN 1706918400 ELSE {T0} END + run_index * 1000 + step)::DOUBLE AS ts,
  substr(sha256(payload), 1, 12) AS params_hash FROM s""")
def coding_corpus(spark, sf):
    root = coding_docs(spark, sf)
    return corpora.coding_runs(spark, root, docs=opened(spark, "coding", root)).records.select("agent_id", "run_id", "step_index", "tool", "goal_id", "ts", "params_hash")


@query(C + f" SELECT DISTINCT {_SUB} AS submission, 'no known format' AS reason FROM c WHERE k % 4 = 3")
def coding_skipped(spark, sf):
    root = coding_docs(spark, sf)
    return corpora.coding_runs(spark, root, docs=opened(spark, "coding", root)).skipped


# --- terminal tasks ---


def terminal_docs(spark, sf):
    k, t, said = cols()
    at = name("task", k % 7, "/model", k % 2, "/", F.when(k % 3 == 0, "baseline_trajectories").otherwise("hack_trajectories"), "/v", k, "/")
    call = lambda tool, keys: F.struct(tool.alias("function_name"), F.struct(keys.alias("keystrokes")).alias("arguments"))
    calls = F.array(call(F.lit("bash_command"), name("cmd", t % 3, " -v ", t, "\n")), call(F.lit("done"), F.lit(None).cast("string")))
    step = F.struct(F.when(said, "agent").otherwise("user").alias("source"), F.when(t % 2 == 1, "2025-01-01T00:00:00+00:00").alias("timestamp"), F.col("text").alias("message"), F.when(said, calls).alias("tool_calls"))
    d = gathered(turns(spark, sf), steps=step)
    run = d.select(name(at, "trial/agent/trajectory.json").alias("rel"), F.to_json(F.struct(F.struct(F.lit("M").alias("model_name")).alias("agent"), "steps")).alias("text"))
    kind = F.when(k % 3 == 0, "baseline").otherwise("rewarded_serious_exploit")
    meta = d.select(name(at, "metadata.json").alias("rel"), F.to_json(F.struct(name("T", k % 7).alias("task_id"), kind.alias("classification"), (k % 10 / 10).alias("reward"))).alias("text"))
    root = new_folder(spark, "corpus")
    datasource.write_documents(run.unionByName(meta), root)
    return root


_TERMINAL = C + """, p AS (SELECT c.*, (row_number() OVER (PARTITION BY k ORDER BY t) - 1) * 2 AS first, 'task' || k % 7 || '/' || CASE WHEN k % 3 = 0 THEN 'baseline_trajectories' ELSE 'hack_trajectories' END || '/v' || k AS run_id
  FROM c WHERE role = 'assistant'),
s AS (SELECT *, unnest([0, 1]) AS j FROM p) """


@query(_TERMINAL + f"""SELECT run_id, CAST(first + j AS INTEGER) AS step_index, 'model' || k % 2 AS agent_id, 'T' || k % 7 AS goal_id, CASE WHEN j = 0 THEN 'cmd' || t % 3 ELSE 'done' END AS tool,
  round(CASE WHEN t % 2 = 1 THEN 1735689600 ELSE {T0} + first END + j * 0.001, 3)::DOUBLE AS ts, substr(sha256(CASE WHEN j = 0 THEN '{{"keystrokes": "cmd' || t % 3 || ' -v ' || t || '\\n"}}' ELSE '{{}}' END), 1, 12) AS params_hash,
  CASE WHEN j = 0 THEN 'cmd' || t % 3 || ' -v ' || t || chr(10) ELSE '' END AS l1_text, md5(text) AS said FROM s""")
def terminal_corpus(spark, sf):
    root = terminal_docs(spark, sf)
    c = corpora.terminal_runs(spark, root, opened(spark, "terminal", root))
    r = c.records.withColumnRenamed("agent_id", "model_dir").join(c.content.drop("tool"), ["model_dir", "run_id", "step_index"])
    return r.select("run_id", "step_index", F.col("model_dir").alias("agent_id"), "goal_id", "tool", F.round("ts", 3).alias("ts"), "params_hash", "l1_text", F.md5("l3_text").alias("said"))


@query(_TERMINAL + """SELECT run_id, 'model' || any_value(k) % 2 AS model_dir, 'T' || any_value(k) % 7 AS task_id, split_part(run_id, '/', 2) AS tree, CASE WHEN any_value(k) % 3 = 0 THEN 'baseline' ELSE 'rewarded_serious_exploit' END AS classification,
  round(any_value(k) % 10 / 10, 6)::DOUBLE AS reward, count(*) AS n_calls FROM s GROUP BY run_id""")
def terminal_labels(spark, sf):
    root = terminal_docs(spark, sf)
    labels = corpora.terminal_runs(spark, root, opened(spark, "terminal", root)).labels
    return labels.select("run_id", "model_dir", "task_id", "tree", "classification", r6("reward", "reward"), "n_calls")


# --- trajectories exported as JSON lines ---


def exported_docs(spark, sf):
    k, t, said = cols()
    calls = F.array(F.struct(F.lit("Bash").alias("name"), F.struct(name("run", t % 3, " x").alias("command"), F.lit("a").alias("note")).alias("parameters")))
    d = gathered(turns(spark, sf), conversation=F.struct("role", F.col("text").alias("content"), F.when(said, calls).alias("tool_calls")))
    path = new_folder(spark, "corpus")
    lines = d.select(F.to_json(F.struct(name("t", k).alias("trajectory_id"), F.when(k % 3 == 0, "0").otherwise("1.2, 3").alias("label"), "conversation")).alias("value"))
    lines.unionByName(spark.range(1).select(F.lit("no json").alias("value"))).write.text(path)
    return path


@query(C + f""" SELECT 't' || k AS run_id, CAST(row_number() OVER (PARTITION BY k ORDER BY t) - 1 AS INTEGER) AS step_index, 'run' || t % 3 AS tool, ({T0} + row_number() OVER (PARTITION BY k ORDER BY t) - 1)::DOUBLE AS ts,
  substr(sha256('{{"command": "run' || t % 3 || ' x", "note": "a"}}'), 1, 12) AS params_hash, 'run' || t % 3 || ' x' || chr(10) || 'a' AS l1_text, md5(text) AS said FROM c WHERE role = 'assistant'""")
def exported_corpus(spark, sf):
    c = corpora.exported_trajectories(spark, exported_docs(spark, sf))
    r = c.records.join(c.content.drop("tool"), ["run_id", "step_index"])
    return r.select("run_id", "step_index", "tool", "ts", "params_hash", "l1_text", F.md5("l3_text").alias("said"))


@query(C + """ SELECT 't' || k AS run_id, k % 3 <> 0 AS hacked, CASE WHEN k % 3 = 0 THEN '' ELSE '1.2|3' END AS codes, CAST(count(*) AS INTEGER) AS n_messages, count(*) FILTER (role = 'assistant') AS n_calls, 1::BIGINT AS skipped FROM c GROUP BY k""")
def exported_labels(spark, sf):
    c = corpora.exported_trajectories(spark, exported_docs(spark, sf))
    skipped = c.skipped.agg(F.count(F.lit(1)).alias("skipped"))
    return c.labels.select("run_id", "hacked", F.array_join("codes", "|").alias("codes"), "n_messages", "n_calls").crossJoin(F.broadcast(skipped))


# --- span trees with annotations ---

_TOKENS = "1000 * (k % 5 + 1) + 100 * t"


def span_docs(spark, sf):
    """A span a turn below a span a conversation; turns of even number that an assistant says are annotated, and each third conversation notes a span that isn't there."""
    k, t, said = cols()
    attrs = F.create_map(F.lit("openinference.span.kind"), F.when(said, "LLM").otherwise("TOOL"), F.lit("input.value"), _phrase(FAILURES, k + t), F.lit("output.value"), _phrase(FAILURES, k * 3 + t * 5),
                         F.lit("llm.token_count.prompt"), (1000 * (k % 5 + 1) + 100 * t).cast("string"), F.lit("llm.output_messages.0.message.content"), F.substring("text", 1, 40))
    span = F.struct(name("s", t).alias("span_id"), F.col("role").alias("span_name"), F.concat(F.lit("2025-01-01T00:00:"), F.lpad(t.cast("string"), 2, "0"), F.lit("Z")).alias("timestamp"),
                    F.when(t % 5 == 2, "Error").otherwise("Unset").alias("status_code"), F.concat(F.lit("PT"), t.cast("string"), F.lit(".5S")).alias("duration"), attrs.alias("span_attributes"))
    note = F.when(said & (t % 2 == 0), F.struct(_phrase(("Tools", "tool ", "Goals"), t).alias("category"), name("s", t).alias("location"), F.lit("HIGH").alias("impact")))
    d = gathered(turns(spark, sf), spans=span, notes=note)
    top = F.struct(F.lit("top").alias("span_id"), F.lit("agent").alias("span_name"), F.lit("2024-12-31T00:00:00Z").alias("timestamp"), F.lit("Ok").alias("status_code"), F.col("spans").alias("child_spans"))
    data = stored(d, name("r", k, ".json"), F.struct(name("r", k).alias("trace_id"), F.array(top).alias("spans")))
    gone = F.when(k % 3 == 0, F.array(F.struct(F.lit("lost").alias("category"), F.lit("gone").alias("location"), F.lit("LOW").alias("impact")))).otherwise(F.array().cast("array<struct<category:string,location:string,impact:string>>"))
    notes = stored(d.withColumn("notes", F.array_compact("notes")), name("r", k, ".json"), F.struct(F.concat("notes", gone).alias("errors"), F.array(F.struct(k.alias("x"))).alias("scores")))
    return corpora.span_traces(spark, data, notes, "set", opened(spark, "spans", data))


_SPANS = C + f""", s AS (SELECT 'r' || k AS run_id, k, t, 's' || t AS span_id, role AS tool, CASE WHEN t % 5 = 2 THEN 'error' ELSE 'ok' END AS status, (1735689600 + t)::DOUBLE AS ts, (t + 0.5)::DOUBLE * 1000 AS duration_ms,
  CASE WHEN role = 'assistant' THEN 'LLM' ELSE 'TOOL' END AS kind, {_phrase_sql(FAILURES, 'k + t')} AS l1, {_phrase_sql(FAILURES, 'k * 3 + t * 5')} AS l2, substr(text, 1, 40) AS l3, {_TOKENS} AS tokens,
  role = 'assistant' AND t % 2 = 0 AS noted, ['tool', 'tool', 'goal'][t % 3 + 1] AS category FROM c
  UNION ALL SELECT DISTINCT 'r' || k, k, -1, 'top', 'agent', 'ok', 1735603200, 0, '', '', '', '', NULL, false, '' FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts) - 1 AS step_index FROM s) """


@query(_SPANS + "SELECT run_id, CAST(step_index AS INTEGER) AS step_index, span_id, tool, status, ts, duration_ms, kind, CAST(tokens AS INTEGER) AS tokens_prompt, md5(l1 || '/' || l2 || '/' || l3) AS texts FROM r")
def span_corpus(spark, sf):
    c = span_docs(spark, sf)
    r = c.records.join(c.content.drop("tool"), ["run_id", "step_index"])
    return r.select("run_id", "step_index", "span_id", "tool", "status", "ts", "duration_ms", "kind", "tokens_prompt", F.md5(F.concat_ws("/", "l1_text", "l2_text", "l3_text")).alias("texts"))


@query(_SPANS + """SELECT run_id, count(*) AS n_calls, count(*) FILTER (status = 'error') AS n_error_status, count(*) FILTER (noted) + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS n_errors_annotated, count(*) FILTER (noted) AS n_locations_resolved,
  count(*) FILTER (noted AND status = 'error') AS n_annotated_on_error_status, '{"x":' || k || '}' AS scores FROM r GROUP BY run_id, k""")
def span_labels(spark, sf):
    return span_docs(spark, sf).labels.select("run_id", "n_calls", "n_error_status", "n_errors_annotated", "n_locations_resolved", "n_annotated_on_error_status", "scores")


@query(_SPANS + """, b AS (SELECT CAST(step_index // 10 AS INTEGER) AS bin, count(*) AS calls, count(*) FILTER (status = 'error') AS errors, count(*) FILTER (noted) AS annotated FROM r GROUP BY 1 HAVING count(*) >= 30)
SELECT 'bin ' || bin AS name, calls, errors, annotated, round(errors / calls::DOUBLE, 6) AS status_error_rate, round(annotated / calls::DOUBLE, 6) AS annotated_rate FROM b
UNION ALL SELECT 'all', count(*), count(*) FILTER (status = 'error' AND noted), count(*) FILTER (noted), NULL, NULL FROM r""")
def span_coverage(spark, sf):
    """Annotated and failed spans by step, and in all: calls, annotated spans that failed, annotated spans."""
    c = span_docs(spark, sf)
    found = E.span_coverage(c.records, c.labels, 2)
    bins = found["bins"].select(name("bin ", F.col("bin")).alias("name"), "calls", "errors", F.col("annotated").cast("long").alias("annotated"), r6("status_error_rate", "status_error_rate"), r6("annotated_rate", "annotated_rate"))
    no = F.lit(None).cast("double")
    return bins.unionByName(found["totals"].select(F.lit("all").alias("name"), F.col("n_calls").alias("calls"), F.col("n_annotated_on_error_status").alias("errors"), F.col("n_locations_resolved").alias("annotated"), no.alias("status_error_rate"), no.alias("annotated_rate")))


def _any(patterns, text: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({text}, '(?i){rx}')" for rx in patterns) + ")"


_CONTENT = _SPANS + f""", o AS (SELECT *, {_any(P.FAILURE_SIGNATURES.values(), "l2 || chr(10) || l3")} AS own, CASE WHEN kind = 'LLM' THEN len(regexp_extract_all(l1, '(?i){P.FAILURE_SIGNATURES["exec_error"]}')) END AS f,
  list_sum(list_transform(string_split(sha256(run_id), ''), lambda c: CASE WHEN c = '' THEN 0 ELSE strpos('0123456789abcdef', c) - 1 END)) % 5 = 0 AS dev FROM r),
w AS (SELECT *, bool_or(own) OVER (PARTITION BY run_id ORDER BY step_index ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS near,
  coalesce(first_value(f IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY step_index ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) > coalesce(last_value(f IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY step_index ROWS UNBOUNDED PRECEDING), 0), false) AS covered FROM o) """
_COUNTS = "count(*) AS n, count(*) FILTER (own) AS own, count(*) FILTER (near) AS near, count(*) FILTER (covered) AS covered"


@query(_CONTENT + f"""SELECT CASE WHEN dev THEN 'dev' ELSE 'eval' END || CASE WHEN noted THEN ' annotated' ELSE ' other' END AS name, {_COUNTS} FROM w GROUP BY dev, noted
UNION ALL SELECT 'category ' || category, {_COUNTS} FROM w WHERE noted AND NOT dev GROUP BY category""")
def span_content(spark, sf):
    """Annotated spans that show a failure themselves, near by, or in the next prompt."""
    c = span_docs(spark, sf)
    found = E.span_content(written(c.records, "spans"), written(c.content, "span-texts"), c.labels)
    four = ("n", "own", "near", "covered")
    kind = F.when(F.col("annotated"), " annotated").otherwise(" other")
    return found["coverage"].select(F.concat("split", kind).alias("name"), *four).unionByName(found["categories"].select(name("category ", F.col("category")).alias("name"), *four))


@query(_CONTENT + """, p AS (SELECT CAST(step_index // 10 AS INTEGER) AS bin, tokens, noted FROM w WHERE kind = 'LLM' AND tokens > 0),
g AS (SELECT bin, count(*) AS n, count(*) FILTER (noted) AS errors, CAST(list_sort(list(tokens))[count(*) // 2 + 1] AS INTEGER) AS median_tokens FROM p GROUP BY bin HAVING count(*) >= 20)
SELECT bin, n, errors, round(errors / n::DOUBLE, 6) AS rate, median_tokens FROM g""")
def span_density(spark, sf):
    """Annotated prompts by step, with the upper median of their tokens."""
    c = span_docs(spark, sf)
    found = E.span_content(written(c.records, "spans"), written(c.content, "span-texts"), c.labels)["by_step"]
    return found.select("bin", "n", "errors", r6("rate", "rate"), "median_tokens")


# --- conversations with a marked mistake ---


def blamed_docs(spark, sf):
    k, t, _ = cols()
    entry = F.struct(F.col("text").alias("content"), F.when(t % 4 != 3, F.col("role")).alias("role"), F.when(t % 4 == 1, name("Web", t)).alias("name"))
    d = gathered(turns(spark, sf), history=entry)
    doc = F.struct(F.when(k % 9 != 8, name("q", k)).alias("question_ID"), "history", (k % 2 == 0).alias("is_correct"), F.lit("Web1").alias("mistake_agent"), (k % 4).cast("string").alias("mistake_step"))
    root = stored(d, name(k, ".json"), doc)
    return corpora.blamed_runs(spark, root, "alg", opened(spark, "blamed", root))


_BLAMED = C + ", e AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t) - 1 AS i, CASE WHEN t % 4 = 1 THEN 'Web' || t WHEN t % 4 <> 3 THEN role ELSE '' END AS tool FROM c WHERE k % 9 <> 8) "


@query(_BLAMED + f"SELECT 'alg/' || k AS run_id, CAST(i AS INTEGER) AS step_index, 'q' || k AS goal_id, tool, ({T0} + i)::DOUBLE AS ts, md5(text) AS said FROM e WHERE tool <> ''")
def blamed_corpus(spark, sf):
    c = blamed_docs(spark, sf)
    return c.records.join(c.content.drop("tool"), ["run_id", "step_index"]).select("run_id", "step_index", "goal_id", "tool", "ts", F.md5("l3_text").alias("said"))


@query(_BLAMED + "SELECT 'alg/' || k AS run_id, 'q' || k AS \"question_ID\", CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END AS is_correct, 'Web1' AS mistake_agent, CAST(k % 4 AS VARCHAR) AS mistake_step, count(*) FILTER (tool <> '') AS n_calls FROM e GROUP BY k")
def blamed_labels(spark, sf):
    return blamed_docs(spark, sf).labels.select("run_id", "question_ID", "is_correct", "mistake_agent", "mistake_step", "n_calls")


# --- chat sessions: events as lines, and a map of sessions ---

_LAST = 7  # sessions of each eighth conversation aren't in the map


def chat_docs(spark, sf):
    k, t, said = cols()
    rows = turns(spark, sf)
    tool = F.when(said, "Bash").otherwise(F.col("role"))
    event = F.struct(name("s", k).alias("session_id"), (t.cast("int")).alias("turn_number"), F.when(t % 6 != 5, 1_700_000_000_000_000 + k * 1_000_000 + t * 1000).alias("ts_us"), tool.alias("tool_name"),
                     F.when(said & (t % 2 == 1), name("git", t % 3)).alias("command_head"), F.sha2("text", 256).alias("params_sha256"), F.when(t % 5 == 4, "error").alias("status"), (t * 1.5).alias("duration_ms"))
    events, sessions = new_folder(spark, "corpus"), new_folder(spark, "corpus")
    rows.select(F.to_json(event).alias("value")).write.text(events)
    one = F.struct(name("u", k % 4).alias("user_id"), F.lit("Code  Helper").alias("agent"), name("v", k % 2).alias("cli_version"), name("repo", k % 3).alias("repo_id"), k.alias("created_at_us"))
    # one object of all sessions, a member a line
    members = rows.where(k % 8 != _LAST).select("k").distinct().select(name('"s', k, '": ', F.to_json(one), ",").alias("value"))
    head = spark.range(1).select(F.lit("{").alias("value"))
    tail = spark.range(1).select(F.lit('"end": {"user_id": "nobody"}}').alias("value"))
    rank = lambda df, n: df.withColumn("n", F.lit(n))
    rank(head, 0).unionByName(rank(members, 1)).unionByName(rank(tail, 2)).coalesce(1).sortWithinPartitions("n").drop("n").write.text(sessions)
    return corpora.chat_sessions(spark, events, sessions)


_CHAT = C + """, u AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t) - 1 AS i FROM c WHERE k % 8 <> 7 AND t % 6 <> 5) """


@query(_CHAT + """SELECT 's' || k AS run_id, CAST(i AS INTEGER) AS step_index, (1700000000000000 + k * 1000000 + t * 1000) / 1e6 AS ts, 'u' || k % 4 AS agent_id, 'v' || k % 2 AS model_version, 'repo' || k % 3 AS goal_id,
  CASE WHEN role <> 'assistant' THEN role WHEN t % 2 = 1 THEN 'git' || t % 3 ELSE 'Bash' END AS tool, substr(sha256(text), 1, 12) AS params_hash, CASE WHEN t % 5 = 4 THEN 'error' ELSE 'ok' END AS status, (t * 1.5)::DOUBLE AS duration_ms FROM u""")
def chat_corpus(spark, sf):
    return chat_docs(spark, sf).records.select("run_id", "step_index", "ts", "agent_id", "model_version", "goal_id", "tool", "params_hash", "status", "duration_ms")


@query(_CHAT + """SELECT 's' || k AS name, count(*) AS n, 'code-helper' AS agent FROM u GROUP BY k
UNION ALL SELECT 'no session', count(*), NULL FROM c WHERE k % 8 = 7 UNION ALL SELECT 'no time or tool', count(*), NULL FROM c WHERE k % 8 <> 7 AND t % 6 = 5""")
def chat_labels(spark, sf):
    c = chat_docs(spark, sf)
    return c.labels.select(F.col("run_id").alias("name"), F.col("n_records").alias("n"), "agent").unionByName(c.skipped.select(F.col("reason").alias("name"), "n", F.lit(None).cast("string").alias("agent")))


# --- marked hallucinations ---

_WENT = ("an error came up", "not found", "it failed", "all is well", "\"error\": 3", "fine", "")
_OWNED = ("I could not do it", "done", "sorry", "it is finished", "unable to go on")


def hallucination_docs(spark, sf):
    k, t, said = cols()
    entry = F.struct((t + 1).cast("string").alias("step"), F.when(said, "assistant").otherwise("user").alias("role"), F.when(said, _phrase(_OWNED, k + t)).otherwise(F.substring("text", 1, 20)).alias("content"),
                     F.when(said, F.array(F.struct(t.alias("b"), F.lit("x").alias("a")))).alias("tool_calls"), F.when(said, _phrase(_WENT, k * 5 + t)).alias("tool_responses"))
    d = gathered(turns(spark, sf), history=entry)
    doc = F.struct(F.lit("m").alias("model_id"), F.lit("d").alias("question_domain"), F.when(k % 2 == 0, "true").otherwise("False").alias("is_hallucination"), F.when(k % 2 == 0, (k % 4 + 1).cast("string")).alias("hallucination_step"), "history")
    root = stored(d, name(F.when(k % 3 == 0, "BFCL").when(k % 3 == 1, "Camel").otherwise("Unknown"), "/", k, ".json"), doc)
    docs = opened(spark, "hallucination", root, directory=list(corpora.FRAMEWORKS))
    return corpora.hallucination_runs(spark, root, docs)


_MADE = C + f""", e AS (SELECT *, CASE WHEN k % 3 = 0 THEN 'bfcl/' ELSE 'camel/' END || k AS run_id, CASE WHEN k % 3 = 0 THEN 'bfcl' ELSE 'camel' END AS framework, row_number() OVER (PARTITION BY k ORDER BY t) - 1 AS i, t + 1 AS source, role = 'assistant' AS said,
  CASE WHEN role = 'assistant' THEN {_phrase_sql(_OWNED, 'k + t')} ELSE substr(text, 1, 20) END AS l3, CASE WHEN role = 'assistant' THEN {_phrase_sql(_WENT, 'k * 5 + t')} ELSE '' END AS l2 FROM c WHERE k % 3 < 2) """


@query(_MADE + """SELECT run_id, framework, CAST(i AS INTEGER) AS step_index, CAST(source AS INTEGER) AS step_source, CASE WHEN said THEN 'assistant' ELSE 'user' END AS role, CASE WHEN said THEN '[{"a": "x", "b": ' || t || '}]' ELSE '' END AS l1_text, l2 AS l2_text, md5(l3) AS said FROM e""")
def hallucination_corpus(spark, sf):
    c = hallucination_docs(spark, sf).content
    return c.select("run_id", "framework", F.col("step_index").cast("int").alias("step_index"), "step_source", "role", "l1_text", "l2_text", F.md5("l3_text").alias("said"))


_FOUND = _MADE + f""", g AS (SELECT run_id, framework, k, count(*) AS n, k % 2 = 0 AS bad, k % 4 + 1 AS truth, max((regexp_matches(l2, '\\S') AND regexp_matches(l2, '(?i){P.RESULT_ERROR}'))::INT) = 1
  AND NOT coalesce(regexp_matches(coalesce(arg_max(l3, i) FILTER (regexp_matches(l3, '\\S')), ''), '(?i){P.ACKNOWLEDGED}'), false) AS flagged,
  list_sum(list_transform(string_split(sha256(run_id), ''), lambda c: CASE WHEN c = '' THEN 0 ELSE strpos('0123456789abcdef', c) - 1 END)) % 5 = 0 AS dev FROM e GROUP BY run_id, framework, k) """


@query(_FOUND + """SELECT coalesce(split, 'all') AS split, coalesce(framework, 'all') AS framework, count(*) FILTER (bad) AS n_positive, count(*) FILTER (NOT bad) AS n_negative,
  round(count(*) FILTER (bad AND flagged) / nullif(count(*) FILTER (bad), 0)::DOUBLE, 6) AS detection, round(count(*) FILTER (NOT bad AND flagged) / nullif(count(*) FILTER (NOT bad), 0)::DOUBLE, 6) AS fpr
FROM (SELECT *, CASE WHEN dev THEN 'dev' ELSE 'eval' END AS split FROM g) GROUP BY ROLLUP (split, framework)""")
def hallucination(spark, sf):
    c = hallucination_docs(spark, sf)
    found = E.hallucination(written(c.content, "entries"), written(c.labels, "entry-labels"))["detection"]
    return found.select(F.coalesce("split", F.lit("all")).alias("split"), F.coalesce("framework", F.lit("all")).alias("framework"), "n_positive", "n_negative", r6("detection", "detection"), r6("fpr", "fpr"))


@query(_FOUND + """, z AS (SELECT g.*, e.i, e.source FROM g JOIN e USING (run_id) WHERE bad AND truth IN (SELECT x.source FROM e x WHERE x.run_id = g.run_id)),
p AS (SELECT framework, 'first' AS predictor, source, truth FROM z WHERE i = 0 UNION ALL SELECT framework, 'third', source, truth FROM z WHERE i = least(2, n - 1)
  UNION ALL SELECT framework, 'middle', source, truth FROM z WHERE i = n // 2 UNION ALL SELECT framework, 'last', source, truth FROM z WHERE i = n - 1)
SELECT framework, predictor, count(*) AS n, count(*) FILTER (source = truth) AS step_hits, count(*) FILTER (abs(source - truth) <= 2) AS near_hits FROM p GROUP BY ALL""")
def hallucination_steps(spark, sf):
    """Localisers by position, in steps of the source."""
    c = hallucination_docs(spark, sf)
    found = E.hallucination(written(c.content, "entries"), written(c.labels, "entry-labels"))["localisation"]
    return found.where(F.col("predictor").isin("first", "third", "middle", "last"))
