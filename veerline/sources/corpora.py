"""Raw corpora as records, content and labels.

A corpus is read as one document a row. Fields come out with get_json_object and from_json with permissive schemas; a
document that isn't what its corpus holds has a null where its list should be, and is counted, never fatal. docs: documents that are read
otherwise than from the root, such as some pipelines' or models' alone. Records,
content and labels of a corpus come from one exploded table of calls, so that their steps agree."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..folders import written
from ..functions import canonical as K
from ..functions import text as T
from ..functions.text import TS_BASE
from .datasource import small_batches
from .files import documents, ranked
from .lines import json_members, placed_lines
from .spans import paired_results, spans_of

RUN_SPACING = 1000.0


@dataclass(frozen=True)
class Corpus:
    """records and labels may be None where a corpus has none; skipped counts what couldn't be used."""

    records: DataFrame | None
    content: DataFrame | None
    labels: DataFrame | None
    skipped: DataFrame | None = None


def _given(spark: SparkSession, root: str, docs: DataFrame | None, pattern: str = "*.json") -> DataFrame:
    """rel and text of the documents below root, or of those that the caller has opened: by the data source, or with a filter on their
    paths, of which either opens the files that fit alone."""
    return documents(spark, root, pattern) if docs is None else docs.select("rel", "text")


def _get(doc, path: str) -> Column:
    return F.get_json_object(T.col(doc), path)


def _texts(raw) -> Column:
    """Elements of a JSON array: objects as the JSON text that they are, strings bare; null if it is no array."""
    raw = F.ltrim(T.col(raw))
    return F.when(raw.startswith("["), F.from_json(raw, "array<string>"))


def _is_string(doc, name: str) -> Column:
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(T.col(doc)), f"$.{name}", "variant"))
    return F.coalesce(kind == "STRING", F.lit(False))


def _string(doc, name: str) -> Column:
    """A field's text if it is a string, else empty."""
    return F.when(_is_string(doc, name), _get(doc, f"$.{name}")).otherwise(F.lit(""))


def _raw(doc, name: str) -> Column:
    """A field's JSON text, that of strings without quotes; null if it is absent or null."""
    return _get(doc, f"$.{name}")


def _told(doc, name: str) -> Column:
    """A field's text: strings verbatim, null as empty, other values as canonical JSON."""
    return F.when(_is_string(doc, name), _raw(doc, name)).otherwise(F.coalesce(K.json_text(_raw(doc, name)), F.lit("")))


def _object(doc, name: str) -> Column:
    """A field's JSON text, {} if it is absent, null or empty."""
    raw = _raw(doc, name)
    return F.when(raw.isNull() | raw.isin("", "[]", "0", "false"), F.lit("{}")).otherwise(raw)


def _record(**given) -> list[Column]:
    """Columns of a record; what isn't given is empty."""
    base = {"ts": F.lit(0.0), "agent_id": F.lit(""), "model": F.lit(""), "model_version": F.lit(""), "goal_id": F.lit(""), "params_hash": F.lit(""), "status": F.lit("ok"),
            "duration_ms": F.lit(0.0), "meta": F.create_map().cast("map<string,string>")} | given
    names = ("ts", "run_id", "agent_id", "model", "model_version", "goal_id", "step_index", "tool", "params_hash", "status", "duration_ms", "meta")
    kinds = {"ts": "double", "step_index": "int", "duration_ms": "double"}
    return [(T.col(base[n]).cast(kinds[n]) if n in kinds else T.col(base[n])).alias(n) for n in names]


def _steps(calls: DataFrame, *order: str) -> DataFrame:
    return calls.withColumn("step_index", F.row_number().over(Window.partitionBy("run_id").orderBy(*order)) - 1)


# --- tool-using runs under injection: runs/<pipeline>/**.json ---


def injection_runs(spark: SparkSession, root: str, docs: DataFrame | None = None) -> Corpus:
    """Labels' utility, attack and security, records of assistant tool calls, content with paired results."""
    docs = _given(spark, root, docs).withColumn("pipeline", F.split("rel", "/")[0]).withColumn("run_id", F.regexp_replace("rel", r"\.json$", ""))
    docs = ranked(docs, ("rel",), ("pipeline",)).withColumn("messages", _texts(_raw("text", "messages")))
    calls = docs.select("run_id", "run_index", "text", F.posexplode("messages").alias("m", "message")).where(_get("message", "$.role") == "assistant")
    calls = calls.select("run_id", "run_index", "text", "m", "message", F.posexplode(_texts(_raw("message", "tool_calls"))).alias("k", "call"))
    calls = _steps(calls, "m", "k")
    # null in JSON and the texts "None" and "" are no errors; the last message of an identifier counts
    errors = docs.select("run_id", F.posexplode("messages").alias("m", "message")).where((_get("message", "$.role") == "tool") & (F.coalesce(_get("message", "$.tool_call_id"), F.lit("")) != "")).groupBy(
        "run_id", _get("message", "$.tool_call_id").alias("id")).agg(F.max_by(F.coalesce(T.has_error(_get("message", "$.error")), F.lit(False)), "m").alias("failed"))
    n = F.count(F.lit(1)).over(Window.partitionBy("run_id"))
    rows = calls.withColumn("id", _get("call", "$.id")).withColumn("n", n).join(errors, ["run_id", "id"], "left")
    args = _object("call", "args")
    pipeline, goal = _get("text", "$.pipeline_name"), F.concat_ws("/", _get("text", "$.suite_name"), _get("text", "$.user_task_id"))
    records = rows.select(*_record(
        ts=F.lit(TS_BASE) + F.col("run_index") * RUN_SPACING + F.col("step_index"), run_id="run_id", agent_id=pipeline, model=pipeline, goal_id=goal, step_index="step_index",
        tool=_get("call", "$.function"), params_hash=K.json_hash(args), status=F.when(F.coalesce("failed", F.lit(False)), "error").otherwise("ok"),
        duration_ms=F.coalesce(_get("text", "$.duration").cast("double"), F.lit(0.0)) * 1000 / F.col("n")))
    results = docs.select("run_id", F.posexplode(paired_results(_raw("text", "messages"))).alias("step_index", "l2_text"))
    content = calls.select("run_id", "step_index", _get("call", "$.function").alias("tool"), F.when(_is_string("call", "args"), args).otherwise(K.json_text(args)).alias("l1_text"), _string("message", "content").alias("l3_text")).join(results, ["run_id", "step_index"], "left").select(
        "run_id", "step_index", "tool", "l1_text", F.coalesce("l2_text", F.lit("")).alias("l2_text"), "l3_text")
    attack = _get("text", "$.attack_type")
    attacked = T.is_attacked(attack)
    counts = calls.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_calls"))
    when = lambda c: F.when(attacked, c)
    injected = F.array_sort(F.array_distinct(F.map_values(F.from_json(_raw("text", "injections"), "map<string,string>"))))
    labels = docs.join(counts, "run_id", "left").select(
        "run_id", "pipeline", _get("text", "$.suite_name").alias("suite"), _get("text", "$.user_task_id").alias("user_task"), when(attack).alias("attack_type"),
        when(_get("text", "$.injection_task_id")).alias("injection_task_id"), attacked.alias("attacked"), (attacked & F.coalesce(_raw("text", "security") == "true", F.lit(False))).alias("injection_success"),
        F.coalesce(_raw("text", "utility") == "true", F.lit(False)).alias("utility"), _get("text", "$.error").alias("run_error"), F.coalesce("n_calls", F.lit(0)).alias("n_calls"),
        F.coalesce(when(injected), F.array().cast("array<string>")).alias("injected"))
    return Corpus(records, content, labels)


# --- coding submissions: <submission>/trajs/*.traj or *.json ---


def coding_runs(spark: SparkSession, root: str, max_runs: int | None = None, docs: DataFrame | None = None) -> Corpus:
    """Submissions of either format; each submission's files are of one, told by its first file. skipped: submission, reason."""
    docs = _given(spark, root, docs, "*").where(F.col("rel").rlike(r"^[^/]+/trajs/[^/]+\.(traj|json)$"))
    docs = docs.select(F.split("rel", "/")[0].alias("submission"), F.split("rel", "/")[2].alias("file"), "text")
    by = Window.partitionBy("submission")
    docs = docs.withColumn("traj", F.max(F.col("file").endswith(".traj").cast("int")).over(by) == 1)
    docs = ranked(docs.where(F.col("file").endswith(".traj") == F.col("traj")), ("file",), ("submission",))
    named = lambda m: F.exists(F.coalesce(_texts(_raw(m, "tool_calls")), F.array().cast("array<string>")), lambda c: F.coalesce(_get(c, "$.function.name"), F.lit("")) != "")
    calls = F.coalesce(F.exists(_texts("text"), lambda m: F.coalesce(_get(m, "$.role") == "assistant", F.lit(False)) & named(m)), F.lit(False))
    # files are traj, or messages if the first one calls a tool
    known = F.col("traj") | (F.max(F.when(F.col("run_index") == 0, calls.cast("int"))).over(by) == 1)
    docs = docs.withColumn("format", F.when(F.col("traj"), "traj").when(known, "messages"))
    if max_runs is not None:
        docs = docs.where(F.col("run_index") < max_runs)
    steps = F.when(F.col("traj"), _texts(_raw("text", "trajectory"))).otherwise(_texts("text"))
    docs = docs.withColumn("run_id", F.regexp_replace("file", r"\.(traj|json)$", "")).withColumn("steps", steps)
    each = docs.where("format IS NOT NULL").select("submission", "run_id", "run_index", "traj", F.posexplode("steps").alias("i", "step"))
    action = F.trim(F.regexp_replace(F.coalesce(_get("step", "$.action"), F.lit("")), r"^\s+|\s+$", ""))
    acts = each.where(F.col("traj")).select("submission", "run_id", "run_index", "i", F.lit(0).alias("k"), F.regexp_extract(action, r"^(\S+)", 1).alias("tool"), action.alias("payload")).where("payload <> ''")
    said = each.where(~F.col("traj") & (_get("step", "$.role") == "assistant")).select("submission", "run_id", "run_index", "i", F.posexplode(_texts(_raw("step", "tool_calls"))).alias("k", "call"))
    said = said.select("submission", "run_id", "run_index", "i", "k", _get("call", "$.function.name").alias("tool"), F.coalesce(_get("call", "$.function.arguments"), F.lit("")).alias("payload")).where("tool <> ''")
    calls = acts.unionByName(said)
    calls = calls.withColumn("step_index", F.row_number().over(Window.partitionBy("submission", "run_id").orderBy("i", "k")) - 1)
    records = calls.select(*_record(
        ts=T.submission_epoch("submission") + F.col("run_index") * RUN_SPACING + F.col("step_index"), run_id="run_id", agent_id="submission", model="submission",
        goal_id=T.goal_of_instance("run_id"), step_index="step_index", tool="tool", params_hash=T.short_hash("payload")))
    good = calls.groupBy("submission").agg(F.count_distinct("run_id").alias("n_runs"))
    counts = docs.groupBy("submission").agg(F.count(F.lit(1)).alias("n_files"), F.max("format").alias("format"), F.sum(F.col("steps").isNull().cast("long")).alias("n_failed")).join(good, "submission", "left")
    reason = F.when(F.col("format").isNull(), F.lit("no known format")).otherwise(F.format_string("no run among %d files (%d could not be parsed)", "n_files", "n_failed"))
    skipped = counts.where(F.col("n_runs").isNull()).select("submission", reason.alias("reason"))
    return Corpus(records, None, None, skipped)


# --- terminal tasks: tasks/<task>/<model>/{baseline,hack}_trajectories/<label>/metadata.json, trial/agent/trajectory.json ---


def terminal_runs(spark: SparkSession, root: str, docs: DataFrame | None = None) -> Corpus:
    docs = _given(spark, root, docs)
    parts = F.regexp_extract
    shape = r"^([^/]+)/([^/]+)/(baseline_trajectories|hack_trajectories)/([^/]+)/"
    side = lambda end: docs.where(F.col("rel").rlike(shape + end)).select(*(parts("rel", shape, k).alias(n) for k, n in ((1, "task"), (2, "model_dir"), (3, "tree"), (4, "label"))), "text")
    keys = ["task", "model_dir", "tree", "label"]
    meta = side("metadata\\.json$").withColumnRenamed("text", "meta_text")
    runs = side("trial/agent/trajectory\\.json$").join(meta, keys, "full").withColumn("steps", _texts(_raw("text", "steps")))
    runs = runs.withColumn("run_id", F.concat_ws("/", "task", "tree", "label"))
    usable = F.col("steps").isNotNull() & F.coalesce(F.try_parse_json("meta_text").isNotNull(), F.lit(False))
    each = runs.where(usable).select("run_id", *keys, "meta_text", "text", F.posexplode("steps").alias("i", "step")).where(_get("step", "$.source") == "agent")
    calls = each.select("*", F.posexplode(_texts(_raw("step", "tool_calls"))).alias("k", "call"))
    keystrokes = _string("call", "arguments.keystrokes")
    tool = T.tool_name(_get("call", "$.function_name"), keystrokes, ("bash_command",))
    calls = calls.withColumn("tool", tool).withColumn("keystrokes", keystrokes).where("tool <> ''")
    # a run is one of a model's: the same path may recur with another model
    w = Window.partitionBy("model_dir", "run_id")
    calls = calls.withColumn("step_index", F.row_number().over(w.orderBy("i", "k")) - 1).withColumn("first_in_step", F.min("step_index").over(Window.partitionBy("model_dir", "run_id", "i")))
    goal = F.coalesce(_get("meta_text", "$.task_id"), F.col("task"))
    args = _object("call", "arguments")
    stamp = T.epoch(_get("step", "$.timestamp"), F.lit(TS_BASE) + F.col("first_in_step"))
    records = calls.select(*_record(ts=stamp + F.col("k") * 0.001, run_id="run_id", agent_id="model_dir", model=F.coalesce(_get("text", "$.agent.model_name"), F.lit("")), goal_id=goal,
                                    step_index="step_index", tool="tool", params_hash=K.json_hash(args)))
    content = calls.select("model_dir", "run_id", "step_index", "tool", F.col("keystrokes").alias("l1_text"), F.lit("").alias("l2_text"), _string("step", "message").alias("l3_text"))
    counts = calls.groupBy("model_dir", "run_id").agg(F.count(F.lit(1)).alias("n_calls"))
    flat = lambda n: _get("meta_text", f"$.{n}")
    labels = runs.join(counts, ["model_dir", "run_id"]).select(
        "run_id", "model_dir", goal.alias("task_id"), "tree", flat("classification").alias("classification"), flat("reward").cast("double").alias("reward"),
        *(flat(n).alias(n) for n in ("exploit_attempted", "judged_serious_exploit", "judged_legitimate_solve", "source_dataset", "episode_count")), "n_calls")
    skipped = runs.join(counts, ["model_dir", "run_id"], "left_anti").select("run_id", "model_dir", F.lit("unusable, or without a call").alias("reason"))
    return Corpus(records, content, labels, skipped)


# --- trajectories exported as JSON lines ---


def exported_trajectories(spark: SparkSession, path: str, agent: str = "trace", docs: DataFrame | None = None) -> Corpus:
    docs = spark.read.text(path).select(F.col("value").alias("text")) if docs is None else docs.select("text")
    docs = docs.where(F.trim("text") != "")
    docs = docs.withColumn("run_id", F.coalesce(_get("text", "$.trajectory_id"), F.lit(""))).withColumn("messages", _texts(_raw("text", "conversation")))
    usable = (F.col("run_id") != "") & F.col("messages").isNotNull()
    each = docs.where(usable).select("run_id", F.posexplode("messages").alias("i", "message")).where(_get("message", "$.role") == "assistant")
    calls = each.select("*", F.posexplode(_texts(_raw("message", "tool_calls"))).alias("k", "call"))
    calls = calls.withColumn("tool", T.tool_name(_get("call", "$.name"), _string("call", "parameters.command"), ("Bash",))).where("tool <> ''")
    calls = _steps(calls, "i", "k")
    params = _object("call", "parameters")
    records = calls.select(*_record(ts=F.lit(TS_BASE) + F.col("step_index"), run_id="run_id", agent_id=F.lit(agent), goal_id="run_id", step_index="step_index", tool="tool", params_hash=K.json_hash(params)))
    entries = F.array_sort(F.map_entries(F.from_json(params, "map<string,variant>")), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    strings = F.transform(F.filter(entries, lambda e: F.schema_of_variant(e["value"]) == "STRING"), lambda e: F.variant_get(e["value"], "$", "string"))
    content = calls.select("run_id", "step_index", "tool", F.array_join(strings, "\n").alias("l1_text"), F.lit("").alias("l2_text"), _string("message", "content").alias("l3_text"))
    counts = calls.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_calls"))
    label = F.coalesce(_get("text", "$.label"), F.lit("None"))
    labels = docs.where(usable).join(counts, "run_id", "left").select("run_id", label.alias("label"), (label != "0").alias("hacked"), T.codes_of(label).alias("codes"), F.size("messages").alias("n_messages"), F.coalesce("n_calls", F.lit(0)).alias("n_calls"))
    return Corpus(records, content, labels, docs.where(~usable).select("run_id", F.lit("no identifier or conversation").alias("reason")))


# --- span trees with annotations: <data>/<dataset>/*.json ---


def span_traces(spark: SparkSession, data: str, annotations: str | None, dataset: str, docs: DataFrame | None = None) -> Corpus:
    docs = _given(spark, data, docs).withColumn("run_id", F.coalesce(_get("text", "$.trace_id"), F.lit("")))
    # trees are read once, in batches of few bytes: records, content and labels start from their spans
    with small_batches(spark):
        spans = written(spans_of(docs.where("run_id <> ''").select("run_id", "text")).where("span IS NOT NULL"), "spans")
    spans = spans.withColumn("epoch", T.epoch(_get("span", "$.timestamp"), F.lit(TS_BASE) + F.col("place")))
    spans = _steps(spans, "epoch", "place").withColumn("attrs", _object("span", "span_attributes"))
    attr = F.from_json("attrs", "map<string,variant>")
    spans = spans.withColumn("a", attr).withColumn("span_id", _get("span", "$.span_id")).withColumn("status", T.span_status(_get("span", "$.status_code")))
    # Python gets what isn't a string alone: its column is worked out for all rows
    string = lambda v: F.schema_of_variant(v) == "STRING"
    plain = lambda v: F.when(string(v), F.try_variant_get(v, "$", "string")).otherwise(K.json_text(F.when(~string(v), F.to_json(v))))
    text = lambda name: F.coalesce(plain(F.try_element_at("a", F.lit(name))), F.lit(""))
    tool = F.coalesce(_get("span", "$.span_name"), F.lit(""))
    records = spans.select(*_record(ts="epoch", run_id="run_id", agent_id=F.lit(dataset), model=text("llm.model_name"), goal_id="run_id", step_index="step_index", tool=tool, params_hash=K.json_hash("attrs"), status="status",
                                    duration_ms=T.duration_ms(_get("span", "$.duration")), meta=F.create_map(F.lit("span_id"), "span_id")))
    number = r"^llm\.output_messages\.(\d+)\.message\.content$"
    said = spans.select("run_id", "step_index", F.explode("a").alias("key", "value")).where(F.col("key").rlike(number)).select(
        "run_id", "step_index", F.regexp_extract("key", number, 1).cast("int").alias("n"), plain(F.col("value")).alias("x")).where("x <> ''")
    said = said.groupBy("run_id", "step_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "x"))), lambda s: s["x"]), "\n").alias("l3_text"))
    tokens = lambda name: T.int_or_null(F.try_variant_get(F.try_element_at("a", F.lit(name)), "$", "string"))
    content = spans.select("run_id", "step_index", "span_id", tool.alias("tool"), text("openinference.span.kind").alias("kind"), text("input.value").alias("l1_text"), text("output.value").alias("l2_text"),
                           tokens("llm.token_count.prompt").alias("tokens_prompt"), tokens("llm.token_count.completion").alias("tokens_completion")).join(said, ["run_id", "step_index"], "left").withColumn("l3_text", F.coalesce("l3_text", F.lit("")))
    counts = spans.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_calls"), F.count_distinct(F.when(F.col("status") == "error", F.col("span_id"))).alias("n_error_status"))
    labels = counts.withColumn("dataset", F.lit(dataset))
    if annotations is not None:
        notes = documents(spark, annotations)
        fixed = F.when(F.try_parse_json("text").isNotNull(), F.col("text")).otherwise(T.without_trailing_commas("text"))
        notes = notes.select(F.regexp_extract("rel", r"([^/]+)\.json$", 1).alias("run_id"), fixed.alias("text"))
        errors = notes.select("run_id", F.explode(F.from_json(_raw("text", "errors"), "array<struct<category:string,location:string,impact:string>>")).alias("e")).select("run_id", "e.*")
        own = spans.select("run_id", F.col("span_id").alias("location"), (F.col("status") == "error").alias("bad")).groupBy("run_id", "location").agg(F.max("bad").alias("bad"))
        noted = errors.join(own, ["run_id", "location"], "left").groupBy("run_id").agg(
            F.collect_list(F.struct("category", "location", "impact")).alias("errors"), F.count(F.lit(1)).alias("n_errors_annotated"),
            F.count("bad").alias("n_locations_resolved"), F.sum(F.coalesce(F.col("bad"), F.lit(False)).cast("long")).alias("n_annotated_on_error_status"))
        labels = labels.join(noted, "run_id", "left").join(notes.select("run_id", F.get(_texts(_raw("text", "scores")), 0).alias("scores")), "run_id", "left")
        labels = labels.fillna(0, ["n_errors_annotated", "n_locations_resolved", "n_annotated_on_error_status"])
    bad = docs.where("run_id = ''").select(F.col("rel").alias("file"), F.lit("no trace identifier").alias("reason"))
    return Corpus(records, content, labels, bad)


# --- multi-agent conversations with a marked mistake ---


def blamed_runs(spark: SparkSession, root: str, variant: str, docs: DataFrame | None = None) -> Corpus:
    """Files in the order of (length of name, name); entries without a label leave holes in the steps."""
    docs = _given(spark, root, docs).withColumn("file", F.regexp_extract("rel", r"([^/]+)$", 1)).withColumn("history", _texts(_raw("text", "history")))
    docs = docs.withColumn("goal", F.coalesce(_get("text", "$.question_ID"), F.lit(""))).withColumn("run_id", F.concat(F.lit(variant + "/"), F.regexp_replace("file", r"\.json$", "")))
    objects = F.forall("history", lambda h: h.startswith("{"))
    usable = F.col("history").isNotNull() & (F.col("goal") != "") & F.coalesce(objects, F.lit(False))
    good = ranked(docs.where(usable), (F.length("file"), "file"))
    each = good.select("run_id", "goal", F.posexplode("history").alias("step_index", "entry")).withColumn("tool", T.seam_label(_get("entry", "$.name"), _get("entry", "$.role"))).where("tool <> ''")
    whole = F.when(_is_string("entry", "content"), F.to_json(F.struct(_raw("entry", "content").alias("content")))).otherwise(F.concat(F.lit('{"content":'), F.coalesce(_raw("entry", "content"), F.lit("null")), F.lit("}")))
    records = each.select(*_record(ts=F.lit(TS_BASE) + F.col("step_index"), run_id="run_id", agent_id=F.lit(variant), goal_id="goal", step_index="step_index", tool="tool", params_hash=K.json_hash(whole)))
    content = each.select("run_id", "step_index", "tool", F.lit("").alias("l1_text"), F.lit("").alias("l2_text"), _told("entry", "content").alias("l3_text"))
    counts = each.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_calls"))
    labels = good.join(counts, "run_id", "left").select("run_id", F.col("goal").alias("question_ID"), F.lit(variant).alias("variant"), *(_get("text", f"$.{n}").alias(n) for n in ("is_correct", "is_corrected", "level", "mistake_agent", "mistake_step", "mistake_reason")), F.coalesce("n_calls", F.lit(0)).alias("n_calls"))
    return Corpus(records, content, labels, docs.where(~usable).select("run_id", F.lit("no history or question").alias("reason")))


# --- chat sessions of coding agents: events as JSON lines and a map of sessions ---


def chat_sessions(spark: SparkSession, events: str, sessions: str) -> Corpus:
    """Labels here are the sessions' own columns; skipped counts events without a session, and without time or tool."""
    meta = written(json_members(spark, sessions).select(F.col("key").alias("session_id"), F.from_json("value", "struct<user_id:string,agent:string,cli_version:string,repo_id:string,created_at_us:bigint>").alias("s")).select("session_id", "s.*"), "sessions")
    schema = "session_id string, turn_number int, ts_us bigint, tool_name string, command_head string, params_sha256 string, model string, status string, duration_ms double"
    lines = placed_lines(spark, events).where(F.trim("value") != "").select(F.col("place").alias("line"), F.from_json("value", schema).alias("e")).select("line", "e.*")
    known = lines.join(meta, "session_id")
    head = F.coalesce("command_head", F.lit(""))
    tool = F.when(F.col("tool_name").isin("Bash", "bash") & (head != ""), head).otherwise(F.coalesce("tool_name", F.lit("")))
    known = known.withColumn("tool", tool)
    used = F.col("ts_us").isNotNull() & (F.col("tool") != "")
    rows = _steps(known.where(used).withColumn("run_id", F.col("session_id")).withColumn("turn", F.coalesce("turn_number", F.lit(0))), "turn", "line")
    plain = lambda c: F.coalesce(c, F.lit(""))
    records = rows.select(*_record(
        ts=F.col("ts_us") / 1e6, run_id="run_id", agent_id=plain("user_id"), model=plain("model"), model_version=plain("cli_version"), goal_id=plain("repo_id"), step_index="step_index", tool="tool",
        params_hash=F.substring(plain("params_sha256"), 1, 12), status=F.coalesce(F.nullif("status", F.lit("")), F.lit("ok")), duration_ms=F.coalesce("duration_ms", F.lit(0.0))))
    counts = rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_records"))
    labels = meta.withColumnRenamed("session_id", "run_id").join(counts, "run_id").select("run_id", "user_id", T.agent_slug("agent").alias("agent"), "cli_version", "created_at_us", "n_records")
    skipped = lines.join(meta, "session_id", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("no session").alias("reason"), "n").unionByName(
        known.where(~used).agg(F.count(F.lit(1)).alias("n")).select(F.lit("no time or tool").alias("reason"), "n"))
    return Corpus(records, None, labels, skipped)


# --- trajectories with marked hallucinations: content only ---

#: Directories and keys of the frameworks.
FRAMEWORKS = {"BFCL": "bfcl", "Camel": "camel", "Magentic_One": "magentic-one", "Octotools": "octotools", "OpenDeepSearch": "opendeepsearch", "OpenManus": "openmanus", "SmolAgents": "smolagents"}


def hallucination_runs(spark: SparkSession, root: str, docs: DataFrame | None = None) -> Corpus:
    docs = _given(spark, root, docs).withColumn("directory", F.split("rel", "/")[0]).where(F.col("directory").isin(*FRAMEWORKS))
    key = F.element_at(F.create_map(*(F.lit(x) for pair in FRAMEWORKS.items() for x in pair)), F.col("directory"))
    docs = docs.withColumn("framework", key).withColumn("run_id", F.concat(F.col("framework"), F.lit("/"), F.regexp_extract("rel", r"([^/]+)\.json$", 1))).withColumn("history", _texts(_raw("text", "history")))
    usable = F.col("history").isNotNull() & F.coalesce(F.forall("history", lambda h: h.startswith("{")), F.lit(False))
    each = docs.where(usable).select("run_id", "framework", F.posexplode("history").alias("step_index", "entry"))
    content = each.select("run_id", "framework", "step_index", T.int_or_null(_get("entry", "$.step")).alias("step_source"), F.coalesce(_get("entry", "$.role"), F.lit("")).alias("role"),
                          _told("entry", "tool_calls").alias("l1_text"), _told("entry", "tool_responses").alias("l2_text"), _told("entry", "content").alias("l3_text"))
    flat = lambda n: _get("text", f"$.{n}")
    labels = docs.where(usable).select("run_id", "framework", flat("model_id").alias("model_id"), flat("question_domain").alias("question_domain"), T.bool_label(flat("is_hallucination")).alias("is_hallucination"),
                                       T.int_or_null(flat("hallucination_step")).alias("hallucination_step"), *(flat(n).alias(n) for n in ("hallucination_category", "hallucination_subcategory", "hallucination_reason", "explanation")), F.size("history").alias("n_entries"))
    return Corpus(None, content, labels, docs.where(~usable).select("run_id", F.lit("no history").alias("reason")))
