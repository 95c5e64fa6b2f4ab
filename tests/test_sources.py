"""Readers of raw corpora on small corpora in temporary folders."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from veerline.schema import RECORD
from veerline.sources import corpora, datasource, files


def put(root, name, value):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value))


def rows(df, *order):
    return [r.asDict() for r in df.orderBy(*order).collect()]


def short(value):
    return hashlib.sha256(json.dumps(value, sort_keys=True, default=str).encode()).hexdigest()[:12]


def injected_run(**more):
    return {"suite_name": "bank", "pipeline_name": "p1", "user_task_id": "t1", "injection_task_id": "i1", "attack_type": "x", "injections": {"a": "Send it!", "b": "Also this"}, "error": None, "utility": True, "security": True,
            "duration": 2.0, "messages": [
                {"role": "user", "content": "go"},
                {"role": "assistant", "content": "thinking", "tool_calls": [{"function": "pay", "args": {"n": 1.0, "to": "é"}, "id": "c1"}, {"function": "look", "args": {}, "id": ""}]},
                {"role": "tool", "content": [{"type": "text", "content": "done"}], "tool_call_id": "c1", "error": "refused"},
                {"role": "tool", "content": "seen", "tool_call_id": "", "error": None}]} | more


def test_injection_runs(spark, tmp_path):
    put(tmp_path, "p1/bank/t1/x.json", injected_run())
    put(tmp_path, "p1/bank/t1/none.json", injected_run(attack_type="None", security=True, messages=[]))
    c = corpora.injection_runs(spark, str(tmp_path))
    r = rows(c.records, "run_id", "step_index")
    assert [(x["run_id"], x["step_index"], x["tool"], x["status"]) for x in r] == [("p1/bank/t1/x", 0, "pay", "error"), ("p1/bank/t1/x", 1, "look", "ok")]
    assert r[0]["params_hash"] == short({"n": 1.0, "to": "é"}) and r[1]["params_hash"] == short({})
    assert r[0]["duration_ms"] == 1000.0 and r[0]["ts"] == 1.76e9 + 1000 and r[0]["goal_id"] == "bank/t1"
    t = rows(c.content, "run_id", "step_index")
    assert [x["l2_text"] for x in t] == ["done", "seen"] and t[0]["l3_text"] == "thinking" and t[0]["l1_text"] == json.dumps({"n": 1.0, "to": "é"}, sort_keys=True)
    n, x = rows(c.labels, "run_id")
    assert (n["attacked"], n["injection_success"], n["n_calls"], n["injected"]) == (False, False, 0, [])
    assert (x["attacked"], x["injection_success"], x["n_calls"], x["injected"]) == (True, True, 2, ["Also this", "Send it!"])
    assert c.records.schema.fieldNames() == RECORD.fieldNames()


def test_coding_runs(spark, tmp_path):
    put(tmp_path, "20240102_agent/trajs/a__b-1.traj", {"trajectory": [{"action": "ls -la\n"}, {"action": "  "}, {"action": "cat x"}]})
    put(tmp_path, "20240102_agent/trajs/bad.traj", "no json")
    put(tmp_path, "20240102_agent/trajs/list.traj", [1])
    put(tmp_path, "chat/trajs/a-2.json", [{"role": "user"}, {"role": "assistant", "tool_calls": [{"id": "1", "type": "function", "function": {"name": "edit", "arguments": "{\"p\": 1}"}}]}])
    put(tmp_path, "empty/trajs/x.traj", {"no": 1})
    put(tmp_path, "odd/trajs/a.json", {"a": 1})
    put(tmp_path, "odd/trajs/b.json", [{"role": "assistant", "tool_calls": [{"function": {"name": "late"}}]}])
    c = corpora.coding_runs(spark, str(tmp_path))
    r = rows(c.records, "agent_id", "run_id", "step_index")
    assert [(x["agent_id"], x["run_id"], x["tool"], x["goal_id"]) for x in r] == [("20240102_agent", "a__b-1", "ls", "a__b"), ("20240102_agent", "a__b-1", "cat", "a__b"), ("chat", "a-2", "edit", "a")]
    assert r[0]["ts"] == 1704153600.0 and r[2]["ts"] == 1.76e9
    assert r[0]["params_hash"] == hashlib.sha256(b"ls -la").hexdigest()[:12] and r[2]["params_hash"] == hashlib.sha256(b'{"p": 1}').hexdigest()[:12]
    assert sorted((x["submission"], x["reason"]) for x in c.skipped.collect()) == [("empty", "no run among 1 files (1 could not be parsed)"), ("odd", "no known format")]


def test_terminal_runs(spark, tmp_path):
    d = "t1/m1/hack_trajectories/v1"
    put(tmp_path, f"{d}/metadata.json", {"task_id": "T", "classification": "c", "reward": 0.5})
    steps = [{"source": "user"}, {"source": "agent", "timestamp": "2025-01-01T00:00:00+00:00", "message": "m", "tool_calls": [
        {"function_name": "bash_command", "arguments": {"keystrokes": "grep x\n"}}, {"function_name": "", "arguments": {}}, {"function_name": "done"}]}, {"source": "agent", "tool_calls": [{"function_name": "bash_command", "arguments": {"keystrokes": "  "}}]}]
    put(tmp_path, f"{d}/trial/agent/trajectory.json", {"agent": {"model_name": "M"}, "steps": steps})
    put(tmp_path, "t2/m1/baseline_trajectories/v1/metadata.json", "{")
    put(tmp_path, "t2/m1/baseline_trajectories/v1/trial/agent/trajectory.json", {"steps": []})
    c = corpora.terminal_runs(spark, str(tmp_path))
    r = rows(c.records, "step_index")
    assert [(x["tool"], x["ts"], x["model"], x["goal_id"]) for x in r] == [("grep", 1735689600.0, "M", "T"), ("done", 1735689600.002, "M", "T"), ("bash_command", 1.76e9 + 2, "M", "T")]
    assert r[1]["params_hash"] == short({})
    t = rows(c.content, "step_index")
    assert [(x["l1_text"], x["l3_text"]) for x in t] == [("grep x\n", "m"), ("", "m"), ("  ", "")]
    (label,) = rows(c.labels, "run_id")
    assert (label["n_calls"], label["reward"], label["tree"]) == (3, 0.5, "hack_trajectories")
    assert c.skipped.count() == 1


def test_exported_trajectories(spark, tmp_path):
    docs = [{"trajectory_id": "r1", "label": "1.2, 3", "conversation": [{"role": "assistant", "content": "hm", "tool_calls": [{"name": "Bash", "parameters": {"command": "rm -r x", "b": 2, "a": "first"}}, {"name": "Read"}]}, {"role": "user"}]},
            {"trajectory_id": "r2", "label": "0", "conversation": []}, {"label": "0"}]
    put(tmp_path, "x.jsonl", "\n".join(map(json.dumps, docs)) + "\n\n")
    c = corpora.exported_trajectories(spark, str(tmp_path / "x.jsonl"))
    assert [(x["tool"], x["ts"]) for x in rows(c.records, "step_index")] == [("rm", 1.76e9), ("Read", 1.76e9 + 1)]
    assert [x["l1_text"] for x in rows(c.content, "step_index")] == ["first\nrm -r x", ""]
    assert [(x["run_id"], x["hacked"], x["codes"], x["n_calls"]) for x in rows(c.labels, "run_id")] == [("r1", True, ["1.2", "3"], 2), ("r2", False, [], 0)]
    assert c.skipped.count() == 1


def test_span_traces(spark, tmp_path):
    leaf = {"span_id": "s3", "span_name": "tool", "timestamp": "2025-01-01T00:00:01Z", "status_code": "Error", "duration": "PT1M2.5S", "span_attributes": {"output.value": {"b": 1, "a": [1.0]}}}
    root = {"span_id": "s1", "span_name": "agent", "timestamp": "2025-01-01T00:00:02Z", "status_code": "Unset", "duration": "junk", "span_attributes": {
        "llm.model_name": "g", "openinference.span.kind": "LLM", "input.value": "{\"q\":  1}", "llm.token_count.prompt": "12", "llm.output_messages.10.message.content": "late", "llm.output_messages.2.message.content": "early"}, "child_spans": [leaf]}
    put(tmp_path, "data/a.json", {"trace_id": "tr", "spans": [root]})
    put(tmp_path, "data/b.json", {"trace_id": "no"})
    put(tmp_path, "notes/tr.json", '{"errors": [{"category": "c", "location": "s3", "impact": "HIGH"}, {"category": "d", "location": "gone", "impact": "LOW"},], "scores": [{"x": 1}]}')
    c = corpora.span_traces(spark, str(tmp_path / "data"), str(tmp_path / "notes"), "gaia")
    r = rows(c.records, "step_index")
    assert [(x["tool"], x["status"], x["duration_ms"], x["model"], x["meta"]) for x in r] == [("tool", "error", 62500.0, "", {"span_id": "s3"}), ("agent", "ok", 0.0, "g", {"span_id": "s1"})]
    assert r[0]["params_hash"] == short(leaf["span_attributes"]) and r[1]["params_hash"] == short(root["span_attributes"])
    t = rows(c.content, "step_index")
    assert (t[0]["l2_text"], t[1]["l1_text"], t[1]["l3_text"], t[1]["kind"], t[1]["tokens_prompt"]) == ('{"a": [1], "b": 1}', '{"q":  1}', "early\nlate", "LLM", 12) or t[0]["l2_text"] == '{"a": [1.0], "b": 1}'
    (label,) = rows(c.labels, "run_id")
    assert (label["n_calls"], label["n_error_status"], label["n_errors_annotated"], label["n_locations_resolved"], label["n_annotated_on_error_status"]) == (2, 1, 2, 1, 1)


def test_blamed_runs(spark, tmp_path):
    put(tmp_path, "10.json", {"question_ID": "q", "history": [{"content": "a", "role": "human"}, {"content": {"z": 1}}, {"content": "c", "role": "x", "name": "Web"}], "mistake_agent": "Web", "mistake_step": "2"})
    put(tmp_path, "2.json", {"history": []})
    c = corpora.blamed_runs(spark, str(tmp_path), "alg")
    assert [(x["step_index"], x["tool"], x["params_hash"]) for x in rows(c.records, "step_index")] == [(0, "human", short({"content": "a"})), (2, "Web", short({"content": "c"}))]
    assert [x["l3_text"] for x in rows(c.content, "step_index")] == ["a", "c"]
    assert c.labels.first()["mistake_step"] == "2" and c.skipped.count() == 1


def test_chat_sessions(spark, tmp_path):
    put(tmp_path, "s.json", {"s1": {"user_id": "u", "agent": "Code  Helper", "cli_version": "1", "created_at_us": 5}})
    events = [{"session_id": "s1", "turn_number": 2, "ts_us": 3000000, "tool_name": "Edit", "params_sha256": "abcdef0123456789"}, {"session_id": "s1", "turn_number": 1, "ts_us": 4000000, "tool_name": "Bash", "command_head": "git", "duration_ms": 5},
              {"session_id": "s1", "tool_name": "Edit"}, {"session_id": "s9", "ts_us": 1, "tool_name": "Edit"}]
    put(tmp_path, "e.jsonl", "\n".join(map(json.dumps, events)))
    c = corpora.chat_sessions(spark, str(tmp_path / "e.jsonl"), str(tmp_path / "s.json"))
    assert [(x["step_index"], x["tool"], x["ts"], x["params_hash"], x["agent_id"]) for x in rows(c.records, "step_index")] == [(0, "git", 4.0, "", "u"), (1, "Edit", 3.0, "abcdef012345", "u")]
    assert c.labels.first()["agent"] == "code-helper"
    assert {x["reason"]: x["n"] for x in c.skipped.collect()} == {"no session": 1, "no time or tool": 1}


def test_hallucination_runs(spark, tmp_path):
    put(tmp_path, "Camel/7.json", {"model_id": "m", "is_hallucination": " True", "hallucination_step": " 3 ", "history": [{"step": "1", "role": "user", "content": None, "tool_calls": [{"b": 1, "a": 2}], "tool_responses": "r"}]})
    put(tmp_path, "Other/1.json", {"history": []})
    c = corpora.hallucination_runs(spark, str(tmp_path))
    (t,) = rows(c.content, "step_index")
    assert (t["run_id"], t["step_source"], t["l1_text"], t["l2_text"], t["l3_text"]) == ("camel/7", 1, '[{"a": 2, "b": 1}]', "r", "")
    (label,) = rows(c.labels, "run_id")
    assert (label["is_hallucination"], label["hallucination_step"], label["n_entries"]) == (True, 3, 1)


def test_ledger_round_trip(spark, tmp_path):
    put(tmp_path, "p1/bank/t1/x.json", injected_run())
    records = corpora.injection_runs(spark, str(tmp_path)).records
    files.write_ledger(records, str(tmp_path / "out"))
    back = files.read_ledger(spark, str(tmp_path / "out"))
    assert rows(back.drop("file", "pos"), "step_index") == rows(records, "step_index")
    line = next(p for p in (tmp_path / "out").glob("part*") if p.stat().st_size).read_text().splitlines()[0]
    assert list(json.loads(line)) == sorted(RECORD.fieldNames())
    m = files.write_manifest(str(tmp_path / "manifest.json"), ledger=back.drop("file", "pos"))
    assert m["ledger"]["n"] == 2 and json.loads((tmp_path / "manifest.json").read_text()) == m
    assert files.content_digest(records)["sha256"] == m["ledger"]["sha256"]


@pytest.mark.parametrize("bad", ['{"ts": 1.0, "odd": 2}', '{"ts": 1.0}', "[]", "junk"])
def test_strict_reader(spark, tmp_path, bad):
    put(tmp_path, "l.jsonl", "\n" + bad + "\n")
    with pytest.raises(Exception, match="unknown|missing|not a JSON object|INVALID_JSON|MALFORMED"):
        files.read_ledger(spark, str(tmp_path / "l.jsonl")).collect()


def test_aligned(spark, tmp_path):
    a = spark.createDataFrame([("r", 0, "t"), ("r", 1, "t")], "run_id string, step_index int, tool string")
    b = spark.createDataFrame([("r", 0, "x"), ("r", 1, "y")], "run_id string, step_index int, l1_text string")
    assert files.aligned(a, b, "l1_text").count() == 2
    with pytest.raises(Exception, match="differ"):
        files.aligned(a, b.limit(1), "l1_text").collect()


# --- the data source ---


def test_data_source(spark, tmp_path):
    root = str(tmp_path / "made")
    docs = spark.createDataFrame([(f"p{i % 3}/s/r{i}.json", f"text {i} é\n") for i in range(60)] + [("p1/odd name+%.json", "odd"), ("p1/none.json", None), ("p1/x.txt", "other")], "rel string, text string")
    datasource.write_documents(docs.repartition(4), root)
    assert (tmp_path / "made/p1/s/r1.json").read_text() == "text 1 é\n" and (tmp_path / "made/p1/none.json").read_text() == ""
    df = datasource.corpus(spark, "injection", root)
    assert df.columns == ["pipeline", "rel", "text"] and df.count() == 62
    some = datasource.corpus(spark, "injection", root, pipeline=["p0", "p2"])
    got = some.where("text LIKE '%7%'").collect()
    assert {r["rel"] for r in got} == {f"p{i % 3}/s/r{i}.json" for i in range(60) if "7" in str(i) and i % 3 != 1}
    assert some.union(df).where("pipeline <> 'p0'").count() == 20 + 42 and df.where("pipeline = 'p1'").union(df.where("pipeline = 'p2'")).count() == 42
    # the default reader sees the same, and rules out files by their paths before they are opened
    native = files.documents(spark, root)
    assert {(r["rel"], r["text"]) for r in native.collect()} == {(r["rel"], r["text"]) for r in df.where("text <> ''").select("rel", "text").collect()}
    one = native.where(F.split("rel", "/")[0] == "p0")
    assert one.count() == 20
    leaf = one._jdf.queryExecution().executedPlan().collectLeaves().head()
    one._jdf.queryExecution().executedPlan().executeCollect()
    assert leaf.metrics().get("numFiles").get().value() == 20


def test_data_source_selects_files(tmp_path):
    for rel in ("t1/m1/hack_trajectories/v1/metadata.json", "t1/m2/baseline_trajectories/v1/trial/agent/trajectory.json", "t2/m1/hack_trajectories/v/metadata.json", "t2/other.json"):
        put(tmp_path, rel, {})
    names = lambda **only: [n for p in datasource.Reader({"kind": "terminal", "path": str(tmp_path)} | {c: json.dumps(v) for c, v in only.items()}).partitions() for n in p.names]
    assert len(names()) == 3 and names(model_dir=["m1"], task=["t2", "t3"]) == ["t2/m1/hack_trajectories/v/metadata.json"] and names(label=["none"]) == []


def test_data_source_lines_and_partitions(spark, tmp_path, monkeypatch):
    put(tmp_path, "a/x.jsonl", '{"a": 1}\n\n{"a": 2}\n')
    put(tmp_path, "y.jsonl", "z")
    got = datasource.corpus(spark, "exported", str(tmp_path)).orderBy("rel", "line").collect()
    assert [(r["rel"], r["line"], r["text"]) for r in got] == [("a/x.jsonl", 0, '{"a": 1}'), ("a/x.jsonl", 1, ""), ("a/x.jsonl", 2, '{"a": 2}'), ("y.jsonl", 0, "z")]
    monkeypatch.setattr(datasource, "PARTITION_FILES", 1)
    assert len(datasource.Reader({"kind": "exported", "path": str(tmp_path)}).partitions()) == 2
    writer = datasource.Writer({"path": str(tmp_path)}, spark.createDataFrame([], "rel string, text string").schema)
    for rel in ("../x", "a//b", "./c", ""):
        with pytest.raises(ValueError, match="below the root"):
            writer.write(iter([{"rel": rel, "text": "t"}]))


def test_filters_on_names_of_files_hold_no_lambdas(spark, tmp_path):
    """The driver works such filters out in several threads, and lambdas of one expression share their variables: files were left out."""
    from veerline.functions import text as T

    for i in range(40):
        put(tmp_path, f"r{i}.json", {"x": i})
    docs = files.documents(spark, str(tmp_path)).select(F.regexp_extract("rel", r"([^/]+)\.json$", 1).alias("run_id"))
    kept = docs.where(~T.is_dev("run_id"))
    assert "lambda" not in kept._jdf.queryExecution().optimizedPlan().toString()
    want = {f"r{i}" for i in range(40) if int(hashlib.sha256(f"r{i}".encode()).hexdigest(), 16) % 5}
    assert {r["run_id"] for r in kept.collect()} == want


def test_spans_pass_python_once_in_batches_of_few_bytes(spark, tmp_path):
    """Records and content start from spans that are written; strings don't go to Python; a setting of the session's own comes back."""
    from veerline.sources import datasource

    put(tmp_path, "data/a.json", {"trace_id": "tr", "spans": [{"span_id": "s", "timestamp": "2025-01-01T00:00:00Z", "span_attributes": {"input.value": "x", "output.value": [1, 2]}}]})
    c = corpora.span_traces(spark, str(tmp_path / "data"), None, "set")
    for table in (c.records, c.content):
        assert "_flattened" not in table._jdf.queryExecution().optimizedPlan().toString()
    assert [(r["l1_text"], r["l2_text"]) for r in c.content.collect()] == [("x", "[1, 2]")]
    before = spark.conf.get(datasource.BATCH_BYTES)
    for given, held in ((before, datasource.AT_ONCE), ("1024", 1024)):
        spark.conf.set(datasource.BATCH_BYTES, given)
        with datasource.small_batches(spark):
            assert int(spark.conf.get(datasource.BATCH_BYTES).rstrip("b")) == held
        assert spark.conf.get(datasource.BATCH_BYTES).rstrip("b") == given.rstrip("b")
    spark.conf.set(datasource.BATCH_BYTES, before)
