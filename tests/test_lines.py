"""Places of lines, members of a large JSON object and sidecars in lockstep, with files split anywhere."""

import json
import random

import pytest
from pyspark.errors import PySparkException

from veerline.sources import files, lines


@pytest.fixture
def split(spark):
    """Ranges of 100 bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "100", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    old = {n: spark.conf.get(n, None) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in old.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def test_places(spark, tmp_path, split):
    rng = random.Random(1)
    texts = ["é" * rng.choice([0, 1, 5, 90, 250]) + str(i) for i in range(80)]
    (tmp_path / "a").mkdir()
    (tmp_path / "a/2.txt").write_text("\n".join(texts[50:]) + "\n")
    (tmp_path / "a/1.txt").write_text("\n".join(texts[:50]))
    rows = lines.placed_lines(spark, str(tmp_path / "a"))
    assert rows.rdd.getNumPartitions() >= 1 and spark.read.text(str(tmp_path / "a")).rdd.getNumPartitions() > 20
    assert [(r["place"], r["value"]) for r in rows.orderBy("place").collect()] == list(enumerate(texts))


def value(rng, depth=0):
    kind = rng.randint(0, 5 if depth < 3 else 2)
    if kind == 0:
        return "".join(rng.choices(['"', "\\", "{", "}", "[", "]", ",", ":", "é", "\n", " ", "a", "}"], k=rng.randint(0, 12)))
    if kind in (1, 2):
        return rng.choice([1, 2.5, True, None, -3])
    if kind == 3:
        return [value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {f'k{i}"}}\\'[: rng.randint(1, 6)]: value(rng, depth + 1) for i in range(rng.randint(0, 4))}


def test_members(spark, tmp_path, split):
    rng = random.Random(2)
    for seed in range(3):
        made = {f'key {i} "{{}}\\ é'[: rng.randint(4, 14)] + str(i): value(rng) if seed else {"a": value(rng, 2)} for i in range(60)}
        path = tmp_path / f"{seed}.json"
        path.write_text(json.dumps(made, ensure_ascii=bool(seed % 2), indent=[None, 1, 3][seed]))
        got = {r["key"]: r["value"] for r in lines.json_members(spark, str(path)).collect()}
        assert set(got) == set(made)
        for k, v in made.items():
            assert got[k] == (v if isinstance(v, str) else None if v is None else got[k])
            if isinstance(v, dict | list):
                assert json.loads(got[k]) == v, k
    for text, want in (("{}", {}), ('{"a": {}}', {"a": "{}"}), ('{"a": 1, "a": {"b": "}"}}\n', {"a": '{"b":"}"}'}), (' {"x": "}"} ', {"x": "}"}), ("", {})):
        (tmp_path / "one.json").write_text(text)
        assert {r["key"]: r["value"] for r in lines.json_members(spark, str(tmp_path / "one.json")).collect()} == want


def test_lockstep(spark, tmp_path, split):
    records = [{"ts": float(i), "run_id": f"r{i // 4}", "agent_id": "a", "model": "m", "model_version": "", "goal_id": "g", "step_index": i % 2, "tool": "t", "params_hash": "p", "status": "ok", "duration_ms": 1.0} for i in range(40)]
    side = [{"run_id": r["run_id"], "step_index": r["step_index"], "l1_text": f"line {i}"} for i, r in enumerate(records)]
    schema = "run_id string, step_index int, l1_text string"

    def joined(side, blank=False):
        (tmp_path / "l.jsonl").write_text("\n".join(json.dumps(r) + ("\n" if blank else "") for r in records))
        (tmp_path / "s.jsonl").write_text("\n".join(map(json.dumps, side)))
        ledger = files.read_ledger(spark, str(tmp_path / "l.jsonl"))
        return files.lockstep(ledger, files.read_sidecar(spark, str(tmp_path / "s.jsonl"), schema))

    for blank in (False, True):
        got = sorted((r["ts"], r["l1_text"]) for r in joined(side, blank).collect())
        assert got == [(float(i), f"line {i}") for i in range(40)]  # repeated keys don't meet each other
    for bad in (side[:-1], [*side, side[0]], [side[4], *side[1:]], side[1:] + side[:1]):
        with pytest.raises(PySparkException, match="differ at line"):
            joined(bad).collect()
