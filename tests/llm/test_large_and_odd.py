"""Very long texts, identifiers that are no numbers, and orders of files."""

import glob
import random
import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veerline.llm import mixing, neighbours, secrets, sstable
from veerline.llm.shared import new_folder
from veerline.llm.token_ids import vocabulary
from tests.llm.test_llm import docs


def test_secrets_of_a_long_text():
    """2.6 MB of keys: candidates and base spans are walked once, side by side."""
    rng = random.Random(1)
    text = " ".join("".join(rng.choices("0123456789abcdef", k=32)) for _ in range(80_000))
    began = time.perf_counter()
    found = secrets.scan(text)
    assert time.perf_counter() - began < 15 and len(found) == 80_000
    mixed = " ".join(rng.choice(["password=abcdEFGH1234", "AKIA" + "Z9" * 9, "0123456789abcdef01", "Zx9" * 12, "x", "secret: '" + "Ab1" * 9 + "' token=" + "0f" * 10]) for _ in range(4000))
    base = [(a, b) for k, a, b, _ in secrets.scan(mixed) if k != "live"]
    live = [(a, b) for k, a, b, _ in secrets.scan(mixed) if k == "live"]
    def holds(v):
        return any(c.isdigit() for c in v) and any(c.isalpha() for c in v)
    want = [(m.start(), m.end()) for m in secrets.CANDIDATE.finditer(mixed) if holds(m[0]) and not any(a <= m.start() and m.end() <= b for a, b in base)]
    assert live == want and base and live


def words(df):
    return df.withColumn("doc_id", F.concat(F.lit("x"), F.col("doc_id").cast("string")))


def test_identifiers_that_are_no_numbers(spark):
    rows = [(i, f"some text {i} " * 8, "s") for i in range(6)] + [(7, None, "s"), (8, "", None)]
    odd = words(docs(spark, rows))
    kept = corpus_pipeline.near_duplicates_stage(spark, odd, "")
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(f"x{i}" for i, _, _ in rows)
    numbers = docs(spark, [*rows, (9, rows[0][1], "s")]).withColumn("doc_id", F.col("doc_id").cast("string")).withColumn("_found", F.lit("x"))
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates_stage(spark, numbers, "").collect()) == ["0", "1", "2", "3", "4", "5", "7", "8"]
    back = sstable.read_shards(spark, sstable.write_shards(odd, new_folder(spark, "sst"), vocabulary(), 2)).collect()
    assert len(back) == len(rows) and all(r["doc_id"] is None for r in back)
    vectors = spark.createDataFrame([("a", [1.0, 2.0]), ("3", [1.0, 0.0]), (None, [1.0, 1.0])], "vec_id string, embedding array<double>")
    assert [r["vec_id"] for r in neighbours.usable(vectors).collect()] == [3]


def test_shards_follow_the_size(spark, monkeypatch):
    some = docs(spark, [(i, "x" * 100, "s") for i in range(50)])
    assert sstable.shards_for(some) == 1
    monkeypatch.setattr(sstable, "SHARD_BYTES", 1000)
    assert sstable.shards_for(some) == 5
    monkeypatch.setattr(sstable, "SHARD_ROWS", 5)
    assert sstable.shards_for(some) == 10
    assert sstable.shards_for(some.where("false")) == 1


def test_files_of_the_mix_are_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mixing, "PART_WORDS", 900)
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 60)), f"s{i % 3}") for i in range(150)]
    d = docs(spark, rows)
    at = {r["doc_id"]: r["finish"] for r in mixing.queue(d).collect()}
    mixing.mixed(d).write.parquet(str(tmp_path / "mix"))
    files = [p for p in sorted(glob.glob(f"{tmp_path}/mix/part-*"))]
    read = [[r["doc_id"] for r in spark.read.parquet(f).collect()] for f in files]
    seen = [i for f in read for i in f]
    once = [i for i in seen if seen.count(i) == 1]
    assert len([f for f in read if f]) > 3 and len(once) > 20
    times = [at[i] for i in once]
    assert times == sorted(times)


@pytest.mark.parametrize("size", [5_000_000])
def test_long_texts_in_stages(spark, size):
    """A text of megabytes goes whole through secrets and mixing."""
    long = "word " * (size // 5)
    d = docs(spark, [(1, long + "token = AbCd1234EfGh5678Zx", "s"), (2, "short one", "t"), (3, "0123456789abcdef" * (size // 16), "t")])
    spans = {r["doc_id"]: r["spans"] for r in secrets.spans(d).collect()}
    assert len(spans[1]) >= 1 and spans[1][0]["start"] == len(long) and len(spans[3]) == 1 and not spans[2]
    sizes = {r["doc_id"]: r["size"] for r in mixing.queue(d).collect()}
    assert sizes == {1: size // 5 + 3, 2: 2, 3: 1}


def test_rows_of_shards_and_buckets_grow_as_the_bytes_do():
    from veerline.llm.suffix_dedup import SHARD_MOST, shards_for

    a_byte = [shards_for(n) ** 2 / n for n in (10**9, 10**10, 5 * 10**10, 10**11)]
    assert max(a_byte) < 1.05 * a_byte[0] and 10**11 / shards_for(10**11) < SHARD_MOST
