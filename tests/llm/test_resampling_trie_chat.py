"""Importance resampling, the conversation trie and chat formatting against plain loops, on small tables and on odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veerline.llm import chat, prefix_trie, resampling
from veerline.llm.token_ids import vocabulary

# --- resampling ---


def features(text):
    text = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    return words, [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def loop_resampling(docs, target, percent=5):
    s, t = (collections.Counter(b for text in texts for b in features(text)[1]) for texts in ([t for _, t in docs], target))
    many, aim = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (many + 10_000) / ((s[b] + 1) * (aim + 10_000)))) for b in s}
    out = []
    for doc_id, text in docs:
        words, found = features(text)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        out.append((doc_id, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((x for x in out if x[1] >= 20), key=lambda x: (-x[4], x[0] is None, x[0] or 0, x[3], x[2], x[1]))
    take = percent * len(order) // 100
    return sorted([(x[0], x[2], x[3], x[4], i + 1 if i < take else None) for i, x in enumerate(order)] + [(x[0], x[2], x[3], x[4], None) for x in out if x[1] < 20], key=str)


def texts(seed, n, vocabulary=40):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghijé日XYZ09", k=rng.randint(1, 9))) for _ in range(vocabulary)]
    return [rng.choice([" ", "-", ", ", "\n"]).join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(n)]


def found(df):
    return sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in df.collect()), key=str)


def test_resampling(spark):
    rows = list(enumerate(texts(1, 400)))
    rows += [(500, None), (501, ""), (502, " .,\n"), (503, "One"), (504, "x" * 500 + " " + "y" * 65 + " z " * 30), (505, "naïve 日本語 " * 40), (505, "naïve 日本語 " * 40), (None, rows[7][1] + " tail " * 20), (-3, rows[7][1])]
    aim = [*texts(2, 30), None, ""]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("rank", "score", "weight", "n_words", "_part", "doc_ids", "bucket"):
        docs = docs.withColumn(c, F.lit("x"))
    target = spark.createDataFrame([(t, i) for i, t in enumerate(aim)], "text string, doc_id long")
    want = loop_resampling(rows, aim)
    assert found(resampling.resampling(docs.repartition(3), target)) == want
    drawn = resampling.resampled(docs, target)
    assert drawn.columns == docs.columns
    assert sorted(r["doc_id"] for r in drawn.select("doc_id").distinct().collect()) == sorted({x[0] for x in want if x[4] is not None and x[0] is not None})


def test_resampling_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b " * 20), (2, None)], "doc_id long, text string")
    assert found(resampling.resampling(none, some)) == []
    assert found(resampling.resampling(some, none)) == loop_resampling([(1, "a b " * 20), (2, None)], [])
    letters = spark.createDataFrame([("x", "a b " * 20)], "doc_id string, text string")
    assert found(resampling.resampling(letters, none))[0][0] is None


def test_long_text_and_words(spark, monkeypatch):
    """A text of five million characters, words beyond the tables of lengths, and n-grams across slices of words."""
    rng = random.Random(3)
    text = " ".join(rng.choices(texts(4, 1)[0].split() or ["a"], k=900_000)) + " " + "q" * 1_000_000
    n, at, buckets, counts = resampling.counted([text, "a b", ""])
    want = collections.Counter(features(text)[1])
    assert n.tolist() == [len(features(text)[0]), 2, 0]
    assert dict(zip(buckets[: at[1]].tolist(), counts[: at[1]].tolist(), strict=True)) == want
    monkeypatch.setattr(resampling, "_AT_ONCE", 3)
    some = [*texts(5, 20), "", "a", "a b"]
    n, at, buckets, counts = resampling.counted(some)
    for i, t in enumerate(some):
        assert collections.Counter(features(t)[1]) == dict(zip(buckets[at[i] : at[i + 1]].tolist(), counts[at[i] : at[i + 1]].tolist(), strict=True))
    rows = resampling.rows_of(*resampling.block_of(at, buckets, counts))
    assert all(np.array_equal(a, b) for a, b in zip(rows, (at, buckets, counts), strict=True))


def test_checksums_of_concatenations():
    rng = random.Random(6)
    parts = [(rng.randbytes(rng.choice([0, 1, 5, 64, 65, 1000])), rng.randbytes(rng.choice([0, 1, 3, 64, 65, 66, 500, 70_000]))) for _ in range(200)]
    a, b = (np.array([zlib.crc32(x[k]) for x in parts], np.uint32) for k in (0, 1))
    size = np.array([len(y) for _, y in parts])
    assert (resampling.shifted(a, size) ^ b).tolist() == [zlib.crc32(x + y) for x, y in parts]


# --- the trie ---


def loop_trie(rows, family=5, heads=9):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[c].append(((turn is not None, turn or 0, digest), (role, text)))
    own = {c: [x for _, x in sorted(v, key=lambda x: x[0])] for c, v in own.items()}
    built = {}
    for c, mine in own.items():
        h, base = zlib.crc32(str(c).encode()) % heads, c - int(math.fmod(c, family))
        built[c] = own.get(base, [])[:h] + mine[h:]
    members = collections.defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for node, cs in members.items():
        below = [k for k in members if k[: len(node)] == node]
        children = lambda k: [x for x in members if len(x) == len(k) + 1 and x[: len(k)] == k]
        ends = ",".join(str(c) for c in sorted(cs) if len(built[c]) == len(node))
        saved = sum((len(members[k]) - 1) * len(k[-1][1].encode()) for k in below if k)
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(children(node)), sum(not children(k) for k in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


TRIE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def many_conversations(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "bé", "", "ccc"]) if t < 3 else f"{rng.randint(0, 3)}") for t in range(rng.choice([0, 1, 2, 4, 9, 12]))]
    return rows


@pytest.mark.parametrize("block", [4096, 3])
def test_trie(spark, monkeypatch, block):
    """Also with blocks of three turns, so that conversations, paths and lists of ends span several."""
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    rows = many_conversations(1, 120)
    rows += [(None, 0, "user", "a"), (1001, None, None, None), (1001, 0, "user", None), (1001, 0, "user", None), (1002, 5, "user", "x\ny"), (-7, 0, "user", "a"), (2003, 0, "user", "a")]
    df = conversations(spark, rows)
    for c in ("node", "parent", "d", "path", "size", "_b"):
        df = df.withColumn(c, F.lit(1))
    got = prefix_trie.trie(df.repartition(3))
    assert sorted((tuple(r[c] for c in TRIE) for r in got.collect()), key=str) == loop_trie(rows)


def test_trie_of_copies_and_nothing(spark):
    assert prefix_trie.trie(conversations(spark, [])).collect() == []
    rows = [(c, t, "user", f"turn {t}") for c in range(3000) for t in range(2)] + [(9001, t, "user", "long") for t in range(300)]
    got = {(r["depth"], r["conv_id"]): r for r in prefix_trie.trie(conversations(spark, rows)).collect()}
    assert got[0, 0]["n_convs"] == 3001 and got[0, 0]["n_leaves"] == loop_leaves(rows)


def loop_leaves(rows):
    own = collections.defaultdict(list)
    for c, _, role, text in rows:
        own[c].append((role, text))
    built = set()
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built.add(tuple(own.get(c - c % 5, [])[:h] + mine[h:]))
    return sum(not any(len(b) > len(a) and b[: len(a)] == a for b in built) for a in built)


# --- chat ---


def loop_digests(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for c, turns in own.items():
        turns.sort()
        said = "".join(t for _, _, r, t in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


ODD = ["", None, "\\", "\\\\", "###", "####", "##", "# #", "### assistant: x", "</turn>", "<</turn>\n", "<\\/turn>", " lead", "trail ", "\n", "naïve 日本語 🙂", "it's", ": ", chat.CONTROL_TEXT, "a" * 3000, "word " * 500, "\t\t", "\r\n x"]


def chat_rows(seed):
    rng = random.Random(seed)
    roles = ["user", "assistant", "assistant", "system", None, "", "a: b", "###", "x\\", "r\n</turn>\n"]
    rows = [(c, t if rng.random() < 0.9 else None, rng.choice(roles), rng.choice(ODD)) for c in range(60) for t in range(rng.randint(0, 9))]
    return rows + [(None, 0, "user", "left out")] + [(77, t, "assistant" if t % 2 else "user", rng.choice(ODD)) for t in range(200)] * 2 + [(-5, 0, "assistant", " ".join(texts(9, 200)) * 20)]


@pytest.mark.parametrize("size", [1_000_000, 300])
def test_chat(spark, monkeypatch, size):
    """Also with segments of 300 characters, so that conversations are cut."""
    monkeypatch.setattr(chat, "AT_ONCE", size)
    rows = chat_rows(2)
    df = conversations(spark, rows).withColumn("segment", F.lit(1)).withColumn("whole", F.lit("x")).withColumn("ids", F.lit(0)).repartition(3)
    segments = chat.formatted(df, vocabulary())
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.read_back(segments).collect()}
    assert got == loop_digests(rows)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary())
    tokenizer.encode_special_tokens = True
    assert segments.count() > len(got) if size == 300 else True
    for s in segments.collect():
        assert tokenizer.decode(s["ids"], skip_special_tokens=False) == s["text"]
        said = "".join(t for r, t in chat.parsed(s["text"]) if r == "assistant")
        inside = [i for i, x in enumerate(s["loss"]) if x]
        assert tokenizer.decode([s["ids"][i] for i in inside], skip_special_tokens=False) == "".join(chat.escaped(t) for r, t in chat.parsed(s["text"]) if r == "assistant")
        assert all(0 <= a < b <= len(s["text"]) for a, b in zip(s["starts"], s["ends"], strict=True)) and bool(said) == bool(inside)


def test_offsets_are_the_library_s():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary())
    tokenizer.encode_special_tokens = True
    for text in (t for t in ODD if t):
        ids, starts, ends = chat.encoded([[text]], vocabulary())[0]
        whole = tokenizer.encode(text, add_special_tokens=False)
        assert ids.tolist() == whole.ids and list(zip(starts.tolist(), ends.tolist(), strict=True)) == whole.offsets


def test_covered():
    rng = random.Random(4)
    for _ in range(200):
        borders = sorted(rng.sample(range(1, 60), 12))
        starts, ends = np.array([0, *borders]), np.array([*borders, 60])
        cuts = sorted(rng.sample(range(61), 6))
        spans = np.array([cuts[0:2], cuts[2:4], cuts[4:6], [60, 60]])
        want = [any(a < e and s < b for s, e in spans) for a, b in zip(starts, ends, strict=True)]
        assert chat.covered(starts, ends, spans).tolist() == want


def test_chat_of_nothing(spark):
    assert chat.read_back(chat.formatted(conversations(spark, []), vocabulary())).collect() == []
