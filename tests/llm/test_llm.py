"""The operators of the training-data pipeline against brute force on small tables, and on odd rows: nulls, empty and very
long texts, ties, repeated rows, empty tables, and extra columns whose names the operators use themselves."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veerline import folders
from veerline.llm import components, minhash, mixing, neighbours, packing, quality, secrets, sstable, suffix_dedup, token_ids, toxicity, trie_counts
from veerline.llm.hashing import shingles, words
from veerline.llm.shared import new_folder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use for columns of their own.
CLASH = ("spans", "n_words", "key", "range", "size", "doc", "uid", "score", "hash", "u", "v", "kept", "target", "part", "bin", "shard", "row")


def docs(spark, rows, clash=False):
    df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)
    for c in CLASH if clash else ():
        df = df.withColumn(c, F.lit("x"))
    return df


def odd_rows():
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    base = [text(rng.randint(1, 120)) for _ in range(30)]
    near = base[3] + " tail end"
    long = text(9000)
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate([*base, near, base[3], base[3].upper(), long, long + " x"])]
    rows += [(100, None, "s1"), (101, "", None), (102, " \n\t ", "s1"), (103, "one", None), (104, "two words", "s2"), (105, "naïve 日本語 " * 40, "s2"), (105, "naïve 日本語 " * 40, "s2"), (-7, base[5], "s0"), (106, "x " * 300, None)]
    return rows


def value(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, odd_rows(), clash=True).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return docs(spark, []).persist()


# --- mixing ---


def expected_targets(sizes, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def test_mixing(spark, odd, empty, monkeypatch):
    q = mixing.queue(odd).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by = collections.Counter()
    for _, t, s in odd_rows():
        by[s] += size(t)
    want = expected_targets(by)
    taken = collections.Counter()
    for r in q:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == by[r["source"]]
        assert 0 <= r["first"] + r["second"] <= 2 * r["size"]
        taken[r["source"]] += r["first"] + r["second"]
    assert len(q) == len(odd_rows()) and all(abs(taken[s] - want[s]) < 2 * mixing.QUANTUM for s in want)
    assert sum(taken.values()) == int(1.5 * sum(by.values()))
    key = lambda rows: sorted((r["doc_id"], r["size"], r["first"], r["second"]) for r in rows)
    assert key(q) == key(mixing.queue(odd.repartition(5)).collect())
    # a plain queue of fragments, all in one list
    flow = []
    for k, r in enumerate(q):
        flow += [((r["start"] + p * r["source_size"] + min(r["size"], 512 * (j + 1))) / r["target"], "n" if r["source"] is None else "s" + r["source"], k, min(512, r["size"] - 512 * j))
                 for p in (0, 1) for j in range(-(-r["size"] // 512))]
    left, gets = int(1.5 * sum(by.values())), collections.Counter()
    for *_, k, words_ in sorted(flow):
        gets[k] += min(left, words_)
        left -= min(left, words_)
    assert all(gets[k] == r["first"] + r["second"] for k, r in enumerate(q))
    monkeypatch.setattr(mixing, "PART_WORDS", 3000)
    m = mixing.mixed(odd)
    assert m.columns == odd.columns
    assert sum(size(r["text"]) for r in m.collect()) == sum(taken.values())
    assert mixing.queue(empty).count() == 0 and mixing.mixed(empty).count() == 0
    blank = docs(spark, [(1, "", "a"), (2, None, "b")])
    assert [r["first"] for r in mixing.queue(blank).collect()] == [0, 0] and mixing.mixed(blank).count() == 0


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 0, "c": 5}, {"a": 1, "b": 1000, "c": 1, None: 7}, {"a": 5}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(("s" + s) if s else "n", s, n) for s, n in sizes.items()], "skey string, source string, source_size long")
    got = {r["skey"]: r["target"] for r in mixing.targets(df).collect()}
    assert got == pytest.approx({("s" + s) if s else "n": t for s, t in expected_targets(sizes).items()})


# --- quality ---


def measured(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    c = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    cover = {k for i, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if c[g] > 1 for k in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover)


def test_quality(spark, odd, empty):
    extra = docs(spark, [(200, "a b c\n" * 30 + "# $ %", "s"), (201, "a b a b a b a", "s"), (202, "\n\nx\n \nx", "s"), (203, "| # " * 60, "s"), (204, "fine words here and there " + " ".join(f"w{i}" for i in range(60)), "s")])
    clash = extra.withColumn("n_words", F.lit("x")).withColumn("_w", F.lit("y")).withColumn("kept", F.lit("z")).withColumn("rating", F.lit("r"))
    for df, n, name in ((odd, len(odd_rows()), "rating"), (extra, 5, "rating"), (clash, 5, "_rating")):
        out = quality.rated(df)
        assert out.columns == [*df.columns, name]
        got = out.collect()
        assert len(got) == n and sorted((r[:-1] for r in got), key=repr) == sorted(map(tuple, df.collect()), key=repr)
        for x in got:
            m, r = measured(x["text"]), x[name]
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == m
            assert r["base_failed"] == (m[0] < 50 or 100 * m[4] > 50 * m[0]) and r["kept"] == (r["reason"] is None) and not (r["base_failed"] and r["kept"])
    assert {x["doc_id"]: x["rating"]["reason"] for x in quality.rated(extra).collect()}[204] is None
    assert quality.rated(empty).count() == 0
    order = quality.estimate(quality.measures(extra.select("text")), quality.rules())
    assert sorted(r.name for _, r in order) == sorted(r.name for r in quality.rules()) and order[0][0] >= order[-1][0]


def test_cascade_order(spark):
    """Of two rules that reject alike, the cheap one goes first; of two that cost alike, the one that rejects more."""
    rows = docs(spark, [(i, " ".join(f"word{i}x{k}" for k in range(400)) + (" $" if i % 2 else ""), "s") for i in range(200)])
    dear = quality.Rule("a_dear", F.regexp_count("text", F.lit(r"(?:\w+ )+\$")) > 0)
    cheap, seldom = quality.Rule("z_cheap", F.col("n_symbols") > 0), quality.Rule("b_seldom", F.col("n_symbols") > 5)
    order = [r.name for _, r in quality.estimate(quality.measures(rows.select("text")).coalesce(1).persist(), [dear, seldom, cheap])]
    assert order[0] == "z_cheap" and order[-1] == "b_seldom"


# --- secrets ---

SECRET = "9f8e7d6c5b4a39281706f5e4d3c2b1a0"


def test_secrets(spark, odd, empty):
    own, copied, extra = f"token = '{SECRET}'", "API-KEY no; api_key: abcdefghij1234567890", "ghp_A1b2C3d4E5f6G7h8I9j0K1l2M3n4"
    rows = [(1, own, "a"), (2, copied, "a"), (3, copied, "b"), (4, copied, "c"), (5, f"é {extra} AKIA{'B' * 14} {'a1' * 8}", "a"), (6, "password: token: abcdefghijklmnop", "a"), (7, "TOKEN=short", "z"), (7, "TOKEN=short", "z"), (8, None, None), (9, "ſecret=abcdefghijklmnop", "q")]
    got = value(secrets.spans(docs(spark, rows)), "doc_id")
    kinds = lambda i: [(s["kind"], s["start"], s["end"], s["verdict"]) for s in got[i]["spans"]]
    assert kinds(1) == [("assign", 0, len(own) - 1, "live"), ("hex", 9, 41, "live")]
    assert [k[3] for k in kinds(2)] == ["copied"] == [k[3] for k in kinds(4)]
    assert [k[:3] for k in kinds(5)] == [("live", 2, 2 + len(extra)), ("access", 3 + len(extra), 21 + len(extra)), ("hex", 22 + len(extra), 38 + len(extra))]
    assert kinds(6) == [] and kinds(7) == [] and kinds(8) == [] and kinds(9) == []
    assert secrets.spans(docs(spark, rows)).count() == len(rows) and secrets.spans(empty).count() == 0 and secrets.spans(odd).count() == len(odd_rows())
    out = secrets.redacted(docs(spark, rows, clash=True))
    text = {r["doc_id"]: r["text"] for r in out.collect()}
    assert out.count() == len(rows) and set(out.columns) == {*docs(spark, rows).columns, *CLASH}
    assert text[1] == "[SECRET]'" and SECRET not in text[1] and text[2] == copied and text[5] == f"é [SECRET] AKIA{'B' * 14} {'a1' * 8}" and text[8] is None


def runs_of(text, ok, least, tail=0):
    """(start, end) of the longest runs of characters in ok of that length at least; tail: so many = may follow."""
    out, i = [], 0
    while i < len(text):
        j = i
        while j < len(text) and text[j] in ok:
            j += 1
        if j - i >= least:
            k = j
            while tail and k < len(text) and k - j < tail and text[k] == "=":
                k += 1
            out.append((i, k))
            j = k
        i = max(i + 1, j)
    return out


def plain_scan(text):
    """Spans by a loop over positions, without patterns: (start, order of the kind, end, kind, value)."""
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    fold = "".join(c.lower() if c in up else c for c in text)
    out, i = [], 0
    while i < len(text):
        end = None
        for word in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            j = i + len(word)
            if fold[i:j] != word:
                continue
            j += text[j : j + 1] in ("'", '"') and j < len(text)
            while text[j : j + 1] == " ":
                j += 1
            if text[j : j + 1] not in (":", "="):
                continue
            j += 1
            while text[j : j + 1] == " ":
                j += 1
            j += text[j : j + 1] in ("'", '"') and j < len(text)
            k = j
            while k < len(text) and text[k] in low + up + dig + "+/_.=-":
                k += 1
            if k > j:
                end = k
                if k - j >= 12:
                    out.append((i, 0, k, "assign", text[j:k]))
                break
        i = end or i + 1
    i = 0
    while (i := text.find("AKIA", i)) >= 0:
        k = i + 4
        while k < len(text) and text[k] in up + dig:
            k += 1
        if k - i >= 18:
            out.append((i, 1, k, "access", text[i:k]))
        i = k
    out += [(a, 2, b, "hex", text[a:b]) for a, b in runs_of(text, dig + "abcdef", 16)]
    base = [(x[0], x[2]) for x in out]
    for a, b in runs_of(text, low + up + dig + "+/_-", 24, 2):
        v = text[a:b]
        if any(c in dig for c in v) and any(c in low + up for c in v) and not any(x <= a and b <= y for x, y in base):
            out.append((a, 3, b, "live", v))
    return sorted(out)


def plain_secrets(rows):
    """All columns of the query for rows (doc_id, text, source)."""
    found = [plain_scan(t or "") for _, t, _ in rows]
    owners, repos = collections.defaultdict(set), collections.defaultdict(set)
    for (i, _, s), spans in zip(rows, found, strict=True):
        for x in spans:
            owners[x[4]].add(s)
            repos[x[4]].add(i)

    def verdict(v):
        n = len(v)
        bits = -sum(c / n * math.log2(c / n) for c in collections.Counter(v).values())
        plain = any(w in v.lower() for w in ("example", "sample", "placeholder", "dummy", "changeme", "your", "xxxx", "0000", "1234"))
        if len(owners[v]) >= 3 or len(repos[v]) >= 100:
            return "copied"
        return "example" if bits < 2.5 or plain else "live" if len(owners[v]) == 1 else "shared"

    out = []
    for (i, _, _), spans in zip(rows, found, strict=True):
        spans = [x for x in spans if x[3] != "live" or verdict(x[4]) == "live"]
        text = lambda xs: ",".join(f"{x[3]}:{x[0]}:{x[2]}" for x in xs)
        n = collections.Counter(x[3] for x in spans)
        v = collections.Counter(verdict(x[4]) for x in spans)
        out.append((i, n["assign"], n["access"], n["hex"], hashlib.sha256(text([x for x in spans if x[3] != "live"]).encode()).hexdigest(), text(spans), v["live"], v["copied"],
                    ",".join(f"{len(owners[x[4]])}/{len(repos[x[4]])}" for x in spans)))
    return sorted(out, key=repr)


def test_secrets_by_loops(spark, tmp_path):
    rng = random.Random(11)
    bits = ["password", "Token", "API_KEY", "apikey", "secret", "passwd", "ſecret", " ", ":", "=", "'", '"', " = ", "é", "AKIA", "B7" * 7, "a1" * 8, "0f", SECRET, "Zk9Qw8Xy7Lm6Np5Rt4Vb3", "==", "x", "-", "\n", "your", "日本", "Q1w2" * 6]
    rows = odd_rows() + [(1000 + i, "".join(rng.choices(bits, k=rng.randint(1, 14))), rng.choice(["a", "b", "c", None])) for i in range(300)]
    rows += [(2000 + i, f"see ghp_{'Zk9Qw8Xy7Lm6Np5Rt4Vb3'}{'0f1e2d3c4b5a6978'}QwErTy", "hot") for i in range(120)]  # many repositories of one owner
    docs(spark, rows, clash=True).write.parquet(str(tmp_path / "documents.parquet"))
    got = secrets.op2_secret_owners(spark, str(tmp_path))
    assert [(f.name, f.dataType.simpleString()) for f in got.schema][:6] == [("doc_id", "bigint"), ("n_assign", "bigint"), ("n_access", "bigint"), ("n_hex", "bigint"), ("base_sha256", "string"), ("spans", "string")]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_secrets(rows)


def test_redaction_of_overlaps(spark):
    token = "ghp_Zk9Qw8Xy7Lm6Np5Rt4Vb3" + "0f1e2d3c4b5a6978" + "QwErTy"
    out = secrets.redacted(docs(spark, [(1, f"see {token} there", "a"), (2, "token = 'your_example_key_1234'", "b")]))
    text = {r["doc_id"]: r["text"] for r in out.collect()}
    assert text == {1: "see [SECRET] there", 2: "token = 'your_example_key_1234'"}


# --- token ids, shards, packing, token counts ---

TEXTS = ["", " ", "a", "  a   b\n\n c \n d\t\te  ", "it's don't we'll 'tis ''s", "x\x1cy", "日本語 text", "naïve café² 12³ ½ a_b  ", "\n\n\n", "<|endoftext|> hi", "a\x85b\xa0c", "word " * 5000, "é ẞ ﬁ"]


def test_token_ids():
    enc = token_ids.Encoder(token_ids.vocabulary())
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choices("ab1é .,\n\t'日²_ ", k=rng.randint(0, 60))) for _ in range(500)]
    for _ in range(2):
        for t, ids in zip(texts, enc.ids_of(texts), strict=True):
            assert ids.tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)
    # a collision of hashes is seen: every name leads to the same pre-token
    enc.memo = collections.defaultdict(int, {k: 0 for k in enc.memo})
    assert enc.ids_of(["some words here"])[0].tolist() == enc.tokenizer.encode("some words here", add_special_tokens=False).ids


def whole_ids(rows):
    enc = token_ids.encoder(token_ids.vocabulary())
    return [(i, [*enc.tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) for i, t, _ in rows]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_shards(spark, odd, empty, tmp_path):
    folder = new_folder(spark, "test-sst")
    shards = sstable.write_shards(odd, folder, token_ids.vocabulary(), 3)
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in sstable.read_shards(spark, shards).collect())
    at, want = 0, []
    for i, ids in sorted(whole_ids(odd_rows()), key=lambda x: x[0]):
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    assert got == want
    readers = [sstable.Reader(r["path"]) for r in shards.collect()]
    assert sum(r.entries for r in readers) == len(want) and sum(r.tokens for r in readers) == at
    for i, ids in whole_ids(odd_rows()):
        assert ids in [x.tolist() for r in readers for x in r.get(i)]
    assert len([x for r in readers for x in r.get(105)]) == 2 and not any(r.get(10**12) for r in readers)
    missing = sum(r.may_hold(k) for r in readers for k in range(10**6, 10**6 + 2000))
    assert missing < 0.05 * 2000 * len(readers)
    assert sstable.read_shards(spark, sstable.write_shards(empty, new_folder(spark, "test-sst"), token_ids.vocabulary(), 2)).count() == 0


def test_shard_keys_and_damage(tmp_path):
    ids = [None, -(2**63), -1, 0, 1, 2**63 - 1]
    keys = [sstable.key_of(i) for i in ids]
    assert keys == sorted(keys) and [sstable.id_of(k) for k in keys] == ids
    w = sstable.Writer(str(tmp_path / "x.sst"), 2)
    for i in range(3000):
        w.add(i // 2, np.arange(i % 50, dtype="<u2"))
    w.close()
    r = sstable.Reader(str(tmp_path / "x.sst"))
    assert len(r.index) > 1 and [len(x) for x in r.get(700)] == [1400 % 50, 1401 % 50] and [i for i, _ in r] == [i // 2 for i in range(3000)]
    raw = bytearray((tmp_path / "x.sst").read_bytes())
    raw[-60] ^= 1
    (tmp_path / "x.sst").write_bytes(raw)
    with pytest.raises(ValueError):
        sstable.Reader(str(tmp_path / "x.sst"))


def test_packing(spark, odd, empty):
    out = packing.pack(packing.pieces(odd, token_ids.vocabulary())).collect()
    whole = collections.defaultdict(list)
    for i, ids in whole_ids(odd_rows()):
        whole[i].append(ids)
    by = collections.defaultdict(list)
    for r in out:
        assert any(crc(ids[r["start"] : r["start"] + r["length"]]) == r["ids_crc32"] for ids in whole[r["doc_id"]])
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
    assert sum(r["length"] for r in out) == sum(len(x) for xs in whole.values() for x in xs)
    assert len(by) <= 1.05 * math.ceil(sum(r["length"] for r in out) / 1024) + 1
    key = lambda rows: sorted((r["doc_id"], r["piece"], r["offset"], r["length"]) for r in rows)
    assert key(out) == key(packing.pack(packing.pieces(odd, token_ids.vocabulary())).collect())
    assert packing.pack(packing.pieces(empty, token_ids.vocabulary())).count() == 0
    assert packing.cut(1024) == [(0, 1024)] and packing.cut(2050) == [(0, 2), (2, 1024), (1026, 1024)] and packing.cut(5) == [(0, 5)]


def test_packing_ends(spark, monkeypatch):
    """More bins that can't be filled than a task may hold: rounds end, and those that gain go on."""
    monkeypatch.setattr(packing, "CHUNK", 20)
    rounds, whole = [], packing.staged

    def counted(df, name):
        rounds.append(name)
        assert rounds.count("bins") <= 20
        return whole(df, name)

    monkeypatch.setattr(packing, "staged", counted)
    parts = lambda lengths: spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    out = packing.pack(parts([600] * 60)).collect()
    assert len(out) == len({r["sequence_id"] for r in out}) == 60 and {r["doc_id"] for r in out} == set(range(60))
    rounds.clear()
    out = packing.pack(parts([600] * 60 + [300] * 60).repartition(24)).collect()
    assert sorted(r["doc_id"] for r in out) == list(range(120))
    fills = collections.Counter()
    for r in out:
        fills[r["sequence_id"]] += r["length"]
    assert max(fills.values()) <= 1024 and len(fills) <= 66  # 60 is the least


def test_best_fit():
    rng = random.Random(1)
    lengths = sorted((rng.randint(1, 1023) for _ in range(400)), reverse=True)
    bins, free = [], []
    for i, n in enumerate(lengths):  # the plain way
        room = [(f, b) for b, f in enumerate(free) if f >= n]
        if room:
            least = min(f for f, _ in room)
            b = [b for f, b in room if f == least][-1]
        else:
            b = len(bins)
            bins.append([])
            free.append(1024)
        bins[b].append(i)
        free[b] -= n
    got = packing.best_fit(lengths)
    assert sorted(i for b in got for i in b) == list(range(400)) and len(got) == len(bins)


def test_token_counts(spark, odd, empty):
    enc = token_ids.encoder(token_ids.vocabulary())
    pieces = {enc.token_bytes[a : a + n].tobytes(): k for k, (a, n) in enumerate(zip(enc.token_at, enc.token_len, strict=True))}
    longest = max(map(len, pieces))
    import regex

    def tokens(word, scores):
        """Pieces of the likeliest segmentation, the plain way."""
        best = [(0.0, 0, None)] + [(-math.inf, 0, None)] * len(word)
        for j in range(1, len(word) + 1):
            for i in range(max(0, j - longest), j):
                if (k := pieces.get(word[i:j])) is not None and best[i][0] > -math.inf:
                    x = best[i][0] + scores[k], best[i][1] - 1
                    if x > best[j][:2]:
                        best[j] = (*x, i)
        out, j = [], len(word)
        while j:
            i = best[j][2]
            out.append(pieces[word[i:j]])
            j = i
        return out

    split = [[w.encode() for w in regex.findall(token_ids.PATTERN, t or "")] for _, t, _ in odd_rows()]
    zipf, n = trie_counts.zipf_scores(len(pieces)), np.ones(len(pieces))
    for w, k in collections.Counter(w for ws in split for w in ws).items():
        np.add.at(n, tokens(w, zipf), k)
    scores = np.log(n / n.sum()).tolist()
    assert trie_counts.fit_scores(odd, token_ids.vocabulary()) == scores
    cuts = {w: len(tokens(w, scores)) for ws in split for w in ws}
    want = sorted((i, len(ws), sum(cuts[w] for w in ws)) for (i, _, _), ws in zip(odd_rows(), split, strict=True))
    got = sorted((r["doc_id"], r["n_pretokens"], r["n_tokens"]) for r in trie_counts.token_counts(odd, token_ids.vocabulary()).collect())
    assert got == want and trie_counts.token_counts(empty, token_ids.vocabulary()).count() == 0


def test_prefix_counts():
    shared = trie_counts.PrefixCounts(trie_counts.piece_trie([b"a", b"b", b"ab"], [-1.0, -1.0, -1.5]))
    assert shared.counts([b"ab", b"aba", b"abb", b"c"]) == {b"ab": 1, b"aba": 2, b"abb": 2, b"c": -1} and shared.nodes == 5
    into = np.zeros(3, int)
    shared.pieces({b"ab": 5, b"aba": 2, b"c": 9}, [1, 1, 2], into)
    assert into.tolist() == [2, 0, 7]


def test_long_pretokens():
    """Pre-tokens of megabytes take a few bytes a byte, and still share their first bytes."""
    import tracemalloc

    rng = random.Random(7)
    word = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=300_000)).encode()
    counter = trie_counts.Counter(token_ids.vocabulary())
    tracemalloc.start()
    ((_, n),) = counter.of([word.decode()])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # cuts of whole pieces after any byte: the long word has no more tokens than its parts
    halves = [counter.of([part.decode()])[0][1] for part in (word[:150_000], word[150_000:])]
    assert peak < 40 * len(word) and sum(halves) - 1 <= n <= sum(halves)
    deep = [b"x" * 2000 + bytes([97 + k]) for k in range(5)]
    alone = [trie_counts.PrefixCounts(counter.trie.root).counts([w])[w] for w in deep]
    assert [trie_counts.PrefixCounts(counter.trie.root).counts(deep)[w] for w in deep] == alone


# --- near duplicates ---


def linked(rows, n, percent):
    """component of each doc_id, by all pairs."""
    sets = collections.defaultdict(list)
    for i, t, _ in rows:
        w = (t or "").encode().lower().split()
        sets[i].append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    comp = {i: i for i in sets}
    for _ in range(len(comp)):
        for a in sets:
            for b in sets:
                if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    return comp, sets


@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, odd, empty, n, percent):
    comp, sets = linked(odd_rows(), n, percent)
    got = minhash.near_duplicates(odd, n, percent).collect()
    assert len(got) == len(odd_rows())
    for r in got:
        assert (r["component_id"], r["kept"]) == (comp[r["doc_id"]], r["doc_id"] == comp[r["doc_id"]]) and r["n_shingles"] in {len(s) for s in sets[r["doc_id"]]}
    assert minhash.near_duplicates(empty).count() == 0
    null = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    assert sorted((r["doc_id"] is None, r["component_id"], r["kept"]) for r in minhash.near_duplicates(null).collect()) == [(False, 1, True), (True, None, True)]


def test_large_group_of_near_copies(spark):
    """Copies that are near an original, but seldom near each other; chains of links; a group with its own template."""
    rng = random.Random(9)
    fresh = lambda: "".join(rng.choices("abcdefghijklmnop", k=8))
    original = [fresh() for _ in range(200)]

    def edited(base, k):
        out = list(base)
        for i in rng.sample(range(len(out)), k):
            out[i] = fresh()
        return out

    group = [original] + [edited(original, rng.choice((2, 4, 6, 8, 10, 14))) for _ in range(120)]
    chain = [[fresh() for _ in range(150)]]
    for _ in range(25):
        chain.append(edited(chain[-1], 3))
    rows = [(i, " ".join(t), "s") for i, t in enumerate(group + chain)]
    rng.shuffle(rows)
    comp, _ = linked(rows, 3, 85)
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs(spark, rows), 3, 85).collect()} == comp


def test_many_near_copies(spark):
    """5,000 copies of one template with edits of their own, of which few are linked to the template: pairs by their bits."""
    rng = np.random.default_rng(12)
    n, size = 5000, 160
    edits = rng.choice([1, 2, 3, 4, 5, 6], n)
    keep = np.ones((n, size), bool)
    for i in range(n):
        at = rng.integers(0, size - 12)  # edits side by side, so that many copies lack the same words
        keep[i, at : at + edits[i] * 2] = False
    rows = [(i, " ".join(f"w{j}" if keep[i, j] else f"x{i}y{j}" for j in range(size)), "s") for i in range(n)]
    # shingles that are the template's; all others are a copy's own
    own = (keep[:, :-2] & keep[:, 1:-1] & keep[:, 2:]).astype(np.float32)
    both, total = own @ own.T, size - 2
    comp = np.arange(n)
    link = (100 * both >= 85 * (2 * total - both)) | np.eye(n, dtype=bool)
    while True:
        after = np.where(link, comp[None, :], n).min(axis=1)
        if (after == comp).all():
            break
        comp = after
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs(spark, rows), 3, 85).collect()}
    assert len(set(comp.tolist())) > 1 and got == dict(enumerate(comp.tolist()))


def test_sketches():
    n, r = minhash.bands(85)
    assert n * r <= minhash.PERMUTATIONS and (1 - 0.85**r) ** n <= 1e-6
    a = shingles(words(["a b c d E f"])[0], 3)
    assert (a == shingles(words([" A  b\nc d e\tf "])[0], 3)).all() and len(a) == 4
    assert [len(w) for w in words(["", "é x", " "])] == [0, 2, 0] and words([]) == []
    s = np.unique(np.random.default_rng(1).integers(0, 2**63, 4000).astype(np.uint64))
    x, y = minhash.signature(s[:3000]), minhash.signature(s[500:])
    assert abs((x == y).mean() - 2500 / len(s)) < 0.12


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(90)]
    comp = {x: x for e in edges for x in e}
    for _ in range(80):
        for a, b in edges:
            comp[a] = comp[b] = min(comp[a], comp[b])
    got = {r["u"]: r["v"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: c for x, c in comp.items() if x != c}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- repeated passages ---


def removed(rows, length=50):
    least = {}
    for i, t, _ in rows:
        b = (t or "").encode()
        for s in range(len(b) - length + 1):
            least[b[s : s + length]] = min(least.get(b[s : s + length], i), i)
    out = []
    for i, t, _ in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for s in range(len(b) - length + 1):
            if least[b[s : s + length]] < i:
                gone[s : s + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


def test_repeats(spark, odd, empty):
    rng = random.Random(4)
    passage = "".join(rng.choices("abc é", k=70))
    rows = odd_rows() + [(300 + i, "".join(rng.choices("xyz ", k=rng.randint(0, 90))) + passage[: rng.randint(30, 70)] + "".join(rng.choices("xyz ", k=40)), "s") for i in range(60)]
    rows += [(400, "a" * 49, "s"), (401, "a" * 50, "s"), (402, "a" * 51, "s"), (403, "ab" * 200, "s"), (404, "b" + "ab" * 100, "s"), (405, passage + passage, "s")]
    got = sorted(tuple(r) for r in suffix_dedup.repeats_removed(docs(spark, rows), 3).collect())
    assert got == removed(rows)
    assert suffix_dedup.repeats_removed(odd).count() == len(odd_rows()) and suffix_dedup.repeats_removed(empty).count() == 0
    null = spark.createDataFrame([(None, "z" * 60), (1, "z" * 60)], "doc_id long, text string")
    assert sorted((r["doc_id"] is None, r["n_removed"]) for r in suffix_dedup.repeats_removed(null).collect()) == [(False, 0), (True, 60)]
    last = spark.createDataFrame([(None, "z" * 60), (2**63 - 1, "z" * 60)], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in suffix_dedup.repeats_removed(last).collect()) == [(str(2**63 - 1), 0), ("None", 0)]


def in_one_process(rows, shards):
    """The five steps without an engine, so that their functions can be replaced."""
    import pyarrow as pa

    def grouped(tables, column):
        t_ = pa.concat_tables(tables)
        return {k: t_.filter(pa.compute.equal(t_[column], k)) for k in sorted(set(t_[column].to_pylist()))}

    one = lambda k: (pa.scalar(k),)
    by = collections.defaultdict(list)
    for i, text, _ in rows:
        by[zlib.crc32(str(i).encode()) % shards].append((i, text))
    docs_ = {k: pa.table({"doc_id": pa.array([i for i, _ in x], pa.int64()), "text": pa.array([x_ for _, x_ in x], pa.string())}) for k, x in by.items()}
    first = grouped([suffix_dedup._step1(shards)(one(k), x) for k, x in docs_.items()], "bucket")
    second = grouped([suffix_dedup._none(suffix_dedup._STEP2), *(suffix_dedup._step2(one(k), x) for k, x in first.items())], "shard")
    third = grouped([suffix_dedup._step3(shards)(one(k), x, second.get(k, suffix_dedup._none(suffix_dedup._STEP2))) for k, x in docs_.items()], "bucket")
    fourth = grouped([suffix_dedup._none(suffix_dedup._STEP4), *(suffix_dedup._step4(one(k), x) for k, x in third.items())], "shard")
    out = [suffix_dedup._step5(one(k), x, fourth.get(k, suffix_dedup._none(suffix_dedup._STEP4))) for k, x in docs_.items()]
    return sorted(tuple(r.values()) for x in out for r in x.to_pylist())


@pytest.mark.parametrize("weak", ["none", "first", "both"])
def test_collisions(monkeypatch, weak):
    """Hashes of contexts that collide all the time remove nothing that isn't repeated: between shards bytes decide, and
    within a shard both hashes must agree."""
    import pyarrow.compute  # noqa: F401

    whole, rng = suffix_dedup.context_hash, random.Random(6)
    if weak != "none":
        monkeypatch.setattr(suffix_dedup, "context_hash", lambda *a: whole(*a) & np.uint64(3))
    passage = ["".join(rng.choices("abc ", k=80)) for _ in range(3)]
    rows = [(i, "".join(rng.choices("xyz ", k=30)) + passage[i % 3][: rng.randint(55, 80)] + "".join(rng.choices("xyz ", k=20)), "s") for i in range(24)]
    if weak == "both":
        # one short document a shard, of a single context: no two of a shard can be taken for each other
        monkeypatch.setattr(suffix_dedup, "second_hash", lambda raw, a, b: np.zeros(len(a), np.uint64))
        rows = [(i, passage[i % 3][:50], "s") for i in range(9)]
    shards = {"none": 4, "first": 4, "both": 997}[weak]
    got = in_one_process(rows, shards)
    assert got == removed(rows) and sum(r[2] for r in got) > 0


def test_shards_for():
    assert [suffix_dedup.shards_for(n) for n in (0, 1, 10**9)] == [1, 1, 125]
    for n in (10**9, 10**11, 10**14):  # a group's bytes are bounded, whatever the input
        assert n / suffix_dedup.shards_for(n) <= suffix_dedup.SHARD_MOST


def test_suffix_order():
    rng = np.random.default_rng(3)
    raw = rng.integers(97, 99, 3000).astype(np.uint8)
    order = suffix_dedup.SuffixOrder(raw, 50)
    start = rng.integers(0, 2950, 700)
    group = np.sort(rng.integers(0, 5, 700))
    text = raw.tobytes()
    got = [(group[i], text[start[i] : start[i] + 50]) for i in order.sort(start, group)]
    assert got == sorted(got)
    o, new = order.classes(start, group)
    assert new.sum() == len({(group[i], text[start[i] : start[i] + 50]) for i in range(700)})
    x, y = rng.integers(0, 2950, 500), rng.integers(0, 2950, 500)
    common = lambda a, b: next((k for k in range(50) if text[a + k] != text[b + k]), 50)
    assert order.common(x, y).tolist() == [common(a, b) for a, b in zip(x, y, strict=True)]


# --- toxicity ---


def toxic_corpus(spark):
    rng = random.Random(8)
    plain = ["".join(rng.choices("aeiou", k=1) + rng.choices("bcdfglmnprst", k=1) + rng.choices("aeiou", k=2)) for _ in range(300)]
    bad = ["idiot", "scumbag", "moronic"]
    rows, labels = [], []
    for i in range(700):
        words_ = rng.choices(plain, k=40)
        toxic = i % 5 == 1
        if toxic:
            words_[rng.randrange(40)] = rng.choice(bad)
        rows.append((i, " ".join(words_), "s"))
        labels.append((i, int(toxic)))
    return docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"), bad


def test_toxicity(spark, odd, empty):
    corpus, labels, bad = toxic_corpus(spark)
    model = toxicity.fit(corpus, labels)
    got = {r["doc_id"]: r["score"] for r in model.scored(corpus, ["doc_id"]).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = {r["doc_id"] for r in corpus.where(toxicity.held_out(F.col("doc_id"))).collect()}
    assert held == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert all((got[i] >= 0.5) == bool(truth[i]) for i in held)
    hidden = docs(spark, [(1, "bo you 1d10t xo", "s"), (2, "such utter s c u m b a g here", "s"), (3, "m0r0nic", "s"), (4, "idiooooot!!!", "s"), (5, "i.d.i.o.t", "s"), (6, "good and fine", "s"), (7, None, "s"), (8, "", "s")])
    s = {r["doc_id"]: r["score"] for r in model.scored(hidden, ["doc_id"]).collect()}
    assert all(s[i] >= 0.5 for i in range(1, 6)) and all(0 <= s[i] < 0.5 for i in (6, 7, 8))
    assert model.scored(odd, ["doc_id"]).count() == len(odd_rows())
    none = toxicity.fit(empty, labels.limit(0))
    assert none.curve is None and none.scored(odd, ["doc_id"]).agg(F.max("score")).first()[0] == 0.0 and none.scored(empty, ["doc_id"]).count() == 0
    # labels of held-out rows are never learnt from
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.fit(corpus, flipped)
    assert again.odds == model.odds and again.curve == model.curve
    twice = labels.unionByName(labels.where("doc_id < 50").withColumn("toxic", F.lit(0)))
    assert toxicity.fit(corpus, twice).odds == model.odds


def model_of(texts):
    import pyarrow as pa

    (batch,) = toxicity.count_batches([pa.RecordBatch.from_pydict({"text": texts})])
    return toxicity.costs(batch["place"].to_numpy(), batch["n"].to_numpy())


def test_restore():
    rng = random.Random(1)
    model = model_of([*(["the idiot said hello world"] * 50), *("".join(rng.choices("aeioutnsr ", k=60)) for _ in range(50)), None, "", "日本 é"])
    for raw, want in (("1d10t", "idiot"), ("h3ll0", "hello"), ("heeeello", "hello"), ("i.d.i.o.t", "idiot"), ("hello###", "hello"), ("hello", "hello"), ("2024", "2024"), ("w0rld!!!", "world")):
        assert toxicity.restore_token(raw, model) == want, raw


def test_best_path():
    """Decoding finds a path as cheap as the cheapest of all."""
    import itertools

    rng = random.Random(3)
    model = model_of(["the idiot said hello world what scum"] * 20 + ["".join(rng.choices("aeioutnsrlc ", k=60)) for _ in range(200)])

    def cost(path):
        context = total = 0
        for out, c in path:
            total += c
            z = toxicity.symbol(out) if out else -1
            if z > 0 or z == 0 and context % toxicity.SYMBOLS:
                total += model[context * toxicity.SYMBOLS + z]
                context = (context * toxicity.SYMBOLS + z) % toxicity.SYMBOLS ** (toxicity.ORDER - 1)
        return total + (model[context * toxicity.SYMBOLS] if context % toxicity.SYMBOLS else 0)

    words_of = lambda path: " ".join("".join(out for out, _ in path).split())
    for _ in range(60):
        token = "".join(rng.choices("ilot1053!|$-. aé", k=rng.randint(1, 7)))
        paths = [(cost(p), words_of(p)) for p in itertools.product(*toxicity.lattice(token))]
        best = min(c for c, _ in paths)
        assert " ".join(toxicity.decode(token, model).split()) in {w for c, w in paths if c == best}, token


def test_symbols():
    """Counting and decoding class characters alike."""
    for c in "aZé日ßſ—“”。〜½²_1 \u3000\U0001F600\U00020000İ":
        assert toxicity.symbols(f"a{c}a").tolist() == [0, 1] + ([] if toxicity.symbol(c.lower()[0]) == 0 else [toxicity.symbol(c.lower()[0])]) + ([0] if toxicity.symbol(c.lower()[0]) == 0 else []) + [1, 0], c


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no tables")
def test_restore_under_the_corpus(spark):
    """The corpus's own model restores its words, however they are written."""
    model = toxicity.character_model(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    raw = {"1d10t": "idiot", "w0rthl355": "worthless", "worth1ess": "worthless", "1 d 1 0 t": "idiot", "idi" + "o" * 200 + "t": "idiot", "1d1" + "0" * 45 + "t": "idiot", "$cum": "scum", "p4th3t1c": "pathetic", "i.d.i.o.t": "idiot"}
    assert {t: toxicity.restore_token(t, model) for t in raw} == raw
    leet = {x: k for k, v in toxicity.LEET.items() if k.isdigit() for x in v}
    rng, good = random.Random(5), []
    for w in ["trash", "pathetic", "idiot", "disgusting", "worthless", "stupid", "clown", "loser", "scum", "moron"] * 20:
        hidden = "".join(leet[c] if c in leet and rng.random() < 0.5 else c for c in w)
        good.append(toxicity.restore_token(hidden, model) == w)
    assert sum(good) >= 0.9 * len(good)


def restored(*texts):
    """The words that each text is restored to, under a model of a few words."""
    rng = random.Random(1)
    restorer = toxicity.Restorer(model_of(["the idiot said hello world what an ass or scum worthless"] * 50 + ["".join(rng.choices("aeioutnsr ", k=60)) for _ in range(50)]))
    return [{w for words in restorer.of(restorer.tokens(t)) for w in words} for t in texts]


def test_restore_spaced():
    raw = {"1 d 1 0 t": "idiot", "so a s s it": "ass", "$ c u m": "scum", "s c u m, you": "scum", "w 0 r t h l 3 s s": "worthless", "an i d i o t!": "idiot",
           "i  d \n i\to  t": "idiot", "i d i o o o o t": "idiot", "s c u m  i d i o t": "idiot", "s-c u.m": "scum"}
    for (text, want), got in zip(raw.items(), restored(*raw), strict=True):
        assert want in got, (text, got)
    assert restored("1 2 3 4", "2024 12 31", "") == [set(), set(), set()]


def test_restore_long_and_marks():
    raw = {"idi" + "o" * 40 + "t": "idiot", "-".join("1d10t" for _ in range(30)): "idiot", "_".join("i.d.i.o.t" for _ in range(9)): "idiot", "@$$": "ass", "(@$$),": "ass", "@ $ $": "ass"}
    for (text, want), got in zip(raw.items(), restored(*raw), strict=True):
        assert want in got, (text, got)
    assert restored("455", "-----", "...") == [set(), set(), set()]


# --- nearest neighbours ---


def brute(vectors, every, k):
    ok = [(i, np.array(v, float)) for i, v in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v) and len(v) == 8]
    out = {}
    for q, x in ok:
        if q % every == 0 and q not in out:
            d = sorted((float(np.sqrt(((y - x) ** 2).sum())), i) for i, y in ok if i != q)
            out[q] = d[:k]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(6)
    v = [(i, rng.normal(size=8).tolist()) for i in range(600)]
    v += [(1000 + i, [1.0] * 8) for i in range(40)] + [(2000, None), (2001, []), (2002, [0.0] * 8), (2003, [float("nan")] + [1.0] * 7), (2004, [float("inf")] + [1.0] * 7), (2005, [None] + [1.0] * 7), (2006, [1.0]), (None, [1.0] * 8), (7, v[7][1]), (100, v[100][1])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>").withColumn("x", F.lit(1)).withColumn("code", F.lit(2))
    v32 = [(i, None if x is None else [None if y is None else float(np.float32(y)) for y in x]) for i, x in v]
    want = brute(v32, 100, 10)
    got = collections.defaultdict(list)
    for r in neighbours.nearest(df).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["score"], r["vec_id"]))
        assert r["rank"] == len(got[r["query_id"]])
    assert set(got) == set(want) and all(len(x) == 10 and x == sorted(x) for x in got.values())
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.95 * sum(len({i for _, i in x}) for x in want.values())
    assert [i for _, i in got[1000]] == list(range(1001, 1011)) and all(s == 0 for s, _ in got[1000])
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [3.0, 2.0])], "vec_id long, embedding array<float>")
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in neighbours.nearest(few).orderBy("rank").collect()] == [(0, 1, 1, 0.0), (0, 2, 2, 2.0)]
    assert neighbours.nearest(few.limit(0)).count() == 0 and neighbours.nearest(few.where("vec_id = 0")).count() == 0


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_cells(spark, monkeypatch, spread):
    """Many cells and blocks, of vectors that they part and of ones that they don't; RERANK far below the rows."""
    monkeypatch.setattr(neighbours, "CELL_ROWS", 150)
    monkeypatch.setattr(neighbours, "BLOCK", 100)
    monkeypatch.setattr(neighbours, "QUERIES", 3)
    monkeypatch.setattr(neighbours, "FEW", 4)
    monkeypatch.setattr(neighbours, "RERANK", 20)
    rng = np.random.default_rng(8)
    middle = rng.normal(size=(12, 8))
    x = np.float32(middle[rng.integers(0, 12, 2400)] + spread * rng.normal(size=(2400, 8)))
    x[:300] = x[0] + np.float32(1e-4) * np.float32(rng.normal(size=(300, 8)))  # one cell larger than a block
    v = [(i, r.tolist()) for i, r in enumerate(x)]
    got = collections.defaultdict(list)
    for r in neighbours.nearest(spark.createDataFrame(v, "vec_id long, embedding array<float>")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    want = brute(v, 100, 10)
    assert {q: [i for _, i in x] for q, x in got.items()} == {q: [i for _, i in x] for q, x in want.items()}


def test_quantiser():
    x = neighbours.extended(np.random.default_rng(2).normal(size=(500, 7)))
    q = neighbours.Quantiser(x)
    codes = q.encode(x)
    approx = neighbours.scan(q.tables(x[:5]), neighbours.pack(codes))
    assert np.allclose(approx, x[:5] @ q.decode(codes).T, atol=1e-3)
    r = x - q.decode(codes)
    assert (r**2).sum() < 0.5 * (x**2).sum()


def test_unequal_near_copies():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 16))
    x[:1500] = x[0] + 1e-3 * rng.normal(size=(1500, 16))  # more than are reranked at first, of equal codes
    ids = rng.permutation(3000)
    quantiser = neighbours.Quantiser(neighbours.extended(x))
    packed = neighbours.pack(quantiser.encode(neighbours.extended(x)))
    q = [*range(0, 1500, 100), *range(1500, 3000, 500)]
    got = collections.defaultdict(list)
    for a, b, _ in neighbours._block_search(quantiser, 10)(ids[q], x[q], ids, x, packed):
        got[a].append(b)
    for i in q:
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        assert got[ids[i]] == [ids[j] for j in np.lexsort((ids, d)) if j != i][:10]


# --- the pipeline ---


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    corpus, labels, _ = toxic_corpus(spark)
    text = {r["doc_id"]: r["text"] for r in corpus.collect()}
    extra = [(900, text[0], "s"), (901, text[2] + " end", "s"), (902, f"token = '{SECRET}' " + " ".join(text[5].split()[::-1]), "t"), (903, None, None), (904, "", "t"), (0, text[0], "s")]
    docs_ = corpus.unionByName(docs(spark, extra))
    docs_.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    sf, at, seen = str(tmp_path), spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, at, sf)
        out.write.parquet(str(tmp_path / name))
        at = seen[name] = spark.read.parquet(str(tmp_path / name))
        assert name == "packing" or at.columns == docs_.columns
    ids = {n: sorted(r["doc_id"] for r in df.collect()) for n, df in seen.items()}
    toxic = {r["doc_id"] for r in labels.collect() if r["toxic"]}
    assert not toxic & set(ids["toxicity"]) and len(ids["toxicity"]) == 700 - len(toxic) + len(extra)
    assert set(ids["toxicity"]) - set(ids["near_duplicates"]) == {900, 901} and len(set(ids["near_duplicates"])) == len(ids["near_duplicates"])
    assert ids["secrets"] == ids["near_duplicates"] and not any(SECRET in (r["text"] or "") for r in seen["secrets"].collect())
    size = lambda df: sum(len((r["text"] or "").split()) for r in df.collect())
    assert abs(size(seen["mixing"]) - 1.5 * size(seen["secrets"])) < 5
    whole = whole_ids([(r["doc_id"], r["text"], None) for r in seen["mixing"].collect()])
    assert seen["packing"].agg(F.sum("length")).first()[0] == sum(len(x) for _, x in whole)
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted(map(tuple, seen["packing"].select("doc_id", "piece", "length", "ids_crc32").collect()))


def test_pipeline_of_odd_rows(spark, odd, empty, tmp_path):
    import corpus_pipeline

    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(30)], "doc_id long, toxic int")
    rows = odd.unionByName(docs(spark, [(None, "no name here", "s1"), (3, None, None)], clash=True))
    for name, df, known in (("odd", rows, labels), ("none", empty, labels.limit(0))):
        sf = str(tmp_path / name)
        df.write.parquet(f"{sf}/documents.parquet")
        known.write.parquet(f"{sf}/labels.parquet")
        at = spark.read.parquet(f"{sf}/documents.parquet")
        for stage, f in corpus_pipeline.STAGES:
            out = f(spark, at, sf)
            assert stage == "packing" or out.columns == df.columns and [x.dataType for x in out.schema] == [x.dataType for x in df.schema]
            out.write.parquet(f"{sf}/{stage}")
            at = spark.read.schema(out.schema).parquet(f"{sf}/{stage}")
        assert (at.count() > 0) == (name == "odd")
    before = folders.made()
    assert corpus_pipeline.run(spark, str(tmp_path / "odd")).count() > 0
    # of the stages' tables, only the last one's input and the packing's own are left
    assert sum("stage-" in p for p in folders.made() - before) == 1 and not any("/secrets-" in p or "/mix-" in p for p in folders.made() - before)


@pytest.mark.parametrize(("name", "types"), [
    ("op1_best_fit_packing", "doc_id bigint piece int start bigint length bigint ids_crc32 bigint sequence_id bigint offset bigint"),
    ("op2_secret_owners", "doc_id bigint n_assign bigint n_access bigint n_hex bigint base_sha256 string spans string"),
    ("op3_toxicity", "doc_id bigint held_out boolean score double predicted int"),
    ("op4_trie_token_counts", "doc_id bigint n_pretokens bigint n_tokens bigint"),
    ("op5_anisotropic_neighbours", "query_id bigint rank int vec_id bigint score double"),
    ("op6_quality_cascade", "doc_id bigint n_words bigint word_chars bigint n_symbols bigint n_dup_lines bigint n_repeat_words bigint base_failed boolean kept boolean"),
    ("op7_suffix_dedup", "doc_id bigint n_bytes bigint n_removed bigint n_spans bigint kept_sha256 string"),
    ("op8_sorted_shards", "doc_id bigint start bigint n_tokens bigint ids_crc32 bigint"),
    ("op9_near_duplicates", "doc_id bigint n_shingles bigint component_id bigint kept boolean"),
    ("op10_mix_sources", "doc_id bigint size bigint source_size bigint target double taken bigint"),
])
def test_columns_of_queries(spark, name, types):
    from veerline.llm import queries

    sf = "/root/testdata/sf0.001"
    df = queries.QUERIES[name](spark, sf)
    want = types.split()
    assert [x for f in df.schema for x in (f.name, f.dataType.simpleString())][: len(want)] == want
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert df.count() >= n if name == "op1_best_fit_packing" else True if name.startswith("op5") else df.count() == n


@pytest.mark.parametrize("name", ["op2_secret_owners", "op6_quality_cascade", "op7_suffix_dedup", "op9_near_duplicates", "op10_mix_sources"])
def test_oracle(spark, name):
    import duckdb

    from veerline.llm import queries

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    df = queries.QUERIES[name](spark, sf)
    found = con.execute(queries.ORACLE[name])
    cols = [d[0] for d in found.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == sorted(found.fetchall())
