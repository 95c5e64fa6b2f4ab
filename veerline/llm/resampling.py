"""Importance resampling towards a target distribution, over hashed n-grams in a sparse matrix.

Documents become rows of a sparse matrix, documents by buckets, that is written once in compressed-sparse-row blocks: a row
of the table is a block of documents with its row pointers, bucket numbers (as steps from one to the next) and counts. Sums
of its columns give the corpus's distribution; the target's comes the same way. The gain of a bucket is the
logarithm of their ratio, and a product of the matrix with the gains gives the weight of each document. To draw without
replacement, Gumbel noise, which a hash of the doc_id gives, is added to the weights and the highest scores are taken.

Buckets are crc32 of the n-gram's bytes. The checksum of a concatenation follows from those of its parts, as appending n bytes is
a linear map of the 32 bits before, so a word is read once and longer n-grams are joined from words, in whole arrays.

Only the sums of columns, BUCKETS numbers, come to the driver. Ranks are places in an order by ranges: no task holds all scores.

Defined results: a null text has no words, and a document without words has no features and a weight of 0; equal rows are documents of
their own and differ in nothing but their ranks; ties of scores go to the smaller doc_id, null last; doc_ids that are no numbers count as null, which is hashed
as an empty string; an empty corpus gives an empty table, and an empty target has a count of 0 in each bucket; columns other than
doc_id and text aren't read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordinals import numbered_by_ranges
from .shared import drop_staged, staged, table
from .token_ids import few

BUCKETS, LONGEST_RUN, SEED = 10_000, 3, 42
#: Words that a document needs to be drawn, and the share of such documents that is.
LEAST_WORDS, PERCENT = 20, 5
#: Lengths whose linear maps are tables of their own; longer ones are put together from powers of two.
_NEAR = 64
#: Words whose n-grams are held at once.
_AT_ONCE = 200_000

# --- checksums of n-grams ---


def _step(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[x & np.uint32(255)] ^ (x >> np.uint32(8))


def _table() -> np.ndarray:
    """Checksums of single bytes, by the reversed polynomial of crc32."""
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & np.uint32(1), (x >> np.uint32(1)) ^ np.uint32(0xEDB88320), x >> np.uint32(1))
    return x


_BYTE = _table()
#: _SHIFT[n, k, b]: what byte k of a checksum, of value b, turns into when n zero bytes follow.
_SHIFT = np.zeros((_NEAR + 1, 4, 256), np.uint32)
_SHIFT[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
for _n in range(_NEAR):
    _SHIFT[_n + 1] = _step(_SHIFT[_n], _BYTE)
_FLAT = _SHIFT.ravel()


def _apply(maps: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = maps[0][x & np.uint32(255)]
    for k in range(1, 4):
        out = out ^ maps[k][(x >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def _powers() -> list[np.ndarray]:
    """Linear maps of 1, 2, 4, 8 and so on zero bytes."""
    out = [_SHIFT[1]]
    for _ in range(31):
        out.append(_apply(out[-1], out[-1]))
    return out


_POWERS = _powers()


def shifted(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Checksums x with n zero bytes after each: crc(a + b) = shifted(crc(a), len(b)) ^ crc(b)."""
    at = np.minimum(n, _NEAR) * 1024
    out = _FLAT[at + (x & np.uint32(255))]
    for k in range(1, 4):
        out ^= _FLAT[at + 256 * k + ((x >> np.uint32(8 * k)) & np.uint32(255))]
    far = np.flatnonzero(n > _NEAR)
    if len(far):
        y, left = x[far], n[far]
        for bit in range(int(left.max()).bit_length()):
            has = (left >> bit) & 1 == 1
            y[has] = _apply(_POWERS[bit], y[has])
        out[far] = y
    return out


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of words: digits, letters, and all bytes of characters beyond ASCII.
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True
_BLANK = zlib.crc32(b" ")


def _word_sums(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Checksum of each word: one byte of all words at a time."""
    x = np.full(len(start), 0xFFFFFFFF, np.uint32)
    left = np.flatnonzero(size <= _NEAR)
    for k in range(_NEAR):
        left = left[size[left] > k]
        if not len(left):
            break
        y = x[left]
        x[left] = _BYTE[(y ^ raw[start[left] + k]) & np.uint32(255)] ^ (y >> np.uint32(8))
    x ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > _NEAR):
        x[i] = zlib.crc32(raw[start[i] : start[i] + size[i]])
    return x


def counted(texts: list[str], buckets: int = BUCKETS, longest: int = LONGEST_RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, row pointers, buckets in ascending order within a row, counts) of the texts."""
    raws = [t.encode("utf-8", "surrogatepass") for t in texts]
    raw = _LOWER[np.frombuffer(b" ".join([b"", *raws, b""]), np.uint8)]
    inside = _IN_WORD[raw]
    start = np.flatnonzero(~inside[:-1] & inside[1:]) + 1
    size = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1 - start
    # words of each text are first[i] to first[i + 1]
    first = np.concatenate([[0], np.searchsorted(start, np.cumsum([len(r) + 1 for r in raws]))]) if texts else np.zeros(1, np.int64)
    totals = np.zeros(buckets, np.int64)
    at, found, counts = [0], [], []
    base = last = 0
    sums = after = None
    for i in range(len(texts)):
        for a in range(first[i], first[i + 1], _AT_ONCE):
            b = min(a + _AT_ONCE, first[i + 1])
            more = min(b + longest - 1, first[i + 1])
            if more > last:  # the next words, of this text and those that follow
                base, last = a, max(more, min(a + _AT_ONCE, len(start)))
                sums = _word_sums(raw, start[base:last], size[base:last])
                after = shifted(np.full(last - base, _BLANK, np.uint32), size[base:last]) ^ sums
            run, hit = sums[a - base : b - base], []
            for n in range(longest):
                m = min(b, first[i + 1] - n) - a  # runs of n + 1 words that start here
                if m <= 0:
                    break
                if n:
                    nxt = slice(a - base + n, a - base + n + m)
                    run = shifted(run[:m], size[a + n : a + n + m] + 1) ^ after[nxt]
                hit.append(run % np.uint32(buckets))
            totals += np.bincount(np.concatenate(hit), minlength=buckets)
        if first[i + 1] > first[i]:
            has = np.flatnonzero(totals)
            found.append(has)
            counts.append(totals[has])
            totals[has] = 0
            at.append(at[-1] + len(has))
        else:
            at.append(at[-1])
    none = np.zeros(0, np.int64)
    return np.diff(first), np.array(at, np.int64), np.concatenate([none, *found]), np.concatenate([none, *counts])


# --- the matrix ---

_BLOCK = "doc_ids array<long>, n_words array<long>, pointers binary, steps binary, counts binary"


def _packed(x: np.ndarray) -> bytes:
    """Numbers below 2 ** 32 as four planes of bytes, by zstd: higher bytes are nearly all zero, and compress to nothing."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T))


def _unpacked(b: bytes) -> np.ndarray:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(b)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def block_of(at: np.ndarray, found: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """The three arrays of a block; counts beyond 2 ** 32 don't fit into it, and no text is that long."""
    steps = np.diff(found, prepend=0)
    firsts = at[:-1][at[:-1] < at[1:]]
    steps[firsts] = found[firsts]
    return at.astype("<i8").tobytes(), _packed(steps), _packed(counts)


def rows_of(pointers: bytes, steps: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row pointers, buckets, counts) of a block."""
    at, step = np.frombuffer(pointers, "<i8"), _unpacked(steps)
    upto = np.cumsum(step)
    firsts = at[:-1][at[:-1] < at[1:]]
    before = upto[firsts] - step[firsts]
    found = upto - np.repeat(before, np.diff(np.append(firsts, len(step))))
    return at, found, _unpacked(counts)


def matrix(docs: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST_RUN) -> DataFrame:
    """The written matrix of docs (doc_id, text), a row a block."""

    def run(batches):
        for batch in batches:
            texts, names = [t or "" for t in batch.column("text").to_pylist()], batch.column("doc_id")
            for part in few(texts):
                n, at, found, counts = counted(texts[part], buckets, longest)
                ids = names.slice(part.start, part.stop - part.start).to_pylist()
                row = dict(zip(("pointers", "steps", "counts"), block_of(at, found, counts), strict=True))
                yield pa.RecordBatch.from_pylist([{"doc_ids": ids, "n_words": n.tolist(), **row}], pa.schema(
                    [("doc_ids", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())), ("pointers", pa.binary()), ("steps", pa.binary()), ("counts", pa.binary())]))

    blocks = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), "text").mapInArrow(run, _BLOCK)
    return staged(blocks, "matrix")


def column_sums(blocks: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Features in each bucket; the only thing that comes to the driver."""

    def run(batches):
        totals = np.zeros(buckets, np.int64)
        for batch in batches:
            for row in batch.select(["pointers", "steps", "counts"]).to_pylist():
                _, found, counts = rows_of(**row)
                np.add.at(totals, found, counts)
        has = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(totals[has])], ["bucket", "n"])

    sums = blocks.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = [0] * buckets
    for row in sums.collect():  # at most as many rows as buckets
        out[row["bucket"]] = row["n"]
    return out


def gains(source: list[int], target: list[int]) -> list[int]:
    """floor(1000 ln of the smoothed ratio of the shares) of each bucket."""
    n, s, t = len(source), float(sum(source)), float(sum(target))
    return [math.floor(1000 * math.log((b + 1.0) * (s + n) / ((a + 1.0) * (t + n)))) for a, b in zip(source, target, strict=True)]


def weights(blocks: DataFrame, gain: list[int]) -> DataFrame:
    """doc_id, n_words, n_features, weight: the product of the matrix with the gains."""
    gain = np.array(gain, np.int64)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                at, found, counts = rows_of(row["pointers"], row["steps"], row["counts"])
                n, w = (np.concatenate([[0], np.cumsum(x)]) for x in (counts, counts * gain[found]))
                cols = [row["doc_ids"], row["n_words"], n[at[1:]] - n[at[:-1]], w[at[1:]] - w[at[:-1]]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "n_words", "n_features", "weight"])

    return blocks.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


# --- the draw ---


def scored(weighted: DataFrame, seed: int = SEED) -> DataFrame:
    """weighted with score: the weight and 1000 times a Gumbel variate of the doc_id, rounded down."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return weighted.withColumn("score", F.col("weight") + noise)


def ranked(rows: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """rows (of scored()) with rank: 1, 2, 3 and so on by score among the drawn, null for all others."""
    rows = staged(rows, "scores")
    enough = F.col("n_words") >= least_words
    take = percent * rows.where(enough).count() // 100
    order = rows.where(enough).withColumn("_last", F.col("doc_id").isNull()).withColumn("_down", -F.col("score"))
    placed = numbered_by_ranges(order, (), ("_down", "_last", "doc_id", "weight", "n_features", "n_words"))
    rank = F.when(F.col("event_index") < take, F.col("event_index") + 1)
    return placed.withColumn("rank", rank).drop("event_index", "_last", "_down").unionByName(rows.where(~enough).withColumn("rank", F.lit(None).cast("long")))


def resampling(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST_RUN, percent: int = PERCENT,
               least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of each of docs; target has a column text."""
    blocks, aim = matrix(docs, buckets, longest), matrix(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), buckets, longest)
    gain = gains(column_sums(blocks, buckets), column_sums(aim, buckets))
    drop_staged(aim)
    return ranked(scored(weights(blocks, gain), seed), percent, least_words)


def resampled(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The drawn documents themselves, all columns; rows of one doc_id are drawn together if one of them is."""
    chosen = resampling(docs, target, **how).where("rank IS NOT NULL AND doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.where(F.col("doc_id").try_cast("long").isNotNull()).join(chosen.withColumnRenamed("doc_id", "_drawn"), F.col("doc_id").try_cast("long") == F.col("_drawn"), "left_semi")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampling(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").select("text"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


#: crc32 goes over half bytes, low ones first; x ** 4 steps of the polynomial are the 16 values.
SQL = r"""
WITH w AS (SELECT 0 AS side, row_number() OVER () AS k, doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
  UNION ALL SELECT 1, row_number() OVER (), item_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') FROM benchmark),
p AS (SELECT side, k, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT side, k, unnest(CASE WHEN i + 2 <= len(w) THEN [w[i], w[i] || ' ' || w[i + 1], w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]] WHEN i + 1 <= len(w) THEN [w[i], w[i] || ' ' || w[i + 1]] ELSE [w[i]] END) AS f FROM p),
n AS (SELECT side, k, f, count(*) AS c FROM g GROUP BY ALL),
u AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM n)),
b AS (SELECT f, xor(list_reduce(list_transform(range(0, len(x)), lambda i: CAST(strpos('123456789ABCDEF', x[CASE WHEN i % 2 = 0 THEN i + 2 ELSE i END]) AS BIGINT)),
    lambda c, h: xor(c >> 4, [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108][(xor(c, h) & 15) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS b FROM u),
m AS (SELECT side, k, b, sum(c) AS c FROM n JOIN b USING (f) GROUP BY ALL),
s AS (SELECT b, coalesce(sum(c) FILTER (side = 0), 0)::DOUBLE AS s, coalesce(sum(c) FILTER (side = 1), 0)::DOUBLE AS t FROM m GROUP BY b),
e AS (SELECT b, CAST(floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000)))) AS BIGINT) AS gain FROM s),
d AS (SELECT k, CAST(sum(c) AS BIGINT) AS n_features, CAST(sum(c * gain) AS BIGINT) AS weight FROM m JOIN e USING (b) WHERE side = 0 GROUP BY k),
x AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT)::DOUBLE AS h FROM w LEFT JOIN d USING (k) WHERE side = 0),
y AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, weight, n_features, n_words) AS r, count(*) FILTER (n_words >= 20) OVER () * 5 // 100 AS many FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND r <= many THEN r END AS rank FROM z
"""
