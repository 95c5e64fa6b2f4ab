"""Best-fit packing of token sequences by hierarchical residual packing.

Texts become pieces of at most CAPACITY tokens; only longer documents are cut, so that all pieces
but the first are full. Full pieces are sequences already. The others are packed in rounds: each
task packs what it holds by best fit, longest first; bins with SLACK or fewer free tokens are
emitted; the underfull ones go on as items of a round with fewer tasks, FAN_IN to one, until one
task has seen all that is left. Where that is too much for one task, other bins meet in each round,
until the tasks can't be fewer and a round no longer lessens the bins. No task packs more than
CHUNK items at once, whatever the size of the input.

An item carries its members (a bin has CAPACITY of them at most), so no joins are needed.
Items are sorted by (length, key) with unique keys: a task that is run again packs alike.

Defined results: null and empty texts have the end id only; equal rows are documents of their
own; an empty table gives an empty table; columns other than doc_id and text aren't read; doc_ids that are no
numbers count as null.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import drop_staged, staged, table
from .token_ids import encoder, few, vocabulary

CAPACITY, END_ID = 1024, 2
#: Free tokens of a nearly full bin; tasks that go into one of the next round; items packed at once.
SLACK, FAN_IN, CHUNK = 2, 8, 200_000
#: A further round of as many tasks goes on only if the last one lessened the bins by so much.
GAIN = 0.01
_MEMBER = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_PLACED = pa.struct([*_MEMBER, ("offset", pa.int64())])
_BIN = "key long, fill int, members array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long,offset:long>>"


def cut(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: full ones, but for the first."""
    first = length % capacity
    out = [(0, first)] if first else []
    return out + [(at, capacity) for at in range(first, length, capacity)]


def pieces(docs: DataFrame, vocab: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece."""

    def run(batches):
        enc = encoder(vocab)
        for batch in batches:
            texts, names, out = [t or "" for t in batch.column("text").to_pylist()], batch.column("doc_id").to_pylist(), []
            for part in few(texts):
                for doc_id, ids in zip(names[part], enc.ids_of(texts[part]), strict=True):
                    ids = np.append(ids.astype("<u4"), np.array([end_id], "<u4"))
                    for k, (at, n) in enumerate(cut(len(ids), capacity)):
                        out.append((doc_id, k, at, n, zlib.crc32(ids[at : at + n].tobytes())))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _MEMBER, strict=True)], [f.name for f in _MEMBER])

    rows = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins, as lists of places in lengths, which come longest first. The fullest bin that has room is taken."""
    bins: list[list[int]] = []
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: there is a bin with r free
    for i, n in enumerate(lengths):
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = with_room[room].pop()
            if not with_room[room]:
                rooms &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        left = room - n
        if left:
            with_room[left].append(b)
            rooms |= 1 << left
    return bins


def _pack(capacity: int):
    kind = pa.list_(_PLACED)

    def packed(items):
        items.sort(key=lambda x: (-x[1], x[0]))
        for b in best_fit([x[1] for x in items], capacity):
            members, at = [m for i in b for m in items[i][2]], 0
            for m in members:
                m["offset"] = at
                at += m["length"]
            yield items[b[0]][0], at, members

    def rows(found):
        keys, fills, members = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(fills, pa.int32()), pa.array(members, kind)], ["key", "fill", "members"])

    def run(batches):
        items = []
        for batch in batches:
            items += zip(batch.column("key").to_pylist(), batch.column("fill").to_pylist(), batch.column("members").to_pylist(), strict=True)
            while len(items) >= CHUNK:
                # all of a chunk: which rows meet in it depends on the order of arrival, the bins are right in any
                yield rows(list(packed(items[:CHUNK])))
                items = items[CHUNK:]
        if items:
            found = list(packed(items))
            for i in range(0, len(found), 10_000):
                yield rows(found[i : i + 10_000])

    return run


def pack(parts: DataFrame, capacity: int = CAPACITY, slack: int = SLACK) -> DataFrame:
    """parts (doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    names = [f.name for f in _MEMBER]
    parts = staged(parts.select(*names, F.monotonically_increasing_id().alias("key")), "pieces")
    full = parts.where(F.col("length") >= capacity).select(*names, F.col("key").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    bins = parts.where(F.col("length") < capacity).select("key", F.col("length").cast("int").alias("fill"), F.array(F.struct(*names, F.lit(0).cast("long").alias("offset"))).alias("members"))
    done, before, last = [], None, None
    tasks, salt = max(1, bins.rdd.getNumPartitions()), 0
    while True:
        bins = staged(bins.mapInArrow(_pack(capacity), _BIN), "bins")
        if last is not None:
            drop_staged(last)
        left = bins.where(F.col("fill") < capacity - slack)
        n = left.count()
        fewer = max(-(-tasks // FAN_IN), -(-2 * n // CHUNK))
        # after the first round, tasks never grow: each further round has fewer of them, gains, or is the last
        if n == 0 or tasks == fewer == 1 or (before is not None and n > before * (1 - GAIN) and fewer >= tasks):
            done.append(bins)
            break
        done.append(staged(bins.where(F.col("fill") >= capacity - slack), "packed"))
        before, tasks, last, salt = n, fewer, bins, salt + 1
        # dealt by key and round: others meet in each round, and the same rows when a task is run again
        bins = left.repartition(tasks, F.xxhash64("key", F.lit(salt))) if tasks > 1 else left.coalesce(1)
    out = full
    for b in done:
        m = b.select(F.col("key").alias("sequence_id"), F.explode("members").alias("m")).select(*(F.col(f"m.{c}").alias(c) for c in names), "sequence_id", F.col("m.offset").alias("offset"))
        out = out.unionByName(m)
    return out


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents"), vocabulary()))
