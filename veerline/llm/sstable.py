"""Sorted-string-table shards of token ids.

A shard is one file, its documents in ascending order of identifier:

    blocks   of about BLOCK bytes, each compressed by zstd. An entry: three varints (bytes of the key shared
             with the entry before, other bytes of the key, bytes of the value), the rest of the key, the value.
             A block's first entry shares nothing. Key: 0 for null, else 1 and the identifier as 8 big-endian
             bytes with the sign bit flipped, so that keys sort as numbers. Value: little-endian ids.
    index    for each block: first key (9 bytes, null padded), offset (8), length (4)
    bloom    bits of a Bloom filter of the keys, BLOOM_BITS a key
    footer   offsets of index and bloom, number of blocks, entries and tokens, bytes of an id, hashes, CRC, magic

A look-up asks the Bloom filter, then finds its block by binary search in the sparse index, then scans
that block. Shards are ranges of identifiers, so that a reader of all shards in order has a sorted table.

A task writes its shard under a name of its own and renames it when it is complete; a repeated task
writes the same bytes.

Defined results: null and empty texts have the end id only; a null identifier sorts first; rows of
equal identifier keep all their entries, ordered by text; identifiers that are no numbers count as null; an empty table gives no shard and no row;
columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import bisect
import hashlib
import os
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import make_folder, new_folder, partitions_for, staged, table
from .token_ids import encoder, few, vocabulary

BLOCK, BLOOM_BITS, BLOOM_HASHES = 1 << 16, 10, 7
FOOTER = struct.Struct("<QQIQQBBI8s")
MAGIC = b"VEERSST1"
END_ID = 2
#: Bytes of text and documents of a shard at most, as a task holds the keys of its shard; fewer bytes aren't worth a task.
SHARD_BYTES, SHARD_ROWS, LEAST_BYTES = 64 << 20, 2_000_000, 4 << 20


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", (doc_id ^ (1 << 63)) & (2**64 - 1))


def id_of(key: bytes) -> int | None:
    if key[0] == 0:
        return None
    n = struct.unpack(">Q", key[1:])[0] ^ (1 << 63)
    return n - (1 << 64) if n >> 63 else n


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(raw: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = raw[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _places(keys: list[bytes], bits: int) -> np.ndarray:
    """Bits of the Bloom filter that the keys set, by double hashing."""
    h = np.frombuffer(b"".join(hashlib.blake2b(k, digest_size=16).digest() for k in keys), "<u8").reshape(-1, 2)
    with np.errstate(over="ignore"):
        return (h[:, :1] + np.arange(BLOOM_HASHES, dtype=np.uint64) * (h[:, 1:] | np.uint64(1))) % np.uint64(bits)


def open_file(path: str, mode: str):
    """A file in the shared folder, which may be in any file system that pyarrow knows."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if path.startswith("/"):
        return open(path, mode)  # noqa: SIM115
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner) if "r" in mode else system.open_output_stream(inner)


def rename(old: str, new: str) -> None:
    if old.startswith(("file:", "/")):
        os.replace(*("/" + p.removeprefix("file:").lstrip("/") for p in (old, new)))
        return
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(old)
    system.move(inner, fs.FileSystem.from_uri(new)[1])


class Writer:
    """Writes entries, which come in ascending order of key, into one file."""

    def __init__(self, path: str, width: int):
        import zstandard

        self.path, self.width, self.part = path, width, f"{path}.{uuid.uuid4().hex}"
        self.out = open_file(self.part, "wb")
        self.zip = zstandard.ZstdCompressor(level=1)
        self.at = self.entries = self.tokens = self.filled = 0
        self.block: list[bytes] = []
        self.index: list[tuple[bytes, int, int]] = []
        self.hashes: list[np.ndarray] = []
        self.keys: list[bytes] = []
        self.first = self.last = b""

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        key, value = key_of(doc_id), ids.tobytes()
        shared = len(os.path.commonprefix([self.last, key])) if self.block else 0
        if not self.block:
            self.first = key
        entry = [_varint(shared), _varint(len(key) - shared), _varint(len(value)), key[shared:], value]
        self.block += entry
        self.filled += sum(map(len, entry))
        self.last = key
        self.keys.append(key)
        self.entries += 1
        self.tokens += len(ids)
        if self.filled >= BLOCK:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            raw = self.zip.compress(b"".join(self.block))
            self.out.write(raw)
            self.index.append((self.first, self.at, len(raw)))
            self.at += len(raw)
            self.block, self.filled = [], 0

    def close(self) -> None:
        self._flush()
        bits = max(64, -(-BLOOM_BITS * self.entries // 8) * 8)
        filled = np.zeros(bits, bool)
        for i in range(0, len(self.keys), 10_000):
            filled[_places(self.keys[i : i + 10_000], bits).ravel()] = True
        index = b"".join(k.ljust(9, b"\0") + struct.pack("<QI", a, n) for k, a, n in self.index)
        bloom = np.packbits(filled).tobytes()
        self.out.write(index)
        self.out.write(bloom)
        self.out.write(FOOTER.pack(self.at, self.at + len(index), len(self.index), self.entries, self.tokens, self.width, BLOOM_HASHES, zlib.crc32(index + bloom), MAGIC))
        self.out.close()
        rename(self.part, self.path)


class Reader:
    def __init__(self, path: str):
        import zstandard

        self.file = open_file(path, "rb")
        self.unzip = zstandard.ZstdDecompressor()
        self.file.seek(0, 2)
        end = self.file.tell()
        index_at, bloom_at, blocks, self.entries, self.tokens, self.width, _, crc, magic = FOOTER.unpack(self._read(end - FOOTER.size, FOOTER.size))
        raw = self._read(index_at, end - FOOTER.size - index_at)
        if magic != MAGIC or zlib.crc32(raw) != crc:
            raise ValueError(f"{path} is no complete shard")
        self.bloom = np.frombuffer(raw[bloom_at - index_at :], np.uint8)
        self.index = []
        for i in range(blocks):
            part = raw[21 * i : 21 * i + 21]
            self.index.append((part[:1] if part[0] == 0 else part[:9], *struct.unpack("<QI", part[9:])))
        self.firsts = [x[0] for x in self.index]
        self.kind = np.dtype(f"<u{self.width}")

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _block(self, i: int):
        raw, at, key = self.unzip.decompress(self._read(*self.index[i][1:])), 0, b""
        while at < len(raw):
            shared, at = _read_varint(raw, at)
            rest, at = _read_varint(raw, at)
            size, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + rest]
            at += rest
            yield key, np.frombuffer(raw, self.kind, size // self.width, at)
            at += size

    def __iter__(self):
        for i in range(len(self.index)):
            for key, ids in self._block(i):
                yield id_of(key), ids

    def may_hold(self, doc_id: int | None) -> bool:
        p = _places([key_of(doc_id)], len(self.bloom) * 8)[0].astype(np.int64)
        return bool(np.all(self.bloom[p // 8] >> (7 - p % 8) & 1))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of all entries of an identifier, none if there is no such entry."""
        key, found = key_of(doc_id), []
        if not self.may_hold(doc_id):
            return found
        # entries of one identifier may go on in the following blocks
        i = max(0, bisect.bisect_left(self.firsts, key) - 1)
        while i < len(self.index) and self.firsts[i] <= key:
            found += [ids for k, ids in self._block(i) if k == key]
            i += 1
        return found

    def close(self) -> None:
        self.file.close()


def write_shards(docs: DataFrame, folder: str, vocab: str, shards: int, end_id: int = END_ID) -> DataFrame:
    """Writes docs as shards into a folder; one row a shard: path, first (its number), docs, tokens."""

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        enc, writer = encoder(vocab), None
        path = f"{folder}/shard-{number:06d}.sst"
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            names = batch.column("doc_id").to_pylist()
            if writer is None and names:
                writer = Writer(path, enc.kind.itemsize)
            for part in few(texts):
                for doc_id, ids in zip(names[part], enc.ids_of(texts[part]), strict=True):
                    writer.add(doc_id, np.append(ids, np.array([end_id], enc.kind)))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"number": pa.array([number], pa.int64()), "path": [path], "docs": pa.array([writer.entries], pa.int64()), "tokens": pa.array([writer.tokens], pa.int64())})

    make_folder(docs.sparkSession, folder)
    rows = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), "text").repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    return staged(rows.mapInArrow(run, "number long, path string, docs long, tokens long"), "shards")


def shards_for(docs: DataFrame) -> int:
    """Shards of docs: as many as there are tasks, if each gets LEAST_BYTES of text, and more where SHARD_BYTES or SHARD_ROWS ask for it."""
    n, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    return max(1, -(-n // SHARD_ROWS), -(-size // SHARD_BYTES), min(partitions_for(docs.sparkSession), -(-size // LEAST_BYTES)))


def read_shards(spark: SparkSession, shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in the shards; start counts over all shards."""
    at, rows = 0, []
    for x in sorted(shards.collect(), key=lambda x: x["number"]):  # a row a shard
        rows.append((x["path"], at))
        at += x["tokens"]

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                reader, out = Reader(path), []
                for doc_id, ids in reader:
                    out.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(out) == 10_000:
                        yield _rows(out)
                        out = []
                reader.close()
                if out:
                    yield _rows(out)

    def _rows(out):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    df = spark.createDataFrame(rows, "path string, start long")
    return df.repartition(max(1, len(rows))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_sorted_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return read_shards(spark, write_shards(docs, new_folder(spark, "sst"), vocabulary(), shards_for(docs)))
