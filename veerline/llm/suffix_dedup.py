"""Removal of passages that repeat across documents: exact matches of LENGTH bytes, by hash-compared suffix sorting.

A byte goes if a string of LENGTH bytes that covers it also starts in a document of smaller doc_id. For each string the
smallest doc_id that holds it decides. Strings are far too many to be shuffled, so they are gathered by anchors: of the
GRAM-byte pieces of a string, the one of least hash (the leftmost, if equal) is its anchor. Equal strings have equal
anchors; successive strings mostly share one. The strings of one anchor in one document form a segment, which spans
less than 2 LENGTH bytes: its context.

1. shards (groups of documents): distinct anchors, with the smallest doc_id of the shard.
2. by anchor: anchors of one document only are done with. The others are asked for.
3. shards: the bytes of the contexts of the anchors that were asked for, each distinct context once.
4. by anchor: the strings of all contexts are sorted as suffixes. Entries of equal context hashes are compared byte by byte,
   and one of each distinct context is sorted. Prefix polynomial hashes and binary search over the
   common length give a suffix comparison in log(LENGTH) steps, which a mergesort uses; neighbours of equal strings
   are compared byte by byte, so that no collision of hashes joins different strings. Each group of equal strings
   has its smallest doc_id.
5. shards: the answers cover bytes of their documents; the rest is kept. An answer finds its segments of the shard by two
   independent hashes of the context, 128 bits.

So every removed byte is covered by a string that went through the sort and was compared as bytes with that of another
shard; hashes alone stand for bytes only between copies within one shard, where 128 bits must agree.

What is shuffled for an anchor is one entry a shard and context, however many documents of the shard hold it, so that
passages which a third of all documents share don't meet in one task. Shards and buckets of anchors grow in number
with the bytes, so that a group's size doesn't.

Defined results: null texts are empty; texts below LENGTH bytes keep all; rows of equal doc_id are one document (they
don't remove bytes from each other); a null doc_id, or one that is no number, counts as 2**63 - 1, the largest; an empty table gives an empty
table; columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .hashing import INVERSE, mix, powers, prefixes, substrings
from .shared import table

LENGTH, GRAM = 50, 22
#: Strings that are sorted at once, at most one anchor's more; their arrays fit into a core's cache.
SORT_AT_ONCE = 30_000
#: Bytes of texts that are held as arrays at once, at most one text's more; these, too, fit into a cache.
BYTES_AT_ONCE = 150_000
#: Bytes of a shard's texts at least and at most, and shards up to which they don't grow. Beyond, they grow with the root of all bytes, so
#: that rows (one a shard and bucket) grow as the bytes do.
SHARD_LEAST, SHARD_MOST, FEW_SHARDS = 8_000_000, 256_000_000, 125
_LAST = 2**63 - 1
#: Fixed value: the odd base of the second hash.
SECOND = 0xC2B2AE3D27D4EB4F
_SECOND_BACK = pow(SECOND, -1, 1 << 64)
_U64, _I64 = np.dtype("<u8"), np.dtype("<i8")


# --- segments -------------------------------------------------------------------------------------------------------


def context_hash(p: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Hash of the bytes of contexts, and of the distance of their first string to the anchor."""
    return mix(substrings(p, start, end) + before.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (end - start).astype(np.uint64))


def second_hash(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Another hash of the bytes, by a polynomial of its own."""
    q = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(mix(raw.astype(np.uint64) + np.uint64(1)) * powers(SECOND, len(raw)), out=q[1:])
    return mix((q[end] - q[start]) * powers(_SECOND_BACK, len(q))[start] + (end - start).astype(np.uint64))


def segments(raws: list[bytes], length: int = LENGTH, gram: int = GRAM):
    """Segments of texts: text number, anchor hash, context hash, first string's start (in the concatenated texts), its
    distance to the anchor, number of strings; and the concatenated texts."""
    raw = np.frombuffer(b"".join(raws), np.uint8)
    sizes = np.array([len(r) for r in raws], np.int64)
    if len(raw) < length:
        none = np.zeros(0, np.int64)
        return none, none.view(np.uint64), none.view(np.uint64), none, none, none, raw
    p = prefixes(raw)
    g = mix((p[gram:] - p[:-gram]) * powers(INVERSE, len(p))[: len(raw) - gram + 1])
    # the smallest of the hashes' upper halves over the pieces of each string; the place below makes it the leftmost
    least = (g >> np.uint64(32) << np.uint64(32)) | np.arange(len(g), dtype=np.uint64)
    width, have = length - gram + 1, 1
    while have * 2 <= width:
        least, have = np.minimum(least[:-have], least[have:]), have * 2
    if have < width:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    # a segment ends where the anchor changes (least holds its place), at the end of a text, and where a text has no string left
    ends = np.cumsum(sizes)
    new = np.ones(len(least), bool)
    np.not_equal(least[1:], least[:-1], out=new[1:])
    for border in (ends - sizes, np.maximum(ends - length + 1, ends - sizes)):
        new[border[border < len(new)]] = True
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(new)) - 1
    text = np.searchsorted(ends, first, "right")
    whole = first + length <= ends[text]
    first, last, text = first[whole], last[whole], text[whole]
    at = (least[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    context = context_hash(p, first, last + length, at - first)
    return text, g[at], context, first, at - first, last - first + 1, raw


# --- hash-compared suffix sort --------------------------------------------------------------------------------------


class SuffixOrder:
    """Compares suffixes of bytes by their first length bytes."""

    def __init__(self, raw: np.ndarray, length: int = LENGTH):
        self.raw, self.length, self.p = raw, length, prefixes(raw)
        start = np.arange(max(0, len(raw) - length + 1))
        self.back, self.whole = powers(INVERSE, len(self.p)), substrings(self.p, start, start + length)

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common prefix, length at most, by binary search over prefix hashes."""
        same = np.full(len(x), self.length, np.int64)
        odd = np.flatnonzero(self.whole[x] != self.whole[y])
        x, y = x[odd], y[odd]
        # as substrings() has them, with what stays the same while the length is searched fetched once
        px, py, bx, by = self.p[x], self.p[y], self.back[x], self.back[y]
        low, high = np.zeros(len(odd), np.int64), np.full(len(odd), self.length, np.int64)
        while len(odd) and (high - low).max() > 1:
            mid = (low + high) >> 1
            equal = (self.p[x + mid] - px) * bx == (self.p[y + mid] - py) * by
            low, high = np.where(equal, mid, low), np.where(equal, high, mid)
        same[odd] = low
        return same

    def less(self, x: np.ndarray, y: np.ndarray, or_equal: bool) -> np.ndarray:
        n = self.common(x, y)
        k = np.minimum(n, self.length - 1)
        return np.where(n == self.length, or_equal, self.raw[x + k] < self.raw[y + k])

    def sort(self, start: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Order of the suffixes within each group; group is ascending. A mergesort of all groups side by side:
        runs of width 1, 2, 4 and so on are merged by each element's rank in the other run."""
        order = np.arange(len(start))
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else order
        size = np.diff(np.append(first, len(start)))
        base, size = np.repeat(first, size), np.repeat(size, size)
        width = 1
        while len(size) and size.max() > width:
            at = np.flatnonzero(size > width)
            place = at - base[at]
            run = place // (2 * width) * (2 * width)
            right = place - run >= width
            # the other run: its first place and its length
            other = base[at] + run + np.where(right, 0, width)
            n = np.where(right, width, np.clip(size[at] - run - width, 0, width))
            low, high = np.zeros(len(at), np.int64), n.copy()
            own = start[order[at]]
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                mid = (low[open_] + high[open_]) >> 1
                theirs = start[order[other[open_] + mid]]
                # elements of the left run go before equal ones of the right run
                before = np.empty(len(open_), bool)
                for side in (True, False):
                    m = right[open_] == side
                    before[m] = self.less(theirs[m], own[open_][m], side)
                low[open_] = np.where(before, mid + 1, low[open_])
                high[open_] = np.where(before, high[open_], mid)
            after = np.where(right, place - run - width, place - run) + low
            merged = order.copy()
            merged[base[at] + run + after] = order[at]
            order = merged
            width *= 2
        return order

    def classes(self, start: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order, and whether each of the ordered suffixes begins a class of equal strings of its group."""
        order = self.sort(start, group)
        s, g = start[order], group[order]
        new = np.ones(len(s), bool)
        if len(s) > 1:
            same = (g[1:] == g[:-1]) & (self.whole[s[1:]] == self.whole[s[:-1]])
            at = np.flatnonzero(same)
            for k in range(self.length):  # verification
                same[at] &= self.raw[s[1:][at] + k] == self.raw[s[:-1][at] + k]
            new[1:] = ~same
        return order, new


# --- the five steps -------------------------------------------------------------------------------------------------


def _packed(x: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def _unpacked(raw: bytes, kind) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)


def _columns(t: pa.Table, *names: str) -> list[list]:
    return [t.column(n).to_pylist() for n in names]


def _documents(t: pa.Table):
    """doc_ids and texts (bytes) of a shard, in parts of bounded size."""
    ids = [_LAST if i is None else i for i in t.column("doc_id").to_pylist()]
    sizes = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(t.column("text")), 0).to_numpy())
    at = 0
    while at < len(ids):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BYTES_AT_ONCE, side="right")))
        yield np.array(ids[at:end], np.int64), [(x or "").encode() for x in t.column("text").slice(at, end - at).to_pylist()]
        at = end


def _by_bucket(bucket: np.ndarray, *orders: np.ndarray):
    """Order by bucket, then the others, and slices of equal bucket."""
    order = np.lexsort((*orders[::-1], bucket))
    b = bucket[order]
    cut = np.flatnonzero(np.append(True, b[1:] != b[:-1])) if len(b) else []
    return order, [(int(b[i]), slice(i, j)) for i, j in zip(cut, [*cut[1:], len(b)], strict=True)] if len(b) else []


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from those before."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


_STEP1 = "bucket int, shard int, keys binary, docs binary, many binary"


def _step1(buckets: int):
    def run(key, t):
        found = [], [], []
        for ids, raws in _documents(t):
            text, anchor, *_ = segments(raws)
            found[0].append((anchor % np.uint64(buckets)).astype(np.int64))
            found[1].append((anchor >> np.uint64(32)).astype("<u4"))
            found[2].append(ids[text])
        bucket, keys, docs = map(np.concatenate, found)
        order = np.lexsort((keys, bucket))
        bucket, keys, docs = bucket[order], keys[order], docs[order]
        s = _starts(bucket, keys)
        if not len(s):
            return _none(_STEP1)
        low, high = np.minimum.reduceat(docs, s), np.maximum.reduceat(docs, s)
        bucket, keys = bucket[s], keys[s]
        _, parts = _by_bucket(bucket)
        shard = key[0].as_py()
        # differences of sorted keys take fewer bytes
        return _table(_STEP1, [(b, shard, _packed(np.diff(keys[p], prepend=keys.dtype.type(0))), _packed(low[p]), _packed(low[p] != high[p])) for b, p in parts])

    return run


def _kinds(schema: str):
    known = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    return [(n, known[k]) for n, k in (x.split() for x in schema.split(", "))]


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _kinds(schema)]
    return pa.table({n: pa.array(c, k) for (n, k), c in zip(_kinds(schema), columns, strict=True)})


def _none(schema: str) -> pa.Table:
    return _table(schema, [])


_STEP2 = "shard int, bucket int, asked binary"


def _step2(key, t):
    shards, raws, docs, many = _columns(t, "shard", "keys", "docs", "many")
    keys = [np.cumsum(_unpacked(r, "<u4"), dtype="<u4") for r in raws]
    shard = np.repeat(np.array(shards, np.int32), [len(k) for k in keys])
    keys = np.concatenate(keys)
    docs = np.concatenate([_unpacked(d, _I64) for d in docs])
    many = np.concatenate([_unpacked(m, bool) for m in many])
    order = np.argsort(keys, kind="stable")
    keys, docs, many, shard = keys[order], docs[order], many[order], shard[order]
    s = _starts(keys)
    shared = (np.minimum.reduceat(docs, s) != np.maximum.reduceat(docs, s)) | np.logical_or.reduceat(many, s)
    pick = np.flatnonzero(np.repeat(shared, np.diff(np.append(s, len(keys)))))
    order, parts = _by_bucket(shard[pick])
    pick = pick[order]
    return _table(_STEP2, [(b, key[0].as_py(), _packed(np.sort(keys[pick[p]]))) for b, p in parts])


_STEP3 = "bucket int, shard int, anchors binary, contexts binary, seconds binary, docs binary, many binary, before binary, n binary, bytes binary"


def _step3(buckets: int):
    def run(key, docs, answers):
        asked = []
        for b, raw in zip(*_columns(answers, "bucket", "asked"), strict=True):
            # the bucket above the anchor's upper half: one sorted list for all buckets
            asked.append(np.uint64(b) << np.uint64(32) | _unpacked(raw, "<u4").astype(np.uint64))
        asked = np.sort(np.concatenate(asked)) if asked else np.zeros(0, np.uint64)
        if not len(asked) or not docs.num_rows:
            return _none(_STEP3)
        found = []
        for ids, raws in _documents(docs):
            text, anchor, context, first, before, n, raw = segments(raws)
            name = (anchor % np.uint64(buckets)) << np.uint64(32) | anchor >> np.uint64(32)
            at = np.searchsorted(asked, name)
            hit = np.flatnonzero(asked[np.minimum(at, len(asked) - 1)] == name)
            # of equal contexts in this part of the shard, one goes on
            size = n[hit] + LENGTH - 1
            second = second_hash(raw, first[hit], first[hit] + size)
            order = np.lexsort((second, context[hit]))
            hit, second, size = hit[order], second[order], size[order]
            d = ids[text[hit]]
            s = _starts(context[hit], second)
            if len(s):
                low, high, hit, size = np.minimum.reduceat(d, s), np.maximum.reduceat(d, s), hit[s], size[s]
                found.append((anchor[hit], context[hit], second[s], low, low != high, before[hit], n[hit], size, raw[_spans(first[hit], size)]))
        if not found:
            return _none(_STEP3)
        anchor, context, second, low, many, before, n, size = (np.concatenate([f[k] for f in found]) for k in range(8))
        raw = np.concatenate([f[8] for f in found])
        at = np.cumsum(size) - size
        order, parts = _by_bucket((anchor % np.uint64(buckets)).astype(np.int64), anchor)
        rows = []
        for b, p in parts:
            o = order[p]
            rows.append((b, key[0].as_py(), anchor[o].tobytes(), context[o].tobytes(), second[o].tobytes(), _packed(low[o]), _packed(many[o]), _packed(before[o].astype("<u1")), _packed(n[o].astype("<u1")), _packed(raw[_spans(at[o], size[o])])))
        return _table(_STEP3, rows)

    return run


def _spans(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Places at[0] to at[0] + n[0] - 1, at[1] and so on."""
    upto = np.cumsum(n)
    return np.repeat(at - (upto - n), n) + np.arange(int(upto[-1]) if len(n) else 0)


def _distinct(anchor: np.ndarray, context: np.ndarray, before: np.ndarray, size: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One entry of each distinct context, in the order of anchors, and for each entry the place of its own one. Entries of
    equal hashes are compared with the first of them byte by byte; where they differ, by their bytes in a dictionary."""
    at = np.cumsum(size) - size
    order = np.lexsort((context, anchor))
    s = _starts(anchor[order], context[order])
    group = np.repeat(np.arange(len(s)), np.diff(np.append(s, len(order))))
    first = order[s][group]
    differ = (size[order] != size[first]) | (before[order] != before[first])
    check = np.flatnonzero(~differ & (order != first))
    for part in (check[i : i + SORT_AT_ONCE // 8] for i in range(0, len(check), SORT_AT_ONCE // 8)):
        n = size[order[part]]
        equal = raw[_spans(at[order[part]], n)] == raw[_spans(at[first[part]], n)]
        differ[part] = ~np.logical_and.reduceat(equal, np.cumsum(n) - n)
    of, ones = np.empty(len(order), np.int64), order[s]
    of[order] = group
    if differ.any():
        extra: dict = {}
        for i in order[differ]:
            name = (anchor[i], context[i], before[i], raw[at[i] : at[i] + size[i]].tobytes())
            of[i] = extra.setdefault(name, (len(s) + len(extra), i))[0]
        ones = np.append(ones, [i for _, i in extra.values()])
        # anchors side by side again
        by = np.argsort(anchor[ones], kind="stable")
        place = np.empty(len(ones), np.int64)
        place[by] = np.arange(len(ones))
        ones, of = ones[by], place[of]
    return ones, of


_STEP4 = "shard int, contexts binary, seconds binary, first binary, last binary, least binary"


def _step4(key, t):
    shards, *columns = _columns(t, "shard", "anchors", "contexts", "seconds", "docs", "many", "before", "n", "bytes")
    anchor, context, second = (np.concatenate([np.frombuffer(r, _U64) for r in c]) for c in columns[:3])
    docs, many, before, n, raw = (np.concatenate([_unpacked(r, k) for r in c]) for c, k in zip(columns[3:], (_I64, bool, "<u1", "<u1", "<u1"), strict=True))
    before, n = before.astype(np.int64), n.astype(np.int64)
    shard = np.repeat(np.array(shards, np.int32), [len(r) // 8 for r in columns[0]])
    at = np.cumsum(n + LENGTH - 1) - (n + LENGTH - 1)
    # one of each context is sorted, and stands for the others
    one, of = _distinct(anchor, context, before, n + LENGTH - 1, raw)
    low = np.full(len(one), _LAST, np.int64)
    np.minimum.at(low, of, docs)
    answers = [[] for _ in range(4)]
    groups = np.append(_starts(anchor[one]), len(one))
    # the strings of an anchor with one distinct context differ in their distance to it: there is nothing to sort
    alone = groups[:-1][np.diff(groups) == 1]
    answers[0].append(alone)
    answers[1].append(np.zeros(len(alone), np.int64))
    answers[2].append(n[one[alone]] - 1)
    answers[3].append(low[alone])
    rest = np.setdiff1d(np.arange(len(one)), alone, assume_unique=True)
    groups = np.append(_starts(anchor[one[rest]]), len(rest))
    strings = np.concatenate([[0], np.cumsum(n[one[rest]])])
    i = 0
    while i < len(groups) - 1:
        j = max(i + 1, int(np.searchsorted(strings[groups], strings[groups[i]] + SORT_AT_ONCE, side="right")) - 1)
        part = rest[groups[i] : groups[j]]
        i = j
        c = one[part]
        which = np.repeat(np.arange(len(part)), n[c])
        offset = _spans(np.zeros(len(c), np.int64), n[c])
        # equal strings have equal anchors at equal distances
        name = np.cumsum(np.append(0, anchor[c][1:] != anchor[c][:-1]))[which] * (LENGTH + 1) + before[c][which] - offset
        by = np.argsort(name, kind="stable")
        size = n[c] + LENGTH - 1
        own = np.cumsum(size) - size
        sorter = SuffixOrder(raw[_spans(at[c], size)])
        start = (own[which] + offset)[by]
        sorted_, new = sorter.classes(start, name[by])
        s = np.flatnonzero(new)
        least = np.repeat(np.minimum.reduceat(low[part][which[by][sorted_]], s), np.diff(np.append(s, len(sorted_))))
        back = np.empty(len(least), np.int64)
        back[by[sorted_]] = least
        # runs of strings with one answer
        runs = _starts(which, back)
        answers[0].append(part[which[runs]])
        answers[1].append(offset[runs])
        answers[2].append(offset[np.append(runs[1:], len(which)) - 1])
        answers[3].append(back[runs])
    rep, first, last, least = (np.concatenate(a) for a in answers)
    # each entry takes the runs of the one that stood for its context
    by = np.argsort(rep, kind="stable")
    rep, first, last, least = rep[by], first[by], last[by], least[by]
    count = np.bincount(rep, minlength=len(one))
    upto = np.cumsum(count) - count
    entry = np.repeat(np.arange(len(of)), count[of])
    run = _spans(upto[of], count[of])
    use = np.flatnonzero((least[run] < docs[entry]) | many[entry])
    entry, run = entry[use], run[use]
    order, parts = _by_bucket(shard[entry])
    entry, run = entry[order], run[order]
    return _table(_STEP4, [(b, context[entry[p]].tobytes(), second[entry[p]].tobytes(), _packed(first[run[p]].astype("<u1")), _packed(last[run[p]].astype("<u1")), _packed(least[run[p]])) for b, p in parts])


_STEP5 = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _covered(raws, ids, runs):
    """Bytes that go, of the concatenated texts."""
    text, _, context, first, _, n, raw = segments(raws)
    step = np.zeros(len(raw) + 1, np.int32)
    contexts, second, a, b, least = runs
    if len(contexts):
        low, high = np.searchsorted(contexts, context, "left"), np.searchsorted(contexts, context, "right")
        segment = np.repeat(np.arange(len(context)), high - low)
        run = _spans(low, high - low)
        same = second_hash(raw, first[segment], first[segment] + n[segment] + LENGTH - 1) == second[run]
        m = same & (ids[text[segment]] > least[run])
        segment, run = segment[m], run[m]
        np.add.at(step, first[segment] + a[run], 1)
        np.add.at(step, first[segment] + b[run] + LENGTH, -1)
    return np.cumsum(step[:-1]) > 0, raw


def _answers(answers: pa.Table):
    """Contexts, second hashes, first and last strings and smallest doc_ids of runs, in the order of contexts."""
    columns = _columns(answers, "contexts", "seconds", "first", "last", "least")
    kinds = (lambda r: np.frombuffer(r, _U64), lambda r: np.frombuffer(r, _U64), lambda r: _unpacked(r, "<u1").astype(np.int64), lambda r: _unpacked(r, "<u1").astype(np.int64), lambda r: _unpacked(r, _I64))
    runs = [np.concatenate([k(r) for r in c]) if c else np.zeros(0, np.int64) for c, k in zip(columns, kinds, strict=True)]
    by = np.argsort(runs[0], kind="stable")
    return tuple(x[by] for x in runs)


def _step5(key, docs, answers):
    runs, rows = _answers(answers), []
    names = iter(docs.column("doc_id").to_pylist())
    for ids, raws in _documents(docs):
        gone, raw = _covered(raws, ids, runs) if sum(map(len, raws)) >= LENGTH else (np.zeros(sum(map(len, raws)), bool), np.frombuffer(b"".join(raws), np.uint8))
        at = 0
        for text in raws:
            g = gone[at : at + len(text)]
            n = int(np.count_nonzero(g))
            spans = int(np.count_nonzero(g[1:] & ~g[:-1])) + int(g[0]) if n else 0
            kept = raw[at : at + len(text)][~g].tobytes() if n else text
            rows.append((next(names), len(text), n, spans, hashlib.sha256(kept).hexdigest()))
            at += len(text)
    return _table(_STEP5, rows)


def shards_for(n_bytes: int) -> int:
    """Shards, and buckets of anchors, of so many bytes."""
    grown = math.isqrt(n_bytes * SHARD_LEAST // FEW_SHARDS)
    return max(1, -(-n_bytes // min(SHARD_MOST, max(SHARD_LEAST, grown))))


def repeats_removed(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of docs."""
    docs = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), "text")
    shards = buckets = shards or shards_for(docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    # rows without a doc_id are dealt by their texts
    shard = F.pmod(F.coalesce(F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")), F.xxhash64("text")), F.lit(shards)).cast("int")
    rows = docs.withColumn("shard", shard)
    by_shard = lambda df: df.groupBy("shard")
    first = by_shard(rows).applyInArrow(_step1(buckets), _STEP1)
    second = first.groupBy("bucket").applyInArrow(_step2, _STEP2)
    third = by_shard(rows).cogroup(by_shard(second)).applyInArrow(_step3(buckets), _STEP3)
    fourth = third.groupBy("bucket").applyInArrow(_step4, _STEP4)
    return by_shard(rows).cogroup(by_shard(fourth)).applyInArrow(_step5, _STEP5)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats_removed(table(spark, sf_dir, "documents"))


#: By all strings and all bytes, as hexadecimal digits: for small tables.
SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS k, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, k, p, substr(h, CAST(2 * p + 1 AS BIGINT), 100) AS x FROM (SELECT doc_id, k, h, unnest(range(0, greatest(len(h) // 2 - 49, 0))) AS p FROM d)),
m AS (SELECT x, min(doc_id) AS least FROM s GROUP BY x HAVING count(*) > 1),
g AS (SELECT s.k, s.p FROM s JOIN m ON m.x = s.x AND m.least < s.doc_id),
i AS (SELECT k, p, p - coalesce(lag(p) OVER (PARTITION BY k ORDER BY p), -1000) AS gap FROM g),
b AS (SELECT k, p, sum((gap > 50)::INT) OVER (PARTITION BY k ORDER BY p) AS run FROM i),
r AS (SELECT k, run, min(p) AS a, max(p) + 50 AS z FROM b GROUP BY k, run),
o AS (SELECT k, a, z, coalesce(lag(z) OVER (PARTITION BY k ORDER BY a), 0) AS upto FROM r),
f AS (SELECT d.k, any_value(doc_id) AS doc_id, any_value(h) AS h, coalesce(string_agg(substr(h, CAST(2 * upto + 1 AS BIGINT), CAST(2 * (a - upto) AS BIGINT)), '' ORDER BY a), '') AS kept,
        coalesce(sum(z - a), 0) AS gone, count(a) AS spans, coalesce(max(z), 0) AS last FROM d LEFT JOIN o ON o.k = d.k GROUP BY d.k)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(gone AS BIGINT) AS n_removed, CAST(spans AS BIGINT) AS n_spans, sha256(unhex(kept || substr(h, CAST(2 * last + 1 AS BIGINT)))) AS kept_sha256 FROM f
"""
