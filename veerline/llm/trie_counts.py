"""Token counts under a unigram model, by dynamic programming that shares prefixes in a trie.

The pieces are a public vocabulary's, never trained here; their probabilities come from the corpus. One round of
expectation and maximisation over all texts: pre-tokens are counted, each distinct one is cut into its likeliest pieces
under scores that follow Zipf's law of the rank, and the pieces' counts (plus one) give the scores of the model.
A text splits into pre-tokens by the vocabulary's pattern; a pre-token's tokens are its likeliest segmentation into pieces.
Distinct pre-tokens form a trie of bytes. Its nodes are worked out a level at a time, all of a level as arrays, so that the forward
score of a prefix (and its number of tokens) is computed once for all that share it; what is kept of it is the count at the
terminal nodes. A text's count is the sum over its pre-tokens. How often a piece is used flows back from the terminal nodes.

Prefixes are shared up to DEEPEST bytes; pre-tokens that are longer, or too few for a level, are walked depth first, in sorted order.
Beyond DEEPEST only the pieces under way are kept, so that a pre-token of many megabytes
takes four bytes a byte. Equal scores prefer fewer tokens, then longer last pieces. Texts of about TOGETHER characters share a trie;
nothing is kept from one trie to the next. What is
shuffled is each task's distinct pre-tokens (of HELD bytes at a time), with their counts, and a count for each piece.

Defined results: null and empty texts have no tokens; a pre-token that the pieces can't make up has as many tokens as bytes; equal
rows are counted each on its own; an empty table gives an empty table; columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import itertools
import math
import os
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pretokens import Splitter
from .shared import kept, table
from .token_ids import encoder, few, vocabulary

#: Bytes up to which prefixes are shared.
DEEPEST = 512
#: Bytes up to which the trie always goes by levels; beyond, levels that fewer than FEW pre-tokens reach are walked.
SHALLOW, FEW = 64, 32
#: Bytes of the pre-tokens of one trie, and characters of the texts whose pre-tokens are counted together.
AT_ONCE, TOGETHER = 2_000_000, 4_000_000
#: Bytes of distinct pre-tokens and their counts that a task holds.
HELD = 64_000_000
_END = -1


def zipf_scores(n: int) -> list[float]:
    """log probabilities of ranks 0 to n - 1."""
    total = math.log(sum(1 / (k + 1) for k in range(n)))
    return [-math.log(k + 1) - total for k in range(n)]


def piece_trie(pieces: list[bytes], scores: list[float]) -> dict:
    """Nested dictionaries by byte; under _END the score and number of a piece that ends there."""
    root: dict = {}
    for k, (piece, score) in enumerate(zip(pieces, scores, strict=True)):
        node = root
        for b in piece:
            node = node.setdefault(b, {})
        if piece and score > node.get(_END, (-math.inf,))[0]:
            node[_END] = score, k
    return root


class PieceTable:
    """The trie of pieces as arrays: edges in a hash table with open addressing, score and number of the piece that ends at a node."""

    def __init__(self, root: dict):
        nodes, keys = [root], []
        for k, node in enumerate(nodes):  # grows on the way
            for b, child in node.items():
                if b != _END:
                    keys.append(k << 8 | b)
                    nodes.append(child)
        ends = [node.get(_END, (-math.inf, -1)) for node in nodes]
        self.score, self.number = np.array([x[0] for x in ends]), np.array([x[1] for x in ends], np.int32)
        bits = max(4, (4 * len(nodes)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.nodes = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        key, node = np.array(keys, np.int64), np.arange(1, len(nodes), dtype=np.int32)
        at = self._slots(key)
        while len(key):
            free = self.keys[at] < 0
            self.keys[at[free]] = key[free]
            here = self.keys[at] == key
            self.nodes[at[here]] = node[here]
            key, node, at = key[~here], node[~here], at[~here] + 1 & self.mask

    def _slots(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def children(self, key: np.ndarray) -> np.ndarray:
        """The node that each key (a node's number and a byte) leads to, -1 if none."""
        at = self._slots(key)
        found = self.keys[at]
        rest = np.flatnonzero((found != key) & (found >= 0))
        while len(rest):
            at[rest] = at[rest] + 1 & self.mask
            found = self.keys[at[rest]]
            rest = rest[(found != key[rest]) & (found >= 0)]
        return np.where(self.keys[at] == key, self.nodes[at], -1)


def _firsts(x: np.ndarray) -> np.ndarray:
    """Whether each value differs from the one before it."""
    out = np.ones(len(x), bool)
    out[1:] = x[1:] != x[:-1]
    return out


class PrefixCounts:
    """Token counts of pre-tokens. The trie's nodes are worked out a level at a time, as arrays; for the few longest pre-tokens it is
    walked depth first, with the forward scores of the current path on a stack."""

    def __init__(self, root: dict):
        self.root, self.nodes, self.table = root, 0, PieceTable(root)

    def forward(self, words: pa.Array):
        """Of sorted, distinct pre-tokens: the node at which each ends; of all nodes, the forward score, negative tokens, the number of the
        last piece and the node where that piece starts; the first node of each level, and the number of nodes."""
        _, offsets, raw = words.buffers()
        raw = np.frombuffer(raw or b"", np.uint8)
        at = np.frombuffer(offsets, np.int32)[words.offset :][: len(words) + 1].astype(np.int64)
        at, n, table = at[:-1], np.diff(at), self.table
        best, fewest = np.zeros(n.sum() + 1), np.zeros(n.sum() + 1, np.int32)
        number, origin = np.full(n.sum() + 1, -1, np.int32), np.zeros(n.sum() + 1, np.int32)
        end, levels, top = np.zeros(len(words), np.int64), [], 1
        alive = np.flatnonzero(n)  # pre-tokens that go on, and their nodes on the level before
        parents = np.zeros(len(alive), np.int64)
        # the pieces under way at each node of the level before, those that started first ahead: node of the piece, node of its start
        piece, began, count = np.zeros(1, np.int64), np.zeros(1, np.int32), np.ones(1, np.int64)
        while len(alive):
            byte = raw[at[alive] + len(levels)]
            new = _firsts(parents) | _firsts(byte)
            head = np.flatnonzero(new)
            parent, m = parents[head], len(head)
            many = count[parent]
            of = np.repeat(np.arange(m), many)
            pair = np.arange(len(of)) + np.repeat((np.cumsum(count) - count)[parent] - (np.cumsum(many) - many), many)
            on = table.children(piece[pair] << 8 | byte[head][of])
            go = np.flatnonzero(on >= 0)
            piece, began, of = on[go].astype(np.int64), began[pair[go]], of[go]
            best[top : top + m] = -math.inf
            done = np.flatnonzero(table.number[piece] >= 0)
            if len(done):
                node, start, last = of[done], began[done], piece[done]
                score, tokens = best[start] + table.score[last], fewest[start] - 1
                first = np.flatnonzero(_firsts(node))
                size = np.diff(np.append(first, len(node)))
                # the highest score, then the fewest tokens, then the longest piece
                tokens[score < np.repeat(np.maximum.reduceat(score, first), size)] = np.iinfo(np.int32).min
                most = np.flatnonzero(tokens == np.repeat(np.maximum.reduceat(tokens, first), size))
                most = most[_firsts(node[most])]
                to = top + node[most]
                best[to], fewest[to], number[to], origin[to] = score[most], tokens[most], table.number[last[most]], start[most]
            # a piece may start after each node that pieces make up: behind those under way
            starts = best[top : top + m] > -math.inf
            had = np.bincount(of, minlength=m)
            count = had + starts
            place = np.arange(len(of)) + (np.cumsum(starts) - starts)[of]
            behind = (np.cumsum(count) - count + had)[starts]
            grown = np.zeros(len(of) + len(behind), np.int64), np.zeros(len(of) + len(behind), np.int32)
            grown[0][place], grown[1][place], grown[1][behind] = piece, began, top + np.flatnonzero(starts)
            piece, began = grown
            parents = np.cumsum(new) - 1
            levels.append(top)
            over = n[alive] == len(levels)
            end[alive[over]] = top + parents[over]
            alive, parents, top = alive[~over], parents[~over], top + m
        self.nodes += top - 1
        return end, best[:top], fewest[:top], number[:top], origin[:top], levels, top

    @staticmethod
    def _parts(words: pa.Array):
        """Places of pre-tokens for levels in sorted order, about AT_ONCE bytes at a time, and those of longer ones, to be walked."""
        n = pc.binary_length(words).to_numpy()
        most = min(DEEPEST, max(SHALLOW, np.partition(n, -FEW)[-FEW] if len(n) >= FEW else 0))
        order = pc.array_sort_indices(words).to_numpy()
        order = order[n[order] <= most]
        cuts = np.flatnonzero(_firsts(np.cumsum(n[order], dtype=np.int64) // AT_ONCE))
        return np.split(order, cuts[1:]), np.flatnonzero(n > most).tolist()

    def visit(self, words: list[bytes]):
        """Each of distinct pre-tokens, its number of tokens (-1 if the pieces can't make it up), and the number of the last piece
        after each of its bytes (good until the next one)."""
        root = self.root
        # for each depth: forward score, negative tokens, and the pieces under way (node, score and tokens at its start)
        stack = [(0.0, 0, [])]
        lasts, last = array("i"), b""
        for word in sorted(words):
            shared = min(len(os.path.commonprefix((last, word))), len(stack) - 1)
            del stack[shared + 1 :], lasts[shared:]
            best, fewest, way = stack[-1]
            for depth in range(shared, len(word)):
                b = word[depth]
                if best > -math.inf:
                    way = [*way, (root, best, fewest)]
                best, fewest, on, number = -math.inf, 0, [], -1
                for node, score, n in way:
                    node = node.get(b)
                    if node is not None:
                        on.append((node, score, n))
                        piece = node.get(_END)
                        if piece is not None and (score + piece[0], n - 1) > (best, fewest):
                            best, fewest, number = score + piece[0], n - 1, piece[1]
                way = on
                lasts.append(number)
                if depth < DEEPEST:
                    stack.append((best, fewest, way))
                self.nodes += 1
            yield word, -fewest if best > -math.inf else -1, lasts
            last = word

    def tokens(self, words: pa.Array) -> np.ndarray:
        """Number of tokens of each of distinct pre-tokens, -1 where the pieces can't make it up."""
        parts, long = self._parts(words)
        out = np.zeros(len(words), np.int64)
        for part in parts:
            end, best, fewest, *_ = self.forward(words.take(pa.array(part)))
            out[part] = np.where(best[end] > -math.inf, -fewest[end], -1)
        place = {words[k].as_py(): k for k in long}
        for word, n, _ in self.visit(list(place)):
            out[place[word]] = n
        return out

    def add_pieces(self, words: pa.Array, times: np.ndarray, lengths: list[int], into: np.ndarray) -> None:
        """Adds the pieces of distinct pre-tokens, each as often as it occurs."""
        parts, long = self._parts(words)
        for part in parts:
            end, best, _, number, origin, levels, top = self.forward(words.take(pa.array(part)))
            passed = np.zeros(top, np.int64)  # how often a cut comes to a node
            passed[end] = np.where(best[end] > -math.inf, times[part], 0)
            for a, b in reversed([*itertools.pairwise([*levels, top])]):
                at = a + np.flatnonzero(passed[a:b])
                np.add.at(into, number[at], passed[at])
                np.add.at(passed, origin[at], passed[at])
        place = {words[k].as_py(): k for k in long}
        for word, n, lasts in self.visit(list(place)):
            at = len(word) if n >= 0 else 0
            while at:
                piece = lasts[at - 1]
                into[piece] += times[place[word]]
                at -= lengths[piece]

    def counts(self, words: list[bytes]) -> dict[bytes, int]:
        return dict(zip(words, self.tokens(pa.array(words, pa.binary())).tolist(), strict=True))

    def pieces(self, words: dict[bytes, int], lengths: list[int], into: np.ndarray) -> None:
        self.add_pieces(pa.array(words.keys(), pa.binary()), np.array([*words.values()], np.int64), lengths, into)


def vocabulary_pieces(path: str) -> list[bytes]:
    enc = encoder(path)
    return [enc.token_bytes[a : a + n].tobytes() for a, n in zip(enc.token_at, enc.token_len, strict=True)]


def _worker(kind: str, path: str, scores: list[float] | None):
    """The worker's counter, made anew for other scores."""
    name = path, zlib.crc32(np.array(scores or []).tobytes())
    workers = kept("tokens")
    if workers.get(kind, (None,))[0] != name:
        workers[kind] = name, Counter(path, scores)
    return workers[kind][1]


class Counter:
    """Counts texts' tokens, or the pieces of pre-tokens. Scores are Zipf's where none are given."""

    def __init__(self, path: str, scores: list[float] | None = None):
        pieces = vocabulary_pieces(path)
        self.lengths = list(map(len, pieces))
        self.trie = PrefixCounts(piece_trie(pieces, scores or zipf_scores(len(pieces))))
        self.split = Splitter().split

    def of(self, texts: list[str]) -> list[tuple[int, int]]:
        """(pre-tokens, tokens) of each text."""
        words, codes, upto = self.split(texts)
        tokens = self.trie.tokens(words)
        tokens = np.where(tokens < 0, pc.binary_length(words).to_numpy(), tokens)[codes]
        tokens = np.concatenate([[0], np.cumsum(tokens)])[upto]
        return list(zip(np.diff(upto).tolist(), np.diff(tokens).tolist(), strict=True))


def fit_scores(docs: DataFrame, vocab: str) -> list[float]:
    """log probabilities of the pieces, from all texts; a number a piece comes to the driver."""

    def distinct(batches):
        """Pre-tokens of a task and how often they occur."""
        split, met = _worker("fit", vocab, None).split, []

        def found():
            rows = pa.concat_tables(met).group_by("word", use_threads=False).aggregate([("n", "sum")])
            met[:] = [rows.select(["word", "n_sum"]).rename_columns(["word", "n"])]

        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for part in few(texts):
                words, codes, _ = split(texts[part])
                met.append(pa.table([words, pa.array(np.bincount(codes, minlength=len(words)), pa.int64())], ["word", "n"]))
                if sum(x.nbytes for x in met) > HELD:
                    found()
                    if met[0].nbytes > HELD // 2:
                        yield from met.pop().to_batches()
        if met:
            found()
            yield from met.pop().to_batches()

    def run(batches):
        counter = _worker("fit", vocab, None)
        total, met, held = np.zeros(len(counter.lengths), np.int64), [], 0

        def settle():
            words = pa.concat_arrays([x.column("word").cast(pa.binary()) for x in met])
            counter.trie.add_pieces(words, np.concatenate([x.column("n").to_numpy() for x in met]), counter.lengths, total)
            met.clear()

        for batch in batches:
            met.append(batch)
            held += batch.nbytes
            if held > HELD:
                settle()
                held = 0
        if met:
            settle()
        place = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), pa.array(total[place], pa.int64())], ["piece", "n"])

    # each distinct pre-token of the corpus is cut once
    words = docs.select("text").mapInArrow(distinct, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = words.mapInArrow(run, "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    n = np.ones(len(vocabulary_pieces(vocab)))
    for x in found:
        n[x["piece"]] += x["n"]
    return np.log(n / n.sum()).tolist()


def token_counts(docs: DataFrame, vocab: str, scores: list[float] | None = None) -> DataFrame:
    """doc_id, n_pretokens, n_tokens of each row of docs. Scores are fitted on docs where none are given."""
    scores = scores or fit_scores(docs, vocab)

    def run(batches):
        counter = _worker("count", vocab, scores)
        for batch in batches:
            texts, out = [t or "" for t in batch.column("text").to_pylist()], []
            for part in few(texts, TOGETHER):
                out += counter.of(texts[part])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([x[k] for x in out], pa.int64()) for k in (0, 1))], ["doc_id", "n_pretokens", "n_tokens"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_pretokens long, n_tokens long")


def op4_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary())
