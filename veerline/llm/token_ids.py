"""Token ids of texts by the tokenizers library, and a memo of pre-tokens that makes it cheap.

The byte-level tokenizer splits a text into pre-tokens and merges within each of them, so equal
pre-tokens have equal ids wherever they stand. Each worker keeps the ids of the pre-tokens it
has met, and gives new ones to the library in bulk: joined by line ends, which are pre-tokens of
their own, and parted again at the line end's id.

Texts below U+0250 without apostrophes are split, hashed and put together again as arrays: classes of
characters give the borders of pre-tokens, polynomial hashes name them. The bytes of all ids are compared
with the text at the end, so that no collision of hashes goes unseen. Other texts go through the regular
expression. ids_of() equals the library's encode() of the whole text; the tests hold the two together.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

from .hashing import mix, prefixes, substrings
from .shared import kept

#: The split pattern of the public byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens after which the memo starts anew: about 150 bytes each.
MOST = 700_000
#: Characters that are held as arrays at once.
AT_ONCE = 500_000
_FAR = 0x250
_LETTER, _NUMBER, _SPACE, _BLANK, _OTHER, _LEAVE = range(6)


def _classes() -> np.ndarray:
    """Class of each character below U+0250; apostrophes and separators are left to the regular expression."""
    import regex

    out = np.full(_FAR, _OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}", _LETTER), (r"\p{N}", _NUMBER), (r"\s", _SPACE), ("[\x1c-\x1f']", _LEAVE), (" ", _BLANK)):
        out[[c for c in range(_FAR) if regex.match(pattern, chr(c))]] = kind
    return out


class Encoder:
    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        size = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.far = regex.compile(PATTERN)
        self.classes = _classes()
        self.end = int(self._plain("\n")[0])
        # bytes of each token: its characters stand for a byte each, printable ones for themselves
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        tokens = [b""] * size
        for token, i in self.tokenizer.get_vocab().items():
            tokens[i] = bytes(byte.get(c, 0) for c in token)
        self.token_len = np.array([len(t) for t in tokens], np.int64)
        self.token_at = np.cumsum(self.token_len) - self.token_len
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.memo: dict[int, int] = {}  # hash of a pre-token: its place in the next two
        self.at, self.len = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.pool, self.used = np.zeros(1 << 18, self.kind), 0

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)

    def _learn(self, new: list[str]) -> list[np.ndarray]:
        """Ids of pre-tokens."""
        out: list[np.ndarray | None] = [None] * len(new)
        bulk = [i for i, w in enumerate(new) if not w.isspace()]
        parts = [bulk[i : i + 512] for i in range(0, len(bulk), 512)]
        texts = ["\n".join([new[i] for i in p]) for p in parts]
        for part, encoding in zip(parts, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(encoding.ids, self.kind)
            cuts = np.flatnonzero(ids == self.end)
            if len(cuts) == len(part) - 1:
                for i, a, b in zip(part, [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)], strict=True):
                    out[i] = ids[a:b]
        return [self._plain(w) if x is None else x for w, x in zip(new, out, strict=True)]

    def _remember(self, hashes: list[int], ids: list[np.ndarray]) -> None:
        n, had = len(ids), len(self.memo)
        lens = np.array([len(x) for x in ids], np.int64)
        while had + n > len(self.at):
            self.at, self.len = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.len))
        while self.used + int(lens.sum()) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.at[had : had + n] = self.used + np.cumsum(lens) - lens
        self.len[had : had + n] = lens
        self.pool[self.used : self.used + int(lens.sum())] = np.concatenate(ids)
        self.used += int(lens.sum())
        self.memo.update(zip(hashes, range(had, had + n), strict=True))

    def _borders(self, kind: np.ndarray) -> np.ndarray:
        """Whether a pre-token starts at each character, by the characters' classes."""
        white = (kind == _SPACE) | (kind == _BLANK)
        start = np.ones(len(kind), bool)
        # within a run of letters, numbers or other characters, and within white space
        start[1:] = (kind[1:] != kind[:-1]) & ~(white[1:] & white[:-1])
        # white space before a word: its last character starts anew if others precede it
        last = np.flatnonzero(white[:-1] & ~white[1:])
        start[last] = True
        # a blank there belongs to the word
        start[last[kind[last] == _BLANK] + 1] = False
        return start

    def ids_of(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as unsigned integers of 2 or 4 bytes."""
        out: list[np.ndarray | None] = [None] * len(texts)
        plain: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            plain.append(i)
            size += len(text)
            if size > AT_ONCE or i == len(texts) - 1:
                self._arrays(texts, plain, out)
                plain, size = [], 0
        return out

    def _arrays(self, texts: list[str], which: list[int], out: list) -> None:
        points = [np.frombuffer(texts[i].encode("utf-32-le", "surrogatepass"), "<u4") for i in which]
        near = []
        for i, p in zip(which, points, strict=True):
            if not len(p):
                out[i] = np.zeros(0, self.kind)
            elif int(p.max()) < _FAR and not np.any((kind := self.classes[p]) == _LEAVE):
                near.append((i, p, kind))
            else:
                words = self.far.findall(texts[i])
                out[i] = np.concatenate(self._learn(words)) if words else np.zeros(0, self.kind)
        if not near:
            return
        if len(self.memo) > MOST:
            self._forget()
        chars = np.concatenate([p for _, p, _ in near])
        first = np.cumsum([0, *(len(p) for _, p, _ in near)])
        start = np.flatnonzero(np.concatenate([self._borders(k) for _, _, k in near]))
        end = np.append(start[1:], len(chars))
        h = mix(substrings(prefixes(chars), start, end) + (end - start).astype(np.uint64))
        codes, names = pd.factorize(h)
        places = list(map(self.memo.get, names.tolist()))
        if None in places:
            new = [k for k, p in enumerate(places) if p is None]
            at = np.zeros(len(names), np.int64)
            at[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)  # a pre-token of each name: the first
            whole = "".join([texts[i] for i, _, _ in near])
            ids = self._learn([whole[a:b] for a, b in zip(start[at[new]].tolist(), end[at[new]].tolist(), strict=True)])
            self._remember(names[new].tolist(), ids)
            places = list(map(self.memo.get, names.tolist()))
        place = np.array(places, np.int64)[codes]
        ids = self.pool[_ragged(self.at[place], self.len[place])]
        raw = "".join([texts[i] for i, _, _ in near]).encode()
        if not np.array_equal(self.token_bytes[_ragged(self.token_at[ids], self.token_len[ids])], np.frombuffer(raw, np.uint8)):
            for i, _, _ in near:  # two pre-tokens of one hash
                out[i] = self._plain(texts[i])
            return
        upto = np.concatenate([[0], np.cumsum(self.len[place])])[np.searchsorted(start, first)]
        for (i, _, _), a, b in zip(near, upto[:-1], upto[1:], strict=True):
            out[i] = ids[a:b]


def _ragged(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Places at[0] to at[0] + n[0] - 1, at[1] and so on."""
    upto = np.cumsum(n)
    total = int(upto[-1]) if len(n) else 0
    return np.repeat(at - (upto - n), n) + np.arange(total)


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    encoders = kept("tokens")
    if path not in encoders:
        encoders[path] = Encoder(path)
    return encoders[path]


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def few(texts: list[str], most: int = 1_000_000):
    """Slices of a list whose texts have about so many characters at most: bounds what is held at once."""
    at, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size > most:
            yield slice(at, i + 1)
            at, size = i + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))
