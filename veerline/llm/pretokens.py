"""Pre-tokens of texts as arrays: what regex.findall(PATTERN, text) finds, for texts of all characters.

Classes of characters, taken from the regular expression's own, give the borders; the pre-tokens are slices of the texts' bytes,
and Arrow's dictionary tells which are equal by comparing those bytes. No pre-token is an object of Python's here.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_LETTER, _NUMBER, _SPACE, _BLANK, _OTHER = range(5)
#: What the pattern takes after an apostrophe that starts a pre-token, where that is no more than the apostrophe else.
_AFTER = ("s", "t", "re", "ve", "m", "ll", "d")


def _classes() -> np.ndarray:
    """Class of each code point."""
    import regex

    every = "".join(map(chr, range(0x110000)))
    out = np.full(len(every), _OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}+", _LETTER), (r"\p{N}+", _NUMBER), (r"\s+", _SPACE)):
        for found in regex.finditer(pattern, every):
            out[found.start() : found.end()] = kind
    out[ord(" ")] = _BLANK
    return out


class Splitter:
    def __init__(self):
        self.classes = _classes()

    def _starts(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Places where pre-tokens start, in texts that follow each other; first has the place of each text's first character."""
        kind = self.classes[points]
        white = (kind == _SPACE) | (kind == _BLANK)
        start = np.ones(len(kind), bool)
        # within a run of letters, numbers or other characters, and within white space
        start[1:] = (kind[1:] != kind[:-1]) & ~(white[1:] & white[:-1])
        # white space before a word of its text: its last character starts anew if others precede it
        last = white[:-1] & ~white[1:]
        inner = first[(first > 0) & (first < len(kind))]
        last[inner - 1] = False
        last = np.flatnonzero(last)
        start[last] = True
        # a blank there belongs to the word
        start[last[kind[last] == _BLANK] + 1] = False
        start[inner] = True
        at = np.flatnonzero(points == ord("'"))
        if len(at):
            self._shortened(points, kind, start, first, at[start[at]])
        return np.flatnonzero(start)

    def _shortened(self, points, kind, start, first, at) -> None:
        """'s and the like, where the apostrophe starts a pre-token: the letters belong to it, and what follows starts anew."""
        end = first[np.searchsorted(first, at, "right")]  # of the text
        for letters in _AFTER:
            n = len(letters)
            here = at[at + n < end]
            for k, letter in enumerate(letters, 1):
                here = here[points[here + k] == ord(letter)]
            start[here + 1] = False
            here = here[here + n + 1 < len(start)]
            start[here[kind[here + n + 1] == _LETTER] + n + 1] = True

    def split(self, texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Distinct pre-tokens as bytes, the number of each pre-token in order, and how many precede each text (and the end)."""
        whole = "".join(texts)
        first = np.cumsum([0, *map(len, texts)])
        raw = whole.encode("utf-8", "surrogatepass")
        start = self._starts(np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4"), first)
        upto = np.searchsorted(start, first)
        if len(raw) > len(whole):
            start = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)[start]
        offsets = np.append(start, len(raw)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
        return words.dictionary, words.indices.to_numpy(), upto
