"""Pre-tokens as arrays against the regular expression, and the trie by levels against the walk."""

import random
import sys

import numpy as np
import regex

from veerline.llm import pretokens, token_ids, trie_counts


def test_split():
    rng, split, find = random.Random(1), pretokens.Splitter().split, regex.compile(token_ids.PATTERN).findall
    anything = "".join(chr(rng.randrange(0x110000)) for _ in range(400))
    for alphabet in ("a' \n\ts", "'strevmldx 1.'' ", "ab1 .\n\x1c\x85\xa0　'日é²Ⅷ\ud800😀'll're", anything + " '\ns"):
        for _ in range(500):
            texts = ["".join(rng.choices(alphabet, k=rng.choice((0, 0, 1, 2, 3, 5, 9, 20)))) for _ in range(rng.randint(0, 6))]
            words, codes, upto = split(texts)
            words = words.to_pylist()
            assert len(set(words)) == len(words)
            assert [[words[k] for k in codes[a:b]] for a, b in zip(upto, upto[1:])] == [[w.encode("utf-8", "surrogatepass") for w in find(t)] for t in texts]


def test_levels_and_walk(monkeypatch):
    rng = random.Random(3)
    for it in range(400):
        letters = b"abc" if it % 2 else b"ab"
        pieces = sorted({bytes(rng.choices(letters, k=rng.randint(1, 5))) for _ in range(rng.randint(1, 12))})
        trie = trie_counts.PrefixCounts(trie_counts.piece_trie(pieces, [-rng.randint(1, 6) / 2 for _ in pieces]))  # many ties
        words = {bytes(rng.choices(letters + b"d" * (it % 3 == 0), k=rng.randint(0, 12))): rng.randint(1, 9) for _ in range(rng.randint(0, 30))}
        want, cut = {}, np.zeros(len(pieces), np.int64)
        for word, n, lasts in trie.visit(list(words)):
            want[word], at = n, len(word) if n >= 0 else 0
            while at:
                cut[lasts[at - 1]] += words[word]
                at -= len(pieces[lasts[at - 1]])
        for name, value in (("SHALLOW", rng.choice((0, 2, 64))), ("FEW", rng.choice((1, 3, 32))), ("AT_ONCE", rng.choice((1, 7, 10**6)))):
            monkeypatch.setattr(trie_counts, name, value)
        got = np.zeros(len(pieces), np.int64)
        trie.pieces(words, [len(p) for p in pieces], got)
        assert trie.counts(list(words)) == want and got.tolist() == cut.tolist()


def test_no_python_work_a_pretoken():
    """Calls don't grow with the distinct pre-tokens: they were several for each of its bytes, which made up most of the time."""
    rng, counter = random.Random(2), trie_counts.Counter(token_ids.vocabulary())
    texts = [" ".join("".join(rng.choices("abcdefgh", k=8)) for _ in range(100)) for _ in range(200)]
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        found = counter.of(texts)
    finally:
        sys.setprofile(None)
    assert calls < 5000 and sum(n for n, _ in found) == 20_000
