"""Toxicity by noisy-channel deobfuscation.

1. A character language model: counts of ORDER characters in a row (letters and word borders; a run of borders is one)
   over all texts of the corpus, added up in each task before the shuffle, and smoothed by interpolation with all
   shorter orders (Witten and Bell). It is kept as a table of whole costs, STEPS to a nat.
2. Obfuscated tokens (leetspeak, letters parted by blanks or marks, repeated letters) become lattices: each
   observed character offers the letters that it may stand for, or nothing, or a border, at a channel cost; whatever
   is put out, borders too, is charged by the model. Viterbi decoding picks the likeliest words: a state is the last
   ORDER - 1 characters, so the best path is exact. A token whose lattice has a single path is restored as it is, so only
   the others are decoded, and each worker remembers the tokens it has met. Tokens without two letters or digits
   side by side ("1", "$", "t!", "d-i") that follow each other after any white space form one lattice, in which a blank
   is a border or nothing; they are also read as whole words, parted only by gaps wider than a blank. A token of marks
   that may all be letters ("@$$") is read as letters. Digits alone are numbers. No token is too long to be decoded.
   The channel's costs are fixed: where obfuscation is rare, costs estimated from the corpus would never restore it.
3. Words of restored texts get log odds from at most TRAIN_ROWS labelled rows (a bound of the fit alone); each word that
   LEAST_ROWS toxic ones hold and that speaks for toxicity counts, however many there are. A logistic
   curve over a text's strongest word and the sum of all others is fitted on the same rows in PARTS parts, each with the
   odds that the other parts give, so that the curve isn't fitted on words that its rows have taught. Every text is
   scored whole.

Rows whose crc32 of the doc_id, as text, is divisible by 5 are held out and never learnt from.

Defined results: null and empty texts score like texts without a known word; labels of a doc_id that occurs
more than once count as toxic if one of them is; without labels of both kinds all scores are 0; equal rows score
alike; an empty table gives an empty table; columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import kept, table

TRAIN_ROWS, FOLDS = 20_000, 5
#: Parts of the labelled rows for the curve.
PARTS = 5
#: Toxic rows that hold a word at least; least log odds, and standard errors by which they are lowered beforehand.
LEAST_ROWS, LEAST_ODDS, ERRORS = 3, 1.0, 2.0
#: Tokens that a worker remembers.
MOST_TOKENS = 200_000
#: Symbols of the character model: 0 a word border, 1 to 26 letters, 27 any other letter; characters in a row; costs a nat.
SYMBOLS, ORDER, STEPS = 28, 5, 12
#: Runs of symbols that are counted at once, at most one text's more.
CODES_AT_ONCE = 2_000_000
_CONTEXTS = SYMBOLS ** (ORDER - 1)
#: What a character of leetspeak may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
        "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "{": "c", "€": "e", "£": "l", "¡": "i"}
#: Those of them that are punctuation around words, too.
OUTER = "!|+(<{¡"
#: Channel costs: a letter written as leetspeak, a character repeated, and what is no letter: a mark or blank that is
#: nothing or a border, one that might be a letter, a digit that is a border.
LEET_COST, REPEAT_COST, PART_COST, BORDER_COST = 0, 3 * STEPS, 1 * STEPS, 2 * STEPS
LETTER_PART_COST, LETTER_BORDER_COST, DIGIT_COST = 3 * STEPS, 5 * STEPS, 8 * STEPS
#: A token without two letters or digits side by side, and two or more of them in a row; each takes time linear in its length.
_LONE = r"(?=\S)(?:[^\w\s]|_)*+(?:[^\W_](?:[^\w\s]|_)++)*+[^\W_]?+(?!\S)"
_SPACED = re.compile(rf"(?<!\S){_LONE}(?:\s++{_LONE})++")
_GAP = re.compile(r"\s{2,}|[^\S ]")
_EDGE = re.compile(r"^[^\w@$!|+(<{€£¡]+|(?<![^\w@$!|+(<{€£¡])[^\w@$!|+(<{€£¡]+$|(?:([^\w])\1\1+)$|^(?:([^\w])\2\2+)")
#: Runs of one character: for _EDGE three are as good as more, for a lattice two; also parted by blanks.
_FOUR, _MORE, _PARTED = re.compile(r"(.)\1{3,}"), re.compile(r"(.)\1\1+"), re.compile(r"(?<!\S)(\S)(?: \1){2,}(?!\S)")
_CLEAN = re.compile(r"[^\W\d_]*")
_THREE = re.compile(r"([^\W\d_])\1\1")
_WORD = re.compile(r"[^\W\d_]+")


def symbol(c: str) -> int:
    """The symbol of a lower-case character."""
    return ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0


@lru_cache(maxsize=1)
def _symbol_table() -> np.ndarray:
    """Symbols of the characters of the first plane."""
    return np.array([symbol(chr(c).lower()[0]) for c in range(0x10000)], np.uint8)


def symbols(text: str) -> np.ndarray:
    """Symbols of a text between borders, each run of borders as one."""
    points = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), "<u4")
    out = _symbol_table()[np.minimum(points, 0xFFFF)]
    for k in np.flatnonzero(points > 0xFFFF):
        out[k] = symbol(chr(points[k]).lower()[0])
    return out[np.append(True, (out[1:] > 0) | (out[:-1] > 0))]


def count_batches(batches):
    """Counts of ORDER symbols in a row over texts: rows of (place, n)."""
    kept("toxicity")
    place, n, codes, size = np.zeros(0, np.int32), np.zeros(0, np.int64), [], 0

    def added():
        """place and n with the codes met since."""
        more, m = np.unique(np.concatenate(codes), return_counts=True)
        every, at = np.unique(np.concatenate([place, more]), return_inverse=True)
        total = np.zeros(len(every), np.int64)
        np.add.at(total, at, np.concatenate([n, m]))
        return every, total, [], 0

    for batch in batches:
        for text in batch.column("text").to_pylist():
            if text:
                s = np.concatenate([np.zeros(ORDER - 2, np.int32), symbols(text).astype(np.int32)])
                code = s[: len(s) - ORDER + 1].copy()
                for k in range(1, ORDER):
                    code *= SYMBOLS
                    code += s[k : len(s) - ORDER + 1 + k]
                codes.append(code)
                size += len(code)
                if size > CODES_AT_ONCE:
                    place, n, codes, size = added()
    if codes:
        place, n, codes, size = added()
    yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), pa.array(n, pa.int64())], ["place", "n"])


def costs(place: np.ndarray, n: np.ndarray) -> bytes:
    """Cost of each symbol after each context, from counts: the interpolated log probability in STEPS, 255 at most."""
    order = np.argsort(place, kind="stable")
    place, n = place[order], n[order]
    cut = np.searchsorted(place, np.arange(SYMBOLS + 1) * _CONTEXTS)

    def slice_of(first: int) -> np.ndarray:
        """Counts after one first symbol: the whole table at once is too much for a driver."""
        out = np.zeros(_CONTEXTS, np.float32)
        own = slice(cut[first], cut[first + 1])
        out[place[own] - first * _CONTEXTS] = n[own]
        return out

    def smoothed(counts, lower):
        counts = counts.reshape(-1, SYMBOLS)
        total, kinds = counts.sum(axis=1, keepdims=True), (counts > 0).sum(axis=1, keepdims=True)
        return (counts + kinds * lower) / np.maximum(total + kinds, 1) + np.where(total == 0, lower, 0)

    shorter = [np.zeros(_CONTEXTS, np.float32)]  # of ORDER - 1 symbols, then fewer
    for first in range(SYMBOLS):
        shorter[0] += slice_of(first)
    for _ in range(ORDER - 2):
        shorter.append(shorter[-1].reshape(SYMBOLS, -1).sum(axis=0))
    lower = np.full((1, SYMBOLS), 1 / SYMBOLS, np.float32)
    for counts in shorter[::-1]:
        rows = len(counts) // SYMBOLS
        lower = smoothed(counts, np.tile(lower, (rows // len(lower), 1)))
    out = np.empty((SYMBOLS, SYMBOLS ** (ORDER - 1)), np.uint8)
    for first in range(SYMBOLS):  # a slice of the contexts at once
        out[first] = np.minimum(np.rint(-STEPS * np.log(smoothed(slice_of(first), lower))), 255).reshape(-1)
    return out.tobytes()


def character_model(docs: DataFrame) -> bytes:
    """Costs by all texts; SYMBOLS ** ORDER numbers at most come to the driver, however large the corpus."""
    found = docs.select("text").mapInArrow(count_batches, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    return costs(found.column("place").to_numpy(), found.column("n").to_numpy())


def lattice(token: str, letters: bool = False) -> list[list[tuple[str, int]]]:
    """For each character of a token what it may stand for, with its cost: a letter, "" for nothing, " " for a border;
    with letters, each mark is a letter."""
    out, previous = [], ""
    for c in token:
        if c.isalpha():
            options = [(c, 0)]
        else:
            options = [(x, LEET_COST) for x in LEET.get(c, "")]
            if not letters:
                options += [(" ", DIGIT_COST)] if c.isdigit() else [(" ", LETTER_BORDER_COST), ("", LETTER_PART_COST)] if c in LEET else [(" ", BORDER_COST), ("", PART_COST)]
        if c == previous and (c.isalpha() or c in LEET):
            options.append(("", REPEAT_COST))
        out.append(options)
        previous = c
    return out


def decode(token: str, model: bytes, letters: bool = False) -> str:
    """The likeliest words, parted by blanks, that the lattice of a token or of lone characters (lower case) holds.

    Paths are chains of (what came before, letter): the cost of a character doesn't grow with the token."""
    best: dict = {0: (0, None)}
    for options in lattice(token, letters):
        options = [(symbol(out) if out else -1, out, cost) for out, cost in options]
        after: dict = {}
        for context, (score, path) in best.items():
            for z, out, cost in options:
                if z < 0 or z == 0 == context % SYMBOLS:
                    key, s, p = context, score + cost, path
                else:
                    place = context * SYMBOLS + z
                    key, s, p = place % _CONTEXTS, score + cost + model[place], (path, out)
                if key not in after or s < after[key][0]:
                    after[key] = (s, p)
        best = after
    path = min(((s + (model[context * SYMBOLS] if context % SYMBOLS else 0), p) for context, (s, p) in best.items()), key=lambda x: x[0])[1]
    out = []
    while path is not None:
        path, c = path
        out.append(c)
    return "".join(reversed(out)).strip()


def restore_token(token: str, model) -> str:
    """Words of a token, or of lone characters parted by single blanks (lower case), obfuscation undone."""
    if _CLEAN.fullmatch(token) and not _THREE.search(token):
        return token
    bare = _EDGE.sub("", _FOUR.sub(r"\1\1\1", token))
    if _CLEAN.fullmatch(bare) and not _THREE.search(bare) or not any(c.isalpha() or c in LEET and not c.isdigit() for c in bare):
        return bare
    bare = _MORE.sub(r"\1\1", _PARTED.sub(r"\1\1", bare))
    if not all(c in LEET for c in bare):
        return decode(bare, model)
    # marks alone: those that may be punctuation at the ends are read both ways
    return " ".join(decode(x, model, letters=True) for x in dict.fromkeys((bare, bare.strip(OUTER))) if x)


class Restorer:
    """Words of texts, with obfuscation undone; remembers what() of tokens."""

    def __init__(self, model: bytes, what=lambda words: words):
        self.model, self.what, self.memo = model, what, {}

    def tokens(self, text: str) -> set[str]:
        text = text.lower()
        out = set(text.split())
        for m in _SPACED.finditer(text):
            out.add(" ".join(m[0].split()))
            out.update("".join(part.split()) for part in _GAP.split(m[0]))
        return out

    def of(self, tokens: set[str]) -> list:
        """what() of each token's words."""
        get, found = self.memo.get, []
        for t in tokens:
            v = get(t, self)
            if v is self:
                v = self.what(_WORD.findall(restore_token(t, self.model)))
                if len(self.memo) < MOST_TOKENS:
                    self.memo[t] = v
                elif len(t) <= 12:
                    self.memo.clear()
            found.append(v)
        return found


def _word_counts(model):
    """model: broadcast. Rows of (word, part, toxic, clean): the labelled texts of a part that hold each word."""

    def run(batches):
        kept("toxicity")
        restorer, counts = Restorer(model.value), {}
        for batch in batches:
            for text, toxic, part in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "part")), strict=True):
                for w in {w for words in restorer.of(restorer.tokens(text or "")) for w in words}:
                    counts.setdefault((w, part), [0, 0])[toxic] += 1
        columns = zip(*((w, part, k[1], k[0]) for (w, part), k in counts.items()), strict=True) if counts else [[]] * 4
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["word", "part", "toxic", "clean"])

    return run


def _features(found: list[float]) -> tuple[float, float]:
    """The strongest word's log odds, and the logarithm of the sum of all others (and one)."""
    top = max(found, default=0.0)
    return top, math.log1p(max(0.0, math.fsum(found) - top))


def _measure(model, odds: dict[str, tuple[float, ...]], keep: list[str], curve: list[float] | None):
    """The columns keep with the features of each text, or with its score if there is a curve. model: broadcast.

    odds: of each word, without each part, then with all; a column part says which counts."""

    def run(batches):
        kept("toxicity")
        restorer = Restorer(model.value, lambda words: tuple((w, odds[w]) for w in words if w in odds))
        for batch in batches:
            x = np.zeros((batch.num_rows, 2))
            parts = batch.column("part").to_pylist() if curve is None else [PARTS] * batch.num_rows
            for i, (text, part) in enumerate(zip(batch.column("text").to_pylist(), parts, strict=True)):
                hits = {w: o[part] for found in restorer.of(restorer.tokens(text)) for w, o in found} if text else {}
                if hits:
                    x[i] = _features(list(hits.values()))
            same = [batch.column(c) for c in keep]
            if curve is None:
                yield pa.RecordBatch.from_arrays([*same, pa.array(x[:, 0]), pa.array(x[:, 1])], [*keep, "x0", "x1"])
            else:
                yield pa.RecordBatch.from_arrays([*same, pa.array(1 / (1 + np.exp(-(curve[0] + x @ np.array(curve[1:])))))], [*keep, "score"])

    return run


def fit_curve(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Logistic regression with a light ridge, by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(x.shape[1]), 1e-2 * np.eye(x.shape[1])
    ridge[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


class Model:
    """A fitted scorer; its costs of characters are broadcast."""

    def __init__(self, characters, odds: dict[str, tuple[float, ...]], curve: list[float] | None):
        self.characters, self.odds, self.curve = characters, odds, curve

    def scored(self, docs: DataFrame, keep: list[str]) -> DataFrame:
        """The columns keep of docs, and score."""
        if self.curve is None:
            return docs.select(*keep, F.lit(0.0).alias("score"))
        schema = docs.select(*keep).withColumn("score", F.lit(0.0)).schema
        return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(_measure(self.characters, self.odds, keep, self.curve), schema)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic."""
    # SYMBOLS ** ORDER bytes, whatever the corpus; each worker holds them once
    characters = docs.sparkSession.sparkContext.broadcast(character_model(docs))
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    order = F.crc32(F.concat(F.lit("fit"), F.col("doc_id").cast("string")).cast("binary"))
    known = known.select("doc_id", "toxic", (order % PARTS).cast("int").alias("part"), order.alias("order")).orderBy("order", "doc_id").limit(train_rows)
    # train_rows bounds what is broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "toxic", "part")
    total = np.zeros((2, PARTS + 1))  # clean and toxic rows without each part, then all
    for x in known.groupBy("toxic", "part").count().collect():
        total[x["toxic"]] += x["count"]
        total[x["toxic"], x["part"]] -= x["count"]
    if total[:, PARTS].min() == 0:
        return Model(characters, {}, None)
    counts = rows.mapInArrow(_word_counts(characters), "word string, part int, toxic long, clean long")
    by = [F.sum(F.when(F.col("part") == p, F.col(c)).otherwise(0)).alias(f"{c}{p}") for c in ("clean", "toxic") for p in range(PARTS)]
    counts = counts.groupBy("word").agg(F.sum("toxic").alias("k1"), F.sum("clean").alias("k0"), *by)
    error = F.sqrt(1 / (F.col("k1") + 0.5) + 1 / (F.col("k0") + 0.5))
    odds = F.log((F.col("k1") + 0.5) / F.lit(total[1, PARTS] + 1)) - F.log((F.col("k0") + 0.5) / F.lit(total[0, PARTS] + 1)) - ERRORS * error
    best = counts.where(F.col("k1") >= LEAST_ROWS).withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS)
    words = {}
    # LEAST_ROWS of train_rows texts hold each of them
    for x in best.collect():
        k = np.array([[x[f"{c}{p}"] for p in range(PARTS)] for c in ("clean", "toxic")])
        k = np.column_stack([k.sum(axis=1, keepdims=True) - k, k.sum(axis=1)])
        lifts = np.log((k[1] + 0.5) / (total[1] + 1)) - np.log((k[0] + 0.5) / (total[0] + 1)) - ERRORS * np.sqrt(1 / (k[0] + 0.5) + 1 / (k[1] + 0.5))
        words[x["word"]] = tuple(np.where(k[1] > 0, np.maximum(lifts, 0), 0).tolist())
    seen = rows.mapInArrow(_measure(characters, words, ["toxic"], None), "toxic int, x0 double, x1 double").toPandas()
    return Model(characters, words, fit_curve(seen[["x0", "x1"]].to_numpy(), seen["toxic"].to_numpy()))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = fit(docs, table(spark, sf_dir, "labels")).scored(docs, ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
