"""Shell words against Python's own lexer."""

import random
import re
import shlex

from pyspark.sql import functions as F

from veerline.functions.shell import LONGEST_WORD, command_tokens, shell_words


def by_shlex(text):
    out = []
    for line in (text or "").splitlines():
        try:
            out += shlex.split(line)
        except ValueError:  # an open quote
            out += line.split()
    return out


def by_kind(words, tool):
    kinds = lambda w: "<num>" if re.fullmatch(r"\d+(\.\d+)?", w) else "<hex>" if re.fullmatch("[0-9a-fA-F-]{12,}", w) else "<long>" if len(w) > LONGEST_WORD else w
    return [kinds(w) for w in words] or [tool]


CASES = ["a 12 3.5 abcdef012345 " + "x" * 65, "it's open", "'a b' c\n", "", " \n", None, "a\\ b", "a\\", '"a \\"b\\" \\c \\\\"', "''", '"" x', "a''b\"c d\"e", "'\\'", "#no comment", "x\u00a0y 'z", "a\x0bb\x1cc\u2028d\re\r\nf", "\u3000 '", "\u0663\u0664 1.", "$(x) | y > z && w;", "\ud83d\ude42 '\ud83d\ude42 x'".encode("utf-16", "surrogatepass").decode("utf-16")]


def test_shell_words(spark):
    rng = random.Random(12)
    alphabet = list("ab 1\t\"'\\\n") + ["é", "\r", "\x0b", "\u2029", "\xa0", "-", "0"]
    texts = CASES + ["".join(rng.choices(alphabet, k=rng.randint(1, 30))) for _ in range(1500)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    got = df.select("i", shell_words("t").alias("w"), command_tokens("t", F.lit("tool")).alias("k"))
    assert "Python" not in got._jdf.queryExecution().toString()
    for r in got.collect():
        want = by_shlex(texts[r["i"]])
        assert (r["w"], r["k"]) == (want, by_kind(want, "tool")), repr(texts[r["i"]])


def test_long_commands(spark):
    """Loops of a million rounds, which a recursive matcher can't do."""
    texts = ["\\a" * 500_000, '"' + '\\"x' * 400_000 + '"', "a'b'" * 300_000, "x " * 300_000 + "'", "'" + "y z" * 500_000 + "'"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").repartition(2)
    got = {r["i"]: (r["n"], r["h"]) for r in df.select("i", F.size(shell_words("t")).alias("n"), F.sha2(F.array_join(shell_words("t"), "\x00"), 256).alias("h")).collect()}
    import hashlib

    for i, t in enumerate(texts):
        want = by_shlex(t)
        assert got[i] == (len(want), hashlib.sha256("\x00".join(want).encode()).hexdigest())
