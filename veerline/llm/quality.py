"""Quality rules as a short-circuit cascade, with DataFrame functions only.

Every document gets the base measures. The rules of the method are then tried in an order that
is estimated on a bounded sample, the SAMPLE_ROWS rows of least hash of the doc_id: rejections per cost first. A rule's cost
is the time that REPEATS evaluations of each row of the sample take beyond those of a constant rule, as a power of four, so that noise
doesn't change the order. A document stops at the first rule that rejects it, so that later rules aren't evaluated for it.
Since a document is kept only if no rule rejects it, the order changes the cost and the reported rule, never the verdict.

Words repeated in 3-word windows are found within the row, in time n log n for n words: windows
are hashed to 32 bits above their position and sorted as numbers; neighbours of equal hash are
candidates, and only these are compared as strings.

Defined results: a null text has no words and no lines; a text without words fails the base
rule; repeated rows are rated each on its own; an empty table gives an empty table; other columns
aren't read, and stay as they are, whatever their names.
"""

from __future__ import annotations

import math
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import SPACE, WORD, table

#: Fewest words, and highest percentage of words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 50, 50
SYMBOLS = "[#*$%&|<>]"
#: Rows of the sample on which the order of the rules is estimated, and evaluations of each.
SAMPLE_ROWS, REPEATS = 500, 32
_BITS, _LOW = 31, (1 << 31) - 1


@dataclass(frozen=True)
class Rule:
    """rejects: over the columns text, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""

    name: str
    rejects: Column


def rules() -> list[Rule]:
    n = F.col("n_words")
    hits = lambda pattern: F.regexp_count("text", F.lit(pattern))
    return [
        Rule("symbols", F.col("n_symbols") * 5 > n),
        Rule("dup_lines", F.col("n_dup_lines") * 2 > F.col("n_lines")),
        Rule("word_length", (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n)),
        Rule("shouting", hits(f"(?<![^{SPACE}])[^{SPACE}]*!!(?![^{SPACE}])") * 2 > n),
        Rule("no_letters", hits(rf"(?<![^{SPACE}])[^{SPACE}\p{{L}}]+(?![^{SPACE}])") * 2 > n),
        Rule("ellipsis", hits(r"(?m)(?:\.\.\.|…)[\x20\x09]*$") * 2 > F.col("n_lines")),
    ]


def measures(docs: DataFrame) -> DataFrame:
    """doc, text (of docs; other names are the measures' own) with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words, all long."""
    at = lambda name: (lambda i: F.get(name, i))
    trimmed = F.btrim("text", F.lit(" \t\n\x0b\x0c\r"))
    words = F.when(trimmed.isNull() | (trimmed == ""), F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACE}]+"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    d = docs.withColumn("_w", words).withColumn("_l", lines)
    d = d.withColumn("_n", F.size("_w")).withColumn("n_lines", F.coalesce(F.size("_l"), F.lit(0)).cast("long"))
    upto = lambda last: F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    w, s, c, k = map(at, ("_w", "_s", "_c", "_k"))
    hashed = F.transform(upto(F.col("_n") - 3), lambda i: F.shiftleft(F.xxhash64(w(i), w(i + 1), w(i + 2)), _BITS).bitwiseOR(i.cast("long")))
    d = d.withColumn("_s", F.sort_array(hashed))
    above = F.filter(upto(F.size("_s") - 2), lambda i: F.shiftright(s(i), _BITS) == F.shiftright(s(i + 1), _BITS))
    d = d.withColumn("_a", above)
    near = F.array_distinct(F.flatten(F.transform("_a", lambda i: F.array(s(i).bitwiseAND(_LOW).cast("int"), s(i + 1).bitwiseAND(_LOW).cast("int")))))
    d = d.withColumn("_c", near)
    full = F.transform("_c", lambda i: F.struct(F.concat_ws(" ", w(i), w(i + 1), w(i + 2)).alias("x"), i.alias("i")))
    d = d.withColumn("_k", F.sort_array(full))
    same = F.filter(upto(F.size("_k") - 2), lambda i: k(i)["x"] == k(i + 1)["x"])
    d = d.withColumn("_e", same)
    cover = F.flatten(F.transform("_e", lambda i: F.flatten(F.transform(F.array(k(i)["i"], k(i + 1)["i"]), lambda p: F.array(p, p + 1, p + 2)))))
    chars = F.coalesce(F.length(F.translate("text", " \t\n\x0b\x0c\r", "")), F.lit(0))
    d = d.withColumn("n_repeat_words", F.size(F.array_distinct(cover)).cast("long"))
    d = d.withColumn("n_dup_lines", F.coalesce(F.size("_l") - F.size(F.array_distinct("_l")), F.lit(0)).cast("long"))
    d = d.withColumn("n_words", F.col("_n").cast("long")).withColumn("word_chars", chars.cast("long"))
    d = d.withColumn("n_symbols", F.coalesce(F.regexp_count("text", F.lit(SYMBOLS)), F.lit(0)).cast("long"))
    return d.drop(*(f"_{x}" for x in "wlnsacke"))


def estimate(sample: DataFrame, among: list[Rule]) -> list[tuple[float, Rule]]:
    """Rejections per cost of each rule on a sample (which has the measures), best first."""
    many = sample.withColumn("_again", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))

    def took(rejects: Column) -> tuple[float, int]:
        began = time.perf_counter()
        n = many.select(F.count_if(F.coalesce(rejects, F.lit(False)))).first()[0]
        return time.perf_counter() - began, n // REPEATS

    constant = F.col("n_words") < 0
    took(constant)
    least = min(took(constant)[0] for _ in range(2))
    found = []
    for rule in among:
        seconds, rejected = took(rule.rejects)
        cost = 4.0 ** round(math.log(max(seconds - least, 1e-3), 4))
        found.append((rejected / cost, rule))
    return sorted(found, key=lambda x: (-x[0], x[1].name))


def rated(docs: DataFrame, among: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs, as they are, with a struct rating (with as many _ before it as make the name new): the measures, base_failed,
    kept and reason (the rule that rejected a row, null if it is kept)."""
    name = "rating"
    while name in docs.columns:
        name = "_" + name
    rows = docs.select(F.struct("*").alias("doc"), F.col("text").alias("text"))
    among = rules() if among is None else among
    first = docs.select("doc_id", "text").orderBy(F.xxhash64("doc_id"), F.xxhash64("text")).limit(sample_rows)
    sample = measures(first.select("text")).coalesce(1).persist()
    try:
        sample.count()
        order = [rule for _, rule in estimate(sample, among)]
    finally:
        sample.unpersist()
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    d = measures(rows).withColumn("base_failed", base)
    reason = F.when(F.col("base_failed"), "base")
    for rule in order:
        reason = reason.when(rule.rejects, rule.name)
    d = d.withColumn("reason", reason).withColumn("kept", F.col("reason").isNull())
    return d.select("doc.*", F.struct("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "reason").alias(name))


def op6_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", *(f"rating.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))


SQL = r"""
WITH d AS (SELECT doc_id, text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, text, w, l, row_number() OVER () AS k, len(w) AS n FROM d),
x AS (SELECT k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM (SELECT k, w, unnest(range(1, n - 1)) AS i FROM g)),
r AS (SELECT k, i FROM x QUALIFY count(*) OVER (PARTITION BY k, x) > 1),
c AS (SELECT k, count(DISTINCT p) AS n_repeat FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY k),
m AS (SELECT doc_id, text, w, l, CAST(n AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words FROM g LEFT JOIN c USING (k)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols * 5 > n_words OR n_dup_lines * 2 > len(l) OR word_chars < 2 * n_words OR word_chars > 20 * n_words
    OR len(list_filter(w, lambda x: x[-2:] = '!!')) * 2 > n_words OR len(list_filter(w, lambda x: NOT regexp_matches(x, '\p{L}'))) * 2 > n_words
    OR len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09]*$'))) * 2 > len(l)) AS kept
FROM b
"""
