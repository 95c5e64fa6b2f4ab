r"""Pattern families over texts of runs of any length.

A run's text is never put together. It is cut into lines, and lines into pieces of SIZE that overlap: a pattern crosses the end of a line only where it allows white
space, so that a match spans at most as many lines with something on them as it has such places, and one. Pieces overlap by that many; what is matched in any piece is matched in
the run. A line is the least that a task holds; with an empty separator, a line may go on from one step to the next."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from .ordinals import BLOCK, numbered_by_ranges, running

#: Lines of a piece that aren't blank.
SIZE = 256


def crossings(pattern: str) -> int:
    """Places at which a match can go on after the end of a line."""
    bare = re.sub(r"\[\^[^\]]*\\n[^\]]*\]", "", re.sub(r"\\\\", "", pattern))  # classes that leave line ends out
    if re.search(r"\\[WDnRvHX]|\(\?[a-z]*s|\[\^", bare):
        raise ValueError(f"not bound to lines: {pattern}")
    return len(re.findall(r"\\s", bare))


def mask(text: Column, family: dict[str, str], flags: str) -> Column:
    """A bit for each pattern of a family that a text holds."""
    bits = F.lit(0).cast("long")
    for k, rx in enumerate(family.values()):
        bits = bits.bitwiseOR(F.when(text.rlike(flags + rx), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def names(bits: Column, family: dict[str, str]) -> Column:
    """Patterns of a mask, in the order of the family."""
    held = F.array(*(F.when(bits.bitwiseAND(F.lit(1 << k).cast("long")) != 0, F.lit(n)) for k, n in enumerate(family)))
    return F.filter(held, lambda x: x.isNotNull())


def lines(content: DataFrame, column: str, sep: str, dedup: bool, keys: tuple[str, ...]) -> DataFrame:
    """keys, event_index, line: lines of each run's texts in step order, empty texts left out; with dedup, each text once, at its first place."""
    rows = content.where(F.col(column) != "").select(*keys, "step_index", F.col(column).alias("_x"))
    if dedup:
        rows = rows.groupBy(*keys, "_x").agg(F.min("step_index").alias("step_index"))
    parts = F.split("_x", "\n", -1)
    rows = rows.select(*keys, "step_index", F.size(parts).alias("_parts"), F.xxhash64("_x").alias("_tie"), F.posexplode(parts).alias("_j", "line"))
    rows = numbered_by_ranges(rows, keys, ("step_index", "_tie", "_j", "line"))
    if sep == "\n":
        return rows.select(*keys, "event_index", "line")
    if sep != "":
        raise ValueError("texts are joined by nothing or by line ends")
    # the first part of a text goes on with the line before
    rows = rows.withColumn("_new", (F.col("_j") > 0).cast("long"))
    rows = running(rows, keys, "_new", "_line", block=BLOCK)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_index", "line"))), lambda p: p["line"]), "")
    return rows.groupBy(*keys, "_line").agg(whole.alias("line")).withColumnRenamed("_line", "event_index")


def matches(content: DataFrame, column: str, family: dict[str, str], sep: str = "\n", dedup: bool = False, keys: tuple[str, ...] = ("run_id",), flags: str = P.FLAGS, size: int = SIZE) -> DataFrame:
    """keys, matched: patterns of the family that each run's texts hold; runs without a text have no row."""
    over = max((crossings(rx) for rx in family.values()), default=0) + 1
    if over >= size:
        raise ValueError("pieces are longer than their overlap")
    rows = lines(content, column, sep, dedup, keys).withColumn("_full", F.col("line").rlike(r"(?U)\S").cast("long"))
    rows = running(rows, keys, "_full", "_k", block=BLOCK)
    # a piece has the lines from one with number b * size on, and those that it shares with the next
    own = F.floor(F.col("_k") / size)
    before = F.when((F.col("_k") % size <= over) & (own > 0), own - 1)
    rows = rows.withColumn("_b", F.explode(F.filter(F.array(own, before), lambda b: b.isNotNull())))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_index", "line"))), lambda p: p["line"]), "\n")
    pieces = rows.groupBy(*keys, "_b").agg(text.alias("_t")).select(*keys, mask(F.col("_t"), family, flags).alias("_m"))
    return pieces.groupBy(*keys).agg(F.bit_or("_m").alias("_m")).select(*keys, names(F.col("_m"), family).alias("matched"))
