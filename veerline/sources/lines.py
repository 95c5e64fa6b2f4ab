r"""Text files whose order matters, in any number of tasks: places of lines, members of one huge JSON object.

Spark reads a text file in byte ranges, also when its records end with something other than a line end. A record's place is its number
within its range plus the records of all ranges before, so it doesn't depend on how the file was split.

A JSON object of any size is cut at its closing braces. Which of them count depends on whether a brace is within a string, and how deep it is: what a piece does
to either is told from the piece alone, for both states in which it may begin, and running sums in two levels put the pieces together. No task reads the file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordinals import running

#: Pieces that are summed at once.
BLOCK = 1 << 16


def placed_lines(spark: SparkSession, path: str, sep: str = "\n") -> DataFrame:
    """file, place (from 0, over all files in the order of their names), value of each record that ends with sep."""
    rows = spark.read.option("lineSep", sep).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id"), "value")
    # within a range, rows are numbered in the order of their ids; a range is one task's
    here = Window.partitionBy("file", "_at").orderBy("_id")
    sizes = rows.groupBy("file", "_at").agg(F.count(F.lit(1)).alias("_n"))  # a row a range
    before = Window.partitionBy(F.lit(0)).orderBy("file", "_at").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("file", "_at", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return rows.withColumn("_i", F.row_number().over(here) - 1).join(starts, ["file", "_at"]).select("file", (F.col("_start") + F.col("_i")).cast("long").alias("place"), "value")


def json_members(spark: SparkSession, path: str) -> DataFrame:
    """key and value (JSON text, strings bare) of each member of the JSON objects in files; of equal keys of a file, the last one."""
    rows = placed_lines(spark, path, "}").withColumnRenamed("place", "event_index")
    # without escapes, each quote opens or closes a string; parts between quotes are outside and inside of strings by turns
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    parts = F.split(plain, '"', -1)
    deeper = lambda x: F.regexp_count(x, F.lit(r"[{\[]")) - F.regexp_count(x, F.lit(r"\]"))
    opened = lambda odd: F.aggregate(F.filter(parts, lambda _, i: i % 2 == odd), F.lit(0), lambda a, x: a + deeper(x))
    rows = rows.select("file", "event_index", "value", (F.size(parts) - 1).alias("_q"), opened(0).alias("_even"), opened(1).alias("_odd"))
    rows = running(rows, ("file",), "_q", "_quotes", block=BLOCK)
    last = F.col("event_index") == F.col("_last")
    ends = rows.groupBy("file").agg(F.max("event_index").alias("_last"))  # a row a file
    inside = lambda quotes: quotes % 2 == 1
    rows = rows.join(ends, "file").withColumn("_closes", ~inside(F.col("_quotes")) & ~last)
    rows = rows.withColumn("_d", F.when(inside(F.col("_quotes") - F.col("_q")), F.col("_odd")).otherwise(F.col("_even")) - F.col("_closes").cast("int"))
    rows = running(rows, ("file",), "_d", "_depth", block=BLOCK)
    # a brace that leads back to the outermost object ends a member
    rows = rows.withColumn("_e", (F.col("_closes") & (F.col("_depth") <= 1)).cast("int"))
    rows = running(rows, ("file",), "_e", "_ends", block=BLOCK)
    piece = F.concat("value", F.when(last | (F.col("_closes") & (F.col("_depth") < 1)), "").otherwise("}"))
    rows = rows.select("file", (F.col("_ends") - F.col("_e")).alias("member"), F.struct(F.col("event_index").alias("i"), piece.alias("x")).alias("p"))
    texts = rows.groupBy("file", "member").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["x"]), "").alias("text"))
    bare = F.regexp_replace("text", r"(?s)^\s*[{,]?\s*", "")
    found = texts.where(bare.startswith('"')).select("file", "member", F.posexplode(F.map_entries(F.from_json(F.concat(F.lit("{"), bare, F.lit("}")), "map<string,string>"))).alias("_k", "_m"))
    newest = F.max_by("_m.value", F.struct("member", "_k"))
    return found.groupBy("file", F.col("_m.key").alias("key")).agg(newest.alias("value")).select("key", "value")
