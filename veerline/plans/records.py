"""The driver's tables as tables of records, content and labels; in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ORIGIN = "2024-01-01 00:00:00"
#: Records before it are the baseline's.
CUT = "2024-01-16 00:00:00"

#: The order of records within an agent or a run.
ORDER = ("us", "event_id")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str, until: str | None = None) -> DataFrame:
    """events as records, with event_id, us (microseconds from ORIGIN), value and base (whether in the baseline).

    until: a time before which records are read; the scan takes it. A prefix in time keeps all steps as they are."""
    e = table(spark, sf_dir, "events")
    if until is not None:
        e = e.where(F.col("ts") < F.lit(until).cast(dict(e.dtypes)["ts"]))
    stamp = lambda c: F.unix_micros(c.cast("timestamp"))
    us = stamp(F.col("ts")) - stamp(F.lit(ORIGIN))
    rows = e.select("event_id", us.alias("us"), "user_id", F.col("event_type").alias("tool"), "value", "props")
    day = F.floor(F.col("us") / 86_400_000_000)
    rows = rows.select(
        "event_id", "us", (F.col("us") / 1e6).alias("ts"), F.concat(F.lit("u"), F.col("user_id")).alias("agent_id"),
        F.concat(F.lit("u"), F.col("user_id"), F.lit("-w"), F.floor(day / 7)).alias("run_id"),
        F.concat(F.lit("g"), F.col("user_id") % 4).alias("goal_id"), "tool", F.substring(F.sha2("props", 256), 1, 12).alias("params_hash"),
        F.when(F.col("tool") == "error", "error").when(F.col("value") < 1, "abort").otherwise("ok").alias("status"),
        F.lit("m").alias("model"), F.concat(F.lit("v"), F.floor(day / 10)).alias("model_version"), "value",
        (F.col("us") < stamp(F.lit(CUT)) - stamp(F.lit(ORIGIN))).alias("base"))
    step = F.row_number().over(Window.partitionBy("run_id").orderBy(*ORDER)) - 1
    return rows.withColumn("step_index", step)


RECORDS = """
WITH r0 AS (SELECT event_id, CAST(date_diff('microsecond', TIMESTAMP '2024-01-01', ts) AS BIGINT) AS us, user_id, event_type AS tool, value, props FROM events),
r1 AS (SELECT *, us / 1e6 AS ts, us // 86400000000 AS day FROM r0),
r2 AS (SELECT event_id, us, ts, 'u' || user_id AS agent_id, 'u' || user_id || '-w' || (day // 7) AS run_id, 'g' || (user_id % 4) AS goal_id,
         tool, substr(sha256(props), 1, 12) AS params_hash, CASE WHEN tool = 'error' THEN 'error' WHEN value < 1 THEN 'abort' ELSE 'ok' END AS status,
         'm' AS model, 'v' || (day // 10) AS model_version, value, us < 15 * 86400000000 AS base FROM r1),
r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY us, event_id) - 1 AS step_index FROM r2)
"""


def content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as content: run_id, step_index, label, text."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.concat(F.lit("c"), F.col("conv_id")).alias("run_id"), F.col("turn").cast("int").alias("step_index"), F.col("role").alias("label"), "text")


CONTENT = """
WITH c AS (SELECT 'c' || conv_id AS run_id, CAST(turn AS INTEGER) AS step_index, role AS label, text FROM conversations)
"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with labels as runs: run_id, source, text, toxic, low (both boolean)."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.select(F.concat(F.lit("d"), F.col("doc_id")).alias("run_id"), "source", "lang", "text", (F.col("toxic") == 1).alias("toxic"), (F.col("quality") == 0).alias("low"))


LABELLED = """
WITH d AS (SELECT 'd' || doc_id AS run_id, source, lang, text, toxic = 1 AS toxic, quality = 0 AS low FROM documents JOIN labels USING (doc_id))
"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with their items as a second ledger: run_id, goal_id, tool, status, ts. Its steps have no order of note."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.select(F.concat(F.lit("o"), F.col("o_orderkey")).alias("run_id"), F.col("o_orderpriority").alias("goal_id"), F.concat("l_returnflag", "l_linestatus").alias("tool"),
                       F.when(F.col("o_orderstatus") == "F", "error").otherwise("ok").alias("status"), "o_orderdate")


LEDGER = """
WITH l AS (SELECT 'o' || o_orderkey AS run_id, o_orderpriority AS goal_id, l_returnflag || l_linestatus AS tool,
             CASE WHEN o_orderstatus = 'F' THEN 'error' ELSE 'ok' END AS status, o_orderdate FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
"""
