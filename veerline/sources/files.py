"""Raw documents as rows, ledgers in and out, manifests."""

from __future__ import annotations

import hashlib
import json
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordinals import numbered_by_ranges
from ..schema import RECORD, checked
from .lines import placed_lines


def documents(spark: SparkSession, root: str, pattern: str = "*.json") -> DataFrame:
    """rel (path below root), text of each file below root that has any bytes and whose name fits. Files are read whole, one a row; a filter on rel
    rules out files before they are opened."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toUri().getPath().rstrip("/")
    # the path as a URI: its part below root
    path = F.regexp_replace("_metadata.file_path", "^[a-z0-9]+:(//[^/]*)?", "")
    return rows.select(F.substring(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), F.lit(len(base) + 2), F.lit(2**31 - 1)).alias("rel"), F.decode("content", "UTF-8").alias("text"))


def ranked(rows: DataFrame, order: tuple[str, ...], by: tuple[str, ...] = (), name: str = "run_index") -> DataFrame:
    """rows with their rank from 0 in a total order, within groups; of all rows, in ranges of the order, if there are no groups."""
    if not by:
        return ranked_of_all(rows, order, name)
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def ranked_of_all(rows: DataFrame, order: tuple, name: str) -> DataFrame:
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    named = rows.select("*", *(k.alias(f"_o{i}") for i, k in enumerate(keys)))
    order = tuple(f"_o{i}" for i in range(len(keys)))
    return numbered_by_ranges(named, (), order).withColumnRenamed("event_index", name).drop(*order)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON-lines files, strictly, with file and pos: the place that gives their order, however the files are split."""
    lines = placed_lines(spark, path).select(F.col("value").alias("line"), "file", F.col("place").alias("pos"))
    return checked(lines).select(*RECORD.fieldNames(), "file", "pos")


def read_sidecar(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON-lines files that stand beside a ledger, with pos."""
    lines = placed_lines(spark, path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("_r"), F.col("place").alias("pos")).select("_r.*", "pos")


def lockstep(ledger: DataFrame, sidecar: DataFrame, keys: tuple[str, ...] = ("run_id", "step_index")) -> DataFrame:
    """ledger with the other columns of a sidecar whose line n is of the ledger's line n. A sidecar that is shorter or longer, or has
    other keys at a place, is an error; equal keys at several places are several rows, each with its own line."""
    left, right = (ranked_lines(d) for d in (ledger, sidecar))
    mine = right.select("_n", *(F.col(k).alias(f"_{k}") for k in keys), *(c for c in sidecar.columns if c not in (*keys, "pos", "file")), F.lit(True).alias("_r"))
    both = left.withColumn("_l", F.lit(True)).join(mine, "_n", "full")
    same = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    fault = F.concat(F.lit("ledger and sidecar differ at line "), F.col("_n").cast("string"))
    return both.where(F.when(~same, F.raise_error(fault).cast("boolean")).otherwise(F.lit(True))).drop("_l", "_r", "_n", *(f"_{k}" for k in keys))


def ranked_lines(rows: DataFrame) -> DataFrame:
    """rows (with pos) with _n: their rank, as blank lines leave holes in the places."""
    return numbered_by_ranges(rows, (), ("pos",)).withColumnRenamed("event_index", "_n")


def as_json(records: DataFrame) -> DataFrame:
    """One column, value: each record as JSON with sorted keys."""
    return records.select(F.to_json(F.struct(*sorted(RECORD.fieldNames())), {"ignoreNullFields": "false"}).alias("value"))


def write_ledger(records: DataFrame, path: str, order: tuple[str, ...] = ("run_id", "step_index")) -> None:
    """Records as JSON lines in an order: range-partitioned, so that files in order hold rows in order."""
    as_json(records.orderBy(*order)).write.text(path)


def write_table(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """The default sink: Parquet, parted by the columns that readers select on."""
    df.write.partitionBy(*by).parquet(path)


def aligned(ledger: DataFrame, sidecar: DataFrame, *others: str) -> DataFrame:
    """ledger with the sidecar's columns, by (run_id, step_index); a row that only one of them has is an error."""
    keys = ["run_id", "step_index"]
    left = ledger.withColumn("_l", F.lit(True))
    right = sidecar.select(*keys, *others, F.lit(True).alias("_r"))
    both = left.join(right, keys, "full")
    fault = F.concat_ws(" ", F.lit("ledger and sidecar differ at"), "run_id", "step_index")
    return both.where(F.when(F.col("_l").isNull() | F.col("_r").isNull(), F.raise_error(fault).cast("boolean")).otherwise(F.lit(True))).drop("_l", "_r")


def content_digest(df: DataFrame) -> dict:
    """Rows of a table and a digest that doesn't depend on their order: sums of parts of each row's SHA-256."""
    h = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    parts = [F.coalesce(F.sum(F.conv(F.substring(h, 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)")), F.lit(0)).alias(f"s{k}") for k in range(8)]
    row = df.agg(F.count(F.lit(1)).alias("n"), *parts).first()
    return {"n": row["n"], "sha256": hashlib.sha256("/".join(str(row[f"s{k}"]) for k in range(8)).encode()).hexdigest()}


def write_manifest(path: str, **tables: DataFrame) -> dict:
    """A manifest of tables: rows and digest of each, as JSON in a file."""
    manifest = {name: content_digest(df) for name, df in sorted(tables.items())}
    df = next(iter(tables.values()))
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(str(PurePosixPath(path)) if "://" not in path else path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(json.dumps(manifest, sort_keys=True, indent=1).encode()))
    out.close()
    return manifest
