"""A corpus pipeline of five stages; each works on all that the one before kept.

1. toxicity: documents whose restored text scores as toxic go
2. near duplicates: one document of each group stays, the one of smallest doc_id (five-word shingles, similarity 0.8)
3. secrets: credentials that aren't widely copied are put out of the texts
4. mixing: documents in the order of the mix, repeated or left out as the sources' targets ask for
5. packing: pieces of the documents with the sequence and place that each gets

All stages: an empty table gives an empty table; other columns, whatever their names, pass through the first four (but for
n_chars, which follows the text); texts of any length are worked on whole. Rows of no use to a stage are named below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veerline.folders import made, remove_but
from veerline.llm import minhash, mixing, packing, secrets, toxicity
from veerline.llm.shared import bounded_reads, staged, table
from veerline.llm.token_ids import vocabulary


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that don't score as toxic. Null and empty texts score like ones without a known word, and stay; equal texts
    share a fate, so repeated rows and ties stay or go together; without labels of both kinds all rows stay."""
    bounded_reads(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    rows = docs.select(F.struct("*").alias("doc"), F.col("text").alias("text"))
    return model.scored(rows, ["doc"]).where(F.col("score") < 0.5).select("doc.*")


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, the one of smallest doc_id, and of rows of equal doc_id, the smallest of
    all columns; rows without a doc_id (or with one that is no number) stay, and so do null and empty texts of doc_ids of their own."""
    bounded_reads(spark)
    found = staged(minhash.near_duplicates(docs).where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_found")).agg(
        F.min("kept").alias("kept"), F.count(F.lit(1)).alias("n")).where("NOT kept OR n > 1"), "dropped")
    n = found.count()
    near = (lambda d: F.broadcast(d)) if n <= minhash.MOST_BROADCAST else (lambda d: d)
    same = docs["doc_id"].try_cast("long") == found["_found"]
    once = docs.join(near(found.select("_found")), same, "left_anti")
    if not found.where("kept").head(1):
        return once
    again = docs.join(near(found.where("kept").select("_found")), same, "left_semi")
    first = again.groupBy(F.col("doc_id").try_cast("long").alias("_found")).agg(F.min(F.struct("*")).alias("doc")).select("doc.*")
    return once.unionByName(first).select(*docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; credentials that look live and aren't widely copied are put out of their texts. Null texts stay null, and
    repeated rows are treated alike; a null source is an owner of its own."""
    bounded_reads(spark)
    return secrets.redacted(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: words of a source are taken up to its target. Texts without words (null, empty) aren't
    taken; a null source is a source of its own; repeated rows are documents of their own."""
    bounded_reads(spark)
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces and their places in sequences. Null and empty texts have one piece of the end id; rows of equal doc_id, as
    the mix has them, are documents of their own."""
    bounded_reads(spark)
    return packing.pack(packing.pieces(docs, vocabulary()))


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicates_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The stages use a fitted model, hashes and a tokenizer, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read back."""
    docs, before = table(spark, sf_dir, "documents"), made()
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
        # what the stage wrote on its way, and what it read, is of no more use
        remove_but(spark, before | {docs._staged_path})
    return STAGES[-1][1](spark, docs, sf_dir)
