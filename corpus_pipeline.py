"""Corpus pipeline: toxicity, exact dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame; all
but the last return the columns of documents, whatever they are. A stage of an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnweave.llm.common import documents, work_path
from tarnweave.llm.exact_dedup import drop_exact_copies
from tarnweave.llm.mixing import mixed_documents
from tarnweave.llm.packing import pack
from tarnweave.llm.simhash import drop_near_copies
from tarnweave.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score below 0.5 stay, each by its own text: repeated ids and rows stay or go one by one, null and empty
    texts stay. The machine is trained on the documents of sf_dir, whatever docs holds."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), documents(spark, sf_dir))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text (white space runs count as one space, null as empty) stays: that with the smallest id, a null id
    last; of rows that share the id that with the least hash of all columns."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked fingerprints stays: that with the smallest id, a null id last; of rows that share the id
    that with the least digest of its text. Null and wordless texts are one group."""
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, 0 to 2 times; texts without words are not taken; a null source is one of its
    own; equal rows are sampled as rows of their own."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences of all rows with their batches and texts; texts without words give none; equal rows are packed like any."""
    return pack(docs, with_text=True)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: Toxicity, near-dedup, sampling and bucket search cannot be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        path = work_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
