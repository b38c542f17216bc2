"""The corpus pipeline: toxicity, exact copies, near copies, personal data, packing.

``STAGES`` are (name, function of (spark, docs, sf_dir)); each works on all that
the one before it kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import exact, jaccard, packing, pii, queries, toxicity
from millrace.llm.common import crc_mod, staged


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fits on the labelled documents of the training fold and drops what scores 0.7 or more.

    Each row is judged by its text alone; without labels of both classes nothing
    is learned and all rows stay. A label counts for all rows of its id.
    """
    model = toxicity.fit(docs.filter(crc_mod("doc_id", 3) != 1), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text stays: that with the largest id; rows that repeat it with its id stay too. Null counts as the empty text."""
    return exact.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at 0.8 stays: that with the smallest id; texts without words stay."""
    return jaccard.keep_one(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become ``[KIND]``; ``n_chars`` follows the text; no row goes."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their ids and their places in sequences of at most 1024; a null or empty text is its end alone, rows that repeat an id are packed each."""
    return packing.pack_documents(docs, *queries.tokenizer(), with_ids=True)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("PII", redact_personal_data),
    ("best-fit packing", pack_sequences),
]

#: No SQL states the trained classifier or the packing; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
