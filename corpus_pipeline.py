"""From raw documents to token ids: five filters and transformations in turn.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns
a frame that is written as Parquet and read again as the next one's input. All but
the last return the columns of ``documents``. A null or empty text passes every stage and
ends with no ids; rows with a null doc_id cannot be told apart and pass the near-duplicate
and benchmark stages. Extra columns travel along unchanged, as names that the stages add
begin with two underscores; only the last adds ``ids``, ``n_bytes`` and ``exact``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routescope.llm import dartminhash, decontaminate, secretscan, toxicity, wfst
from routescope.llm.labelled import fold
from routescope.llm.queries import table, vocabulary
from routescope.llm.tables import saved


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below one half; learned from four fifths of the labels."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~fold("doc_id", 5, 0))
    return toxicity.score(docs, model, docs.columns, "__score").where(F.col("__score") < 0.5).select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class, the one with the smallest id."""
    return dartminhash.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, found secrets replaced by a mark."""
    return secretscan.redact(docs)


def with_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their SentencePiece ids."""
    return wfst.encode(docs, wfst.compiled(vocabulary("piece_bpe_32k.model")), docs.columns)


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("sentencepiece", with_ids),
]

# Scores of a trained network and merges of a vocabulary file are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
