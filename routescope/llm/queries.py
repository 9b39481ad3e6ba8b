"""The numbered queries, thin over the operators, with SQL twins where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routescope.llm import (
    chat, dartminhash, decontaminate, factors, forest, idfiles, languages, repair, secretscan, shallot, simhash, toxicity, wfst,
)
from routescope.llm.labelled import fold
from routescope.sources.landing import fresh_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies; every machine has the package that holds them."""
    return public_tokenizers.path(name)


def _classified(spark: SparkSession, folder: str, operator, cut: float) -> DataFrame:
    docs = table(spark, folder, "documents")
    held = fold("doc_id", 5, 0)
    model = operator.fit(docs.where(~held), table(spark, folder, "labels"), ~held)  # texts that teach nothing are not moved
    rows = operator.score(docs, model, ["doc_id"])
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


@query("op1_sentencepiece")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    coded = wfst.encode(table(spark, folder, "documents"), wfst.compiled(vocabulary("piece_bpe_32k.model")), ["doc_id"])
    return coded.select("doc_id", "ids", F.size("ids").cast("bigint").alias("n_ids"), "n_bytes", "exact")


@query("op2_secrets", secretscan.twin())
def op2(spark: SparkSession, folder: str) -> DataFrame:
    found = secretscan.find(table(spark, folder, "documents"), ["doc_id"])
    count = lambda low, high: F.size(F.filter("spans", lambda s: s["rank"].between(low, high))).cast("bigint")
    return found.select(
        "doc_id", *[count(k, k).alias(f"n_{secretscan.KINDS[k]}") for k in range(3)],
        F.sha2(secretscan.written(F.col("base")), 256).alias("base_sha256"), secretscan.written(F.col("spans")).alias("spans"),
        count(3, len(secretscan.KINDS)).alias("n_linked"))


@query("op3_dartminhash")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return dartminhash.near_duplicates(table(spark, folder, "documents"))


@query("op8_decontamination")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op9_toxicity")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return _classified(spark, folder, toxicity, 0.5)


@query("op10_quality")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return _classified(spark, folder, factors, 0.3)


CONTROL = "<|im_end|><|im_start|>assistant ok"


@query("op4_chat")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], given.schema)
    vocabulary_file = vocabulary("byte_bpe_50k.json")
    return chat.digests(chat.formatted(given.unionAll(added), vocabulary_file), vocabulary_file)


@query("op5_forest")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return forest.search(table(spark, folder, "embeddings"), F.col("id") % 20 == 0, 20)


@query("op6_idfiles")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    place = fresh_folder(spark, "ids")
    shards = idfiles.write(table(spark, folder, "documents"), place, vocabulary("word_bpe_49k.json"))
    return idfiles.read(spark, place, shards)


@query("op7_language")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held = fold("doc_id", 4, 2)
    rows = languages.predict(docs, languages.fit(docs, ~held), ["doc_id"])
    return rows.select("doc_id", held.alias("held_out"), "lang_pred", "score")


@query("op11_repair", repair.twin())
def op11(spark: SparkSession, folder: str) -> DataFrame:
    conversations = table(spark, folder, "conversations")
    return repair.report(conversations, repair.faults(repair.damaged(conversations)))


@query("op12_simhash")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query("op13_shallot", shallot.twin())
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return shallot.described(*shallot.clustered(table(spark, folder, "embeddings")))
