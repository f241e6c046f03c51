"""A training corpus from the documents table: five stages, each a table in, a table out.

Stages read what the one before has written. All but the last return rows with
the columns of documents; the last returns packed sequences.

* language: documents without a letter, or far from every centroid of the
  languages learned from the table's own labels, go;
* near_duplicates: of documents whose five-word shingles are similar at 0.8 or
  more (directly or by way of others) the one with the least doc_id stays;
* secrets: spans of secrets are replaced by a mark, n_chars counted anew;
* mixing: documents are repeated or left out so that sources come to their targets;
* packing: token ids of all documents, in sequences of at most 2048.

Null and empty texts go in the first stage; the operators' modules state the
results for other odd input. An empty table passes through as empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mdloom.llm import language_id, mixing, ngram_join, packing, secrets
from mdloom.llm.common import load, written
from mdloom.session import ship_package


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    model = language_id.fit(docs.select("doc_id", "text", "lang"), F.lit(True))
    return language_id.known(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return ngram_join.one_of_each(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return secrets.masked(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return mixing.as_mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return packing.pack_documents(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secrets", mask_secrets), ("mixing", mix), ("packing", pack)]

#: Trained models, a seeded draw and a tokenizer are beyond SQL; tests/llm compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
