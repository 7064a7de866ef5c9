"""A corpus from raw documents to packed training sequences, in five stages.

Every stage works on all that its predecessor kept. ``run`` writes each stage's result to
the shared folder and reads it again, which cuts the lineage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseload.llm import language_id, packing, quality, secrets, simhash
from caseload.llm.common import table
from caseload.session import configure, materialise

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages of the labelled rows.

    Rejected: null texts, texts without a letter, and texts that no language's coder
    makes shorter than their bytes.
    """
    docs = configure(spark) and docs.select(*COLUMNS)
    found = language_id.identify(docs, language_id.train(docs), COLUMNS)
    return found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("bits_per_byte") < 8)).select(*COLUMNS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labelled ones among them, takes for good."""
    docs = configure(spark) and docs.select(*COLUMNS)
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, COLUMNS).where("predicted = 1").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the smallest id.

    Of rows with the same id one stays; rows without an id cannot be told apart and stay.
    """
    docs = configure(spark) and docs.select(*COLUMNS)
    found = simhash.near_duplicates(docs)
    kept = found.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    named = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.select(*COLUMNS).unionByName(docs.where(F.col("doc_id").isNull()))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every span found replaced by a mask."""
    docs = configure(spark) and docs.select(*COLUMNS)
    found = secrets.scan(docs, secrets.train(docs), COLUMNS)
    masked = found.withColumn("text", secrets.redacted(F.col("text"), F.col("found")))
    changed = F.when(F.size("found") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return masked.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    return packing.pack(configure(spark) and docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", keep_language),
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("packing", pack),
]

# No SQL: trained models and a trained tokenizer decide; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
