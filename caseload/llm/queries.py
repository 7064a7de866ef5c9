"""The registered queries: each operator on its whole table, with its digest columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseload.llm import (
    alignment, bpe, embedding_dups, language_id, max_entropy, merkle, packing, quality, revisits, secrets, simhash, top_k, toxicity,
)
from caseload.llm.common import id_remainder, table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(id_remainder("doc_id", 5) != 0)
    scored = quality.score(docs, quality.train(docs, labels), ["doc_id"])
    return scored.select("doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    coder = language_id.train(docs.where(id_remainder("doc_id", 3) != 1))
    found = language_id.identify(docs, coder, ["doc_id"])
    held_out = (id_remainder("doc_id", 3) == 1).alias("held_out")
    return found.select("doc_id", held_out, "lang_pred", "score", "bits_per_byte")


def op4_max_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = id_remainder("doc_id", 7) == 2
    scored = max_entropy.score(docs, max_entropy.train(docs.where(~held_out)))
    return scored.withColumn("held_out", held_out)


def op5_embedding_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dups.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.train(docs), ["doc_id"])

    def number(kind):
        of = secrets.KINDS.index(kind) + 1
        return F.size(F.filter("base", lambda s: s["kind"] == of)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[number(kind) for kind in secrets.KINDS[:3]],
        F.sha2(secrets.listed("base"), 256).alias("base_sha256"),
        secrets.listed("found").alias("spans"),
    )


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, ["doc_id"])


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisits.resolve(revisits.captures_of_pages(table(spark, sf_dir, "pages")), revisits.HEADERS)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return found.select("doc_id", digits, "component_id")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.when(id_remainder("doc_id", 5) == 0, merkle.lower_ascii(F.col("text"))).otherwise(F.col("text"))
    proved = merkle.prove(docs, tampered)
    return proved.select(
        "doc_id", "leaf", "subroot", "root", F.sha2("siblings", 256).alias("proof_sha256"), "folded_root", "verified"
    )


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    found = alignment.link_counts(docs, a, b, ["doc_id"])
    return found.select(
        F.col("doc_id").cast("long"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    training = id_remainder("doc_id", 5) != 0
    labels = table(spark, sf_dir, "labels").where(training)
    model = toxicity.train(docs.where(training), labels)
    scored = toxicity.score(docs, model, ["doc_id"])
    return scored.select("doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


QUERIES = {
    "op1_packing": (op1_packing, None),
    "op2_quality": (op2_quality, None),
    "op3_language": (op3_language, None),
    "op4_max_entropy": (op4_max_entropy, None),
    "op5_embedding_dups": (op5_embedding_dups, None),
    "op6_secrets": (op6_secrets, None),
    "op7_byte_bpe": (op7_byte_bpe, None),
    "op8_top_k": (op8_top_k, None),
    "op9_revisits": (op9_revisits, revisits.PAGES_SQL),
    "op10_simhash": (op10_simhash, None),
    "op11_merkle": (op11_merkle, None),
    "op12_alignment": (op12_alignment, None),
    "op13_toxicity": (op13_toxicity, None),
}
