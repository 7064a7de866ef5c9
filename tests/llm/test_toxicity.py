"""Toxicity by nnPU: held-out accuracy, defined cases and the features."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseload.llm import queries, toxicity
from caseload.llm.common import id_remainder

LARGER = "/root/testdata/sf0.1"
INSULTS = r"\b(trash|pathetic|idiot|disgusting|worthless|stupid|clown|scum|loser|moron)\b"


def test_features_are_words_present():
    data = np.frombuffer(b"Idiot, idiot! the  cat\xc3\xa9 x", np.uint8)
    indptr, slot, value = toxicity.features(data, np.array([0, 13, len(data)]))
    assert list(np.diff(indptr)) == [1, 3] and (value == 1).all()
    alone = toxicity.features(np.frombuffer(b"idiot", np.uint8), np.array([0, 5]))[1]
    assert slot[0] == alone[0]


@pytest.mark.skipif(not Path(LARGER).exists(), reason="the larger tables are not here")
def test_held_out_and_insults(spark):
    got = queries.QUERIES["op13_toxicity"][0](spark, LARGER)
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    rows = got.join(labels, "doc_id").where("held_out").select("predicted", "toxic").collect()
    accuracy = np.mean([r.predicted == r.toxic for r in rows])
    assert len(rows) > 500 and accuracy >= 0.9
    flagged = got.join(docs.select("doc_id", F.lower("text").rlike(INSULTS).alias("insult")), "doc_id")
    shares = {r.insult: r.share for r in flagged.groupBy("insult").agg(F.avg("predicted").alias("share")).collect()}
    assert shares[True] >= 0.95 and shares[False] <= 0.06
    assert got.count() == docs.count() and got.where(~F.col("held_out")).count() == docs.where(id_remainder("doc_id", 5) != 0).count()


def test_odd_rows(spark):
    long = "calm words " * 30_000 + "idiot"
    rows = [(1, None), (2, ""), (3, long), (4, "you idiot"), (4, "you idiot"), (None, "scum"), (5, "日本 😀")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit("x"), "predicted": F.lit(2)})
    labels = spark.createDataFrame([(4, 1), (1, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    out = toxicity.score(docs, model, ["doc_id", "score", "predicted"]).collect()
    assert len(out) == len(rows) and all(0.0 <= r.score <= 1.0 for r in out)
    assert {type(r.predicted) for r in out} == {int}
    by = {(r.doc_id, i): r.score for i, r in enumerate(out)}
    assert by[(1, 0)] == by[(2, 1)]  # null and empty texts both score the bias
    assert out[3].score == out[4].score  # repeated rows


def test_without_positives_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))
    assert all(r.score < 1e-6 and r.predicted == 0 for r in toxicity.score(docs, model, ["doc_id"]).collect())
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert toxicity.score(empty, model, ["doc_id"]).count() == 0
