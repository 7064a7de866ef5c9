"""The Merkle manifest against a direct build of the trees."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from caseload.llm import merkle, queries

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def H(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(value) -> str:
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tamper(doc_id, text):
    if text is None or zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5:
        return text
    return text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def brute(rows, fanout):
    """doc_id, leaf, subroot, root, siblings, folded_root of each row, by walking the trees."""

    def leaf(r, text):
        return H("".join(field(v) for v in (r[0], r[1], r[2], r[3], text)))

    def build(digests):
        tiers = [digests]
        while len(tiers[-1]) > 1:
            below = tiers[-1]
            tiers.append([H("".join(below[i : i + fanout])) for i in range(0, len(below), fanout)])
        return tiers

    def proof(tiers, i):
        out = []
        for below in tiers[:-1]:
            start = i // fanout * fanout
            run = below[start : start + fanout]
            out.append((run, i - start))
            i //= fanout
        return out

    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        mine = sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        trees[s] = (mine, build([leaf(r, r[4]) for r in mine]))
    top = build([trees[s][1][-1][0] for s in sources])
    root = top[-1][0]
    out = []
    for k, s in enumerate(sources):
        mine, tiers = trees[s]
        for i, r in enumerate(mine):
            path = proof(tiers, i) + proof(top, k)
            folded = leaf(r, tamper(r[0], r[4]))
            for run, at in path:
                folded = H("".join(run[:at]) + folded + "".join(run[at + 1 :]))
            sib = "".join("".join(run[:at] + run[at + 1 :]) for run, at in path)
            out.append((r[0], leaf(r, r[4]), tiers[-1][0], root, sib, folded))
    return sorted(out, key=lambda t: (t[0] is not None, t[0] or 0, t[1]))


def spark_rows(df):
    tampered = F.when(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0, merkle.lower_ascii(F.col("text")))
    got = merkle.prove(df, tampered.otherwise(F.col("text")))
    rows = [(r.doc_id, r.leaf, r.subroot, r.root, r.siblings, r.folded_root) for r in got.collect()]
    return sorted(rows, key=lambda t: (t[0] is not None, t[0] or 0, t[1])), got


ODD = [
    (1, "b", "en", 3, "Abc"), (2, "b", None, None, None), (2, "b", None, None, None), (None, "b", "fr", 0, ""),
    (3, None, "de", 5, "HELLO"), (4, "a", "en", 2, "日本"), (5, "é", "en", 1, "x" * 5000),
    *[(10 + i, "big", "en", i, f"Text {i} OF THE hot source") for i in range(70)],
]


@pytest.mark.parametrize("fanout", [16, 4, 2])
def test_against_direct_trees(spark, monkeypatch, fanout):
    monkeypatch.setattr(merkle, "FANOUT", fanout)
    df = spark.createDataFrame(ODD, SCHEMA).withColumns({"leaf": F.lit(1), "run": F.lit("x"), "tree": F.lit(2)})
    got, full = spark_rows(df)
    assert got == brute(ODD, fanout)
    verified = sorted((r.doc_id, r.verified) for r in full.collect() if r.doc_id is not None)
    assert verified == sorted((r[0], tamper(r[0], r[4]) == r[4]) for r in ODD if r[0] is not None)
    assert not all(v for _, v in verified)


def test_one_row_and_empty(spark):
    one = [(7, "s", "en", 1, "A")]
    got, _ = spark_rows(spark.createDataFrame(one, SCHEMA))
    assert got == brute(one, 16) and got[0][4] == "" and got[0][1] == got[0][2] == got[0][3]
    assert merkle.prove(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_on_documents(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select(*merkle.FIELDS).collect()]
    want = {r[0]: r for r in brute(rows, 16)}
    got = queries.QUERIES["op11_merkle"][0](spark, sf_dir).collect()
    assert len(got) == len(rows)
    for r in got:
        w = want[r.doc_id]
        assert (r.leaf, r.subroot, r.root, r.folded_root) == (w[1], w[2], w[3], w[5])
        assert r.proof_sha256 == H(w[4]) and r.verified == (w[5] == w[3])
    assert 0 < sum(not r.verified for r in got) < len(got)
