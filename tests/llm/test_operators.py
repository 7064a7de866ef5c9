"""The pipeline operators against brute force, and on odd rows."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from oracle import connect, differences
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from caseload.llm import (
    bpe, embedding_dups, language_id, max_entropy, packing, quality, queries, revisits, secrets, simhash, top_k,
)
from caseload.llm.components import components, local_roots

WORDS = re.compile(rb"[^\x20\x09-\x0d]+")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
LONG = "Thing of $$$ that é " * 20_000


def run(spark, sf_dir, name):
    return queries.QUERIES[name][0](spark, sf_dir).collect()


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns named like the operators' own."""
    rows = [(1, None), (2, ""), (3, "a"), (4, LONG), (5, "12 34 %%"), (6, "same words here"), (6, "same words here"),
            (7, "same words here"), (None, "token = abcdef123"), (8, "x" * 70_000), (9, "  \n\t ß 日本 😀")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clash = {n: F.lit("x") for n in ("score", "fp", "base", "row", "n", "ids", "length", "key", "rank", "lang_pred", "_text", "predicted")}
    return df.withColumns({**clash, "lang": F.lit("en"), "quality": F.lit(1)})


OPERATORS = {
    "packing": lambda df: packing.pack(df, VOCABULARY),
    "quality": lambda df: quality.score(df, quality.train(df, df), ["doc_id", "score"]),
    "language": lambda df: language_id.identify(df, language_id.train(df), ["doc_id", "score"]),
    "max_entropy": lambda df: max_entropy.score(df, max_entropy.train(df)),
    "secrets": lambda df: secrets.scan(df, secrets.train(df), ["doc_id"]),
    "bpe": lambda df: bpe.encode(df, RANKS, public_tokenizers.PATTERN, ["doc_id"]),
    "simhash": simhash.near_duplicates,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(odd, name):
    rows = OPERATORS[name](odd).collect()
    ids = collections.Counter(r["doc_id"] for r in rows)
    assert set(ids) == {1, 2, 3, 4, 5, 6, 7, 8, 9, None}
    if name != "packing":
        assert ids[6] == 2 and len(rows) == 11
    if name == "language":
        assert {r["doc_id"] for r in rows if r["lang_pred"] == "und"} == {1, 2, 5}
    if name == "simhash":
        of = {r["doc_id"]: r for r in rows}
        assert of[1]["fp"] == of[2]["fp"] == 0 and of[7]["component_id"] == 6 and of[2]["component_id"] == 1


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(odd, name):
    assert OPERATORS[name](odd.where("false")).collect() == []


def test_packing(spark, sf_dir, docs):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in run(spark, sf_dir, "op1_packing"):
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert pieces.keys() == docs.keys() and set(sequences) == set(range(len(sequences)))
    for doc_id, text in docs.items():
        ids, at = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted(pieces[doc_id], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    assert sum(len(p) and sum(r["length"] for r in p) for p in pieces.values()) > 0.9 * packing.WINDOW * len(sequences)


def test_plan_uses_every_piece():
    histogram = np.random.default_rng(1).integers(0, 9, 65)
    histogram[0] = 0
    used = np.zeros(65, int)
    for lengths, uses in packing.plan(histogram, 64):
        assert sum(lengths) <= 64
        for n in lengths:
            used[n] += uses
    assert (used == histogram).all()


def test_quality(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")  # the smallest table has 65 labels to learn from
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = run(spark, sf_dir, "op2_quality")
    known = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["doc_id"] in truth and r["held_out"]]
    assert np.mean([a == b for a, b in known]) > 0.9
    assert all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


def test_attention_gradient():
    draw = np.random.default_rng(2)
    model = quality.AttentionModel()
    model.weights = [w.astype(np.float64) + 0.01 * draw.standard_normal(w.shape) for w in model.weights]
    x, bags, y = draw.random((7, quality.PAIRS + quality.FORM)), np.array([0, 3, 7]), np.array([1.0, 0.0])
    loss = lambda: -np.mean(y * np.log(p := model.scores(x, bags)) + (1 - y) * np.log(1 - p))
    for w, g in zip(model.weights, model.gradients(x, bags, y), strict=True):
        w[0, 0] += 1e-5
        up = loss()
        w[0, 0] -= 2e-5
        assert (up - loss()) / 2e-5 == pytest.approx(g[0, 0], rel=1e-2, abs=1e-5)
        w[0, 0] += 1e-5


def test_language(spark, sf_dir):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    held = [r for r in run(spark, sf_dir, "op3_language") if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.95


def test_code_lengths_are_a_code():
    data = np.frombuffer(b"abracadabra and banana", np.uint8)
    tree = language_id.ContextTree(language_id.grams(data, np.array([0, len(data)])))
    for context in (b"\0\0\0\0", b"abra", b"xbra", b"zzzz", b"anan"):
        keys = np.array([int.from_bytes(context + bytes([b]), "big") for b in range(256)], np.uint64)
        assert np.exp2(-tree.code_lengths(keys)).sum() == pytest.approx(1)
    coder = language_id.Coder(["x"], [tree])
    assert np.allclose(coder.code_lengths(keys)[:, 0], tree.code_lengths(keys))


def test_language_model(spark, sf_dir, docs):
    words = lambda t: [*WORDS.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), t.encode())), None]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    counts = collections.Counter(w for i, t in docs.items() if not held[i] for w in words(t))
    total, kinds = sum(counts.values()), len(counts)
    gain = 0.0
    for r in run(spark, sf_dir, "op4_max_entropy"):
        text = words(docs[r["doc_id"]])
        base = sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in text)
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held[r["doc_id"]], len(text), total)
        assert r["n_known"] == sum(counts[w] > 0 for w in text) and r["base_score"] == pytest.approx(base)
        gain += (r["score"] - r["base_score"]) * r["held_out"]
    assert gain > 0


def test_slot_chances_sum_to_one():
    draw = np.random.default_rng(3)
    weights = max_entropy.Weights(draw.random(max_entropy.SLOTS) + 0.1, draw.permutation(max_entropy.SLOTS))
    weights.class_weights += draw.standard_normal(weights.class_weights.shape).astype(np.float32)
    weights.slot_weights += draw.standard_normal(weights.slot_weights.shape).astype(np.float32)
    every = np.arange(max_entropy.SLOTS)
    one, two = np.full(len(every), 3), np.full(len(every), max_entropy.START)
    assert (10 ** max_entropy._chances(weights, every, one, two)).sum() == pytest.approx(1, rel=1e-4)


def test_embedding_duplicates(spark):
    draw = np.random.default_rng(4)
    centres = draw.standard_normal((40, 16))
    x = np.repeat(centres, 15, axis=0) + 0.09 * draw.standard_normal((600, 16))
    x[30:200] = x[30]  # copies
    vectors = [list(map(float, np.float32(v))) for v in x]
    labels = [i % 2 if i < 300 else 7 for i in range(600)]
    rows = [*zip(range(600), vectors, labels, strict=True), (600, None, 1), (601, [0.0] * 16, 1), (602, [float("nan")] * 16, 1), (603, vectors[0], None), (604, vectors[31], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit(1))
    unit = np.array([v for _, v, _ in rows[:600]] + [vectors[31]])
    unit /= np.sqrt((unit * unit).sum(axis=1))[:, None]
    tag = np.array([*labels, 1])
    link = (unit @ unit.T >= 0.98) & (tag[:, None] == tag)
    a, b = np.nonzero(np.triu(link, 1))
    root = local_roots(601, a, b)
    ids = [*range(600), 604]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dups.near_duplicates(df).collect()}
    assert len(got) == 605 and all(got[i] == (0, i, True) for i in (600, 601, 602, 603))
    for k, i in enumerate(ids):
        assert got[i] == (link[k].sum() - 1, ids[root[k]], ids[root[k]] == i)
    assert embedding_dups.near_duplicates(df.where("false")).count() == 0


def test_secrets(spark, sf_dir, docs):
    assign = re.compile(secrets.ASSIGN[4:], re.I | re.A)
    for r in run(spark, sf_dir, "op6_secrets"):
        t = docs[r["doc_id"]]
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if m.end() - m.start() >= 24]
        text = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [s for s in r["spans"].split(",") if s and not s.startswith("random")] == [s for s in text.split(",") if s]


def test_random_strings_and_redaction(spark):
    words = "the ordinary identifiers documentation understanding representation " * 30
    rows = [(i, f"{words} token = '{hashlib.sha1(str(i).encode()).hexdigest()}'") for i in range(60)]
    rows += [(100 + i, words) for i in range(60)]
    rows.append((900, "é key qZ8fK2vLx9Wm4TbY7RcD1nPj and internationalizationconfiguration end"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = secrets.scan(df, secrets.train(df), ["doc_id", "text"]).where("doc_id = 900")
    row = found.select(secrets.listed("found").alias("s"), secrets.redacted(F.col("text"), F.col("found")).alias("t")).first()
    assert row["s"] == "random:6:30" and row["t"] == "é key [secret] and internationalizationconfiguration end"


def test_byte_bpe(spark, sf_dir, docs):
    ranks = bpe.read_ranks(RANKS)
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in run(spark, sf_dir, "op7_byte_bpe"):
        ids = encoding.encode_ordinary(docs[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()
    coder = bpe.TextCoder(ranks, public_tokenizers.PATTERN)
    for t in ["", " ", "a  b", " lead", "tail ", "x" * 1000, "a  b\n\n c's\t1"]:
        assert coder.encode([t])[0][1] == ",".join(map(str, encoding.encode_ordinary(t))).encode()


def test_byte_bpe_joins_what_it_remembers_at_once():
    """Chunks are looked up once each, without a row of pieces per text; long ones are forgotten."""
    coder = bpe.TextCoder(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.pieces.ranks, special_tokens={})

    class Counted(dict):
        def get(self, *key):
            raise AssertionError("looked up twice")

    coder.known = Counted()
    texts = ["one two two", "y" * 500 + " two", "", "y" * 500]
    for _ in range(2):
        for text, (n, ids, raw) in zip(texts, coder.encode(texts), strict=True):
            want = encoding.encode_ordinary(text)
            assert (n, ids, raw) == (len(want), ",".join(map(str, want)).encode(), text.encode())
    assert set(coder.known) == {"one", " two"}


def test_byte_bpe_meets_each_key_of_a_batch_once(monkeypatch):
    """Equal chunks and pieces of a batch are looked up once, whatever white space stands around them;
    keys met again stay when others are forgotten."""
    coder = bpe.TextCoder(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.pieces.ranks, special_tokens={})
    monkeypatch.setattr(bpe, "CACHE_KEYS", 40)
    asked = []
    encode = coder.pieces.encode
    monkeypatch.setattr(coder.pieces, "encode", lambda pieces: asked.append(pieces) or encode(pieces))
    rng = np.random.default_rng(7)
    marks = [" ", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", " ", "​", " ", " ", "　", "a", "é", "7", "'s", "!", "日", "–", "😀", "bcbc"]
    for _ in range(150):
        texts = ["".join(rng.choice(marks, rng.integers(0, 12))) for _ in range(20)]
        for text, (n, ids, raw) in zip(texts, coder.encode(texts), strict=True):
            want = encoding.encode_ordinary(text)
            assert (n, ids, raw) == (len(want), ",".join(map(str, want)).encode(), text.encode()), repr(text)
        assert len(set(asked[-1])) == len(asked[-1])
    asked.clear()
    for k in range(6):
        coder.encode([" often " + " ".join(f"q{k}w{i}" for i in range(30))])
    assert sum(b" often" in pieces for pieces in asked) == 1


def test_byte_bpe_queries_are_bounded_by_length(monkeypatch):
    """Long pieces go to more queries than short ones, since their steps are kept by DuckDB."""
    coder = bpe.PieceCoder(bpe.read_ranks(RANKS))
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    rng = np.random.default_rng(2)
    pieces = ["".join(rng.choice([*"abcdefghij"], n)) for n in [3, 150, 7, 199, 260, 12, 150, 5] * 4]
    rows, lists = [], bpe._lists
    monkeypatch.setattr(bpe, "_lists", lambda flat, size: rows.append(size) or lists(flat, size))
    monkeypatch.setattr(bpe, "WORK_PER_QUERY", 50_000)
    assert coder.encode([p.encode() for p in pieces]).to_pylist() == [encoding.encode_ordinary(p) for p in pieces]
    assert len(rows) > 4 and max((size[1:] ** 2).sum() for size in rows[1:]) <= 50_000


def test_byte_bpe_of_texts_that_are_not_utf8(spark):
    """Bytes that are no UTF-8 are replaced text by text, as they were; neighbours are not touched."""
    df = spark.sql("SELECT 1 AS doc_id, CAST(X'616220C3' AS STRING) AS text").unionAll(
        spark.sql("SELECT 2, CAST(X'A9206364' AS STRING)")).unionAll(spark.sql("SELECT 3, 'é x'")).coalesce(1)
    rows = {r.doc_id: r for r in bpe.encode(df, RANKS, public_tokenizers.PATTERN, ["doc_id"], with_values=True).collect()}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    for i, text in enumerate([b"ab \xc3", b"\xa9 cd", "é x".encode()], 1):
        text = text.decode("utf-8", "replace")
        assert bytes(rows[i].decoded).decode() == text and rows[i].ids == ",".join(map(str, encoding.encode_ordinary(text)))


def test_top_k(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.floor(64 * np.array([r["embedding"] for r in rows], float)).astype(int)
    got = collections.defaultdict(list)
    for r in sorted(run(spark, sf_dir, "op8_top_k"), key=lambda r: r["rank"]):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        best = [j for j in np.lexsort((ids, -s)) if j != i][:20]
        assert got[ids[i]] == [(ids[j], s[j]) for j in best]


def test_top_k_prunes_without_loss(spark):
    draw = np.random.default_rng(5)
    x = draw.standard_normal((5000, 8)) * draw.lognormal(0, 1, 5000)[:, None]
    rows = [(i, list(map(float, v))) for i, v in enumerate(x)] + [(5000, None), (5001, [float("inf")] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("norm", F.lit(1))
    got = collections.defaultdict(list)
    for r in sorted(top_k.search(df, F.col("vec_id") % 50 == 0, k=5).collect(), key=lambda r: r["rank"]):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    y = np.floor(64 * x).astype(int)
    for i in range(0, 5000, 50):
        s = y @ y[i]
        assert got[i] == [(j, s[j]) for j in np.lexsort((np.arange(5000), -s)) if j != i][:5]
    assert len(got) == 100 and top_k.search(df.where("false"), F.lit(True)).count() == 0


def test_revisits(spark, sf_dir):
    query, sql = queries.QUERIES["op9_revisits"]
    assert differences(query(spark, sf_dir), connect(sf_dir), sql) == []


def test_revisit_cases(spark):
    columns = "capture_id long, url string, ts long, status int, body string, etag string, last_modified string, content_type string, x string"
    rows = [(1, "http://WWW.a.org:80/p/?utm_source=q#f", 10, 200, "b1", '"1"', "d", "html", "k"), (2, "https://a.org/p", 10, 200, "b2", '"2"', "d", "html", "k"),
            (3, "a.org/p", 20, 304, None, 'W/"2"', None, "text", None), (4, "http://a.org/p", 10, 304, None, '"1"', "d", None, None),
            (5, "http://a.org/p", 30, 304, None, None, "d", None, None), (6, None, 40, 304, None, None, "d", None, None), (7, "http://a.org/p", None, 304, None, '"2"', "d", None, None)]
    df = spark.createDataFrame(rows, columns)
    got = {r["capture_id"]: r for r in revisits.resolve(df, ("etag", "last_modified", "content_type")).collect()}
    assert {i: r["outcome"] for i, r in got.items()} == {1: "full", 2: "full", 3: "resolved", 4: "orphan", 5: "resolved", 6: "orphan", 7: "orphan"}
    assert (got[3]["target_id"], got[3]["body"], got[3]["etag"], got[3]["content_type"]) == (2, "b2", 'W/"2"', "html")


def brute_fingerprint(text: str) -> int:
    words = WORDS.findall(text.encode().lower())
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, sf_dir, docs):
    prints = {i: brute_fingerprint(t) for i, t in docs.items()}
    ids = sorted(prints)
    values = np.array([prints[i] for i in ids], np.uint64)
    a, b = np.nonzero(np.triu(np.bitwise_count(values[:, None] ^ values) <= 2, 1))
    root = local_roots(len(ids), a, b)
    for r in run(spark, sf_dir, "op10_simhash"):
        assert r["fingerprint"] == f"{prints[r['doc_id']]:016x}"
        assert r["component_id"] == ids[root[ids.index(r["doc_id"])]]


def test_simhash_links_in_split_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 64)
    draw = np.random.default_rng(6)
    free = (draw.integers(0, 1 << 13, 3000, dtype=np.uint64) << np.uint64(13)) | (draw.integers(0, 8, 3000, dtype=np.uint64) << np.uint64(45))
    values = np.unique(free ^ np.uint64(0x123456789ABCDEF))
    df = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    got = {r["node"]: r["component"] for r in components(simhash.links(df), "a", "b").collect()}
    order = np.sort(values.view(np.int64))
    a, b = np.nonzero(np.triu(np.bitwise_count(order.view(np.uint64)[:, None] ^ order.view(np.uint64)) <= 2, 1))
    root = local_roots(len(order), a, b)
    assert got == {int(v): int(order[r]) for v, r in zip(order, root, strict=True) if order[r] != v}


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, 200), (200, 300), (5, 5), (None, 3)]
    got = components(spark.createDataFrame(links, "u long, v long"), "u", "v").collect()
    assert {(r["node"], r["component"]) for r in got} == {(i, 1) for i in range(2, 61)} | {(200, 100), (300, 100)}


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, docs
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality", "near_duplicates", "secrets", "packing"]
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, sf_dir)
        kept = spark.createDataFrame(kept.toPandas(), docs.schema)
        assert kept.columns == columns
        sizes.append(kept.count())
        assert kept.join(before, "doc_id", "left_anti").count() == 0
        if name == "near_duplicates":
            prints = [brute_fingerprint(r["text"]) for r in kept.collect()]
            values = np.array(prints, np.uint64)
            assert not np.triu(np.bitwise_count(values[:, None] ^ values) <= 2, 1).any()
        if name == "secrets":
            assert not kept.where(F.col("text").rlike(secrets.HEX)).count()
    assert sizes[-1] == sizes[-2] < sizes[0]
    placed = corpus_pipeline.pack(spark, kept, sf_dir)
    assert placed.select("doc_id").distinct().count() == sizes[-1]
    assert corpus_pipeline.run(spark, sf_dir).count() == placed.count()
