"""Cross-tokenizer alignment against a direct walk over both token lists."""

from __future__ import annotations

import collections
import hashlib

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from caseload.llm import alignment, queries

A = public_tokenizers.path("byte_bpe_50k.json")
B = public_tokenizers.path("piece_bpe_32k.model")


def token_bytes():
    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=B)
    inverse = {c: b for c, b in alignment.byte_chars().items()}

    def of_a(i):
        return bytes(inverse[c] for c in first.id_to_token(i))

    def of_b(i):
        piece = second.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode()

    return first, second, of_a, of_b


def brute(texts):
    """Per text: n_a, n_b, n_groups, n_links, groups, and its linked pairs, by two pointers."""
    first, second, of_a, of_b = token_bytes()
    out = []
    for text in texts:
        text = text or ""
        a = first.encode(" " + text, add_special_tokens=False).ids
        b = second.encode(text, out_type=int)
        whole = (" " + text).encode()
        if not text or b"".join(map(of_a, a)) != whole or b"".join(map(of_b, b)) != whole:
            out.append((0, 0, 0, 0, "", collections.Counter()))
            continue
        ra, rb, at = [], [], 0
        for i in a:
            ra.append((at, at + len(of_a(i))))
            at = ra[-1][1]
        at = 0
        for i in b:
            rb.append((at, at + len(of_b(i))))
            at = rb[-1][1]
        links, i, j = collections.Counter(), 0, 0
        while i < len(a) and j < len(b):
            if max(ra[i][0], rb[j][0]) < min(ra[i][1], rb[j][1]):
                links[(a[i], b[j])] += 1
            if ra[i][1] <= rb[j][1]:
                i += 1
            else:
                j += 1
        groups, ga, gb, i, j = [], [], [], 0, 0
        cuts = {e for _, e in ra} & {e for _, e in rb}
        for i in range(len(a)):
            ga.append(a[i])
            while j < len(b) and rb[j][1] <= ra[i][1]:
                gb.append(b[j])
                j += 1
            if ra[i][1] in cuts:
                groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
                ga, gb = [], []
        out.append((len(a), len(b), len(groups), sum(links.values()), ";".join(groups), links))
    return out


def test_against_two_pointers(spark):
    texts = [None, "", "Hello  world\n\tthe <s> x", "<|endoftext|> done", "naïve café 日本語 😀", "a" * 3000, "x y",
             "x y", "Über\r\nline   nbsp", "tab\tand  spaces   ", "ﬁ ligature ½"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(alignment.link_counts(df.withColumn("n_a", df.doc_id), A, B, ["doc_id", "n_a"], with_groups=True).collect())
    want = brute(texts)
    docs = collections.Counter(pair for *_, links in want for pair in links)
    top = collections.defaultdict(int)
    for (x, _), n in docs.items():
        top[x] = max(top[x], n)
    assert len(got) == len(texts)
    for r, (na, nb, ng, nl, groups, links) in zip(got, want, strict=True):
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups) == (na, nb, ng, nl, groups), r.doc_id
        assert r.groups_sha256 == (hashlib.sha256(groups.encode()).hexdigest() if na else "")
        assert r.count_sum == sum(m * docs[p] for p, m in links.items())
        assert r.n_best == sum(m for p, m in links.items() if docs[p] == top[p[0]])
    assert got[0].n_a == 0 and got[2].n_links > 0 and got[6].count_sum == got[7].count_sum


def test_ids_alone_are_asked_for(monkeypatch):
    """The tokenizer builds no offsets, which nothing here reads; results as by two pointers."""
    asked = []

    class Own:
        def __init__(self, real):
            self.real = real

        def __getattr__(self, name):
            asked.append(name)
            return getattr(self.real, name)

    real = Tokenizer.from_file(A)
    real.encode_special_tokens = True
    monkeypatch.setattr("tokenizers.Tokenizer", type("Files", (), {"from_file": staticmethod(lambda path: Own(real))}))
    texts = ["Hello  world\n\tthe", "日本語 😀 naïve", "", "x"]
    raw = [t.encode() for t in texts]
    run = alignment._encoder(A, B, True)()
    found = run(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    assert "encode_batch" not in asked and "encode_batch_fast" in asked
    for i, (na, nb, ng, nl, groups, links) in enumerate(brute(texts)):
        assert [found[k][i] for k in range(5)] == [na, nb, ng, nl, groups]
        keys = [x * alignment.B_IDS + y for x, y in sorted(links)]
        assert found[6][i].as_py() == keys and found[7][i].as_py() == [links[pair] for pair in sorted(links)]


def test_chunks_give_the_ids_of_the_whole_text():
    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    rng = np.random.default_rng(4)
    marks = [" ", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "\u180e", "\u200b", "\u3000", "a", "é", "7", "'s", "!", "日", "<|endoftext|>", "\u0301"]
    for _ in range(4000):
        text = "".join(rng.choice(marks, rng.integers(1, 12)))
        chunks = alignment.spaced_chunks(text)
        assert "".join(chunks) == " " + text
        ids = [i for c in chunks for i in first.encode(c, add_special_tokens=False).ids]
        assert ids == first.encode(" " + text, add_special_tokens=False).ids, repr(text)
    assert alignment.spaced_chunks("") == []


def test_groups_text_of_uneven_slices():
    a, b = np.array([5, 70000, 9]), np.array([1, 2, 3, 4])
    assert alignment.groups_text(a, b, np.array([2, 3]), np.array([1, 4])) == "5,70000|1;9|2,3,4"
    assert alignment.groups_text(a % 65536, b, np.array([2, 3]), np.array([1, 4])) == "5,4464|1;9|2,3,4"
    assert alignment.groups_text(a[:0], b[:0], a[:0], b[:0]) == ""


def test_equal_chunks_are_aligned_once(monkeypatch):
    """Both tokenizers get a chunk once, also across batches; a text with a chunk that B does not
    give back has no tokens, its neighbours keep theirs; chunks met again are not forgotten."""
    given = []

    class Own(sentencepiece.SentencePieceProcessor):
        def encode(self, texts, **options):
            given.extend(texts)
            return super().encode(texts, **options)

    monkeypatch.setattr("sentencepiece.SentencePieceProcessor", Own)
    monkeypatch.setattr(alignment, "CACHE_CHUNKS", 50)
    run = alignment._encoder(A, B, True)()
    rng = np.random.default_rng(5)
    marks = [" ", " ", " ", "  ", "\n", "\t", "\x1c", "\xa0", "\u3000", "a", "word", "naïve", "7", "日", "😀", "<s>", "<|endoftext|>"]
    for k in range(12):
        texts = ["".join(rng.choice(marks, rng.integers(0, 30))) for _ in range(40)]
        texts += ["often met", "", "often \u2581 not" if k else "often", f"often q{k}", " ".join(f"w{k}x{i}" for i in range(60))]
        raw = [t.encode() for t in texts]
        found = run(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
        for i, (na, nb, ng, nl, groups, links) in enumerate(brute(texts)):
            assert [found[j][i] for j in range(5)] == [na, nb, ng, nl, groups], repr(texts[i])
            assert found[5][i] == (hashlib.sha256(groups.encode()).hexdigest() if na else "")
            keys = [x * alignment.B_IDS + y for x, y in sorted(links)]
            assert found[6][i].as_py() == keys and found[7][i].as_py() == [links[pair] for pair in sorted(links)]
        assert (found[0][42] == 0) == (k > 0) and found[0][40] > 0
    assert sum("met" in text.split(" ") for text in given) == 1


def test_a_model_that_reaches_over_spaces_gets_whole_texts(tmp_path):
    model = alignment.sentencepiece_model_pb2.ModelProto()
    with open(B, "rb") as file:
        model.ParseFromString(file.read())
    assert alignment.cuts_apart(B)
    for change in (lambda m: setattr(m.pieces[5000], "piece", "a\u2581b"), lambda m: setattr(m.normalizer_spec, "remove_extra_whitespaces", True)):
        other = alignment.sentencepiece_model_pb2.ModelProto()
        other.CopyFrom(model)
        change(other)
        path = tmp_path / "other.model"
        path.write_bytes(other.SerializeToString())
        assert not alignment.cuts_apart(str(path))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.link_counts(df, A, B, ["doc_id"]).count() == 0


def test_query_on_documents(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in rows], brute([r.text for r in rows]), strict=True))
    docs = collections.Counter(pair for *_, links in want.values() for pair in links)
    got = queries.QUERIES["op12_alignment"][0](spark, sf_dir).collect()
    assert len(got) == len(rows)
    assert sum(r.n_a > 0 for r in got) > len(rows) // 2
    for r in got:
        na, nb, ng, nl, groups, links = want[r.doc_id]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links) == (na, nb, ng, nl)
        assert r.groups_sha256 == (hashlib.sha256(groups.encode()).hexdigest() if na else "")
        assert r.count_sum == sum(m * docs[p] for p, m in links.items())
