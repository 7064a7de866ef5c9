"""Alignment of two tokenizations of the same texts, and corpus-wide link counts.

Tokenizer A is byte-level BPE (a ``tokenizers`` file) on space + text; tokenizer B
is a sentencepiece model on the text, which adds the space itself. Special-token
strings inside a text are plain text for both. A token's bytes: A's vocabulary entry
decoded from the byte-to-character table of byte-level BPE; B's piece in UTF-8 with
U+2581 as a space and ``<0xHH>`` as the byte HH.

Method (inside an Arrow task): cumulative byte ends of both token lists go
into end-to-index dictionaries; their keys' hash-set intersection, sorted, slices
both id lists into groups. Links are expanded per slice from the merged ends of both
sides: every stretch between two consecutive ends lies in one A and one B token, and
those pairs are exactly the overlapping ones, each once. Slices end where both sides
end, so all slices are expanded in one vectorised pass.

No token of A or B reaches over a single space between other characters, so both sides
end before it: a text's groups and links are those of its chunks between such spaces, in
order. A batch's distinct chunks that are not remembered are aligned in one pass, the
others looked up. A model of B whose tokens could reach over gets whole texts as chunks.

Across the corpus (Spark): each text's distinct linked id pairs are counted by
documents with a map-side combined aggregate; the highest count per A id follows
from that table; links are then joined with the counts and summed per text.

Defined cases: a null or empty text, or one whose joined A or B bytes differ from
space + text, has no tokens: zero counts, no links, ``groups`` and its digest ''. Every row is a
document of its own (repeated rows are counted twice; a null ``doc_id`` is kept).
Ties for an A id's highest count all count as best. An empty table gives no rows.
Kept columns named like the added ones are replaced by them.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Sequence
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2

from caseload.llm.bpe import CACHE_KEY, chunk_starts, in_row, joined
from caseload.llm.common import map_texts
from caseload.session import materialise

# Pair keys: A id times this, plus B id (B has fewer ids); a key has fewer bits than this.
B_IDS, KEY_BITS = 1 << 16, 40
# Chunks held anew by a worker's memory, and given to a tokenizer as one text.
CACHE_CHUNKS, TOGETHER = 125_000, 16

ADDED = T.StructType([
    T.StructField("n_a", T.LongType()), T.StructField("n_b", T.LongType()),
    T.StructField("n_groups", T.LongType()), T.StructField("n_links", T.LongType()),
    T.StructField("groups", T.StringType()), T.StructField("groups_sha256", T.StringType()),
    T.StructField("pair_keys", T.ArrayType(T.LongType())), T.StructField("pair_links", T.ArrayType(T.LongType())),
])


def byte_chars() -> dict[str, int]:
    """The byte-to-character table of byte-level BPE, inverted: character to byte.

    Printable bytes stand for themselves; the others, in byte order, take the
    characters from U+0100 on.
    """
    kept = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    chars, extra = {}, 0
    for b in range(256):
        if b in kept:
            chars[chr(b)] = b
        else:
            chars[chr(256 + extra)] = b
            extra += 1
    return chars


class Table:
    """Bytes of every id of a vocabulary as one array with offsets."""

    def __init__(self, entries: Sequence[bytes]):
        self.lengths = np.array([len(e) for e in entries], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64)
        self.data = np.frombuffer(b"".join(entries), np.uint8)

    def join(self, ids: np.ndarray) -> np.ndarray:
        lengths = self.lengths[ids]
        total = int(lengths.sum())
        if not total:
            return np.zeros(0, np.uint8)
        before = np.repeat(np.cumsum(lengths) - lengths, lengths)
        return self.data[np.repeat(self.starts[ids], lengths) + np.arange(total) - before]


def a_table(tokenizer) -> Table:
    chars = byte_chars()
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    entries = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        entries[i] = bytes(chars[c] for c in token) if all(c in chars for c in token) else token.encode()
    return Table(entries)


def b_table(model) -> Table:
    entries = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            entries.append(bytes([int(piece[3:5], 16)]))
        else:
            entries.append(piece.replace("▁", " ").encode())
    return Table(entries)


def align(ends_a: np.ndarray, ends_b: np.ndarray):
    """Groups as ``a_cut, b_cut`` (slice ends) and links as index pairs of one text.

    The slices come from the intersection of the two end-to-index dictionaries. Links
    are expanded for all slices at once: slices are cut where both sides end, so the
    merged ends of the whole text are those of every slice, and each stretch between
    two of them lies in one A and one B token of the same slice.
    """
    to_a = dict(zip(ends_a.tolist(), range(1, len(ends_a) + 1), strict=True))
    to_b = dict(zip(ends_b.tolist(), range(1, len(ends_b) + 1), strict=True))
    common = sorted(to_a.keys() & to_b.keys())
    if not common:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    a_cut = np.fromiter(map(to_a.__getitem__, common), np.int64, len(common))
    b_cut = np.fromiter(map(to_b.__getitem__, common), np.int64, len(common))
    # Stretches end at every end of A and, in between, at the ends of B alone; those before
    # a stretch's end give its token on each side.
    size = max(int(ends_a[-1]), int(ends_b[-1])) + 1
    is_a, is_b = np.zeros(size, bool), np.zeros(size, bool)
    is_a[ends_a], is_b[ends_b] = True, True
    merged = np.flatnonzero(is_a | is_b)
    at_a, at_b = is_a[merged], is_b[merged]
    return a_cut, b_cut, np.cumsum(at_a) - at_a, np.cumsum(at_b) - at_b


# Decimal ids followed by the mark of their place: 0 the next id, 1 the other side, 2 a new slice.
MARKED = pa.array([f"{i}{mark}".encode() for mark in ",|;" for i in range(B_IDS)], pa.large_binary())


def marked(a: np.ndarray, b: np.ndarray, a_cut: np.ndarray, b_cut: np.ndarray) -> np.ndarray | None:
    """The places in ``MARKED`` of each slice's A ids, then its B ids; none if a slice lacks a side or an id is too large."""
    in_a, in_b = np.diff(a_cut, prepend=0), np.diff(b_cut, prepend=0)
    if not (in_a.all() and in_b.all()) or max(a.max(initial=0), b.max(initial=0)) >= B_IDS:
        return None
    ids = np.empty(len(a) + len(b), np.int64)
    # An id stands behind its slice's earlier ones and all ids of the slices before.
    ids[np.arange(len(a)) + np.repeat(b_cut - in_b, in_a)] = a
    ids[np.arange(len(b)) + np.repeat(a_cut, in_b)] = b
    ids[a_cut + b_cut - in_b - 1] += B_IDS
    ids[a_cut + b_cut - 1] += 2 * B_IDS
    return ids


def groups_text(a: np.ndarray, b: np.ndarray, a_cut: np.ndarray, b_cut: np.ndarray) -> str:
    """``a1,a2|b1;a3|b2,b3``: each slice's A ids, then its B ids."""
    ids = marked(a, b, a_cut, b_cut)
    if ids is None:
        return _groups_by_slice(a, b, a_cut, b_cut)
    return str(joined(MARKED.take(pa.array(ids)), np.array([0, len(ids)]))[0].as_py(), "ascii")[:-1]


def _groups_by_slice(a, b, a_cut, b_cut) -> str:
    out, a0, b0 = [], 0, 0
    for a1, b1 in zip(a_cut.tolist(), b_cut.tolist(), strict=True):
        out.append(",".join(map(str, a[a0:a1].tolist())) + "|" + ",".join(map(str, b[b0:b1].tolist())))
        a0, b0 = a1, b1
    return ";".join(out)


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often each occurs."""
    ordered = np.sort(values)
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)
    return ordered[first], np.diff(first, append=len(ordered))


def spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a space before each that is not empty."""
    full = offsets[1:] > offsets[:-1]
    return np.insert(data, offsets[:-1][full], 0x20), offsets + np.append(0, np.cumsum(full))


def spaced_chunks(text: str) -> list[str]:
    """Space + text cut before single spaces between other characters; none of an empty text.

    The pre-tokenizer of A starts a new piece at each such space, whatever stands around it.
    """
    data = np.frombuffer(text.encode(), np.uint8)
    data, offsets = spaced(data, np.array([0, len(data)]))
    return [bytes(part).decode() for part in np.split(data, chunk_starts(data, offsets)[1:])] if len(data) else []


def cuts_apart(model_path: str) -> bool:
    """Whether B's tokens never reach over a space behind another character: no piece does,
    and texts are not normalised."""
    model = sentencepiece_model_pb2.ModelProto()
    with open(model_path, "rb") as file:
        model.ParseFromString(file.read())
    plain = model.normalizer_spec
    if plain.precompiled_charsmap or plain.remove_extra_whitespaces or not plain.escape_whitespaces:
        return False
    return not any("▁" in entry.piece.lstrip("▁") for entry in model.pieces)


def _encoder(a_path: str, b_path: str, with_groups: bool):
    def make():
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        first = Tokenizer.from_file(a_path)
        first.encode_special_tokens = True
        second = sentencepiece.SentencePieceProcessor(model_file=b_path)
        table_a, table_b = a_table(first), b_table(second)
        by_chunk = cuts_apart(b_path)
        # By chunk: its groups, each closed by a semicolon, its links' keys as bytes, how many
        # tokens of A (-1 if not all bytes come back) and of B, and how many groups. Once there
        # are many, those not met since are forgotten.
        known: dict[str, tuple[bytes, bytes, int, int, int]] = {}
        older: dict[str, tuple[bytes, bytes, int, int, int]] = {}

        def entries(chunks: list[str]) -> list[tuple[bytes, bytes, int, int, int]]:
            nonlocal known, older
            if len(known) > CACHE_CHUNKS:
                known, older = {}, known
            absent = [c for c in chunks if c not in known]
            if older:
                known.update((c, older[c]) for c in absent if c in older)
                absent = [c for c in absent if c not in older]
            # Those that would be cut apart again where they meet go to the tokenizers together.
            loose = [c for c in absent if not by_chunk or c[1:2].isspace() or c[-1].isspace()]
            alone = set(loose)
            for part, together in ((loose, 1), ([c for c in absent if c not in alone], TOGETHER)):
                known.update(zip(part, aligned(part, together), strict=True))
            out = [*map(known.__getitem__, chunks)]
            for chunk in absent:
                if len(chunk) > CACHE_KEY:
                    del known[chunk]
            return out

        def aligned(chunks: list[str], together: int) -> list[tuple[bytes, bytes, int, int, int]]:
            """Chunks are aligned in one pass over both sides: each ends where A and B end."""
            parts = ["".join(chunks[i : i + together]) for i in range(0, len(chunks), together)]
            # sequential batches: in a task, threads add CPU time, not speed; no offsets are needed
            a, n_a = flat([e.ids for e in first.encode_batch_fast(parts, add_special_tokens=False)])
            b, n_b = flat(second.encode([p[1:] for p in parts], out_type=int, num_threads=1))
            raw = [c.encode() for c in chunks]
            data, size = np.frombuffer(b"".join(raw), np.uint8), np.fromiter(map(len, raw), np.int64, len(raw))
            whole = np.add.reduceat(size, np.arange(0, len(size), together)) if len(size) else size
            good = (sums(table_a.lengths[a], n_a) == whole) & (sums(table_b.lengths[b], n_b) == whole)
            for table, ids, n in ((table_a, a, n_a), (table_b, b, n_b)):
                unlike = table.join(ids[np.repeat(good, n)]) != data[np.repeat(good, whole)]
                good[np.flatnonzero(good)[np.repeat(np.arange(good.sum()), whole[good])[unlike]]] = False
            a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
            good = np.repeat(good, together)[: len(chunks)]
            a_ends, b_ends, ends = np.cumsum(table_a.lengths[a]), np.cumsum(table_b.lengths[b]), np.cumsum(size[good])
            a_upto = np.append(0, np.searchsorted(a_ends, ends, "right"))
            b_upto = np.append(0, np.searchsorted(b_ends, ends, "right"))
            if not (np.array_equal(a_ends[a_upto[1:] - 1], ends) and np.array_equal(b_ends[b_upto[1:] - 1], ends)):
                return aligned(chunks, 1)
            a_cut, b_cut, la, lb = align(a_ends, b_ends)
            groups = np.searchsorted(a_cut, a_upto, "right")
            places = marked(a, b, a_cut, b_cut)
            if places is None:
                text = []
                for i, (g0, g1) in enumerate(pairwise(groups.tolist())):
                    own = a[a_upto[i] : a_upto[i + 1]], b[b_upto[i] : b_upto[i + 1]]
                    text.append((groups_text(*own, a_cut[g0:g1] - a_upto[i], b_cut[g0:g1] - b_upto[i]) + ";").encode())
            else:
                text = joined(MARKED.take(pa.array(places)), a_upto + b_upto).to_numpy(False).tolist()
            keys = (a[la] * B_IDS + b[lb]).astype("<i8").tobytes()
            links = [keys[i:j] for i, j in pairwise((8 * np.searchsorted(la, a_upto)).tolist())]
            found = zip(text, links, np.diff(a_upto).tolist(), np.diff(b_upto).tolist(), np.diff(groups).tolist(), strict=True)
            failed = [c for c, ok in zip(chunks, good.tolist(), strict=True) if not ok]
            rest = iter(aligned(failed, 1) if together > 1 and failed else [(b"", b"", -1, 0, 0)] * len(failed))
            return [next(found if ok else rest) for ok in good.tolist()]

        def run(data: np.ndarray, offsets: np.ndarray):
            data, offsets = spaced(data, offsets)
            starts = chunk_starts(data, offsets) if by_chunk else offsets[:-1][offsets[1:] > offsets[:-1]]
            cuts = pa.py_buffer(np.append(starts, len(data)).astype(np.int64))
            chunks = pa.LargeStringArray.from_buffers(len(starts), cuts, pa.py_buffer(data)).dictionary_encode()
            held = entries(chunks.dictionary.to_numpy(False).tolist())
            codes = chunks.indices.to_numpy()
            numbers = np.array([entry[2:] for entry in held], np.int64).reshape(-1, 3)
            # Chunks of text i: from upto[i] to upto[i + 1], none if one of them failed.
            upto = np.searchsorted(starts, offsets)
            ok = sums(numbers[codes, 0] < 0, np.diff(upto)) == 0
            codes = codes[np.repeat(ok, np.diff(upto))]
            upto = np.append(0, np.cumsum(np.where(ok, np.diff(upto), 0)))
            text, at = in_row(joined(pa.array([entry[0] for entry in held], pa.large_binary()).take(pa.array(codes)), upto))
            links, links_at = in_row(joined(pa.array([entry[1] for entry in held], pa.large_binary()).take(pa.array(codes)), upto))
            n_links = np.diff(links_at) // 8
            # A text's distinct keys: sorted by text, then key.
            row = np.repeat(np.arange(len(upto) - 1) << KEY_BITS, n_links)
            pairs, times = _distinct(row | np.frombuffer(links, "<i8"))
            found = pa.array(np.searchsorted(pairs, np.arange(len(upto)) << KEY_BITS).astype(np.int32))
            groups = [text[i : max(i, j - 1)] for i, j in pairwise(at)]
            n_a, n_b, n_groups = (sums(numbers[codes, k], np.diff(upto)) for k in range(3))
            return (
                n_a, n_b, n_groups, n_links, [str(g, "ascii") if with_groups else None for g in groups],
                [hashlib.sha256(g).hexdigest() if n else "" for g, n in zip(groups, n_a.tolist(), strict=True)],
                pa.ListArray.from_arrays(found, pa.array(pairs & ((1 << KEY_BITS) - 1))),
                pa.ListArray.from_arrays(found, pa.array(times.astype(np.int64))),
            )

        return run

    return make


def flat(lists: Sequence[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(n.sum())), n


def sums(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of the first ``n[0]`` values, the next ``n[1]`` and so on."""
    return np.diff(np.append(0, np.cumsum(values, dtype=np.int64))[np.append(0, np.cumsum(n))])


_ENCODERS: dict[tuple[str, str, bool], Callable] = {}


def align_texts(df: DataFrame, a_path: str, b_path: str, keep: Sequence[str], text: str = "text", with_groups: bool = False) -> DataFrame:
    """``keep`` columns plus n_a, n_b, n_groups, n_links, groups (null unless
    ``with_groups``), groups_sha256, and per text its distinct linked pair keys
    (A id * 65536 + B id) with their link counts."""

    def make():
        key = a_path, b_path, with_groups
        if key not in _ENCODERS:
            _ENCODERS[key] = _encoder(*key)()
        return _ENCODERS[key]

    return map_texts(df, text, keep, ADDED, make)


def link_counts(
    df: DataFrame, a_path: str, b_path: str, keep: Sequence[str], text: str = "text", with_groups: bool = False
) -> DataFrame:
    """:func:`align_texts` per row, plus n_best and count_sum from corpus-wide pair counts.

    An id pair's count is the number of documents that hold it linked; ``count_sum``
    adds the counts over a text's links, ``n_best`` counts the links whose count is
    the highest of their A id.
    """
    rows = df.withColumn("_row", F.monotonically_increasing_id())
    aligned = align_texts(rows, a_path, b_path, [*keep, "_row"], text, with_groups)
    aligned = materialise(aligned, "alignment")
    pairs = aligned.select("_row", F.explode(F.arrays_zip("pair_keys", "pair_links")).alias("p")).select(
        "_row", F.col("p.pair_keys").alias("key"), F.col("p.pair_links").alias("links")
    )
    counts = pairs.groupBy("key").agg(F.count(F.lit(1)).alias("docs"))
    best = counts.groupBy(F.floor(F.col("key") / B_IDS).alias("a")).agg(F.max("docs").alias("top"))
    counts = counts.join(best, F.floor(F.col("key") / B_IDS) == F.col("a")).select("key", "docs", (F.col("docs") == F.col("top")).alias("best"))
    counts = materialise(counts, "alignment-counts")
    # always a shuffle join: the pair table grows with the corpus, so no size switch
    sums = pairs.join(counts.hint("shuffle_merge"), "key").groupBy("_row").agg(
        F.sum(F.col("links") * F.col("docs")).alias("count_sum"),
        F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"),
    )
    out = aligned.drop("pair_keys", "pair_links").join(sums, "_row", "left")
    return out.fillna(0, ["count_sum", "n_best"]).drop("_row")
