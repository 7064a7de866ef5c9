"""Byte-level BPE encoding and decoding with recursive DuckDB queries per partition.

A text is split by the vocabulary's pattern; each distinct piece is encoded once per
worker. Pieces become rows with their list of tokens; a recursive query joins
neighbours to the merge table and contracts each piece's leftmost pair of least rank
until none is left. Decoding joins the tokens to the vocabulary and aggregates their
bytes in order of position.

Defined cases: a null or empty text has no tokens and decodes to no bytes; a piece that is a token
itself is that token; repeated rows are each encoded; an empty table gives no
rows; only the named columns are read, so others cannot clash. A piece above
``LONG_PIECE`` bytes would need as many rounds as it has merges, so its pairs are taken
from a heap instead, in the same order.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Sequence
from itertools import pairwise
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from caseload.llm.common import map_texts

# Keys held anew by a worker's memory, the longest that is remembered, pieces per query and
# their squared lengths.
CACHE_KEYS, CACHE_KEY = 250_000, 64
PIECES_PER_QUERY, WORK_PER_QUERY = 60_000, 100_000_000
LONG_PIECE = 200

# White space in the sense of the pattern.
WHITE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# White characters: those of one byte, and the others' codes by their number of bytes.
NARROW_WHITE = np.array([b < 0x80 and chr(b).isspace() for b in range(256)])
WIDE_WHITE = {n: [int.from_bytes(c, "big") for i in range(0x80, 0x3001) if chr(i).isspace() and len(c := chr(i).encode()) == n] for n in (2, 3)}
WIDE_LEAD = np.isin(np.arange(256), [code >> 8 * (n - 1) for n, codes in WIDE_WHITE.items() for code in codes])
IDS_TYPE = pa.list_(pa.int32())

ENCODE = """
WITH RECURSIVE steps AS (
    SELECT piece, tokens FROM start
    UNION ALL
    SELECT s.piece, s.tokens[:(b.best & 4294967295) - 1] || [(b.best >> 32)::INTEGER] || s.tokens[(b.best & 4294967295) + 2:]
    FROM steps s JOIN (
        SELECT t.piece, min(m.merged | t.pos) AS best
        FROM (
            SELECT piece, generate_subscripts(tokens[2:], 1) AS pos,
                   unnest(tokens[:-2])::BIGINT << 32 | unnest(tokens[2:]) AS pair
            FROM steps
        ) t
        JOIN merges m ON m.pair = t.pair
        GROUP BY t.piece
    ) b ON b.piece = s.piece
), last AS (
    SELECT piece, min(len(tokens)) AS size FROM steps GROUP BY piece
)
SELECT s.tokens FROM steps s JOIN last l ON l.piece = s.piece AND l.size = len(s.tokens) ORDER BY s.piece
"""

DECODE = """
SELECT d.piece, unhex(string_agg(v.digits, '' ORDER BY d.pos)) AS bytes
FROM ids d JOIN vocabulary v ON v.token = d.token GROUP BY d.piece ORDER BY d.piece
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


def merge_rows(ranks: dict[bytes, int]) -> pa.Table:
    """Every way to make a token from two tokens: both in one number, and the token above 32 bits for a place."""
    first, second, merged = [], [], []
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
            if a is not None and b is not None:
                first.append(a)
                second.append(b)
                merged.append(rank)
    return pa.table({"pair": np.array(first, np.int64) << 32 | np.array(second, np.int64), "merged": np.array(merged, np.int64) << 32})


class PieceCoder:
    """Token ids and decoded bytes of pieces, by DuckDB in this worker's memory."""

    def __init__(self, ranks: dict[bytes, int]):
        import duckdb

        self.ranks = ranks
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "300MB"})
        self.db.execute("SET preserve_insertion_order = false")
        self.db.register("given", merge_rows(ranks))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM given")
        self.db.unregister("given")
        tokens = pa.table({"token": pa.array(ranks.values(), pa.int32()), "digits": [t.hex() for t in ranks]})
        self.db.register("given", tokens)
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM given")
        self.db.unregister("given")

    def encode(self, pieces: Sequence[bytes]) -> pa.ListArray:
        """The ids of each piece."""
        whole = [self.ranks.get(piece) for piece in pieces]
        ready = [i for i, token in enumerate(whole) if token is not None]
        long = [i for i, token in enumerate(whole) if token is None and len(pieces[i]) > LONG_PIECE]
        queued = [i for i, token in enumerate(whole) if token is None and len(pieces[i]) <= LONG_PIECE]
        found = [_lists(np.array([whole[i] for i in ready], np.int32), np.ones(len(ready), np.int32))]
        found += [pa.array([self._by_heap(pieces[i])], IDS_TYPE) for i in long]
        # A piece's lists of all rounds hold up to half the square of its length.
        work = np.cumsum(np.fromiter((len(pieces[i]) ** 2 for i in queued), np.int64, len(queued)))
        query = np.arange(len(queued)) // PIECES_PER_QUERY + work // WORK_PER_QUERY
        ends = [*(np.flatnonzero(np.diff(query)) + 1).tolist(), len(queued)] if queued else []
        for at, end in pairwise([0, *ends]):
            part = [pieces[i] for i in queued[at:end]]
            start = _lists(self.byte_ids[np.frombuffer(b"".join(part), np.uint8)], np.array([*map(len, part)]))
            self.db.register("start", pa.table({"piece": np.arange(len(part), dtype=np.int32), "tokens": start}))
            found += self.db.sql(ENCODE).to_arrow_table().column("tokens").cast(IDS_TYPE).chunks
            self.db.unregister("start")
        return pa.concat_arrays(found).take(pa.array(np.argsort(np.array(ready + long + queued, np.int64))))

    def decode(self, encoded: pa.ListArray) -> list[bytes]:
        """The bytes of each list of ids; an empty list has none."""
        out = [b""] * len(encoded)
        for at in range(0, len(encoded), PIECES_PER_QUERY):
            part = encoded[at : at + PIECES_PER_QUERY]
            size = part.value_lengths().to_numpy()
            pos = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            self.db.register("ids", pa.table({"piece": np.repeat(np.arange(len(part)), size), "pos": pos, "token": part.flatten()}))
            found = self.db.sql(DECODE).to_arrow_table()
            for i, raw in zip(found.column("piece").to_numpy().tolist(), found.column("bytes").to_numpy().tolist(), strict=True):
                out[at + i] = raw
            self.db.unregister("ids")
        return out

    def _by_heap(self, piece: bytes) -> list[int]:
        """The same contractions for a long piece: pairs by rank and place from a heap."""
        ranks, text = self.ranks, piece
        end = list(range(1, len(text) + 1))  # end of the token that starts here
        before = list(range(-1, len(text) - 1))
        alive = bytearray(b"\1" * len(text))
        heap: list[tuple[int, int, int]] = []

        def offer(a):
            b = end[a]
            if b < len(text) and (rank := ranks.get(text[a : end[b]])) is not None:
                heapq.heappush(heap, (rank, a, end[b]))

        for a in range(len(text)):
            offer(a)
        while heap:
            _, a, stop = heapq.heappop(heap)
            b = end[a]
            if not alive[a] or b >= len(text) or end[b] != stop:
                continue
            alive[b] = 0
            end[a] = stop
            if stop < len(text):
                before[stop] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        out, a = [], 0
        while a < len(text):
            out.append(ranks[text[a : end[a]]])
            a = end[a]
        return out


def _lists(flat: np.ndarray, size: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(flat))


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the chunks of UTF-8 texts start: at each text and each single space between
    other characters. Pieces of the pattern never reach over such a place."""
    white = np.append(NARROW_WHITE[data], False)
    lead = np.flatnonzero(WIDE_LEAD[data])
    if len(lead):
        after = np.append(data, [0, 0]).astype(np.int64)
        code = after[lead] << 16 | after[lead + 1] << 8 | after[lead + 2]
        for size in (2, 3):
            at = lead[np.isin(code >> 8 * (3 - size), WIDE_WHITE[size])]
            for k in range(size):
                white[at + k] = True
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    space = np.flatnonzero(data == 0x20)
    space = space[~(edge[space] | edge[space + 1])]
    edge[space[~(white[space - 1] | white[space + 1])]] = True
    return np.flatnonzero(edge[:-1])


class TextCoder:
    """Texts cut into chunks at single spaces; a chunk's pieces do not depend on the rest."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pieces = PieceCoder(ranks)
        # Both classes spelled out, so that they are the pattern's own.
        spelled = pattern.replace(r"[^\s", "[^" + WHITE[1:-1]).replace(r"\s", WHITE).replace(r"\S", "[^" + WHITE[1:])
        self.pattern = regex.compile(spelled)
        self.digits = pa.array([b"%d," % i for i in range(max(ranks.values()) + 1)], pa.large_binary())
        # What is remembered of pieces: the ids as text with a comma behind every one, their
        # number and the bytes. Once there are many, those not met since are forgotten.
        self.known: dict[str, tuple[bytes, int, bytes]] = {}
        self.older: dict[str, tuple[bytes, int, bytes]] = {}

    def encode(self, texts: Sequence[str]) -> list[tuple[int, bytes, bytes]]:
        """Per text the number of ids, the ids as text and the bytes they decode to."""
        raw = [text.encode() for text in texts]
        found = self.encode_bytes(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([*map(len, raw)], dtype=np.int64)))
        return [(n, bytes(ids), bytes(decoded)) for n, ids, decoded in zip(*found, strict=True)]

    def encode_bytes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[int], list[memoryview], list[memoryview]]:
        """The same of valid UTF-8 texts ``data[offsets[i]:offsets[i + 1]]``.

        Equal chunks, then equal pieces of the batch are found by Arrow and looked up once.
        """
        starts = chunk_starts(data, offsets)
        cuts = pa.py_buffer(np.append(starts, len(data)).astype(np.int64))
        chunks = pa.LargeStringArray.from_buffers(len(starts), cuts, pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        split, upto = self._split(chunks.dictionary.to_numpy(False).tolist())
        pieces = pa.array(split, pa.large_string()).dictionary_encode()
        entries = self._entries(pieces.dictionary.to_numpy(False).tolist())
        size = np.append(0, np.cumsum(np.fromiter(map(SIZE, entries), np.int64, len(entries))[pieces.indices.to_numpy()]))
        size = np.diff(size[upto])[chunks.indices.to_numpy()]
        # Chunks of text i: from first[i] to first[i + 1].
        first = np.searchsorted(starts, offsets)
        found = []
        for part in (IDS, RAW):
            values = pa.array([*map(part, entries)], pa.large_binary())
            held = joined(values.take(pieces.indices), upto)
            found.append(joined(held.take(chunks.indices), first))
        (ids, ids_at), (raw, raw_at) = map(in_row, found)
        return (
            np.diff(np.append(0, np.cumsum(size))[first]).tolist(),
            [ids[a : max(a, b - 1)] for a, b in pairwise(ids_at)],
            [raw[a:b] for a, b in pairwise(raw_at)],
        )

    def _split(self, chunks: list[str]) -> tuple[list[str], np.ndarray]:
        """The chunks' pieces in a row, and where each chunk's begin and the last one's end.

        Neighbours that would be cut apart again where they meet are split as one text.
        """
        loose = [i for i, c in enumerate(chunks) if c[0] != " " or c[1:2].isspace() or c[-1].isspace()]
        pieces, at = [], 0
        for i in [*loose, len(chunks)]:
            pieces += self.pattern.findall("".join(chunks[at:i]))
            if i < len(chunks):
                pieces += self.pattern.findall(chunks[i])
            at = i + 1
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        chunk_ends = np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks)))
        return pieces, np.append(0, np.searchsorted(ends, chunk_ends, "right"))

    def _entries(self, pieces: list[str]) -> list[tuple[bytes, int, bytes]]:
        if len(self.known) > CACHE_KEYS:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        absent = [p for p in pieces if p not in known]
        if older:
            known.update((p, older[p]) for p in absent if p in older)
            absent = [p for p in absent if p not in older]
        ids = self.pieces.encode([p.encode() for p in absent])
        sizes = ids.value_lengths().to_numpy()
        text, at = in_row(joined(self.digits.take(ids.flatten()), np.append(0, np.cumsum(sizes))))
        text = bytes(text)
        found = zip([text[a:b] for a, b in pairwise(at)], sizes.tolist(), self.pieces.decode(ids), strict=True)
        known.update(zip(absent, found, strict=True))
        entries = [*map(known.__getitem__, pieces)]
        for piece in absent:
            if len(piece) > CACHE_KEY:
                del known[piece]
        return entries


IDS, SIZE, RAW = itemgetter(0), itemgetter(1), itemgetter(2)


def joined(values: pa.LargeBinaryArray, at: np.ndarray) -> pa.LargeBinaryArray:
    """Values from ``at[i]`` to ``at[i + 1]`` as one."""
    if not len(values):
        return pa.array([b""] * (len(at) - 1), pa.large_binary())
    ends = np.frombuffer(values.buffers()[1], np.int64)[values.offset + at]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(ends), values.buffers()[2]])


def in_row(values: pa.LargeBinaryArray) -> tuple[memoryview, list[int]]:
    """All bytes, and where each value begins and the last one ends."""
    if not len(values):
        return memoryview(b""), [0]
    _, at, data = values.buffers()
    return memoryview(data if data is not None else b""), np.frombuffer(at, np.int64)[: len(values) + 1].tolist()


def valid(data: np.ndarray, offsets: np.ndarray) -> bool:
    """Whether every text is valid UTF-8: the whole is, and no text begins within a character."""
    try:
        str(memoryview(data), "utf-8")
    except UnicodeDecodeError:
        return False
    starts = offsets[:-1][offsets[:-1] < len(data)]
    return not ((data[starts] & 0xC0) == 0x80).any()


_CODERS: dict[tuple[str, str], TextCoder] = {}


def encode(df: DataFrame, ranks_path: str, pattern: str, keep: Sequence[str], text: str = "text", with_values: bool = False) -> DataFrame:
    """``keep`` plus ``n_tokens, ids_sha256, decoded_sha256``; with ``ids`` and ``decoded`` if asked for."""
    names = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    names += [("ids", T.StringType()), ("decoded", T.BinaryType())] if with_values else []

    def make():
        coder = _CODERS.get((ranks_path, pattern))
        if coder is None:
            coder = _CODERS[ranks_path, pattern] = TextCoder(read_ranks(ranks_path), pattern)

        def run(data, offsets):
            if not valid(data, offsets):
                texts = [bytes(data[a:b]).decode("utf-8", "replace").encode() for a, b in pairwise(offsets)]
                data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([*map(len, texts)]))
            sizes, ids, raw = coder.encode_bytes(data, offsets)
            columns = [sizes, [hashlib.sha256(i).hexdigest() for i in ids], [hashlib.sha256(d).hexdigest() for d in raw]]
            return columns + ([[str(i, "ascii") for i in ids], [bytes(d) for d in raw]] if with_values else [])

        return run

    return map_texts(df, text, keep, T.StructType([T.StructField(n, t) for n, t in names]), make)
