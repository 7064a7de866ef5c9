"""Packing of token sequences into windows by non-negative least squares.

Documents become token ids with an end mark and are cut into pieces of one window
and a rest. The histogram of piece lengths, at most ``window`` numbers, is all the
driver sees. Every combination of up to three lengths that fills a window exactly is
a column; non-negative least squares gives how often each should be used, the counts
are rounded and held to what exists, and the residual histogram is packed best fit,
largest first. Pieces then find their place from their rank among equals: ranks are
counted per input task, so no length, however common, meets in one task.

Defined cases: a null or empty text is its end mark alone; equal documents and
repeated or null ids are packed row by row; long texts are cut into many pieces; an
empty table gives no rows; only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

import heapq
import os
import re
import unicodedata
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseload.llm.common import pieces
from caseload.session import materialise

WINDOW = 2048
END_ID = 1
# Keys held by a worker's memory of words, and the longest that is remembered.
CACHE_KEYS, CACHE_KEY = 500_000, 48
CUT_BYTES = 1 << 20

PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()),
    T.StructField("doc_tokens", T.LongType()),
    T.StructField("ids", T.BinaryType()),
    T.StructField("task", T.IntegerType()),
    T.StructField("task_rank", T.LongType()),
])


class WordEncoder:
    """Token ids of a text as little-endian bytes, word by word with a memory.

    White space is never part of a token in this vocabulary and no merge crosses it,
    so a text's ids are those of its words in order (``array("I")`` is little-endian
    with four bytes on every platform that Spark runs its Python workers on). Words of the common alphabets are
    split here as the tokenizer's own pattern does, so that its model sees each distinct
    run of letters once, not once per neighbouring mark; other words go through the
    whole tokenizer.
    """

    SIMPLE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
    WIDER = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        show = ByteLevel(add_prefix_space=False, use_regex=False)
        # Characters below 0x530 as the byte-level alphabet writes their UTF-8 bytes.
        self.shown = {c: show.pre_tokenize_str(chr(c))[0][0] for c in range(0x20, 0x530)}
        self.words = Memory(self.word)
        self.runs = Memory(self._run)

    def _run(self, run: str) -> bytes:
        shown = run if run.isascii() else run.translate(self.shown)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def word(self, word: bytes) -> bytes:
        if word.isascii():
            text = word.decode()
            if text.isprintable() and "<|" not in text:
                return b"".join(map(self.runs.__getitem__, self.SIMPLE.findall(text.lower())))
            return self._whole(word)
        text = unicodedata.normalize("NFC", word.decode("utf-8", "replace"))
        if max(text) >= "\u0530" or not text.isprintable() or "<|" in text:
            return self._whole(word)
        return b"".join(map(self.runs.__getitem__, self.WIDER.findall("".join([c.lower() for c in text]))))

    def _whole(self, word: bytes) -> bytes:
        ids = self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def parts(self, text: bytes) -> Iterator[bytes]:
        """The ids of a text, some of its words at a time."""
        begin = 0
        while begin < len(text):
            end = min(begin + CUT_BYTES, len(text))
            while end < len(text) and text[end] not in b" \t\n\r\x0b\x0c":
                end += 1
            yield b"".join(map(self.words.__getitem__, text[begin:end].split()))
            self.words.shrink()
            self.runs.shrink()
            begin = end


class Memory(dict):
    """Remembers results for short keys, up to a number of them."""

    def __init__(self, compute):
        super().__init__()
        self.compute = compute

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= CACHE_KEY:
            self[key] = value
        return value

    def shrink(self):
        if len(self) > CACHE_KEYS:
            self.clear()


_ENCODERS: dict[str, WordEncoder] = {}


def cut_documents(df: DataFrame, tokenizer: str, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces of all documents, with their rank among equal lengths of their task."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encoder = _ENCODERS.setdefault(tokenizer, WordEncoder(tokenizer))
        task = TaskContext.get().partitionId()
        ranks: dict[int, int] = defaultdict(int)
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary()), ("task", pa.int32()), ("task_rank", pa.int64())])
        for batch in batches:
            for rows, (data, offsets) in pieces(batch, text):
                raw = data.tobytes()
                out: list[list] = [[] for _ in schema]
                for i, name in enumerate(rows.column(doc_id).to_pylist()):
                    first, done, rest = len(out[0]), 0, b""
                    parts = encoder.parts(raw[offsets[i] : offsets[i + 1]])
                    more = True
                    while more:
                        part = next(parts, None)
                        more = part is not None
                        rest += part if more else END_ID.to_bytes(4, "little")
                        while len(rest) >= 4 * window or (rest and not more):
                            ids, rest = rest[: 4 * window], rest[4 * window :]
                            n = len(ids) // 4
                            row = (name, done, n, zlib.crc32(ids), 0, ids if with_ids else None, task, ranks[n])
                            for column, value in zip(out, row, strict=True):
                                column.append(value)
                            ranks[n] += 1
                            done += n
                    out[4][first:] = [done] * (len(out[4]) - first)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    source = df.select(F.col(doc_id).cast("long").alias(doc_id), F.col(text).cast("string").alias(text))
    return source.mapInArrow(run, PIECES)


def combinations(present: np.ndarray, window: int) -> np.ndarray:
    """Rows of three lengths, ascending, that sum to the window; 0 stands for none."""
    have = np.zeros(window + 1, bool)
    have[present] = True
    have[0] = True
    lengths = np.flatnonzero(have)
    rows = []
    for a in lengths[lengths <= window // 3]:
        b = lengths[(lengths >= a) & (lengths <= (window - a) // 2)]
        b = b[have[window - a - b]]
        rows.append(np.column_stack([np.full(len(b), a), b, window - a - b]))
    return np.concatenate(rows) if rows else np.zeros((0, 3), int)


def repeat_counts(histogram: np.ndarray, combos: np.ndarray, rounds: int = 250) -> np.ndarray:
    """Non-negative x with A x near the histogram, by accelerated projected gradients.

    Column j of A counts the lengths in combination j; A is never built.
    """
    window = len(histogram) - 1

    def times(x):
        out = sum(np.bincount(combos[:, k], x, minlength=window + 1) for k in range(3))
        out[0] = 0
        return out

    def back(r):
        return r[combos[:, 0]] + r[combos[:, 1]] + r[combos[:, 2]]

    target = histogram.astype(float)
    target[0] = 0
    probe = np.ones(len(combos))
    bound = 1.0
    for _ in range(20):
        probe = back(times(probe))
        bound = np.linalg.norm(probe)
        probe /= bound
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - back(times(y) - target) / (1.02 * bound))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def plan(histogram: np.ndarray, window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths with how often each is used; together they use every piece.

    ``histogram[n]`` is the number of pieces of length n. The plan depends on the
    histogram alone and has a number of patterns bounded by the window.
    """
    left = histogram.astype(np.int64).copy()
    patterns: list[tuple[tuple[int, ...], int]] = []
    combos = combinations(np.flatnonzero(left), window)
    if len(combos):
        x = repeat_counts(left, combos)
        rounded = np.rint(x).astype(np.int64)
        order = np.argsort(-x, kind="stable")
        for j in order[rounded[order] > 0]:
            lengths = tuple(int(n) for n in combos[j] if n)
            most = min(int(left[n]) // lengths.count(n) for n in lengths)
            uses = min(int(rounded[j]), most)
            if uses:
                for n in lengths:
                    left[n] -= uses
                patterns.append((lengths, uses))
    # Residual: the longest piece first, filled up with the longest that still fit.
    alive = [-int(n) for n in np.flatnonzero(left)]
    heapq.heapify(alive)
    while alive:
        n = -alive[0]
        if not left[n]:
            heapq.heappop(alive)
            continue
        room, taken = window, []
        stock = left.copy()
        best = n
        while best > 0:
            k = int(min(stock[best], room // best))
            taken += [best] * k
            stock[best] -= k
            room -= k * best
            fit = np.flatnonzero(stock[: min(room, best) + 1])
            best = int(fit[-1]) if len(fit) else 0
        used = {m: taken.count(m) for m in set(taken)}
        uses = min(int(left[m]) // k for m, k in used.items())
        for m, k in used.items():
            left[m] -= k * uses
        patterns.append((tuple(taken), uses))
    return patterns


class Slots:
    """Where the r-th piece of a length goes: runs of ranks per length and pattern."""

    def __init__(self, patterns, window: int):
        begin, filled = 0, np.zeros(window + 1, np.int64)
        runs: list[list[tuple]] = [[] for _ in range(window + 1)]
        for lengths, uses in patterns:
            offset = 0
            for n in lengths:
                runs[n].append((int(filled[n]), begin, offset))
                filled[n] += uses
                offset += n
            begin += uses
        self.sequences = begin
        self.starts = np.concatenate([[0], np.cumsum([len(r) for r in runs])])
        self.runs = np.array([row for r in runs for row in r] or [(0, 0, 0)], np.int64).reshape(-1, 3)
        # One sorted key per run: the length above the first rank.
        self.span = max(int(filled.max()), 1) + 1
        self.keys = np.repeat(np.arange(window + 1), np.diff(self.starts)) * self.span + self.runs[: self.starts[-1], 0]

    def place(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        run = self.runs[np.searchsorted(self.keys, lengths * self.span + ranks, "right") - 1]
        return run[:, 1] + ranks - run[:, 0], run[:, 2]


def pack(df: DataFrame, tokenizer: str, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Every piece with its ``sequence_id`` and ``offset``; ``ids`` holds the tokens if asked for."""
    cut = materialise(cut_documents(df, tokenizer, window, doc_id, text, with_ids), "pieces")
    counts = materialise(cut.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = np.zeros(window + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # one row per length
        histogram[row["length"]] = row["n"]
    slots = df.sparkSession.sparkContext.broadcast(Slots(plan(histogram, window), window))
    # One row per task and length: the ranks used up by the tasks before it.
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = cut.join(base, ["task", "length"]).withColumn("rank", F.col("before") + F.col("task_rank"))
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])]
    schema = T.StructType([ranked.schema[n] for n in out] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            sequence, offset = slots.value.place(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            columns = [batch.column(n) for n in out] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema.fields])

    return ranked.select(*out, "rank").mapInArrow(run, schema)
