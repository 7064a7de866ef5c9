"""Language identification by prediction by partial matching over bytes.

Every language has a tree of byte contexts up to ``ORDER`` bytes with the counts of
what followed. A text's code length in a language is the exact length that a
frozen PPM-C coder with exclusions would need: from the longest known context,
an escape to the next shorter one for each context that has never seen the byte,
bytes already ruled out left aside, and a uniform code at the end.

Defined cases: a null text or one without a letter is ``und`` with score 0; equal
code lengths go to the language first by name; repeated rows are each scored; an
empty table gives no rows; without any training text every row is ``und``. Only
the named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseload.llm.common import map_texts, sample_share, segment_sums

ORDER = 4
# Bytes of training text per language, and the longest text used for training.
TRAIN_BYTES = 1_500_000
MAX_TRAIN_TEXT = 64 << 10
UNKNOWN = "und"
EMPTY = np.uint64(0xFFFF_FFFF_FFFF_FFFF)
STEP = 1 << 19


def grams(data: np.ndarray, offsets: np.ndarray, order: int = ORDER, begin: int = 0, end: int | None = None) -> np.ndarray:
    """Bytes ``begin`` to ``end``, each packed with the ``order`` bytes before it.

    A text begins after zeros.
    """
    end = len(data) if end is None else end
    edges = np.clip(offsets, begin, end)
    at = np.arange(begin, end) - np.repeat(offsets[:-1], np.diff(edges))
    out = np.zeros(end - begin, np.uint64)
    for back in range(order, -1, -1):
        low = max(begin - back, 0)
        shifted = np.zeros(end - begin, np.uint64)
        shifted[low + back - begin :] = data[low : end - back]
        shifted[at < back] = 0
        out = (out << np.uint64(8)) | shifted
    return out


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return place, sorted_keys[place] == keys


class ContextTree:
    """Counts of one language: per order the contexts with totals, and their bytes."""

    def __init__(self, text_grams: np.ndarray, order: int = ORDER):
        self.order, self.levels = order, []
        for k in range(order + 1):
            seen, counts = np.unique(text_grams & np.uint64((1 << 8 * (k + 1)) - 1), return_counts=True)
            contexts, first = np.unique(seen >> np.uint64(8), return_index=True)
            level = {"grams": seen, "n": counts.astype(float), "contexts": contexts}
            level["total"] = np.add.reduceat(level["n"], first)
            level["distinct"] = np.diff(np.append(first, len(seen))).astype(float)
            if k:  # what is left of the shorter context once this one's bytes are ruled out
                below = self.levels[-1]
                short = contexts & np.uint64((1 << 8 * (k - 1)) - 1)
                node, _ = _find(below["contexts"], short)
                tail, _ = _find(below["grams"], seen & np.uint64((1 << 8 * k) - 1))
                level["left_total"] = below["total"][node] - np.add.reduceat(below["n"][tail], first)
                level["left_distinct"] = below["distinct"][node] - level["distinct"]
            self.levels.append(level)

    def code_lengths(self, keys: np.ndarray) -> np.ndarray:
        """Bits for the last byte of each packed gram after the bytes before it."""
        bits = np.zeros(len(keys))
        todo = np.ones(len(keys), bool)
        above = np.full(len(keys), -1)
        for k in range(self.order, -1, -1):
            level = self.levels[k]
            node, known = _find(level["contexts"], (keys >> np.uint64(8)) & np.uint64((1 << 8 * k) - 1))
            known &= todo
            first, later = known & (above < 0), known & (above >= 0)
            total, distinct = np.zeros(len(keys)), np.zeros(len(keys))
            total[first], distinct[first] = level["total"][node[first]], level["distinct"][node[first]]
            if later.any():
                upper = self.levels[k + 1]
                total[later] = upper["left_total"][above[later]]
                distinct[later] = upper["left_distinct"][above[later]]
            place, hit = _find(level["grams"], keys & np.uint64((1 << 8 * (k + 1)) - 1))
            hit &= known
            bits[hit] += np.log2(total[hit] + distinct[hit]) - np.log2(level["n"][place[hit]])
            escape = known & ~hit & (distinct > 0)
            bits[escape] += np.log2(total[escape] + distinct[escape]) - np.log2(distinct[escape])
            todo &= ~hit
            above = np.where(known, node, above)
        bits[todo] += np.log2(max(256 - len(self.levels[0]["grams"]), 1))
        return bits


class Coder:
    """Code lengths in all languages at once, looked up by the packed gram.

    Grams known to some language lie in an open-addressing table; those are most
    bytes of ordinary text. The few others walk the trees.
    """

    def __init__(self, languages: Sequence[str], trees: Sequence[ContextTree]):
        self.languages, self.trees = list(languages), list(trees)
        keys = np.unique(np.concatenate([tree.levels[-1]["grams"] for tree in trees]))
        self.costs = np.stack([tree.code_lengths(keys) for tree in trees], axis=1)
        self.bits = max(10, int(np.ceil(np.log2(4 * len(keys)))))
        self.slots = np.full(1 << self.bits, EMPTY)
        self.rows = np.zeros(1 << self.bits, np.int32)
        slot, waiting = self._slot(keys), np.arange(len(keys))
        while len(waiting):
            free = np.flatnonzero(self.slots[slot[waiting]] == EMPTY)
            _, winner = np.unique(slot[waiting[free]], return_index=True)
            placed = waiting[free[winner]]
            self.slots[slot[placed]], self.rows[slot[placed]] = keys[placed], placed
            waiting = np.setdiff1d(waiting, placed, assume_unique=True)
            slot[waiting] = (slot[waiting] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def code_lengths(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        held = self.slots[slot]
        rows = np.where(held == keys, self.rows[slot], -1)
        open_ = np.flatnonzero((held != keys) & (held != EMPTY))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            held = self.slots[slot[open_]]
            match = held == keys[open_]
            rows[open_[match]] = self.rows[slot[open_[match]]]
            open_ = open_[~match & (held != EMPTY)]
        out = self.costs[rows]
        rare = np.flatnonzero(rows < 0)
        if len(rare):
            new, back = np.unique(keys[rare], return_inverse=True)
            out[rare] = np.stack([tree.code_lengths(new) for tree in self.trees], axis=1)[back]
        return out

    def text_bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of every text in every language; any length, a step of bytes at a time."""
        totals = np.zeros((len(offsets) - 1, len(self.languages)))
        for begin in range(0, len(data), STEP):
            end = min(begin + STEP, len(data))
            keys = grams(data, offsets, self.trees[0].order, begin, end)
            totals += segment_sums(self.code_lengths(keys), np.clip(offsets, begin, end) - begin)
        return totals


def train(
    labelled: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    train_bytes: int = TRAIN_BYTES,
    order: int = ORDER,
) -> Coder | None:
    """A coder from a bounded sample of labelled rows; None if there is none.

    The sample holds about ``train_bytes`` bytes per language in texts of up to
    ``MAX_TRAIN_TEXT`` bytes, so the driver receives no more than that.
    """
    size = F.octet_length(text)
    usable = labelled.select(doc_id, text, lang).where(F.col(lang).isNotNull() & (size > 0) & (size <= MAX_TRAIN_TEXT))
    rows = sample_share(usable, lang, size, train_bytes, doc_id, "language").select(lang, text).toArrow()
    names = sorted(set(rows.column(lang).to_pylist()))
    trees = []
    for name in names:
        texts = [t.encode() for t, n in zip(rows.column(text).to_pylist(), rows.column(lang).to_pylist(), strict=True) if n == name]
        data = np.frombuffer(b"".join(texts), np.uint8)
        trees.append(ContextTree(grams(data, np.cumsum([0, *map(len, texts)]), order), order))
    return Coder(names, trees) if names else None


def identify(df: DataFrame, coder: Coder | None, keep: Sequence[str], text: str = "text") -> DataFrame:
    """``keep`` plus ``lang_pred``, ``score`` (posterior of equal priors), ``bits_per_byte``.

    Whole texts are read, in batches of bounded size; no row is shuffled.
    """
    fields = T.StructType([
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("bits_per_byte", T.DoubleType()),
    ])
    shared = df.sparkSession.sparkContext.broadcast(coder)

    def make():
        model = shared.value

        def predict(data, offsets):
            n = len(offsets) - 1
            if model is None:
                return [UNKNOWN] * n, np.zeros(n), np.zeros(n)
            bits = model.text_bits(data, offsets)
            best = bits.argmin(axis=1)
            least = bits[np.arange(n), best]
            share = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
            lettered = [has_letter(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            names = [model.languages[i] if ok else UNKNOWN for i, ok in zip(best, lettered, strict=True)]
            return names, np.where(lettered, share, 0.0), least / np.maximum(np.diff(offsets), 1)

        return predict

    return map_texts(df, text, keep, fields, make)


def has_letter(data: np.ndarray) -> bool:
    """Whether UTF-8 bytes hold a letter of any script."""
    lower = data[:256] | 32
    if ((lower >= 97) & (lower <= 122)).any():
        return True
    return any(c.isalpha() for c in data.tobytes().decode("utf-8", "replace"))
