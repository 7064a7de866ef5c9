"""Document quality by attention-based multiple-instance learning.

A text is a bag of passages of ``WORDS`` words. Each passage is encoded from hashed
byte pairs and a few counts of its form; gated attention, learned from the labels of
whole documents alone, weighs the passages, and the weighted mean of their
representations is scored.

Defined cases: a null or empty text is one empty passage; rows without a label,
with a null label or a null id are not learned from; with several labels of a
document, each counts; repeated rows are each scored; an empty table gives no rows;
with labels of one kind only, or none, the score is their share, or 0.5. Only the
named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseload.llm.common import map_texts, segment_sums, text_bytes

WORDS = 40
PAIRS = 256
FORM = 8
HIDDEN, GATE = 24, 12
# Labelled documents used for training at most, about; and passages of one of them.
TRAIN_DOCUMENTS = 2500
TRAIN_PASSAGES = 64
EPOCHS = 60
THRESHOLD = 0.3
STEP = 1 << 19

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
KIND = np.zeros(256, np.int64)  # 0 other, 1 upper, 2 digit, 3 punctuation, 4 beyond ASCII
KIND[65:91], KIND[48:58], KIND[128:] = 1, 2, 4
KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 3


def passage_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One row per passage, and the passage offsets of the texts (one each at least)."""
    n = len(offsets) - 1
    blocks, counts = [], np.zeros(n, np.int64)
    carry: tuple[int, int] | None = None  # text and words of it seen in earlier steps
    begin = 0
    while begin < len(data):
        end = min(begin + STEP, len(data))
        if end < len(data):  # cut after a space or a text, if there is one
            cut = np.flatnonzero(SPACE[data[begin:end]])
            cut = max(int(cut[-1]) + 1 + begin if len(cut) else begin, int(offsets[np.searchsorted(offsets, end, "right") - 1]))
            end = cut if cut > begin else end
        rows, owner, carry = _step(data[begin:end], np.clip(offsets, begin, end) - begin, carry)
        blocks.append((rows, owner))
        begin = end
    # Steps share a passage if a text goes on; its rows are added up.
    keyed = [owner for _, owner in blocks]
    if keyed:
        owner = np.concatenate(keyed)
        raw = np.concatenate([rows for rows, _ in blocks])
        new = np.append(True, (owner[1:] != owner[:-1]).any(axis=1))
        raw = np.add.reduceat(raw, np.flatnonzero(new), axis=0)
        texts = owner[new][:, 0]
        counts += np.bincount(texts, minlength=n)
    else:
        raw, texts = np.zeros((0, PAIRS + FORM), np.float32), np.zeros(0, np.int64)
    bare = np.flatnonzero(counts == 0)
    if len(bare):
        place = np.searchsorted(texts, bare)
        raw = np.insert(raw, place, 0, axis=0)
        counts[bare] = 1
    return _scaled(raw), np.concatenate([[0], np.cumsum(counts)])


def _step(data, offsets, carry):
    """Counts of the passages in a step; ``carry`` continues the text cut before it."""
    size = np.diff(offsets)
    text = np.repeat(np.arange(len(size)), size)
    space = SPACE[data]
    first = np.zeros(len(data), bool)
    first[offsets[:-1][size > 0]] = True
    before = np.append(True, space[:-1])
    start = ~space & (before | first)
    starts = np.flatnonzero(start)
    words = np.cumsum(start)
    base = np.where(size > 0, words[np.minimum(offsets[:-1], len(data) - 1)] - start[np.minimum(offsets[:-1], len(data) - 1)], 0)
    seen = carry[1] if carry and size[carry[0]] else 0
    index = words - base[text]
    if seen:
        index[text == carry[0]] += seen
    number = np.maximum(index - 1, 0) // WORDS
    change = np.append(True, (text[1:] != text[:-1]) | (number[1:] != number[:-1]))
    passage = np.cumsum(change) - 1
    total = int(passage[-1]) + 1
    owner = np.stack([text[change], number[change]], axis=1)
    lower = data | np.where(KIND[data] == 1, 32, 0).astype(np.uint8)
    pair = lower.astype(np.int64)
    pair[1:] = pair[1:] * 31 + lower[:-1] * 17
    column = passage * PAIRS + pair % PAIRS
    pairs = np.bincount(column, minlength=total * PAIRS).reshape(total, PAIRS)
    kinds = np.bincount(passage * 5 + KIND[data], minlength=total * 5).reshape(total, 5)
    # A word equal to the one before it, told by a sum over its bytes and its length.
    ends = np.append(starts[1:], len(data))
    weight = (lower.astype(np.int64) + 1) * (lower.astype(np.int64) + 7) * ~space
    if len(starts):
        mark = np.add.reduceat(weight, starts) * 64 + (ends - starts) % 64
        of = passage[starts]
        again = np.append(False, (mark[1:] == mark[:-1]) & (of[1:] == of[:-1]))
        repeats = np.bincount(of, again, minlength=total)
        count = np.bincount(of, minlength=total)
    else:
        repeats = count = np.zeros(total)
    bytes_ = np.bincount(passage, minlength=total)
    rows = np.column_stack([pairs, kinds[:, 1:], repeats, count, bytes_]).astype(np.float32)
    rows = np.column_stack([rows, np.zeros((total, FORM - 7), np.float32)])
    last = int(text[-1])
    return rows, owner, (last, int(index[-1]))


def _scaled(raw: np.ndarray) -> np.ndarray:
    size = np.maximum(raw[:, PAIRS + 6 : PAIRS + 7], 1)
    words = np.maximum(raw[:, PAIRS + 5 : PAIRS + 6], 1)
    out = np.sqrt(raw / size).astype(np.float32)
    out[:, PAIRS + 4] = raw[:, PAIRS + 4] / words[:, 0]
    out[:, PAIRS + 5] = np.log1p(raw[:, PAIRS + 5]) / 4
    out[:, PAIRS + 6] = size[:, 0] / words[:, 0] / 10
    out[:, PAIRS + 7] = 1
    return out


class AttentionModel:
    """h = tanh(xE); a = softmax(w . (tanh(hV) * sigmoid(hU))); score = sigmoid(c . sum(a h) + b)."""

    def __init__(self, seed: int = 7):
        draw = np.random.default_rng(seed)
        scale = lambda a, b: (draw.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.weights = [scale(PAIRS + FORM, HIDDEN) * 4, scale(HIDDEN, GATE), scale(HIDDEN, GATE), scale(GATE, 1), scale(HIDDEN, 1), np.zeros((1, 1), np.float32)]
        self.constant: float | None = None

    def _forward(self, x, bags):
        e, v, u, w, c, b = self.weights
        h = np.tanh(x @ e)
        t, g = np.tanh(h @ v), 1 / (1 + np.exp(-(h @ u)))
        s = (t * g @ w)[:, 0]
        size = np.diff(bags)
        s = np.exp(s - np.repeat(np.maximum.reduceat(s, bags[:-1]), size))
        a = s / np.repeat(np.add.reduceat(s, bags[:-1]), size)
        z = np.add.reduceat(a[:, None] * h, bags[:-1], axis=0)
        logit = (z @ c)[:, 0] + b[0, 0]
        return h, t, g, a, z, 1 / (1 + np.exp(-np.clip(logit, -30, 30)))

    def scores(self, x: np.ndarray, bags: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(bags) - 1, self.constant)
        return self._forward(x, bags)[-1].astype(float)

    def attention(self, x: np.ndarray, bags: np.ndarray) -> np.ndarray:
        return self._forward(x, bags)[3]

    def gradients(self, x, bags, y):
        e, v, u, w, c, b = self.weights
        h, t, g, a, z, p = self._forward(x, bags)
        d = ((p - y) / len(y)).astype(np.float32)
        size = np.diff(bags)
        dz = np.repeat(d[:, None] * c[:, 0], size, axis=0)
        da = (dz * h).sum(axis=1)
        ds = a * (da - np.repeat(np.add.reduceat(a * da, bags[:-1]), size))
        dgate = ds[:, None] * w[:, 0]
        dt, dg = dgate * g * (1 - t * t), dgate * t * g * (1 - g)
        dh = (a[:, None] * dz + dt @ v.T + dg @ u.T) * (1 - h * h)
        return [x.T @ dh, h.T @ dt, h.T @ dg, (t * g).T @ ds[:, None], z.T @ d[:, None], d.sum().reshape(1, 1)]

    def fit(self, x, bags, y, epochs=EPOCHS, batch=64, rate=0.01, decay=1e-4):
        if len(set(y.tolist())) < 2:
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        draw = np.random.default_rng(3)
        moments = [(np.zeros_like(w), np.zeros_like(w)) for w in self.weights]
        step = 0
        for epoch in range(epochs):
            order = draw.permutation(len(y))
            for at in range(0, len(order), batch):
                chosen = np.sort(order[at : at + batch])
                rows = np.concatenate([np.arange(bags[i], bags[i + 1]) for i in chosen])
                part = np.concatenate([[0], np.cumsum(np.diff(bags)[chosen])])
                step += 1
                speed = rate * (1 - epoch / epochs) + 1e-4
                for w, grad, (m, q) in zip(self.weights, self.gradients(x[rows], part, y[chosen]), moments, strict=True):
                    grad = grad + decay * w
                    m += 0.1 * (grad - m)
                    q += 0.001 * (grad * grad - q)
                    w -= speed * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.999**step)) + 1e-8)
        return self


def train(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    documents: int = TRAIN_DOCUMENTS,
    passages: int = TRAIN_PASSAGES,
) -> AttentionModel:
    """Fit on about ``documents`` labelled rows, chosen by a hash of their id.

    Of a longer text, ``passages`` evenly spaced passages are learned from. The chosen
    ids are the small side of the join by construction (twice ``documents`` at most).
    """
    known = labels.select(doc_id, label).where(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
    share = min(1.0, documents / max(known.count(), 1))
    place = F.pmod(F.xxhash64(F.lit("quality"), F.col(doc_id).cast("string")), F.lit(1 << 30))
    chosen = known.where(place < share * (1 << 30)).limit(2 * documents)
    labelled = docs.select(doc_id, text).join(F.broadcast(chosen), doc_id)
    schema = f"y double, rows int, id string, x binary"

    def encode(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                x, _ = passage_features(*text_bytes(batch.column(text).slice(i, 1)))
                x = x[np.unique(np.linspace(0, len(x) - 1, min(len(x), passages)).astype(int))].astype(np.float16)
                columns = [[float(batch.column(label)[i].as_py())], [len(x)], [str(batch.column(doc_id)[i])], [x.tobytes()]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, (pa.float64(), pa.int32(), pa.string(), pa.binary()), strict=True)],
                    ["y", "rows", "id", "x"],
                )

    # Rows in an order that does not depend on how the table is cut.
    rows = labelled.mapInArrow(encode, schema).toArrow().sort_by([("id", "ascending"), ("x", "ascending")])
    blocks = [np.frombuffer(x, np.float16).reshape(-1, PAIRS + FORM) for x in rows.column("x").to_pylist()]
    y = np.clip(rows.column("y").to_numpy(), 0, 1)
    if not blocks:
        return AttentionModel().fit(None, None, y)
    bags = np.concatenate([[0], np.cumsum(rows.column("rows").to_numpy())])
    return AttentionModel().fit(np.concatenate(blocks).astype(np.float32), bags, y)


def score(df: DataFrame, model: AttentionModel, keep: Sequence[str], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` plus ``score`` and ``predicted``; whole texts, no shuffle."""
    fields = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        def rate(data, offsets):
            x, bags = passage_features(data, offsets)
            p = shared.value.scores(x, bags)
            return p, (p >= threshold).astype(np.int32)

        return rate

    return map_texts(df, text, keep, fields, make)
