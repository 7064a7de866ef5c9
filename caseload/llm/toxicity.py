"""Toxicity by non-negative positive-unlabelled (nnPU) learning.

Only confirmed toxic documents are positives; every other document is unlabelled,
a mix of toxic and clean ones. The class prior (the toxic share) is the share of
toxic labels among the labelled training rows. A linear classifier on hashed words
is trained in numpy with the non-negative risk estimator: the
negative-class risk of the unlabelled set, corrected by the prior times the
positives' negative-class risk, is never allowed below zero; when a batch drives it
below, the step goes back up that term instead (Kiryo et al., 2017). The loss is the
logistic loss (the sigmoid loss saturates here: with a strongly negative bias the
positives' gradients vanish and no word outweighs it), so the score is the sigmoid of
the classifier's output and 0.5 is its decision point.

Features are computed from whole texts in Arrow tasks: words are runs of ASCII
letters and digits and of bytes beyond ASCII, lower-cased; the words present in a
text are hashed into ``DIMENSIONS`` slots with value 1. (Unit-length counts and word
pairs were tried: one insult among hundreds of words then weighs too little, and
rare pairs let the classifier learn single positives by heart.) Training reads a bounded sample: the ``TRAIN_POSITIVES``
positives and ``TRAIN_UNLABELLED`` unlabelled training documents of smallest hash of
their id; scoring covers every row.

Defined cases: a null or empty text has no features and scores the sigmoid of the
bias; rows with a null label or null id are not learned from as positives; repeated
rows are each scored; an empty table gives no rows. Without positives the weights stay
zero and the bias is very negative (score near 0); the prior is kept within
[0.001, 0.999]. Only the named columns are read; kept columns named like the added
ones are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseload.llm.common import map_texts, segment_sums
from caseload.llm.tokens import hashed_words

DIMENSIONS = 1 << 18
# Training documents read at most (documented bounds on the fitted sample).
TRAIN_POSITIVES = 4000
TRAIN_UNLABELLED = 16000
ITERATIONS = 200
STEP = 0.05
PENALTY = 1e-3
MIN_DOCUMENTS = 20
THRESHOLD = 0.5

WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CSR rows of the texts: row offsets, slots of the words present, and ones."""
    n = len(offsets) - 1
    spaced = np.where(WORD[data], data, np.uint8(0x20))
    text, h, _, _, _ = hashed_words(spaced, offsets)
    slots = (h.view(np.uint64) % np.uint64(DIMENSIONS)).astype(np.int64)
    keys = np.unique(text.astype(np.int64) * DIMENSIONS + slots)
    rows, slot = keys // DIMENSIONS, keys % DIMENSIONS
    return np.searchsorted(rows, np.arange(n + 1), "left"), slot, np.ones(len(slot))


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    prior: float

    def decide(self, indptr: np.ndarray, slot: np.ndarray, value: np.ndarray) -> np.ndarray:
        return segment_sums(self.weights[slot] * value, indptr) + self.bias


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))


def fit(positives, unlabelled, prior: float, iterations: int = ITERATIONS) -> Model:
    """nnPU with the logistic loss, full-batch Adam steps and an L2 penalty.

    ``positives`` and ``unlabelled`` are CSR sets ``(indptr, slot, value)``. Slots held
    by fewer than ``MIN_DOCUMENTS`` of all these documents keep weight 0, so that no
    slot can stand for one document alone.
    """
    weights, bias = np.zeros(DIMENSIONS), 0.0
    if len(positives[0]) <= 1:
        return Model(weights, -30.0, prior)
    held = np.bincount(np.concatenate([positives[1], unlabelled[1]]), minlength=DIMENSIONS) >= MIN_DOCUMENTS
    p, u = _only(positives, held), _only(unlabelled, held)
    n_p, n_u = len(p[0]) - 1, max(len(u[0]) - 1, 1)
    state = [np.zeros(DIMENSIONS), np.zeros(DIMENSIONS), np.zeros(1), np.zeros(1)]
    for t in range(1, iterations + 1):
        zp = segment_sums(weights[p[1]] * p[2], p[0]) + bias
        zu = segment_sums(weights[u[1]] * u[2], u[0]) + bias
        # logistic loss: l(z, +1) = log(1 + e^-z), l(z, -1) = log(1 + e^z)
        sp, su = sigmoid(zp), sigmoid(zu)
        negative = _softplus(zu).sum() / n_u - prior * _softplus(zp).mean()
        if negative >= 0:
            gp, gu = prior * ((sp - 1) - sp) / n_p, su / n_u
        else:  # the non-negative correction: climb the negative risk back up
            gp, gu = prior * sp / n_p, -su / n_u
        grad = np.bincount(p[1], np.repeat(gp, np.diff(p[0])) * p[2], DIMENSIONS).astype(np.float64)
        grad += np.bincount(u[1], np.repeat(gu, np.diff(u[0])) * u[2], DIMENSIONS)
        grad += PENALTY * weights
        weights, state[0], state[1] = _adam(weights, grad, state[0], state[1], t)
        b, state[2], state[3] = _adam(np.array([bias]), np.array([gp.sum() + gu.sum()]), state[2], state[3], t)
        bias = float(b[0])
    return Model(weights, bias, prior)


def _only(csr, held: np.ndarray):
    indptr, slot, value = csr
    ok = held[slot]
    kept = np.concatenate([[0], np.cumsum(ok)])[indptr]
    return kept, slot[ok], value[ok]


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def _adam(w, g, m, v, t):
    m = 0.9 * m + 0.1 * g
    v = 0.999 * v + 0.001 * g * g
    return w - STEP * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8), m, v


FEATURES = T.StructType([T.StructField("_slots", T.ArrayType(T.IntegerType())), T.StructField("_values", T.ArrayType(T.DoubleType()))])


def _make_features():
    import pyarrow as pa

    def run(data, offsets):
        indptr, slot, value = features(data, offsets)
        at = pa.array(indptr.astype(np.int32))
        return pa.ListArray.from_arrays(at, pa.array(slot.astype(np.int32))), pa.ListArray.from_arrays(at, pa.array(value))

    return run


def _sample(df: DataFrame, text: str, order: Column, bound: int):
    """CSR features of the ``bound`` rows of smallest ``order``, read without moving texts.

    Only the order values go through the top-k (at most ``bound`` of them reach the
    driver); the texts are then read by a filter below the k-th value. Rows tied at that
    value are equal rows (``order`` hashes the id with the text), so which of them fill
    the last places does not change the sample.
    """
    keyed = df.select(order.alias("_order"), F.col(text))
    smallest = [row[0] for row in keyed.select("_order").orderBy("_order").limit(bound).collect()]
    if not smallest:
        return np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0)
    last = smallest[-1]
    below = sum(1 for value in smallest if value < last)
    chosen = keyed.where(F.col("_order") < last).unionByName(keyed.where(F.col("_order") == last).limit(bound - below))
    table = map_texts(chosen, text, [], FEATURES, _make_features).toArrow()
    slots, values = table.column("_slots").combine_chunks(), table.column("_values").combine_chunks()
    lengths = slots.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) if len(slots) else np.zeros(0, np.int64)
    indptr = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    slot = slots.flatten().to_numpy(zero_copy_only=False).astype(np.int64) if len(slots) else np.zeros(0, np.int64)
    value = values.flatten().to_numpy(zero_copy_only=False) if len(values) else np.zeros(0)
    return indptr, slot, value


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fit on confirmed toxic ``docs`` (by ``labels``) against all ``docs`` as unlabelled.

    ``docs`` and ``labels`` are the training rows already; the prior comes from
    ``labels``' non-null values. The positives are the ``TRAIN_POSITIVES`` toxic ids of
    smallest hash (a bounded list), and their rows are found by a filter, not a join.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
    share = known.agg(F.avg(F.col(label).cast("double"))).first()[0]
    prior = float(np.clip(share if share is not None else 0.0, 0.001, 0.999))
    toxic = known.where(F.col(label) == 1).select(doc_id).distinct()
    picked = toxic.orderBy(F.xxhash64(F.lit("toxicity"), F.col(doc_id))).limit(TRAIN_POSITIVES).collect()
    order = F.xxhash64(F.lit("toxicity"), F.col(doc_id), F.col(text))
    ids = [row[0] for row in picked]
    positives = _sample(docs.where(F.col(doc_id).isin(ids)), text, order, TRAIN_POSITIVES) if ids else (np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0))
    unlabelled = _sample(docs, text, order, TRAIN_UNLABELLED)
    return fit(positives, unlabelled, prior)


ADDED = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


def score(docs: DataFrame, model: Model, keep: Sequence[str], text: str = "text") -> DataFrame:
    """``keep`` columns with ``score`` (sigmoid of the output) and ``predicted`` (score >= 0.5)."""

    def make():
        def run(data, offsets):
            s = sigmoid(model.decide(*features(data, offsets)))
            return s, (s >= THRESHOLD).astype(np.int32)

        return run

    return map_texts(docs, text, keep, ADDED, make)
