"""A hashed maximum-entropy language model with a class-factored softmax.

Word counts of all training texts give the base model. For the maximum-entropy model, every
word has a slot: frequent words one of their own, the others share slots by a hash of their ending. Slots fall
into classes by the company they keep. The next slot is predicted as class, then slot
within the class, each a softmax over three features of the history: the slot before
(n-gram), the one before that (skip), and a hash of both (n-gram). A slot's words
share its probability by their smoothed counts, so the whole is a probability over
all words and starts out equal to the base model.

Weights are trained by full-batch updates: each pass has every task sum the model's
expected feature counts over its texts; the sums, of fixed size, are added up across the cluster, and the
weights move by the scaled log ratio of seen to expected counts, which never lowers
the likelihood. Scoring works on the distinct histories of a batch.

Counts of words are exact. Those above a 2^-20 share of all tokens, fewer than 2^20, are
broadcast; the other words of a text are joined to the count table by hash.

Defined cases: a null or empty text has the end alone; unknown words share one smoothed
count per slot; repeated rows and ids are each scored; without training texts all
counts are 0; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseload.llm.common import pieces, segment_sums
from caseload.llm.tokens import hashed_words, runs
from caseload.session import materialise

CLASSES, MEMBERS = 16, 32
SLOTS = CLASSES * MEMBERS
OWN = 384  # slots of single frequent words; the others are shared
SHARED = SLOTS - OWN
START = SLOTS  # what stands before a text
HASHED = 2048
FEATURES = 2 * (SLOTS + 1) + HASHED
HOT = 1 << 20
PASSES = 2
SMOOTH = 2.0
BLOCKS = 128
END_KEY, END_CHECK = -1, 0
HELD_ROWS = 1_000_000


def _tail(ending: np.ndarray, length: np.ndarray) -> np.ndarray:
    return (ending * 40503 + (length > 6) * 977 + (length > 10) * 331) % 65521 % SHARED


def _merged(key, check, *columns):
    """Rows of equal words summed in the last column."""
    order = np.lexsort((check, key))
    key, check, *columns = (c[order] for c in (key, check, *columns))
    new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (check[1:] != check[:-1]))) if len(key) else order
    *same, n = columns
    return key[new], check[new], *(c[new] for c in same), np.add.reduceat(n, new) if len(new) else n


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """``key, check, tail, n``: how often each word, and the end of a text, occurs."""
    names = ["key", "check", "tail", "n"]

    def run(batches):
        held = []

        def out():
            rows = _merged(*(np.concatenate(c) for c in zip(*held, strict=True)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in rows], names)

        for batch in batches:
            for _, texts in pieces(batch, text):
                for data, offsets, _, last in runs(*texts):
                    _, key, check, ending, length = hashed_words(data, offsets)
                    tail = _tail(ending, length).astype(np.int32)
                    held.append(_merged(key, check, tail, np.ones(len(key), np.int64)))
                    if last:
                        ends = len(offsets) - 1
                        held.append((np.array([END_KEY]), np.array([END_CHECK], np.int32), np.array([0], np.int32), np.array([ends])))
            if sum(len(h[0]) for h in held) > HELD_ROWS:
                yield out()
        if held:
            yield out()

    rows = df.select(F.col(text).cast("string").alias(text)).mapInArrow(run, "key long, check int, tail int, n long")
    return rows.groupBy("key", "check").agg(F.first("tail").alias("tail"), F.sum("n").alias("n"))


@dataclass
class Words:
    """Frequent words by hash: counts and slots; and what the slots weigh."""

    key: np.ndarray
    check: np.ndarray
    n: np.ndarray
    slot: np.ndarray
    mass: np.ndarray  # of each slot: counts plus one per word, and one for unknown words
    tokens: int
    types: int
    floor: int  # words counted less often are not held here

    def find(self, key, check):
        """Place of each word here, and whether it is."""
        if not len(self.key):
            return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
        place = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return place, (self.key[place] == key) & (self.check[place] == check)


def frequent_words(vocabulary: DataFrame) -> Words:
    """The words above the share, at most ``HOT``, and sums over all words."""
    by_tail = vocabulary.groupBy("tail").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types")).collect()
    tokens, types = sum(r["n"] for r in by_tail), sum(r["types"] for r in by_tail)
    mass = np.ones(SLOTS)
    for row in by_tail:  # one row per shared slot
        mass[OWN + row["tail"]] += row["n"] + row["types"]
    floor = tokens // HOT + 1
    rows = vocabulary.where(F.col("n") >= floor).toArrow()
    key, check, tail, n = (rows.column(c).to_numpy() for c in ("key", "check", "tail", "n"))
    rank = np.lexsort((check, key, -n))
    slot = OWN + tail.astype(np.int64)
    own = rank[:OWN]
    slot[own] = np.arange(len(own))
    np.subtract.at(mass, OWN + tail[own], n[own] + 1)
    mass[: len(own)] = n[own] + 1
    mass[len(own) : OWN] = 1e-9  # slots without a word
    order = np.argsort(key, kind="stable")
    return Words(key[order], check[order], n[order], slot[order], mass, tokens, types, floor)


def token_arrays(words: Words, data, offsets, last: bool, carry=(START, START)):
    """Per token its text, word hash (0 check for ends), place among the frequent words, slot and history."""
    text, key, check, ending, length = hashed_words(data, offsets)
    n = len(offsets) - 1
    per_text = np.bincount(text, minlength=n)
    ends = np.cumsum(per_text) + np.arange(n)
    total = len(key) + (n if last else 0)
    spot = np.arange(len(key)) + (text if last else 0)
    out = [np.zeros(total, np.int64), np.full(total, END_KEY), np.full(total, END_CHECK, np.int32), np.zeros(total, np.int64)]
    for column, value in zip(out, (text, key, check, OWN + _tail(ending, length)), strict=True):
        column[spot] = value
    of, key, check, slot = out
    if last:
        of[ends] = np.arange(n)
        slot[ends] = OWN
    place, hot = words.find(key, check)
    slot[hot] = words.slot[place[hot]]
    one, two = np.full(total, START), np.full(total, START)
    one[1:], two[2:] = slot[:-1], slot[:-2]
    first = np.append(True, of[1:] != of[:-1]) if total else np.zeros(0, bool)
    one[first] = START
    two[first] = START
    second = np.flatnonzero(first[:-1]) + 1 if total else np.zeros(0, np.int64)
    two[second[~first[second]]] = START
    if total and carry != (START, START):
        one[0], two[0] = carry
        if total > 1 and not first[1]:
            two[1] = carry[0]
    return of, key, check, place, hot, slot, one, two


def features(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    both = (one * 1_000_003 + two * 8191) % 2_147_483_647 % HASHED
    return one, SLOTS + 1 + two, 2 * (SLOTS + 1) + both


def _sum_over_texts(df: DataFrame, text: str, words, add, size: int) -> np.ndarray:
    """Sum over all texts of what ``add(total, slot, one, two)`` adds to ``size`` numbers.

    A task sends its sum in blocks; each block is added up as it streams by.
    """
    step = -(-size // BLOCKS)

    def local(batches):
        total = np.zeros(step * BLOCKS)
        for batch in batches:
            for _, texts in pieces(batch, text):
                carry = (START, START)
                for data, offsets, _, last in runs(*texts):
                    *_, slot, one, two = token_arrays(words.value, data, offsets, last, carry)
                    add(total[:size], slot, one, two)
                    carry = (int(slot[-1]), int(one[-1])) if len(slot) and not last else (START, START)
        if total.any():
            parts = [total[b * step : (b + 1) * step].astype("<f4").tobytes() for b in range(BLOCKS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array(parts, pa.binary())], ["block", "v"])

    def summed(batches):
        block, total = None, None
        for batch in batches:
            for b, v in zip(batch.column("block").to_pylist(), batch.column("v").to_pylist(), strict=True):
                if b != block:
                    if block is not None:
                        yield _row(block, total)
                    block, total = b, 0.0
                total = total + np.frombuffer(v, "<f4").astype(np.float64)
        if block is not None:
            yield _row(block, total)

    def _row(block, total):
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["block", "v"])

    schema = "block int, v binary"
    parts = df.select(F.col(text).cast("string").alias(text)).mapInArrow(local, schema)
    rows = parts.repartition("block").sortWithinPartitions("block").mapInArrow(summed, schema).toArrow()
    out = np.zeros(step * BLOCKS)
    for b, v in zip(rows.column("block").to_pylist(), rows.column("v").to_pylist(), strict=True):
        out[b * step : (b + 1) * step] = np.frombuffer(v)
    return out[:size]


def slot_classes(seen: np.ndarray) -> np.ndarray:
    """Position of each slot, class by class: slots with like neighbours share a class."""
    left = seen[: SLOTS + 1].T  # what stands before the slot
    right = np.pad(seen[:SLOTS], ((0, 0), (0, 1)))  # and what follows it
    rows = []
    for table in (left, right):
        expected = table.sum(axis=1, keepdims=True) * table.sum(axis=0) / max(table.sum(), 1)
        rows.append(np.log((table + 1) / (expected + 1)))
    x = np.concatenate(rows, axis=1)
    groups = [np.arange(SLOTS)]
    while len(groups[0]) > MEMBERS:
        halves = []
        for group in groups:
            centred = x[group] - x[group].mean(axis=0)
            values, vectors = np.linalg.eigh(centred @ centred.T)
            order = np.argsort(vectors[:, -1] * np.sqrt(max(values[-1], 0)), kind="stable")
            halves += [group[order[: len(group) // 2]], group[order[len(group) // 2 :]]]
        groups = halves
    place = np.empty(SLOTS, np.int64)
    place[np.concatenate(groups)] = np.arange(SLOTS)
    return place


class Weights:
    """Weights of (feature, class) and (feature, slot), slots ordered by class."""

    def __init__(self, mass: np.ndarray, place: np.ndarray):
        self.place = place
        self.mass = np.empty(SLOTS)
        self.mass[place] = mass
        by_class = self.mass.reshape(CLASSES, MEMBERS).sum(axis=1)
        self.class_share = by_class / by_class.sum()
        self.slot_share = self.mass / np.repeat(by_class, MEMBERS)
        self.class_weights = np.zeros((FEATURES, CLASSES), np.float32)
        self.slot_weights = np.zeros((FEATURES, SLOTS), np.float32)

    def class_chances(self, one, two):
        logit = np.log(self.class_share).astype(np.float32) + sum(self.class_weights[f] for f in features(one, two))
        return _softmax(logit)

    def slot_chances(self, one, two, group):
        weights = self.slot_weights.reshape(FEATURES, CLASSES, MEMBERS)
        logit = np.log(self.slot_share).astype(np.float32).reshape(CLASSES, MEMBERS)[group] + sum(weights[f, group] for f in features(one, two))
        return _softmax(logit)

    def update(self, seen: np.ndarray, expected_class: np.ndarray, expected_slot: np.ndarray) -> None:
        """Three features are active at a time, hence a third of the log ratio."""
        seen_class = seen.reshape(FEATURES, CLASSES, MEMBERS).sum(axis=2)
        a, b = SMOOTH * self.class_share, SMOOTH * self.slot_share
        self.class_weights += (np.log((seen_class + a) / (expected_class + a)) / 3).astype(np.float32)
        self.slot_weights += (np.log((seen + b) / (expected_slot + b)) / 3).astype(np.float32)


def _softmax(logit):
    logit -= logit.max(axis=1, keepdims=True)
    np.exp(logit, out=logit)
    logit /= logit.sum(axis=1, keepdims=True)
    return logit


def _distinct(*columns):
    """Distinct tuples, how often each occurs and where each row's is."""
    packed = np.zeros(len(columns[0]), np.int64)
    for column in columns:
        packed = packed * (SLOTS + 1) + column
    keys, back, n = np.unique(packed, return_inverse=True, return_counts=True)
    out = []
    for _ in columns:
        out.append(keys % (SLOTS + 1))
        keys = keys // (SLOTS + 1)
    return out[::-1], n, back


def _add_seen(total, slot, one, two):
    for f in features(one, two):
        total += np.bincount(f * SLOTS + slot, minlength=len(total))


def _add_expected(weights):
    def add(total, slot, one, two):
        """Expected counts of slots within the classes that occurred, then of classes."""
        model = weights.value
        slots, classes = total[: FEATURES * SLOTS], total[FEATURES * SLOTS :]
        (a, b, g), n, _ = _distinct(one, two, model.place[slot] // MEMBERS)
        chances = model.slot_chances(a, b, g) * n[:, None]
        columns = g[:, None] * MEMBERS + np.arange(MEMBERS)
        for f in features(a, b):
            slots += np.bincount((f[:, None] * SLOTS + columns).ravel(), chances.ravel(), minlength=len(slots))
        (a, b), n, _ = _distinct(one, two)
        chances = model.class_chances(a, b) * n[:, None]
        for f in features(a, b):
            classes += np.bincount((f[:, None] * CLASSES + np.arange(CLASSES)).ravel(), chances.ravel(), minlength=len(classes))

    return add


@dataclass
class Model:
    words: Words
    weights: Weights
    vocabulary: DataFrame


def train(df: DataFrame, text: str = "text", passes: int = PASSES) -> Model:
    """Counts and weights from all of ``df``; ``passes`` updates of the weights."""
    spark = df.sparkSession
    vocabulary = materialise(word_counts(df, text), "words")
    words = frequent_words(vocabulary)
    held = spark.sparkContext.broadcast(words)
    raw = _sum_over_texts(df, text, held, _add_seen, FEATURES * SLOTS).reshape(FEATURES, SLOTS)
    weights = Weights(words.mass, slot_classes(raw))
    seen = np.empty_like(raw)
    seen[:, weights.place] = raw
    seen_class = seen.reshape(FEATURES, CLASSES, MEMBERS).sum(axis=2)
    # Before the first update the history has no say: expectations follow from the sums.
    weights.update(seen, seen.sum(axis=1, keepdims=True) * weights.class_share, np.repeat(seen_class, MEMBERS, axis=1) * weights.slot_share)
    for _ in range(passes - 1):
        shared = spark.sparkContext.broadcast(weights)
        size = FEATURES * (SLOTS + CLASSES)
        slots, classes = np.split(_sum_over_texts(df, text, held, _add_expected(shared), size), [FEATURES * SLOTS])
        weights.update(seen, classes.reshape(FEATURES, CLASSES), slots.reshape(FEATURES, SLOTS))
    return Model(words, weights, vocabulary)


def score(df: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of every row."""
    spark = df.sparkSession
    held = spark.sparkContext.broadcast((model.words, model.weights))
    names = ["row", "doc_id", "n_tokens", "n_known", "logs", "chances", "key", "check", "times"]

    def run(batches):
        from pyspark import TaskContext

        words, weights = held.value
        logs = np.log10(words.n + 1.0)
        slot_mass = np.log10(words.mass)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for rows, texts in pieces(batch, text):
                n = rows.num_rows
                sums = np.zeros((n, 4))
                cold = []
                carry = (START, START)
                for data, offsets, _, last in runs(*texts):
                    of, key, check, place, hot, slot, one, two = token_arrays(words, data, offsets, last, carry)
                    carry = (int(slot[-1]), int(one[-1])) if len(slot) and not last else (START, START)
                    known = np.where(hot, logs[place], 0.0) if len(logs) else np.zeros(len(of))
                    values = np.column_stack([np.ones(len(of)), hot, known, _chances(weights, slot, one, two) - slot_mass[slot]])
                    sums += segment_sums(values, np.searchsorted(of, np.arange(n + 1)))
                    rare = np.flatnonzero(~hot)
                    mixed = key[rare] ^ (of[rare] * 0x1E3779B97F4A7C15)
                    _, first, times = np.unique(mixed, return_index=True, return_counts=True)
                    cold.append((of[rare[first]], key[rare[first]], check[rare[first]], times))
                of, key, check, times = (np.concatenate(c) for c in zip(*cold, strict=True))
                columns = [
                    pa.array(np.concatenate([np.arange(n), of]) + row),
                    pa.concat_arrays([rows.column(doc_id).cast(pa.int64()), pa.nulls(len(of), pa.int64())]),
                    *(_filled(sums[:, k].astype(np.int64), len(of)) for k in (0, 1)),
                    *(_filled(sums[:, k], len(of)) for k in (2, 3)),
                    *(pa.concat_arrays([pa.nulls(n, kind), pa.array(c, kind)]) for c, kind in ((key, pa.int64()), (check, pa.int32()), (times, pa.int64()))),
                ]
                row += n
                yield pa.RecordBatch.from_arrays(columns, names)

    source = df.select(F.col(doc_id).cast("long").alias(doc_id), F.col(text).cast("string").alias(text))
    schema = "row long, doc_id long, n_tokens long, n_known long, logs double, chances double, key long, check int, times long"
    told = materialise(source.mapInArrow(run, schema), "scores")
    texts = told.where(F.col("key").isNull()).drop("key", "check", "times")
    rare = told.where(F.col("key").isNotNull()).select("row", "key", "check", "times")
    counted = rare.join(model.vocabulary.where(F.col("n") < model.words.floor).select("key", "check", "n"), ["key", "check"])
    counted = counted.groupBy("row").agg(
        F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + F.lit(1.0))).alias("more_logs")
    )
    total = model.words.tokens + model.words.types + 1
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    return texts.join(counted, "row", "left").select(
        "doc_id", "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(model.words.tokens).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * float(np.log10(total))).alias("base_score"),
        (logs + F.col("chances")).alias("score"),
    )


def _filled(values, more):
    kind = pa.int64() if values.dtype.kind == "i" else pa.float64()
    return pa.concat_arrays([pa.array(values, kind), pa.nulls(more, kind)])


def _chances(weights: Weights, slot, one, two) -> np.ndarray:
    """log10 of the chance of each token's slot after its history."""
    place = weights.place[slot]
    (a, b, p), _, back = _distinct(one, two, place)
    (c, d), _, history = _distinct(a, b)
    group = p // MEMBERS
    classes = weights.class_chances(c, d)[history, group]
    slots = weights.slot_chances(a, b, group)[np.arange(len(p)), p % MEMBERS]
    return (np.log10(classes.astype(np.float64)) + np.log10(slots.astype(np.float64)))[back]
