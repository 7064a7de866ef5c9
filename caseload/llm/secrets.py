"""Secret scans: fixed rules, and character Markov models for random strings.

Everything runs as DataFrame expressions. The rules give spans of three kinds. Their
values are the labelled random strings; words of a bounded sample of documents that
are no such values are the labelled ordinary identifiers. Two first-order Markov
models over characters are counted from them; a further
run of ``MIN_RUN`` or more characters whose log-likelihood ratio reaches ``MIN_RATIO``
is a span of the kind ``random``, unless a rule's span overlaps it.

Defined cases: a null or empty text has no spans; repeated rows are each scanned; spans
starting together are ordered by kind; without any labelled string the random model is
the even one; an empty table gives no rows; only the named columns are read, so
others cannot clash. Whole texts are scanned and no row is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# Longest runs: a run that is long enough is the match, a shorter one is none.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
RUN = r"[A-Za-z0-9+/_=-]"
MIN_VALUE = 6
MIN_RUN = 20
MIN_RATIO = 10.0  # natural log
SAMPLE_DOCUMENTS = 2000
ORDINARY_LENGTH = 8
ORDINARY_WEIGHT = 500.0  # steps that the fall-back of the ordinary model counts for
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
WIDTH = len(ALPHABET) + 1  # 0 is the start of a string, or any other character
CHUNK = 256
MASK = "[secret]"


def located(text: Column, pattern: str, group: int = 0) -> Column:
    """``start, end, value`` of all matches, left to right, in characters.

    ``split`` gives what lies between the matches, so positions are running sums of
    lengths; they are summed in chunks to stay linear in the number of matches.
    """
    parts = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), F.length),
        F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)),
    )
    parts = F.filter(parts, lambda p: p["1"].isNotNull())
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / CHUNK).cast("int")),
        lambda b: F.slice(parts, b * CHUNK + 1, CHUNK),
    )
    spans = "array<struct<start:int,end:int,value:string>>"
    within = F.transform(
        blocks,
        lambda block: F.aggregate(
            block,
            F.struct(F.lit(0).alias("at"), F.array().cast(spans).alias("out")),
            lambda acc, p: F.struct(
                (acc["at"] + p["0"] + p["1"]).alias("at"),
                F.concat(
                    acc["out"],
                    F.array(
                        F.struct(
                            (acc["at"] + p["0"]).alias("start"),
                            (acc["at"] + p["0"] + p["1"]).alias("end"),
                            p["2"].alias("value"),
                        )
                    ),
                ).alias("out"),
            ),
        ),
    )
    joined = F.aggregate(
        within,
        F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{spans}>").alias("out")),
        lambda acc, b: F.struct(
            (acc["at"] + b["at"]).alias("at"),
            F.concat(
                acc["out"],
                F.array(
                    F.transform(
                        b["out"],
                        lambda s: F.struct(
                            (s["start"] + acc["at"]).alias("start"),
                            (s["end"] + acc["at"]).alias("end"),
                            s["value"].alias("value"),
                        ),
                    )
                ),
            ).alias("out"),
        ),
    )
    return F.when(text.rlike(pattern), F.flatten(joined["out"])).otherwise(F.array().cast(spans))


def base_spans(text: Column) -> dict[str, Column]:
    """The rules' spans by kind."""
    assign = F.filter(located(text, ASSIGN, 2), lambda s: F.length(s["value"]) >= MIN_VALUE)
    return {"assign": assign, "access": located(text, ACCESS), "hex": located(text, HEX)}


def _code(character: Column) -> Column:
    return F.when(F.length(character) > 0, F.instr(F.lit(ALPHABET), character)).otherwise(F.lit(0))


def transitions(words: DataFrame, word: str, label: str) -> DataFrame:
    """``label, step, n``: how often a character follows another (or the start)."""
    steps = F.transform(
        F.sequence(F.lit(1), F.length(word)),
        lambda i: F.when(i > 1, _code(F.substr(F.col(word), i - 1, F.lit(1)))).otherwise(F.lit(0)) * WIDTH
        + _code(F.substr(F.col(word), i, F.lit(1))),
    )
    rows = words.where(F.length(word) > 0).select(label, F.explode(steps).alias("step"))
    return rows.groupBy(label, "step").agg(F.count(F.lit(1)).alias("n"))


def train(df: DataFrame, doc_id: str = "doc_id", text: str = "text", documents: int = SAMPLE_DOCUMENTS) -> list[float]:
    """Log-likelihood ratio, random against ordinary, of every step between characters.

    Random strings are the rules' values in all texts. Ordinary words come from about
    ``documents`` texts chosen by a hash; only the two tables of counts, at most
    ``WIDTH`` squared each, reach the driver.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    docs = df.select(F.col(doc_id).alias("doc_id"), body.alias("text"))
    spans = base_spans(F.col("text"))
    values = F.concat(*spans.values())
    held = F.col("text").rlike(ASSIGN) | F.col("text").rlike(ACCESS) | F.col("text").rlike(HEX)
    random = docs.where(held).select(F.explode(values).alias("s")).select(F.lit(1).alias("label"), F.col("s.value").alias("word"))
    share = min(1.0, documents / max(docs.count(), 1))
    place = F.pmod(F.xxhash64(F.lit("secrets"), F.col("doc_id").cast("string")), F.lit(1 << 30))
    ordinary = docs.where((place < share * (1 << 30)) & ~held).select(
        F.lit(0).alias("label"),
        F.explode(F.regexp_extract_all("text", F.lit(f"{RUN}{{{ORDINARY_LENGTH},}}"), F.lit(0))).alias("word"),
    )
    counts = transitions(random.unionByName(ordinary), "word", "label").collect()
    seen = [[0.0] * (WIDTH * WIDTH) for _ in range(2)]
    for row in counts:
        seen[row["label"]][row["step"]] += row["n"]
    # Random strings fall back on equal chances, ordinary ones on how common a character is.
    common = [0.1 + sum(seen[0][b::WIDTH]) for b in range(WIDTH)]
    falls = [[n / sum(common) for n in common], [1 / WIDTH] * WIDTH]
    models = []
    for table, fall, weight in zip(seen, falls, (ORDINARY_WEIGHT, WIDTH), strict=True):
        sums = [sum(table[a * WIDTH : (a + 1) * WIDTH]) + weight for a in range(WIDTH)]
        models.append([math.log((n + weight * fall[k % WIDTH]) / sums[k // WIDTH]) for k, n in enumerate(table)])
    return [r - o for o, r in zip(*models, strict=True)]


def ratio(word: Column, table: Sequence[float]) -> Column:
    """Log-likelihood ratio of a string: the sum over its steps."""
    weights = F.lit(list(table))
    step = lambda i: F.when(i > 1, _code(F.substr(word, i - 1, F.lit(1)))).otherwise(F.lit(0)) * WIDTH + _code(F.substr(word, i, F.lit(1)))
    return F.aggregate(
        F.sequence(F.lit(1), F.length(word)), F.lit(0.0), lambda acc, i: acc + F.element_at(weights, step(i) + 1)
    )


def scan(df: DataFrame, table: Sequence[float], keep: Sequence[str], text: str = "text") -> DataFrame:
    """``keep`` plus ``base`` and ``found``: sorted ``start, kind, end``; kinds are numbered from 1."""
    kept = [F.col(name) for name in keep if name.lower() not in ("base", "found", "_text")]
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = df.select(*kept, body.alias("_text"))
    spans = base_spans(F.col("_text"))
    runs = F.filter(
        located(F.col("_text"), f"{RUN}{{{MIN_RUN},}}"),
        lambda s: s["value"].rlike("[A-Za-z]") & ~s["value"].rlike(HEX) & ~s["value"].rlike(ACCESS) & (ratio(s["value"], table) >= MIN_RATIO),
    )
    rows = rows.select(*kept, *[column.alias(kind) for kind, column in spans.items()], runs.alias("runs"))
    free = F.filter("runs", lambda r: ~F.exists("assign", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    rows = rows.withColumn("random", free)

    def tagged(kind: str) -> Column:
        number = F.lit(KINDS.index(kind) + 1)
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), number.alias("kind"), s["end"].alias("end")))

    base = F.array_sort(F.concat(*[tagged(kind) for kind in KINDS[:3]]))
    found = F.array_sort(F.concat(*[tagged(kind) for kind in KINDS]))
    return rows.select(*kept, base.alias("base"), found.alias("found"))


def listed(spans: str) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    names = F.array(*[F.lit(kind) for kind in KINDS])
    each = F.transform(
        spans,
        lambda s: F.concat_ws(":", F.element_at(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")),
    )
    return F.array_join(each, ",")


def redacted(text: Column, spans: Column, mask: str = MASK) -> Column:
    """The text with each span, or run of overlapping spans, replaced by ``mask``."""
    done = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda acc, s: F.when(
            s["start"] >= acc["at"],
            F.struct(
                s["end"].alias("at"),
                F.concat(acc["out"], F.array(F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))).alias("out"),
            ),
        ).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))),
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, acc["at"] + 1)),
    )
    return F.when(F.size(spans) > 0, done).otherwise(text)
