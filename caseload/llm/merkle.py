"""Merkle manifest of a document table, with every leaf's proof found by pointer jumping.

A row is a leaf: H of its fields doc_id, source, lang, n_chars, text, each written
``-`` if null, else as its UTF-8 byte count, ``:`` and its value (integers in
decimal); H is the lowercase hex SHA-256 of the concatenated inputs, digests taken
as their hex text. Per source, leaves ascend by doc_id; every run of ``FANOUT``
consecutive nodes (the last one shorter, even of one) becomes the H of their
digests, level by level, while a source has more than one node. What is left is the
source's subroot (a lone leaf is its own). Subroots, ordered by source (null first,
UTF-8 bytewise), give the root in the same way.

Proofs are built without walking any path one level at a time per leaf. Every
inner node points to its parent and holds one segment: the run of digests its parent
was hashed from, and its own place in that run. Rounds of self-joins replace each
pointer by the pointer's pointer and append that node's segments, so the distance
to the ancestor doubles each round, until every node reaches the root. Leaves then
join once with their parent's full path. A leaf's proof is the list of runs from its
own level to the root; its siblings are the run without its own digest.

Folding a leaf (or a changed leaf) with its proof applies H(left + digest + right)
from the bottom up, as SQL ``aggregate`` over the segments, so no Python runs.

Defined cases: null fields are ``-``; a null ``doc_id`` sorts first within its
source; equal ``doc_id`` values are ordered by their leaf digest (repeated rows are
equal leaves, so their order does not change any digest); every row is a leaf of its
own; a null source is a source of its own, first of all. An empty text is ``0:``. A
table with one row has the leaf as subroot and root and the H of nothing as proof
digest. An empty table gives no rows. Only the five named columns are read, so other
columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseload.session import materialise

FANOUT = 16
DIGEST = 64  # hex characters of one SHA-256 digest
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
KEY = ["tree", "level", "pos"]
# The tree of subroots; source trees are numbered from 0 in source order.
TOP = -1
LAST = 1 << 30


def H(text: Column) -> Column:
    return F.sha2(text, 256)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(text: Column) -> Column:
    """The leaf digest of a row whose text is ``text``."""
    return H(F.concat(*[field(F.col(name)) for name in FIELDS[:-1]], field(text)))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def positions(df: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``name``: the place of each row in its ``group``, from 0, by ``order``.

    Rows are range-partitioned by group and order, so one large group is spread over
    many tasks; each task's first place comes from the counts of the tasks before it
    in the same group, a table of at most one row per task and group.
    """
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    ordered = df.repartitionByRange(tasks, F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    ordered = ordered.withColumns({"_task": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    ordered = materialise(ordered, "merkle-order")
    counts = ordered.groupBy(group, "_task").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    counts = materialise(counts.withColumn("_start", F.coalesce(before, F.lit(0))), "merkle-counts")
    place = F.col("_start") + F.col("_at") - F.col("_first")
    return ordered.join(counts, [group, "_task"]).withColumn(name, place).drop("_task", "_at", "_n", "_first", "_start")


def levels(nodes: DataFrame) -> DataFrame:
    """Inner nodes of the trees whose level-0 ``nodes`` are given, with their runs.

    ``nodes``: tree, level, pos, digest, n (nodes of that tree on that level). A run is
    the concatenated digests a node was hashed from. Each level is written to the
    shared folder and the next one is made from it; a tree stops at one node.
    """
    made = []
    current = nodes
    while current.where(F.col("n") > 1).limit(1).count():
        run = F.array_sort(F.collect_list(F.struct("pos", "digest")))
        parents = (
            current.where(F.col("n") > 1)
            .groupBy("tree", (F.col("level") + 1).alias("level"), F.floor(F.col("pos") / FANOUT).alias("pos"))
            .agg(F.concat_ws("", F.transform(run, lambda s: s["digest"])).alias("run"), F.max("n").alias("below"))
        )
        parents = parents.select(*KEY, H(F.col("run")).alias("digest"), F.ceil(F.col("below") / FANOUT).cast("long").alias("n"), "run")
        parents = materialise(parents, "merkle-level")
        made.append(parents)
        current = parents.select(*KEY, "digest", "n")
    if not made:
        return nodes.sparkSession.createDataFrame([], "tree long, level int, pos long, digest string, n long, run string")
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out


def parent_of(trees: int) -> list[Column]:
    """Parent key and place in its run of a node with ``tree, level, pos, n``.

    A source's top node goes up into the tree of subroots, at its source's place,
    when there is more than one source. The root has none.
    """
    inner = F.col("n") > 1
    up = (F.col("tree") >= 0) & F.lit(trees > 1)
    return [
        F.when(inner, F.col("tree")).when(up, F.lit(TOP)).cast("long").alias("p_tree"),
        F.when(inner, F.col("level") + 1).when(up, F.lit(1)).cast("int").alias("p_level"),
        F.when(inner, F.floor(F.col("pos") / FANOUT)).when(up, F.floor(F.col("tree") / FANOUT)).cast("long").alias("p_pos"),
        F.when(inner, F.col("pos") % FANOUT).when(up, F.col("tree") % FANOUT).cast("int").alias("place"),
    ]


def _sides(seg: Column) -> tuple[Column, Column]:
    cut = seg["place"] * DIGEST
    return seg["run"].substr(F.lit(1), cut), seg["run"].substr(cut + DIGEST + 1, F.lit(LAST))


def fold(path: Column, start: Column) -> Column:
    """H(left + digest + right) over the segments of ``path``, from ``start`` up."""

    def step(acc: Column, seg: Column) -> Column:
        left, right = _sides(seg)
        return H(F.concat(left, acc, right))

    return F.aggregate(path, start, step)


def siblings(path: Column) -> Column:
    """The runs of ``path`` without the node's own digest, concatenated level by level."""

    def step(acc: Column, seg: Column) -> Column:
        left, right = _sides(seg)
        return F.concat(acc, left, right)

    return F.aggregate(path, F.lit(""), step)


SEGMENTS = "array<struct<run:string,place:int>>"


def paths(inner: DataFrame, trees: int) -> DataFrame:
    """``tree, level, pos, run, path``: each inner node's segments up to the root.

    Pointer jumping: each round joins the table with itself on the pointer, takes the
    pointer's pointer and appends its segments; rounds grow as the log of the depth.
    """
    up = inner.select(*KEY, "run", *parent_of(trees))
    target = inner.select(*[F.col(k).alias(f"p_{k}") for k in KEY], F.col("run").alias("p_run"))
    first = up.join(target, [f"p_{k}" for k in KEY], "left")
    has = F.col("p_tree").isNotNull()
    seg = F.when(has, F.array(F.struct(F.col("p_run").alias("run"), F.col("place")))).otherwise(F.array().cast(SEGMENTS))
    state = first.select(*KEY, "run", "p_tree", "p_level", "p_pos", seg.alias("path"))
    state = materialise(state, "merkle-jump")
    while state.where(F.col("p_tree").isNotNull()).limit(1).count():
        jump = state.select(*[F.col(k).alias(f"p_{k}") for k in KEY], *[F.col(f"p_{k}").alias(f"q_{k}") for k in KEY], F.col("path").alias("more"))
        joined = state.join(jump, [f"p_{k}" for k in KEY], "left")
        matched = F.col("more").isNotNull()
        state = joined.select(
            *KEY,
            "run",
            *[F.when(matched, F.col(f"q_{k}")).alias(f"p_{k}") for k in KEY],
            F.when(matched, F.concat("path", "more")).otherwise(F.col("path")).alias("path"),
        )
        state = materialise(state, "merkle-jump")
    return state.select(*KEY, "run", "path")


def prove(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """Per row: doc_id, source, leaf, subroot, root, siblings, folded_root, verified.

    ``siblings`` is the proof: the other digests of each run from the leaf up to the
    root, level by level, left to right. ``changed`` is the text that is folded with
    the original proof (by default the text itself); ``verified`` tells whether it
    gives the root again.
    """
    spark = docs.sparkSession
    changed = F.col("text") if changed is None else changed
    rows = docs.select(
        *[F.col(name) for name in FIELDS[:-1]], leaf_of(F.col("text")).alias("leaf"), leaf_of(changed).alias("changed")
    )
    rows = materialise(rows.drop("lang", "n_chars"), "merkle-leaves")
    sources = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    sources = positions(sources.withColumn("_all", F.lit(0)), "_all", [F.col("source").asc_nulls_first()], "tree").drop("_all")
    sources = materialise(sources, "merkle-sources")
    trees = sources.count()
    if not trees:
        schema = "doc_id long, source string, leaf string, subroot string, root string, siblings string, folded_root string, verified boolean"
        return spark.createDataFrame([], schema)
    keyed = rows.join(sources, rows["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    leaves = positions(keyed, "tree", [F.col("doc_id").asc_nulls_first(), F.col("leaf")], "pos")
    leaves = leaves.withColumn("level", F.lit(0))
    inner = levels(leaves.select(*KEY, F.col("leaf").alias("digest"), "n"))
    tops = inner.where(F.col("n") == 1).select("tree", "digest")
    lone = leaves.where(F.col("n") == 1).select("tree", F.col("leaf").alias("digest"))
    subroots = materialise(tops.unionByName(lone).where(F.col("tree") >= 0), "merkle-subroots")
    top = levels(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("pos"), "digest", F.lit(trees).cast("long").alias("n")))
    inner = inner.unionByName(top)
    if trees == 1:
        root = subroots.first()["digest"]
    else:
        root = top.where(F.col("n") == 1).first()["digest"]
    jumped = paths(inner, trees)
    above = jumped.select(*[F.col(k).alias(f"p_{k}") for k in KEY], F.col("run").alias("p_run"), F.col("path").alias("more"))
    up = leaves.select("doc_id", "source", "tree", "leaf", "changed", *parent_of(trees))
    joined = up.join(above, [f"p_{k}" for k in KEY], "left").join(subroots.withColumnRenamed("digest", "subroot"), "tree")
    own = F.array(F.struct(F.col("p_run").alias("run"), F.col("place")))
    path = F.when(F.col("p_run").isNotNull(), F.concat(own, "more")).otherwise(F.array().cast(SEGMENTS))
    out = joined.select("doc_id", "source", "leaf", "subroot", F.lit(root).alias("root"), "changed", path.alias("path"))
    folded = fold(F.col("path"), F.col("changed"))
    return out.select(
        "doc_id", "source", "leaf", "subroot", "root", siblings(F.col("path")).alias("siblings"),
        folded.alias("folded_root"), (folded == F.col("root")).alias("verified"),
    )
