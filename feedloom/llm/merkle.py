"""Merkle manifests: a hash tree over each group of rows, one over the groups' roots, and a proof for each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import saved, shared_dir

ARITY = 16


def leaf_digest(values: list[Column]) -> Column:
    """Hex sha256 of the values one after the other, each as its number of UTF-8 bytes, a colon and itself, or - if null."""
    said = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*(said(v.cast("string")) for v in values)), 256)


def _hex(c: Column) -> Column:
    return F.lower(F.hex(c))


def _joined(siblings: Column) -> Column:
    """The digests of sorted siblings as one binary."""
    return F.unhex(F.array_join(F.transform(siblings, lambda s: F.hex(s["digest"])), ""))


def folded(path: Column, leaf: Column) -> Column:
    """The root that a leaf (hex) and the siblings on its path give."""
    return F.aggregate(path, leaf, lambda digest, s: F.sha2(F.concat(_hex(s["left"]), digest, _hex(s["right"])), 256))


def siblings_of(path: Column) -> Column:
    """All siblings on the path, level by level, left to right, as hex."""
    return F.array_join(F.transform(path, lambda s: F.concat(_hex(s["left"]), _hex(s["right"]))), "")


def _positions(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df, written in the given order, with _part, the range it lies in, and _nth, its place there."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = ranged.withColumns({"_part": F.spark_partition_id(), "_nth": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    return saved(placed, name)


def _with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """nodes (tree, at, n, digest, ...) with left and right, the digests of their run's other nodes.

    Each node goes to the computed indices of its siblings, its own slot shifted by 1 to arity - 1, and meets their rows
    by an equijoin; a row gathers at most arity - 1 of them."""
    slot, base = F.col("at") % arity, F.col("at") - F.col("at") % arity
    shift = F.explode(F.sequence(F.lit(1), F.lit(arity - 1)))
    sent = nodes.select("tree", "n", "digest", base.alias("_base"), slot.alias("slot"), shift.alias("_shift"))
    sent = sent.select("tree", (F.col("_base") + (F.col("slot") + F.col("_shift")) % arity).alias("at"), "n", F.struct(F.col("slot").alias("slot"), "digest").alias("_sent")).filter("at < n").drop("n")
    gathered = nodes.join(sent, ["tree", "at"], "left").groupBy(*nodes.columns).agg(F.sort_array(F.collect_list("_sent")).alias("_all"))
    part = lambda keep: _joined(F.filter("_all", keep))
    return gathered.withColumns({"left": part(lambda s: s["slot"] < slot), "right": part(lambda s: s["slot"] > slot)}).drop("_all")


def _levels(nodes: DataFrame, arity: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The levels of all trees, from their leaves on, each with its nodes' siblings, and the trees' tops (tree, digest, height).

    nodes has (tree, at, n, digest) and what leaves carry; n is the number of a tree's nodes on the level. Rows in slot
    zero of a run emit its parent. Trees with one node are done."""
    levels, tops = [], nodes.filter("n = 1").select("tree", "digest", F.lit(0).alias("height"))
    widest = nodes.agg(F.max("n")).first()[0] or 0
    while widest > 1:
        level = saved(_with_siblings(nodes.filter("n > 1"), arity), f"{name}-{len(levels)}")
        levels.append(level)
        parent = F.unhex(F.sha2(F.concat(_hex(F.col("digest")), _hex(F.col("right"))), 256))
        up = F.expr(f"(n + {arity - 1}) div {arity}")
        nodes = level.filter(F.col("at") % arity == 0).select("tree", F.expr(f"at div {arity}").alias("at"), up.alias("n"), parent.alias("digest"))
        tops = tops.unionByName(nodes.filter("n = 1").select("tree", "digest", F.lit(len(levels)).alias("height")))
        widest = -(-widest // arity)
    return levels, tops


def _paths(levels: list[DataFrame], tops: DataFrame, arity: int) -> DataFrame:
    """Leaves with path, the siblings of each level from the leaf on, and what tops (tree, height, path, ...) carry."""
    kept = [c for c in tops.columns if c not in ("tree", "height", "path")]
    top = lambda height: tops.filter(F.col("height") == height).select("tree", F.lit(0).cast("long").alias("_up"), F.col("path").alias("_path"), *kept)
    above = None
    for height in range(len(levels), 0, -1):
        known = top(height) if above is None else top(height).unionByName(above.select("tree", F.col("at").alias("_up"), F.col("path").alias("_path"), *kept))
        own = levels[height - 1].withColumn("_up", F.expr(f"at div {arity}"))
        path = F.concat(F.array(F.struct("left", "right")), F.col("_path"))
        above = own.join(known, ["tree", "_up"]).withColumn("path", path).drop("_up", "_path", "left", "right")
    return above


def manifest(docs: DataFrame, *, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), group_col: str = "source", id_col: str = "doc_id", presented: dict[str, Column] | None = None, arity: int = ARITY) -> DataFrame:
    """One row per input row: id, leaf, shown (the leaf of the row as presented), subroot, root (hex), and path, an array of
    (left, right) binaries: the digests of the siblings on each level from the leaf's to the last below the root.

    A leaf is leaf_digest() of the columns; with `presented`, shown is that of the columns as those expressions give them.
    The leaves of a group, by id, are cut into runs of arity, the last one maybe shorter; the digest of a run's digests is
    its parent, until one node is left, the group's subroot. The subroots, by group (null first, bytewise), give the root
    in the same way. A single node is its own root. folded(path, leaf) recomputes the root.

    Texts are hashed in one pass and don't move. Leaves are sorted by ranges and numbered from the counts of each range's
    groups, so a hot group spans many tasks. On each level nodes meet their siblings by an equijoin on computed indices,
    which the slot-zero rows turn into parents; each level is written and a sixteenth of the one below. Paths come down the
    same way: a node's parent is found by an equijoin, and rows of a run share one.

    Null ids come first in their group; rows of one id are ordered by leaf; repeated rows are leaves of their own; null
    groups are one group; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    own = [F.col(c) for c in columns]
    shown = [(presented or {}).get(c, F.col(c)) for c in columns]
    leaf = F.unhex(leaf_digest(own))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(group_col).cast("string").alias("_group"), leaf.alias("digest"), (F.unhex(leaf_digest(shown)) if presented else leaf).alias("shown"))
    rows = saved(rows, "merkle-leaves").withColumn("_row", F.monotonically_increasing_id())
    ranged = _positions(rows, ["_group", "_id", "digest", "_row"], "merkle-sorted")
    # A row for each range and group: the group's rows in earlier ranges, then the groups in order.
    runs = ranged.groupBy("_part", "_group").agg(F.count("*").alias("_n"), F.min("_nth").alias("_first"))
    of_group = Window.partitionBy("_group")
    runs = saved(runs.withColumns({"_before": F.sum("_n").over(of_group.orderBy("_part")) - F.col("_n"), "n": F.sum("_n").over(of_group)}), "merkle-runs")
    groups = _positions(runs.filter("_before = 0").select("_group"), ["_group"], "merkle-groups")
    sizes = groups.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n"))
    trees = saved(groups.join(sizes, "_part").select("_group", (F.col("_before") + F.col("_nth")).alias("tree")), "merkle-trees")
    same = runs.select("_part", F.col("_group").alias("_g"), (F.col("_before") - F.col("_first")).alias("_shift"), "n")
    same = same.join(trees, F.col("_g").eqNullSafe(F.col("_group"))).drop("_group").withColumnRenamed("_part", "_p")
    leaves = ranged.join(same, (F.col("_part") == F.col("_p")) & F.col("_group").eqNullSafe(F.col("_g")))
    leaves = saved(leaves.select("tree", (F.col("_shift") + F.col("_nth")).alias("at"), "n", "digest", "shown", "_id"), "merkle-numbered")
    levels, tops = _levels(leaves, arity, "merkle-level")
    subroots = saved(tops, "merkle-subroots")
    count = subroots.count()
    upper = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), F.lit(count).cast("long").alias("n"), "digest", "height")
    root_levels, root = _levels(upper, arity, "merkle-root-level")
    empty = F.array().cast("array<struct<left:binary,right:binary>>")
    root = root.select("tree", F.col("height").alias("height"), empty.alias("path"), F.col("digest").alias("root"))
    if root_levels:
        upper = _paths(root_levels, root, arity)
    else:
        upper = upper.select("tree", "at", "digest", "height", empty.alias("path"), F.col("digest").alias("root"))
    upper = saved(upper.select(F.col("at").alias("tree"), "height", "path", F.col("digest").alias("subroot"), "root"), "merkle-upper")
    out = leaves.filter("n = 1").join(upper.drop("height"), "tree").select("_id", "digest", "shown", "subroot", "root", "path")
    if levels:
        out = out.unionByName(_paths(levels, upper, arity).select("_id", "digest", "shown", "subroot", "root", "path"))
    return out.select(F.col("_id").alias(id_col), _hex(F.col("digest")).alias("leaf"), _hex(F.col("shown")).alias("shown"), _hex(F.col("subroot")).alias("subroot"), _hex(F.col("root")).alias("root"), "path")
