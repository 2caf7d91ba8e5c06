"""Merkle manifest of a table: one leaf per row, one tree per group, one tree
over the groups' roots.

Method: sibling-shift self-joins.  The nodes of a level are rows ``(grp, idx,
m, digest)``: group, place, number of nodes of the group on this level.  Nodes
in slot ``k = idx mod arity`` are joined to the node in slot zero of their run
by the computed index ``idx - k``, one equijoin per slot offset, and the rows of
slot zero emit the parents ``(grp, idx div arity, ceil(m / arity))``.  A group
leaves the loop when one node is left, its subroot; the subroots are the leaves
of the top tree, folded by the same loop.  Each level is written as a table of
runs (a parent with its children), so the manifest itself is the set of these
tables, and a lost executor re-reads one level only.

Proofs go the other way: a run joins its parent's path by ``(grp, idx)`` and
deals the path, with the siblings of each child put in front, to its children.
A row moves with its run, so a path is shuffled once for ``arity`` rows.

Scale: places come from a distributed sort, so a group that holds a third of
all rows is spread like any other; nothing is collected by group.  The number of
jobs is the tree's height.  A level of at most ``SMALL`` nodes is joined by
broadcast (its size follows from the group sizes before it is built).

Results by case.  A null field enters the leaf as ``-``, an empty one as ``0:``;
a text of any length is hashed whole in its row.  A null group is a group of its
own and comes first.  Rows of equal key are ordered by their leaf; equal rows
have equal leaves and each its own place and proof.  The root of an empty table is
no row.  A group of one row has its leaf as its subroot; with one group the
subroot is the root.  Columns that are not named are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurescope.llm.common import bounded_broadcast, positions, stage

ARITY = 3
#: Nodes of a level that may be broadcast: digests of 64 bytes, and on the way
#: down paths of (arity - 1) digests for each level above (some 2 KB).
SMALL = 4000
#: Groups whose starts may be broadcast.
SMALL_GROUPS = 20_000


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the concatenated parts."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value with its length in front, so that no two rows spell the same."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(columns: dict[str, Column]) -> Column:
    return digest(*[field(c) for c in columns.values()])


@dataclass
class Tree:
    """Staged runs of every level, lowest first, and the nodes that were left
    alone in their group: ``(grp, height, digest)``."""
    runs: list[tuple[DataFrame, int]]
    tops: DataFrame


def _is_small(count: int, df: DataFrame) -> DataFrame:
    return F.broadcast(df) if count <= SMALL else df


def _level_sizes(groups: DataFrame, arity: int) -> list[int]:
    """Nodes on each level in the groups that are still folded there, until no
    group has more than one node; two scalars per level reach the driver."""
    total, most = groups.agg(F.sum("m"), F.max("m")).first()
    if not total:
        return []
    heights = 0
    while most > 1:
        most, heights = -(-most // arity), heights + 1
    if not heights:
        return []
    at, sums = F.col("m"), []
    for _ in range(heights):
        sums.append(F.sum(F.when(at > 1, at).otherwise(0)))
        at = F.ceil(at / F.lit(arity))
    return [int(n) for n in groups.agg(*sums).first()]


def climb(nodes: DataFrame, sizes: list[int], arity: int, name: str) -> Tree:
    """Fold ``nodes(grp, idx, m, node)`` level by level; ``node`` is a struct with
    a ``digest`` and whatever else the children are to carry."""
    tops = nodes.filter("m = 1").select("grp", F.lit(0).alias("height"), F.col("node.digest").alias("digest"))
    runs = []
    for height, count in enumerate(sizes, start=1):
        live = nodes.filter("m > 1").withColumn("slot", F.col("idx") % arity)
        run = live.filter("slot = 0").select("grp", "idx", "m", F.col("node").alias("n0"))
        for k in range(1, arity):
            sibling = live.filter(F.col("slot") == k).select(
                F.col("grp"), (F.col("idx") - k).alias("idx"), F.col("node").alias(f"n{k}"))
            run = run.join(_is_small(count, sibling), ["grp", "idx"], "left")
        run = run.select(
            "grp", F.expr(f"idx div {arity}").alias("idx"),
            F.ceil(F.col("m") / F.lit(arity)).alias("m"),
            F.filter(F.array(*[f"n{k}" for k in range(arity)]), lambda n: n.isNotNull()).alias("kids"))
        run = run.withColumn("digest", F.sha2(F.array_join(
            F.transform("kids", lambda n: n["digest"]), ""), 256))
        run = stage(run, f"{name}-runs-{height}")
        runs.append((run, count // 2))  # a group of m > 1 nodes has at most m / 2 parents
        nodes = run.select("grp", "idx", "m", F.struct("digest").alias("node"))
        tops = tops.unionByName(nodes.filter("m = 1").select(
            "grp", F.lit(height).alias("height"), F.col("node.digest").alias("digest")))
    return Tree(runs, tops)


def _children(run: DataFrame, above: DataFrame, arity: int) -> DataFrame:
    """The children of ``run`` joined to their parents' paths, each with its own."""
    joined = run.select("grp", "idx", "kids").join(above, ["grp", "idx"])
    kids = joined.select("grp", "idx", "kids", "path", "subroot", "root",
                         F.posexplode("kids").alias("slot", "kid"))

    def siblings(some):
        return F.array_join(F.transform(F.expr(some), lambda n: n["digest"]), "")

    step = F.array(F.struct(siblings("slice(kids, 1, slot)").alias("left"),
                            siblings("slice(kids, slot + 2, size(kids))").alias("right")))
    return kids.select("grp", (F.col("idx") * arity + F.col("slot")).alias("idx"), "kid",
                       F.concat(step, F.col("path")).alias("path"), "subroot", "root")


def descend(tree: Tree, apexes: DataFrame, arity: int) -> DataFrame:
    """``(grp, idx, kid, path, subroot, root)`` of the lowest level, from the paths of
    the apexes ``(grp, height, path, subroot, root)``."""
    above = None
    for height in range(len(tree.runs), 0, -1):
        run, parents = tree.runs[height - 1]
        here = apexes.filter(F.col("height") == height).select(
            "grp", F.lit(0).cast("long").alias("idx"), "path", "subroot", "root")
        above = here if above is None else above.drop("kid").unionByName(here)
        above = _children(run, _is_small(parents, above), arity)
    return above


def prove(rows: DataFrame, key: str, group: str, columns: list[str],
          claimed: dict[str, Column] | None = None, arity: int = ARITY) -> DataFrame:
    """One row per row of the table: ``id, leaf, claimed`` (leaf of the row with
    the columns of ``claimed`` put in place of its own), ``subroot, root`` and
    ``path``, the siblings ``(left, right)`` on each level from the leaf to the root.
    """
    own = {c: F.col(c) for c in columns}
    other = leaf(own | {c: v for c, v in (claimed or {}).items() if c in own})
    leaves = rows.select(F.col(key).alias("id"), F.col(group).cast("string").alias("g"),
                         leaf(own).alias("digest"), other.alias("claimed"))
    # a claimed leaf that differs is the exception: the others need no second digest
    leaves = leaves.withColumn("claimed", F.when(F.col("claimed") != F.col("digest"), F.col("claimed")))
    order = [F.col("g").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("digest").asc()]
    leaves = positions(leaves, order, "merkle-leaves")
    groups = leaves.groupBy("g").agg(F.min("pos").alias("start"), F.count(F.lit(1)).alias("m"))
    groups = positions(groups, [F.col("g").asc_nulls_first()], "merkle-groups")
    groups = stage(groups.withColumnRenamed("pos", "grp").withColumnRenamed("g", "_g"), "merkle-starts")
    sizes = _level_sizes(groups, arity)
    nodes = leaves.join(bounded_broadcast(groups, SMALL_GROUPS), F.col("g").eqNullSafe(F.col("_g"))).select(
        "grp", (F.col("pos") - F.col("start")).alias("idx"), "m",
        F.struct("digest", "id", "claimed").alias("node"))
    tree = climb(nodes, sizes, arity, "merkle")

    subroots = stage(tree.tops, "merkle-subroots")
    top = subroots.select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("idx"),
                          F.struct("digest", "grp", "height").alias("node"))
    top_size = groups.agg(F.count(F.lit(1)).alias("m"))
    top_sizes = _level_sizes(top_size, arity)
    top = top.withColumn("m", F.lit(groups.count()).cast("long"))
    over = climb(top, top_sizes, arity, "merkle-top")
    no_path = F.expr("cast(array() AS array<struct<left: string, right: string>>)")
    if over.runs:
        root = over.tops.select("grp", "height", no_path.alias("path"),
                                F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
        apexes = descend(over, root, arity).select(
            F.col("kid.grp").alias("grp"), F.col("kid.height").alias("height"), "path",
            F.col("kid.digest").alias("subroot"), "root")
    else:
        apexes = subroots.select("grp", "height", no_path.alias("path"),
                                 F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    apexes = stage(apexes, "merkle-apexes")
    single = nodes.filter("m = 1").select("grp", F.col("node").alias("kid")).join(
        bounded_broadcast(apexes, SMALL), "grp").select("kid", "path", "subroot", "root")
    below = single if not tree.runs else single.unionByName(
        descend(tree, apexes, arity).select("kid", "path", "subroot", "root"))
    return below.select(
        F.col("kid.id").alias("id"), F.col("kid.digest").alias("leaf"),
        F.coalesce("kid.claimed", "kid.digest").alias("claimed"), "subroot", "root", "path")


def proof_digest(path: str = "path") -> Column:
    """Digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def fold(start: Column, path: str = "path") -> Column:
    """The root that follows from a leaf and the siblings on its path."""
    return F.aggregate(path, start, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))
