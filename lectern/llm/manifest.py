"""A Merkle manifest of a dataset that stores one level in ``STRIDE`` and recomputes the others.

The rows of a group, in order, are the leaves of a tree in which ``ARITY`` consecutive nodes make
their parent; the roots of the groups are the leaves of a tree over them.

*Build.* Leaves get dense numbers by one range sort. Levels 0, 3, 6, ... are written. The nodes
of a written level fall into aligned subtrees of ``ARITY ** STRIDE`` nodes; a task takes a subtree,
climbs its levels and keeps the top alone.

*Extract.* From the top down, each subtree is read again from its stored nodes. Its interior levels
are computed once more, every stored node takes its siblings of each level from them, and
the levels are forgotten. The path from a subtree's top to the root comes to it by a join
of one row a subtree; it is handed on to all its nodes, so no path is shuffled with the leaves.

A group of a third of all rows has more subtrees, no larger ones; a tree over n rows needs
log(n) / log(512) rounds. A proof is a list of (left, right): the siblings of the run before and
after the node, as concatenated hex digests, from the leaf up to the root.

Defined results: null values hash as ``-``; null groups come first; null keys come first in
their group; rows with equal keys follow the order of their leaves, and equal rows have proofs
of their own; a table of one row has its leaf as root and an empty proof; an empty table gives
no rows; columns that are not named as fields are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lectern.llm.columns import once
from lectern.llm.order import numbered
from lectern.operators.stage import written

ARITY = 8
STRIDE = 3
SUBTREE = ARITY**STRIDE
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    return digest(*map(field, values))


# --- one subtree -------------------------------------------------------------------------


def _above(nodes: Column, width: Column) -> Column:
    """The level above ``nodes``, whose whole level has ``width`` nodes; a lone node is the top."""
    run = lambda j: F.sha2(F.array_join(F.slice(nodes, j * ARITY + 1, ARITY), ""), 256)
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / ARITY).cast("int")), run)
    return F.when(width > 1, runs).otherwise(nodes)


def _widths(width: Column) -> list[Column]:
    """Nodes of the whole tree at each level of a subtree whose lowest level has ``width``."""
    return [F.ceil(width / ARITY**i) for i in range(STRIDE + 1)]


def _climb(nodes: Column, width: Column, use: Callable[[list[Column]], Column]) -> Column:
    """``use`` of all levels of a subtree, from ``nodes`` to its top, each computed once."""
    widths = _widths(width)

    def level(found: list[Column]) -> Column:
        if len(found) > STRIDE:
            return use(found)
        return once(_above(found[-1], widths[len(found) - 1]), lambda nodes: level([*found, nodes]))

    return once(nodes, lambda nodes: level([nodes]))


def _siblings(levels: list[Column], width: Column, at: Column) -> Column:
    """The path of the ``at``-th node of the lowest of ``levels`` up to the top of its subtree."""

    def step(i: int) -> Column:
        here = F.floor(at / ARITY**i).cast("int")
        within = here % ARITY
        left = F.array_join(F.slice(levels[i], here - within + 1, within), "")
        right = F.array_join(F.slice(levels[i], here + 2, ARITY - 1 - within), "")
        return F.when(_widths(width)[i] > 1, F.struct(left.alias("left"), right.alias("right")))

    return F.array_compact(F.array(*map(step, range(STRIDE))))


# --- the levels of all trees -------------------------------------------------------------


def _subtrees(nodes: DataFrame) -> DataFrame:
    """(tree, block, width, nodes): the stored nodes of each aligned subtree, in order; 512 at most."""
    item = F.struct("pos", *(c for c in nodes.columns if c not in ("tree", "width", "pos")))
    block = F.floor(F.col("pos") / SUBTREE)
    return nodes.groupBy("tree", block.alias("block"), "width").agg(F.sort_array(F.collect_list(item)).alias("nodes"))


def checkpoints(nodes: DataFrame, widest: int) -> list[DataFrame]:
    """The written levels over ``nodes`` (tree, pos, width, digest, ...), the last of one node a tree.
    Further columns stay with the lowest level."""
    levels = [nodes]
    while widest > 1:
        trees = _subtrees(levels[-1].select("tree", "pos", "width", "digest"))
        top = _climb(F.col("nodes.digest"), F.col("width"), lambda found: found[-1][0])
        climbed = trees.select("tree", "block", F.col("width").alias("below"), top.alias("digest"))
        above = climbed.select("tree", F.col("block").alias("pos"), F.ceil(F.col("below") / SUBTREE).alias("width"), "digest")
        levels.append(written(above, f"level{STRIDE * len(levels)}"))
        widest = -(-widest // SUBTREE)
    return levels


def paths(levels: list[DataFrame], upper: DataFrame) -> DataFrame:
    """The columns of the lowest of ``levels``, the ``path`` of each node and ``top``; ``upper``
    (tree, path, top) has the paths of the trees' tops and what their nodes are to carry."""
    found = upper.select("tree", F.lit(0).cast("long").alias("pos"), "path", "top")
    for nodes in reversed(levels[:-1]):
        above = found.select("tree", F.col("pos").alias("block"), F.col("path").alias("_up"), "top")
        trees = _subtrees(nodes).join(above, ["tree", "block"])

        def own(levels: list[Column]) -> Column:
            with_path = lambda node, at: F.struct(node.alias("node"), F.concat(_siblings(levels, F.col("width"), at), F.col("_up")).alias("path"))
            return F.transform("nodes", with_path)

        proven = trees.select("tree", "width", "top", F.explode_outer(_climb(F.col("nodes.digest"), F.col("width"), own)).alias("p"))
        found = proven.select("tree", "width", "top", "p.node.*", "p.path")
    return found if len(levels) > 1 else levels[0].join(found.drop("pos"), "tree")


def build(docs: DataFrame, group: str = "lang", key: str = "doc_id", fields: Sequence[str] = FIELDS, presented: Column | None = None) -> DataFrame:
    """(group, key, leaf, subroot, root, path, presented), one row per row of ``docs``.

    ``presented`` is a leaf as someone else computes it, of what may be other data; it is carried
    beside the leaf to be held against the proof (``folded``) and null where there is none.
    """
    other = F.lit(None).cast("string") if presented is None else presented
    leaves = docs.select(F.col(group).alias("_group"), F.col(key).alias("_key"), leaf([F.col(f) for f in fields]).alias("digest"), other.alias("presented"))
    ranked = numbered(leaves, [F.col("_group").asc_nulls_first(), F.col("_key").asc_nulls_first(), "digest"], "leaves")
    # one row a group passes the window
    sizes = ranked.groupBy("_group").agg(F.count("*").alias("width"), F.min("rank").alias("_first"))
    groups = sizes.select(F.col("_group").alias("_of"), "width", "_first", (F.row_number().over(Window.orderBy("_first")) - 1).cast("long").alias("tree"))
    groups = written(groups, "groups")
    bounds = groups.agg(F.count("*").alias("n"), F.max("width").alias("widest")).first()
    placed = ranked.join(groups, F.col("_group").eqNullSafe(F.col("_of")))
    nodes = placed.select("tree", (F.col("rank") - F.col("_first")).alias("pos"), "width", "digest", "_key", "presented")
    levels = checkpoints(nodes, bounds["widest"] or 0)
    tops = levels[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(bounds["n"]).cast("long").alias("width"), "digest")
    over = checkpoints(written(tops, "subroots"), bounds["n"])
    nothing = F.array().cast("array<struct<left:string,right:string>>")
    proven_tops = paths(over, over[-1].select("tree", nothing.alias("path"), F.struct(F.col("digest").alias("root")).alias("top")))
    facts = F.struct("_of", F.col("digest").alias("subroot"), "top.root")
    upper = proven_tops.select(F.col("pos").alias("tree"), "path", "digest", "top").join(groups.select("tree", "_of"), "tree").select("tree", "path", facts.alias("top"))
    proven = paths(levels, upper)
    return proven.select(F.col("top._of").alias(group), F.col("_key").alias(key), F.col("digest").alias("leaf"), "top.subroot", "top.root", "path", "presented")


def folded(path: Column, start: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.aggregate(path, start, lambda below, run: digest(run["left"], below, run["right"]))


def siblings(path: Column) -> Column:
    """All siblings of a proof in one string, from the leaf's run up to the root's."""
    return F.array_join(F.transform(path, lambda run: F.concat(run["left"], run["right"])), "")
