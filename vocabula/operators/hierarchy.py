"""Parent-child links as full hierarchies: path, depth, root, subtree size and descendants of every node, with loops detected.

Bottom-up leaf peeling: each round takes the nodes without pending children away and sends their subtree sizes to their parents;
the reverse order of the rounds assigns roots, depths and paths top-down. Each node has one parent, so what no round can take away
is exactly the nodes on loops; a node below a loop learns of it in the reverse pass.

A round that takes less than a quarter of the nodes away shows that chains are left, which leaves alone would peel one node a round. Then
every chain (nodes with one child each, below a node that stays) is contracted into one longer link between its foot and its anchor, by
pointer doubling. What branches after that halves in a round, so the number of rounds grows with the logarithm of the nodes, whatever the
depth. All rounds are distributed and alike at every size.

Messages are pre-aggregated by parent and hot parents are joined by broadcast, so a parent with a third of all rows as children does no
harm. Descendants come out as rows from the paths, not as lists in the ancestors' rows, which would be unbounded.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocabula.scale import Scratch, hot_keys, join_beside

#: Rounds that take away less than one part in so many are followed by a contraction of chains.
SLOW = 4
_KEY = ["src", "node"]
Cut = Callable[[DataFrame], DataFrame]


def links(df: DataFrame, src: str, node: str, parent: str) -> DataFrame:
    """(src, node, parent), one row per node id; null ids are left out, null and blank parents are null. If the rows of one id
    name several parents, the greatest counts."""
    named = F.when(F.regexp_replace(F.col(parent), r"[\s 　]+", "") != "", F.col(parent))
    return df.filter(F.col(node).isNotNull()).groupBy(F.lit(src).alias("src"), F.col(node).alias("node")).agg(F.max(named).alias("parent"))


def _state(nodes: DataFrame, with_path: bool, cut: Cut) -> tuple[DataFrame, DataFrame | None]:
    """(src, node, parent, gap, extra, pending, below[, via]): nodes with their parent, if it is a node itself, and their number of children.

    gap: steps from the parent to the node; via: the nodes between them; extra: number of these, and of what hangs on them alone; below:
    descendants so far. And the parents of very many.
    """
    nodes = cut(nodes)
    counts = nodes.filter("parent IS NOT NULL").groupBy("src", "parent").agg(F.count(F.lit(1)).alias("pending"))
    counts = cut(counts.join(nodes.select("src", F.col("node").alias("parent")), ["src", "parent"], "left_semi"))
    hot = hot_keys(counts, ["src", "parent"], "pending", nodes.count())
    linked = join_beside(nodes, counts.select("src", "parent"), hot, ["src", "parent"])
    # hot parents are settled above, so both sides of what follows have one row per node
    zero = F.lit(0).cast("long")
    state = (
        nodes.select(*_KEY)
        .join(linked, _KEY, "left")
        .join(counts.withColumnRenamed("parent", "node"), _KEY, "left")
        .select(*_KEY, "parent", F.lit(1).cast("long").alias("gap"), zero.alias("extra"), F.coalesce("pending", zero).alias("pending"), zero.alias("below"), *[F.array().cast("array<string>").alias("via")] * with_path)
    )
    return cut(state), hot


def _told(state: DataFrame, leaves: DataFrame) -> DataFrame:
    """The nodes that stay, after the leaves told their parents."""
    told = leaves.filter("parent IS NOT NULL").groupBy("src", F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("done"), F.sum(F.expr("below + 1 + extra")).alias("more"))
    stay = state.filter("pending > 0").join(told, _KEY, "left")
    changed = {"pending": F.col("pending") - F.coalesce("done", F.lit(0)), "below": F.col("below") + F.coalesce("more", F.lit(0))}
    return stay.withColumns(changed).drop("done", "more")


def _chains(state: DataFrame, cut: Cut) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """(links of chain nodes, the nodes that stay, nodes of loops that nothing else hangs on, feet and anchors of very many).

    A chain node has a parent and one child. Each points to its child and doubles the pointer until it stands on the foot, a node that is
    no chain node; those that never get there lie on a loop. Per chain node: foot, anchor (parent of the uppermost), up (steps from the
    anchor), under (nodes below it down to the foot, the foot left out, and what hangs on them), and own_path from the anchor to it.
    """
    with_path = "via" in state.columns
    child = state.filter("parent IS NOT NULL").groupBy("src", F.col("parent").alias("node")).agg(F.min(F.struct("node", "gap", "extra")).alias("c"))
    own = cut(
        state.filter("pending = 1 AND parent IS NOT NULL")
        .join(child, _KEY)
        .select(*_KEY, "parent", "gap", F.col("extra").alias("before"), F.col("below").alias("mine"), *["via"] * with_path, F.col("c.node").alias("at"), F.col("c.gap").alias("steps"), F.col("c.extra").alias("under"))
    )
    # at: where the pointer stands; steps: from the node to it; under: weight of what was passed on the way, both ends left out
    jump = [F.col("node").alias("at"), F.col("at").alias("to"), F.col("steps").alias("more"), F.expr("mine + 1 + under").alias("weight")]
    done, open_, turns, most = [own.limit(0)], own, 0, 2 * own.count()
    while not open_.isEmpty() and 1 << turns <= most:
        nxt = reduce(DataFrame.unionByName, [open_, *done]).select("src", *jump)
        moved = cut(open_.join(nxt, ["src", "at"], "left"))
        done.append(moved.filter("to IS NULL").select(*own.columns))
        far = {"at": F.col("to"), "steps": F.col("steps") + F.col("more"), "under": F.col("under") + F.col("weight")}
        open_, turns = moved.filter("to IS NOT NULL").withColumns(far).select(*own.columns), turns + 1
    # pointers double, so what is open after more turns than the number of nodes has digits lies on a loop
    ranked = reduce(DataFrame.unionByName, done)
    lists = [F.sort_array(F.collect_list(F.struct((-F.col("steps")).alias("place"), "node", "via"))).alias("nodes")] if with_path else []
    top = ranked.groupBy("src", F.col("at").alias("foot")).agg(F.max(F.struct("steps", "parent", "gap", "before", "under", "mine")).alias("t"), F.count(F.lit(1)).alias("n"), *lists)
    segment = [F.flatten(F.transform("nodes", lambda x: F.concat(x["via"], F.array(x["node"])))).alias("segment")] if with_path else []
    top = cut(top.select("src", "foot", "n", F.col("t.parent").alias("anchor"), (F.col("t.steps") + F.col("t.gap")).alias("length"), F.expr("t.before + t.mine + 1 + t.under").alias("weight"), *segment))
    # a chain of very many nodes, or a node above many chains, must not come together in one task
    n = ranked.count()
    sums = top.groupBy("src", F.col("anchor").alias("node")).agg(F.sum("n").alias("n")).unionByName(top.select("src", F.col("foot").alias("node"), "n"))
    busy = hot_keys(sums.groupBy(*_KEY).agg(F.max("n").alias("n")), _KEY, "n", n)
    feet = None if busy is None else busy.withColumnRenamed("node", "foot")
    members = join_beside(ranked.withColumnRenamed("at", "foot"), top, feet, ["src", "foot"]).withColumn("up", F.col("length") - F.col("steps"))
    layer = cut(members.select(*_KEY, "foot", "anchor", "up", "under", F.col("mine").alias("below"), *[F.expr("slice(segment, 1, int(up))").alias("own_path")] * with_path))
    gone = layer.select(*_KEY).unionByName(open_.select(*_KEY))
    shorter = {"parent": F.coalesce("anchor", "parent"), "gap": F.coalesce("length", "gap"), "extra": F.coalesce("weight", "extra")}
    if with_path:
        shorter["via"] = F.concat(F.coalesce("segment", F.array().cast("array<string>")), "via")
    stay = state.join(gone, _KEY, "left_anti").join(top.drop("n").withColumnRenamed("foot", "node"), _KEY, "left").withColumns(shorter).select(*state.columns)
    return layer, cut(stay), open_.select(*_KEY, F.col("mine").alias("below")), busy


def hierarchy(nodes: DataFrame, with_path: bool = False) -> DataFrame:
    """(src, node_id, root_id, depth, descendants[, path]) of all nodes of links(); path runs from the root to the node.

    Nodes on a loop or below one: root_id '', depth -1, descendants and path null. A node that is its own parent is a loop.
    """
    scratch = Scratch(nodes.sparkSession)
    state, hot = _state(nodes, with_path, scratch.cut)
    layers: list[tuple[Callable, DataFrame, DataFrame | None]] = []
    loops: list[DataFrame] = []
    left = state.count()
    while left:
        leaves = state.filter("pending = 0")
        rest = scratch.cut(_told(state, leaves))
        n = rest.count()
        if n < left:
            layers.append((_leaf_depths, leaves, hot))
        if (left - n) * SLOW < left and n:
            chain, rest, loop, busy = _chains(rest, scratch.cut)
            layers.append((_chain_depths, chain, busy))
            loops.append(loop)
            n = rest.count()
        state, left = rest, n
    paths = ["path"] * with_path
    nothing = [F.lit(None).cast("array<string>").alias("path")] * with_path
    stuck = reduce(DataFrame.unionByName, loops) if loops else state.select(*_KEY, "below")
    known = [scratch.cut(stuck.select(*_KEY, F.lit("").alias("root"), F.lit(-1).cast("long").alias("depth"), "below", *nothing))]
    for settle, layer, busy in reversed(layers):
        known.append(scratch.cut(settle(layer, reduce(DataFrame.unionByName, known), paths, busy)))
    scratch.drop(known)
    out = reduce(DataFrame.unionByName, known)
    return out.select("src", F.col("node").alias("node_id"), F.col("root").alias("root_id"), "depth", F.when(F.col("depth") >= 0, F.col("below")).alias("descendants"), *paths)


def _under(low: DataFrame, above: str, known: DataFrame, columns: list[str], busy: DataFrame | None) -> DataFrame:
    """Rows of `low` with what is known of the node in column `above`; a node above a third of all rows does no harm."""
    side = known.select("src", F.col("node").alias(above), *columns)
    return join_beside(low, side, None if busy is None else busy.toDF("src", above), ["src", above])


def _depth(steps: str) -> Column:
    return F.when(F.col("depth") < 0, -1).otherwise(F.col("depth") + F.col(steps)).cast("long").alias("depth")


def _leaf_depths(leaves: DataFrame, known: DataFrame, paths: list[str], busy: DataFrame | None) -> DataFrame:
    roots = leaves.filter("parent IS NULL").select(*_KEY, F.col("node").alias("root"), F.lit(0).cast("long").alias("depth"), "below", *[F.array("node").alias(x) for x in paths])
    got = _under(leaves.filter("parent IS NOT NULL"), "parent", known, ["root", "depth", *paths], busy)
    return roots.unionByName(got.select(*_KEY, "root", _depth("gap"), "below", *[F.concat(x, "via", F.array("node")).alias(x) for x in paths]))


def _chain_depths(layer: DataFrame, known: DataFrame, paths: list[str], busy: DataFrame | None) -> DataFrame:
    footed = _under(layer, "foot", known.withColumnRenamed("below", "low"), ["low"], busy)
    got = _under(footed, "anchor", known, ["root", "depth", *paths], busy)
    return got.select(*_KEY, "root", _depth("up"), F.expr("below + under + 1 + low").alias("below"), *[F.concat(x, "own_path").alias(x) for x in paths])


def descendants(tree: DataFrame) -> DataFrame:
    """(src, ancestor_id, descendant_id, distance): one row per node and each node above it, from a hierarchy with paths."""
    step = tree.filter("depth > 0").select("src", "node_id", "depth", F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("at", "ancestor_id"))
    return step.select("src", "ancestor_id", F.col("node_id").alias("descendant_id"), (F.col("depth") - F.col("at")).alias("distance"))
