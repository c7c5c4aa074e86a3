"""Trees as edge tables (tree_id, parent, child, length): numbering, roll-ups, clades, pruning.

All trees are worked on at once.  ``intervals`` numbers the nodes of a tree so that what lies below a node is a range of
numbers: counts below a node are differences and sets below it are range joins, without a row per node and ancestor.
Walks from a node upwards (``climbed``) double their step each round, so a tree may be as deep as it has nodes.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut, forget


def sound(edges: DataFrame) -> DataFrame:
    """(tree_id, parent, child, length) with every child once, which all operators on trees start from.

    Edges that repeat are one; a node with two parents or two lengths raises when the job runs; rows without tree, parent or
    child are left out; a length that is null, NaN or below 0 counts as 0.
    """
    length = F.col("length").cast("double")
    length = F.greatest(F.coalesce(F.when(~F.isnan(length), length), F.lit(0.0)), F.lit(0.0))
    plain = edges.dropna(subset=["tree_id", "parent", "child"]).select("tree_id", "parent", "child", length.alias("length"))
    end = F.struct("parent", "length")
    one = plain.groupBy("tree_id", "child").agg(F.min(end).alias("_a"), F.max(end).alias("_b"))
    wrong = F.raise_error(F.concat(F.lit("two parents or lengths of node "), F.col("child").cast("string")))
    up = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(wrong)
    return one.withColumn("_a", up).select("tree_id", "_a.parent", "child", "_a.length")


def tips_of(edges: DataFrame) -> DataFrame:
    """(tree_id, node) of the nodes without children."""
    nodes = edges.select("tree_id", F.col("child").alias("node"))
    return nodes.join(edges.select("tree_id", F.col("parent").alias("node")), ["tree_id", "node"], "left_anti").distinct()


def heights(edges: DataFrame) -> DataFrame:
    """(tree_id, node, height): tips 0, every other node one above its highest child.  Raises on a cycle.

    Trees are peeled, the round of a node is its height; of those too deep for that a node is done in the round after its
    last child.
    """
    layers, _, aside = peeled(cut(with_roots(edges.select("tree_id", "parent", "child").distinct()), "nodes"), [])
    aside = cut(aside, "deep-trees")
    out = functools.reduce(DataFrame.unionByName, [layer.select("tree_id", "node", F.lit(h).alias("height")) for h, layer in enumerate(layers)])
    return out if aside.isEmpty() else out.join(aside, "tree_id", "left_anti").unionByName(_heights_by_rounds(edges.join(aside, "tree_id", "left_semi")))


def _heights_by_rounds(edges: DataFrame) -> DataFrame:
    """``heights`` of deep trees."""
    edges = cut(edges.select("tree_id", "parent", "child").distinct(), "edges")
    level = tips_of(edges).withColumn("height", F.lit(0))
    done, left = [level], cut(edges.groupBy("tree_id", F.col("parent").alias("node")).agg(F.count("*").alias("open")), "open")
    for h in itertools.count(1):
        up = edges.join(level.withColumnRenamed("node", "child"), ["tree_id", "child"]).groupBy("tree_id", F.col("parent").alias("node")).agg(F.count("*").alias("_n"))
        left = cut(left.where("open > 0").join(up, ["tree_id", "node"], "left").select("tree_id", "node", (F.col("open") - F.coalesce("_n", F.lit(0))).alias("open")), "open")
        ready, waiting = left.agg(F.count_if(F.col("open") == 0), F.count_if(F.col("open") > 0)).first()
        if not ready:
            break
        level = left.where("open = 0").select("tree_id", "node", F.lit(h).alias("height"))
        done.append(level)
    if waiting:
        raise ValueError(f"{waiting} nodes are on or above a cycle")
    return functools.reduce(DataFrame.unionByName, done)


def ancestors(edges: DataFrame) -> DataFrame:
    """(tree_id, node, ancestor, steps), every node its own ancestor at 0; paths double each round.  Raises on a cycle."""
    edges = cut(edges.select("tree_id", "parent", "child"), "edges")
    reach = edges.select("tree_id", F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).alias("steps"))
    for k in itertools.count():  # all paths of up to 2^k steps are known; the longest ones go on
        if not reach.where("node = ancestor").isEmpty():
            raise ValueError("a node is its own ancestor")
        far = reach.where(F.col("steps") == 2**k).alias("a")
        longer = far.join(reach.alias("b"), (F.col("a.tree_id") == F.col("b.tree_id")) & (F.col("a.ancestor") == F.col("b.node")))
        longer = cut(longer.select("a.tree_id", "a.node", "b.ancestor", (F.col("a.steps") + F.col("b.steps")).alias("steps")), "paths")
        if longer.isEmpty():
            break
        reach = reach.unionByName(longer)
    all_up = reach
    own = edges.select("tree_id", F.col("child").alias("node")).unionByName(edges.select("tree_id", F.col("parent").alias("node"))).distinct()
    return all_up.unionByName(own.select("tree_id", "node", F.col("node").alias("ancestor"), F.lit(0).alias("steps")))


def _walk(nodes: pd.DataFrame) -> tuple[list[int], list[int]]:
    """The place of every node's parent (or -1) and a walk through one tree's nodes, which are sorted by name."""
    place = pd.Series(np.arange(len(nodes)), index=nodes["node"])
    up = np.full(len(nodes), -1)
    up[nodes["parent"].notna()] = place[nodes["parent"].dropna()].to_numpy()
    by_parent = np.argsort(up, kind="stable")
    first = np.searchsorted(up[by_parent], np.arange(-1, len(nodes) + 1))
    below = by_parent.tolist()
    starts, ends = first[1:-1].tolist(), first[2:].tolist()
    waiting, walk = below[: first[1]][::-1], []
    while waiting:
        v = waiting.pop()
        walk.append(v)
        waiting.extend(reversed(below[starts[v] : ends[v]]))
    if len(walk) < len(nodes):
        raise ValueError(f"{len(nodes) - len(walk)} nodes are on or below a cycle")
    return up.tolist(), walk


def _in_order(nodes: pd.DataFrame) -> pd.DataFrame:
    """The numbers of one tree's nodes (see ``intervals``), children in the order of their names."""
    nodes = nodes.sort_values("node", ignore_index=True)
    above, walk = _walk(nodes)
    size, level = [1] * len(nodes), [0] * len(nodes)
    for v in walk:
        if above[v] >= 0:
            level[v] = level[above[v]] + 1
    for v in reversed(walk):
        if above[v] >= 0:
            size[above[v]] += size[v]
    at = np.array(walk, int)
    enter, leave = np.arange(1, len(at) + 1), np.arange(len(at)) + np.array(size, int)[at]
    tips = np.append(0, np.cumsum(enter == leave))
    marks = np.append(0, np.cumsum(nodes["_marked"].to_numpy(int)[at]))
    out = nodes.iloc[at][["tree_id", "node", "parent", "length"]].reset_index(drop=True)
    return out.assign(enter=enter, leave=leave, level=np.array(level, int)[at], first_tip=tips[enter - 1] + 1, tips=tips[leave] - tips[enter - 1], marked=marks[leave] - marks[enter - 1])


NUMBERS = ["enter", "leave", "level", "first_tip", "tips", "marked"]


def intervals(edges: DataFrame, marks: DataFrame | None = None, most: int = 500_000) -> DataFrame:
    """(tree_id, node, parent, length, enter, leave, level, first_tip, tips, marked) of every node.

    A walk through the tree, children by name, numbers nodes from 1 (``enter``) and tips from 1 (``first_tip`` is the first
    at or below the node); ``leave`` is the last number below the node, ``level`` the edges from the root, ``marked`` how many
    nodes of ``marks`` (tree_id, node) are at or below it.  Roots have no parent; several roots of a tree follow each other.
    Raises on a cycle.

    Trees of at most ``most`` nodes are walked in a task each.  Larger ones are peeled (``peeled``) until the rest fits a task,
    and the numbers come down again: every node is in a few joins.  Those too deep for that are numbered by list ranking.
    All ways give the same numbers.
    """
    nodes = with_roots(cut(sound(edges), "edges"))
    marked = F.lit(0)
    if marks is not None:
        nodes = nodes.join(marks.select("tree_id", "node").distinct().withColumn("_m", F.lit(1)), ["tree_id", "node"], "left")
        marked = F.coalesce("_m", F.lit(0))
    nodes = cut(nodes.select("tree_id", "node", "parent", "length", "leaf", marked.alias("_marked")), "nodes")
    sizes = cut(nodes.groupBy("tree_id").agg(F.count("*").alias("_n")), "tree-sizes")
    kind = dict(nodes.dtypes)
    schema = f"tree_id {kind['tree_id']}, node {kind['node']}, parent {kind['node']}, length double, {', '.join(c + ' long' for c in NUMBERS)}"
    near = nodes.drop("leaf").join(sizes.where(F.col("_n") <= most).select("tree_id"), "tree_id", "left_semi").groupBy("tree_id").applyInPandas(_in_order, schema)
    # A tree all of whose nodes have a parent has no root: a cycle, which the walk would not see.
    large = sizes.where(F.col("_n") > most).select("tree_id")
    return near if large.isEmpty() else near.unionByName(_from_peeled(nodes.join(large, "tree_id", "left_semi"), most, schema).select(near.columns))


def with_roots(edges: DataFrame) -> DataFrame:
    """(tree_id, node, parent, leaf) and the edges' other columns, a row per node; roots have nulls there."""
    parents = edges.select("tree_id", F.col("parent").alias("node")).distinct().withColumn("_inner", F.lit(True))
    return edges.withColumnRenamed("child", "node").join(parents, ["tree_id", "node"], "full").withColumn("leaf", F.col("_inner").isNull()).drop("_inner")


def peeled(nodes: DataFrame, sums: list[str], most: int = 0) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """Layers of trees from the leaves inwards, the rests of at most ``most`` nodes a tree, and the ids of trees left aside.

    ``nodes`` are those of ``with_roots``, already written.  Each round takes the leaves off and adds their ``sums`` to
    their parents.  A round that leaves more than three quarters of a tree, and more than ``most`` nodes, puts the tree
    aside (its layers are to be dropped), so the rounds of the others together read a few times their nodes.
    """
    layers, rests, aside = [], [], []
    while True:
        leaves, inner = nodes.where("leaf").drop("leaf"), nodes.where("not leaf").drop("leaf")
        layers.append(leaves)
        counts = cut(nodes.groupBy("tree_id").agg(F.count_if(~F.col("leaf")).alias("_left"), F.count("*").alias("_all")), "peeled-sizes")
        if sums:
            more = leaves.where("parent is not null").groupBy("tree_id", F.col("parent").alias("node")).agg(*[F.sum(c).alias(f"_more{c}") for c in sums])
            inner = inner.join(more, ["tree_id", "node"], "left").select("tree_id", "node", *[c for c in inner.columns if c not in ("tree_id", "node", *sums)], *[(F.col(c) + F.coalesce(f"_more{c}", F.lit(0))).alias(c) for c in sums])
        rests.append(inner.join(counts.where(F.col("_left") <= most).select("tree_id"), "tree_id", "left_semi"))
        large = F.col("_left") > most
        aside.append(counts.where(large & (F.col("_left") > 0.75 * F.col("_all"))).select("tree_id"))
        going = counts.where(large & (F.col("_left") <= 0.75 * F.col("_all"))).select("tree_id")
        if going.isEmpty():
            return layers, functools.reduce(DataFrame.unionByName, rests), functools.reduce(DataFrame.unionByName, aside)
        rest = cut(inner.join(going, "tree_id", "left_semi"), "rest")
        parents = rest.where("parent is not null").select("tree_id", F.col("parent").alias("node")).distinct().withColumn("_inner", F.lit(True))
        nodes = cut(rest.join(parents, ["tree_id", "node"], "left").withColumn("leaf", F.col("_inner").isNull()).drop("_inner"), "peeled")


def _rest_sums(nodes: pd.DataFrame) -> pd.DataFrame:
    """The sums at or below each node of what peeling left of one tree."""
    nodes = nodes.sort_values("node", ignore_index=True)
    up, walk = _walk(nodes)
    for c in ("_n", "_t", "_m"):
        total = nodes[c].tolist()
        for v in reversed(walk):
            if up[v] >= 0:
                total[up[v]] += total[v]
        nodes[c] = total
    return nodes


def _rest_numbers(nodes: pd.DataFrame) -> pd.DataFrame:
    """The numbers of what peeling left of one tree, by the sums of each node's earlier siblings."""
    nodes = nodes.sort_values("node", ignore_index=True)
    up, walk = _walk(nodes)
    enter, tip, level = (nodes["_n_before"] + 1).tolist(), nodes["_t_before"].tolist(), [0] * len(nodes)
    for v in walk:
        if up[v] >= 0:
            enter[v], tip[v], level[v] = enter[v] + enter[up[v]], tip[v] + tip[up[v]], level[up[v]] + 1
    out = nodes[["tree_id", "node", "parent", "length"]].assign(enter=enter, level=level, tips=nodes["_t"], marked=nodes["_m"])
    return out.assign(leave=out["enter"] + nodes["_n"] - 1, first_tip=np.array(tip, int) + 1)[["tree_id", "node", "parent", "length", *NUMBERS]]


def _running(batches):
    """Adds to rows sorted by parent the sums over earlier rows of the same parent, as far as they are in this partition."""
    last, carried = None, {"_n": 0, "_t": 0}
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = [(batch["tree_id"][i].as_py(), batch["parent"][i].as_py()) for i in (0, -1)]
        new = np.full(batch.num_rows, ends[0] != last)
        same = [pc.or_(pc.fill_null(pc.equal(c[1:], c[:-1]), False), pc.and_(pc.is_null(c[1:]), pc.is_null(c[:-1]))) for c in (batch["tree_id"], batch["parent"])]
        new[1:] = ~pc.and_(*same).to_numpy(zero_copy_only=False)
        group, first = np.cumsum(new), np.flatnonzero(new)
        for c in ("_n", "_t"):
            values = batch[c].to_numpy()
            before = np.cumsum(values) - values
            before -= np.append(-carried[c], before[first])[group]
            carried[c] = int(before[-1] + values[-1])
            batch = batch.append_column(f"{c}_before", pa.array(before))
        last = ends[1]
        yield batch


def _with_earlier_siblings(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``_n_before`` and ``_t_before``, the sums over the earlier children of the same parent by name.

    As in ``_next_siblings`` rows are range-partitioned by (tree, parent, name), since one parent may have most nodes; a
    parent that goes on in a later partition takes its sums there, at most a row per partition.
    """
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = nodes.repartitionByRange(parts, "tree_id", "parent", "node").sortWithinPartitions("tree_id", "parent", "node").withColumn("_pid", F.spark_partition_id())
    kinds = ", ".join(f"{c} {t}" for c, t in ranged.dtypes)
    placed = cut(ranged.mapInArrow(_running, f"{kinds}, _n_before long, _t_before long"), "siblings")
    earlier = Window.partitionBy("tree_id", "parent").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    pieces = placed.groupBy("tree_id", "parent", "_pid").agg(F.sum("_n").alias("_n"), F.sum("_t").alias("_t"))
    pieces = pieces.select(F.col("tree_id").alias("_tree"), F.col("parent").alias("_p"), F.col("_pid").alias("_q"), *[F.sum(c).over(earlier).alias(f"_more{c}") for c in ("_n", "_t")]).where("_more_n is not null")
    same = (F.col("tree_id") == F.col("_tree")) & F.col("parent").eqNullSafe(F.col("_p")) & (F.col("_pid") == F.col("_q"))
    return placed.join(F.broadcast(pieces), same, "left").select(*nodes.columns, *[(F.col(f"{c}_before") + F.coalesce(f"_more{c}", F.lit(0))).alias(f"{c}_before") for c in ("_n", "_t")])


def _from_peeled(nodes: DataFrame, most: int, schema: str) -> DataFrame:
    """``intervals`` of large trees: sums go up while peeling, numbers come down layer by layer."""
    one = lambda c: c.cast("long")
    counted = nodes.select("tree_id", "node", "parent", "length", "leaf", F.lit(1).cast("long").alias("_n"), one(F.col("leaf")).alias("_t"), one(F.col("_marked")).alias("_m"))
    layers, rest, aside = peeled(counted, ["_n", "_t", "_m"], most)
    aside = cut(aside, "deep-trees")
    rest = rest.groupBy("tree_id").applyInPandas(_rest_sums, rest.schema)
    every = [layer.withColumn("_round", F.lit(r)) for r, layer in enumerate([*layers, rest])]
    every = functools.reduce(DataFrame.unionByName, every).join(aside, "tree_id", "left_anti")
    placed = _with_earlier_siblings(every)
    done = cut(placed.where(F.col("_round") == len(layers)).groupBy("tree_id").applyInPandas(_rest_numbers, schema), "numbers")
    for r in reversed(range(len(layers))):
        up = done.select("tree_id", F.col("node").alias("parent"), F.col("enter").alias("_enter"), F.col("first_tip").alias("_tip"), F.col("level").alias("_level"))
        enter = F.coalesce("_enter", F.lit(0)) + 1 + F.col("_n_before")
        now = placed.where(F.col("_round") == r).join(up, ["tree_id", "parent"], "left").select(
            "tree_id", "node", "parent", "length", enter.alias("enter"), (enter + F.col("_n") - 1).alias("leave"), F.coalesce(F.col("_level") + 1, F.lit(0).cast("long")).alias("level"),
            (F.coalesce("_tip", F.lit(1)) + F.col("_t_before")).alias("first_tip"), F.col("_t").alias("tips"), F.col("_m").alias("marked"))
        done = done.unionByName(cut(now, "numbers") if r else now)
    return done if aside.isEmpty() else done.unionByName(_ranked(nodes.join(aside, "tree_id", "left_semi")).select(done.columns))


def _next_siblings(nodes: DataFrame) -> DataFrame:
    """(tree_id, node, _next): the next child of the same parent by name.

    One parent may have most nodes, so rows are range-partitioned by (tree, parent, name), looked at inside a partition,
    and the last one of a partition gets the first one of the parent's next partition.
    """
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(nodes.select("tree_id", "parent", "node").repartitionByRange(parts, "tree_id", "parent", "node").withColumn("_pid", F.spark_partition_id()), "siblings")
    inside = Window.partitionBy("_pid", "tree_id", "parent").orderBy("node")
    placed = placed.withColumn("_next", F.lead("node").over(inside))
    across = Window.partitionBy("tree_id", "parent").orderBy("_pid")  # a row per partition
    firsts = placed.groupBy("tree_id", "parent", "_pid").agg(F.min("node").alias("_first")).withColumn("_after", F.lead("_first").over(across))
    ends = firsts.where("_after is not null").select(F.col("tree_id").alias("_t"), F.col("parent").alias("_p"), F.col("_pid").alias("_q"), "_after")
    same = (F.col("tree_id") == F.col("_t")) & F.col("parent").eqNullSafe(F.col("_p")) & (F.col("_pid") == F.col("_q"))
    return placed.join(ends, same, "left").select("tree_id", "node", F.coalesce("_next", "_after").alias("_next"))


def _ranked(nodes: DataFrame) -> DataFrame:
    """``intervals`` by list ranking: every node is entered and left once, each step knows the next one, and steps double."""
    first = nodes.where("parent is not null").groupBy("tree_id", F.col("parent").alias("node")).agg(F.min("node").alias("_child"))
    known = cut(nodes.join(first, ["tree_id", "node"], "left").join(_next_siblings(nodes), ["tree_id", "node"]), "walk-nodes")
    leaf = F.col("_child").isNull()
    one = lambda c: c.cast("long")
    down = known.select("tree_id", "node", F.lit(0).alias("side"), F.coalesce("_child", "node").alias("to"), F.when(leaf, 1).otherwise(0).alias("to_side"), F.lit(1).cast("long").alias("n"), one(leaf).alias("t"), one(F.col("_marked")).alias("m"), F.lit(1).cast("long").alias("l"))
    none = [F.lit(0).cast("long").alias(c) for c in "ntm"]
    left = known.select("tree_id", "node", F.lit(1).alias("side"), F.coalesce("_next", "parent").alias("to"), F.when(F.col("_next").isNotNull(), 0).otherwise(1).alias("to_side"), *none, F.lit(-1).cast("long").alias("l"))
    steps = cut(down.unionByName(left), "walk")
    total = steps.count()
    for k in itertools.count():
        if steps.where("to is not null").isEmpty():
            break
        if 1 << k > 2 * total:
            raise ValueError("nodes are on or below a cycle")
        ahead = steps.select("tree_id", F.col("node").alias("to"), F.col("side").alias("to_side"), F.col("to").alias("_to"), F.col("to_side").alias("_side"), *[F.col(c).alias(f"_{c}") for c in "ntml"])
        going = steps.where("to is not null").join(ahead, ["tree_id", "to", "to_side"])
        going = going.select("tree_id", "node", "side", F.col("_to").alias("to"), F.col("_side").alias("to_side"), *[(F.col(c) + F.col(f"_{c}")).alias(c) for c in "ntml"])
        before, steps = steps, cut(steps.where("to is null").unionByName(going), "walk")
        forget(before)
    end = steps.where("side = 1").select("tree_id", "node", *[F.col(c).alias(f"_{c}") for c in "ntm"])
    whole = steps.groupBy("tree_id").agg(F.max("n").alias("_all"), F.max("t").alias("_tips"))
    both = steps.where("side = 0").join(end, ["tree_id", "node"]).join(whole, "tree_id").join(nodes.select("tree_id", "node", "parent", "length"), ["tree_id", "node"])
    return both.select("tree_id", "node", "parent", "length", (F.col("_all") - F.col("n") + 1).alias("enter"), (F.col("_all") - F.col("_n")).alias("leave"), (-F.col("l")).alias("level"), (F.col("_tips") - F.col("t") + 1).alias("first_tip"), (F.col("t") - F.col("_t")).alias("tips"), (F.col("m") - F.col("_m")).alias("marked"))


def climbed(edges: DataFrame, stops: DataFrame | None = None) -> DataFrame:
    """(tree_id, node, top, distance, steps) of every node with a parent: the nearest of ``stops`` (tree_id, node) above it, else its root.

    ``distance`` adds the lengths of the edges up to there.  Each round doubles the ways of inner nodes that go on; tips take
    their parent's way in one join at the end.  Raises on a cycle.
    """
    edges = cut(sound(edges), "edges")
    inner = edges.select("tree_id", F.col("parent").alias("child")).distinct().withColumn("_inner", F.lit(True))
    edges = cut(edges.join(inner, ["tree_id", "child"], "left").withColumn("_inner", F.col("_inner").isNotNull()), "edges")
    halt = edges.where("_inner").select("tree_id", F.col("child").alias("top"), F.lit(True).alias("_up"))
    ways = edges.where("_inner").select("tree_id", F.col("child").alias("node"), F.col("parent").alias("top"), F.col("length").alias("distance"), F.lit(1).cast("long").alias("steps")).join(halt, ["tree_id", "top"], "left")
    going = F.col("_up").isNotNull()
    if stops is not None:
        stops = stops.select("tree_id", F.col("node").alias("top"), F.lit(True).alias("_stop")).distinct()
        ways = ways.join(stops, ["tree_id", "top"], "left")
        going = going & F.col("_stop").isNull()
    columns = ["tree_id", "node", "top", "distance", "steps"]
    ways = cut(ways.select(*columns, going.alias("_open")), "ways")
    total = ways.count()
    for k in itertools.count():
        if ways.where("_open").isEmpty():
            break
        if 1 << k > 2 * total:
            raise ValueError("nodes are on or below a cycle")
        ahead = ways.select("tree_id", F.col("node").alias("top"), F.col("top").alias("_top"), F.col("distance").alias("_distance"), F.col("steps").alias("_steps"), F.col("_open").alias("_on"))
        onward = ways.where("_open").join(ahead, ["tree_id", "top"])
        onward = onward.select("tree_id", "node", F.col("_top").alias("top"), (F.col("distance") + F.col("_distance")).alias("distance"), (F.col("steps") + F.col("_steps")).alias("steps"), F.col("_on").alias("_open"))
        before, ways = ways, cut(ways.where("not _open").unionByName(onward), "ways")
        forget(before)
    above = ways.select("tree_id", F.col("node").alias("parent"), F.col("top").alias("_top"), F.col("distance").alias("_distance"), F.col("steps").alias("_steps"))
    if stops is not None:
        above = above.join(stops.select("tree_id", F.col("top").alias("parent")), ["tree_id", "parent"], "left_anti")
    tips = edges.where("not _inner").join(above, ["tree_id", "parent"], "left").select("tree_id", F.col("child").alias("node"), F.coalesce("_top", "parent").alias("top"), (F.col("length") + F.coalesce("_distance", F.lit(0.0))).alias("distance"), (F.coalesce("_steps", F.lit(0)) + 1).cast("long").alias("steps"))
    return ways.select(*columns).unionByName(tips)


def tip_counts(edges: DataFrame) -> DataFrame:
    """(tree_id, node, tips): tips at or below each node."""
    return intervals(edges).select("tree_id", "node", "tips")


def clades(edges: DataFrame, most: int) -> DataFrame:
    """(tree_id, clade, tip): the largest subtrees of at most ``most`` tips; a tip without one is its own clade.

    A clade's tips are a range of at most ``most`` numbers, which lies in two blocks of that many numbers at the most.
    """
    nodes = cut(intervals(edges), "intervals")
    above = nodes.select("tree_id", F.col("node").alias("parent"), F.col("tips").alias("_above"))
    top = nodes.join(above, ["tree_id", "parent"], "left").where((F.col("tips") <= most) & (F.col("_above").isNull() | (F.col("_above") > most)))
    last = F.col("first_tip") + F.col("tips") - 1
    block = F.explode(F.sequence(F.floor(F.col("first_tip") / most), F.floor(last / most)))
    top = top.select("tree_id", F.col("node").alias("clade"), F.col("first_tip").alias("_from"), last.alias("_to"), block.alias("_block"))
    tips = nodes.where("enter = leave").select("tree_id", F.col("node").alias("tip"), F.col("first_tip").alias("_at"), F.floor(F.col("first_tip") / most).alias("_block"))
    return tips.join(top, ["tree_id", "_block"]).where("_at between _from and _to").select("tree_id", "clade", "tip")


def large_clades(cut_up: DataFrame, more_than: int) -> DataFrame:
    """(tree_id, clade, n): clades of ``clades`` with more tips than the limit."""
    return cut_up.groupBy("tree_id", "clade").agg(F.count("*").alias("n")).where(F.col("n") > more_than)


def own_families(cut_up: DataFrame, families: DataFrame) -> DataFrame:
    """(tree_id, clade, family): the families that only this clade holds; ``families`` has (node, family)."""
    named = cut_up.join(families.select(F.col("node").alias("tip"), "family"), "tip").where("family is not null")
    one = named.groupBy("tree_id", "family").agg(F.min("clade").alias("clade"), F.max("clade").alias("_other"))
    return one.where("clade = _other").select("tree_id", "clade", "family")


def representatives(cut_up: DataFrame, orders: DataFrame) -> DataFrame:
    """(tree_id, clade, tip, label): of each clade its smallest tip, labelled ``clade_order``; ``orders`` has (node, order1)."""
    one = cut_up.groupBy("tree_id", "clade").agg(F.min("tip").alias("tip"))
    return one.join(orders.select(F.col("node").alias("tip"), "order1"), "tip", "left").select("tree_id", "clade", "tip", F.concat_ws("_", "clade", "order1").alias("label"))


def _changes(nodes: DataFrame, states: DataFrame) -> DataFrame:
    """Nodes whose state differs from their parent's, with ``change``, the difference; both states must be known."""
    s = states.select("tree_id", "node", "state")
    both = nodes.join(s, ["tree_id", "node"]).join(s.select("tree_id", F.col("node").alias("parent"), F.col("state").alias("_before")), ["tree_id", "parent"])
    return both.withColumn("change", F.col("state") - F.col("_before")).where("change <> 0").drop("state", "_before")


def state_changes(edges: DataFrame, states: DataFrame) -> DataFrame:
    """(tree_id, node, change, tips, nodes): edges with a gain (1) or reversal (-1); how many tips are at or below, inner nodes strictly below."""
    rest = F.when(F.col("enter") == F.col("leave"), 0).otherwise(F.col("leave") - F.col("enter") - F.col("tips"))
    return _changes(intervals(edges), states).where("change in (1, -1)").select("tree_id", "node", "change", "tips", rest.alias("nodes"))


def tips_of_changes(edges: DataFrame, states: DataFrame) -> DataFrame:
    """(tree_id, node, change, tip): the tips at or below each gain or reversal, a row each.

    A range of up to 2 ** (k + 1) tip numbers meets at most three blocks of 2 ** k; every tip is in one block of each k that
    occurs, so rows meet by equal blocks.
    """
    nodes = cut(intervals(edges), "intervals")
    found = _changes(nodes, states).where("change in (1, -1)")
    last = F.col("first_tip") + F.col("tips") - 1
    found = found.withColumn("_k", F.floor(F.log2(F.col("tips").cast("double"))).cast("int"))
    block = lambda c: F.floor(c / F.pow(F.lit(2.0), F.col("_k"))).cast("long")
    found = cut(found.select("tree_id", "node", "change", F.col("first_tip").alias("_from"), last.alias("_to"), "_k", F.explode(F.sequence(block(F.col("first_tip")), block(last))).alias("_block")), "changes")
    sizes = F.broadcast(found.select("_k").distinct())  # at most 63 rows
    tips = nodes.where("enter = leave").select("tree_id", F.col("node").alias("tip"), F.col("first_tip").alias("_at")).crossJoin(sizes)
    return tips.withColumn("_block", block(F.col("_at"))).join(found, ["tree_id", "_k", "_block"]).where("_at between _from and _to").select("tree_id", "node", "change", "tip")


def shifts(edges: DataFrame, states: DataFrame) -> DataFrame:
    """(tree_id, node, shift): the nearest node at or above whose state differs from its parent's; null before any shift."""
    edges = cut(sound(edges), "edges")
    changed = cut(_changes(edges.select("tree_id", F.col("child").alias("node"), "parent"), states).select("tree_id", "node"), "changed")
    mark = changed.withColumn("_own", F.lit(True))
    near = climbed(edges, changed).join(mark, ["tree_id", "node"], "left").join(mark.select("tree_id", F.col("node").alias("top"), F.lit(True).alias("_above")), ["tree_id", "top"], "left")
    near = near.select("tree_id", "node", F.when(F.col("_own"), F.col("node")).when(F.col("_above"), F.col("top")).alias("shift"))
    roots = edges.select("tree_id", F.col("parent").alias("node")).join(edges.select("tree_id", F.col("child").alias("node")), ["tree_id", "node"], "left_anti").distinct()
    return near.unionByName(roots, allowMissingColumns=True)


def pruned(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """Edges at or above the nodes of ``keep`` (tree_id, node); single-child nodes stay (see ``contracted``)."""
    return intervals(edges, keep).where("marked > 0 and parent is not null").select("tree_id", "parent", F.col("node").alias("child"), "length")


def contracted(edges: DataFrame) -> DataFrame:
    """Edges without single-child nodes: along a chain lengths add up; a root with one child gives way to the first node with several.

    A tree without a fork has no edge left.
    """
    edges = cut(sound(edges), "edges")
    kids = edges.groupBy("tree_id", F.col("parent").alias("node")).agg(F.count("*").alias("_n"))
    forks = cut(kids.where("_n > 1").select("tree_id", "node"), "forks")
    chains = kids.where("_n = 1").select("tree_id", "node")
    ways = climbed(edges, forks).join(chains, ["tree_id", "node"], "left_anti")
    return ways.join(forks.withColumnRenamed("node", "top"), ["tree_id", "top"], "left_semi").select("tree_id", F.col("top").alias("parent"), F.col("node").alias("child"), F.col("distance").alias("length"))
