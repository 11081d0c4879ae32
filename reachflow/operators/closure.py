"""Reachability, forests and fixed points over edge tables, in rounds of DataFrame operations.

Edges are written once, in buckets of the end that rounds look up. Each round writes what is new (scratch.Rounds) and
ends by one emptiness test, so that the lineage stays short and a lost executor costs one round at most. Rounds follow
the depth of the graph in reachability and levels; forests take the logarithm of it.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachflow.operators.components import connected_components
from reachflow.sources.scratch import Rounds, bucketed, keyed, narrow, written

#: Edges of a weak component whose strong ones a task may find by itself: some hundred MB of Python objects.
TASK_EDGES = 500_000
#: Labels of paths in one batch of rows that a task hands on.
PATH_LABELS = 1_000_000
#: Units of a block that is closed over all sets at once, and links of sets that go to every task.
BLOCK_UNITS, SET_LINKS = 1024, 5_000_000


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def reachable(edges: DataFrame, roots: DataFrame, src: str = "src", dst: str = "dst", node: str = "node", entered: DataFrame | None = None) -> DataFrame:
    """node: the roots and all that edges lead to from them; semi-naive, each node is expanded once. Null nodes are left out.

    With entered (node, best written by scratch.keyed), edges lead to its nodes only.
    """
    steps = keyed(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null"), "src")
    found = Rounds()
    fresh = found.add(roots.select(F.col(node).alias("node")).where("node is not null").distinct())
    while not fresh.isEmpty():
        reached = steps.join(fresh.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        if entered is not None:
            reached = reached.join(entered, "node", "left_semi")
        fresh = found.add(reached.join(found.every(), "node", "left_anti"))
    return found.every()


def reachable_pairs(edges: DataFrame, starts: DataFrame, src: str = "src", dst: str = "dst", node: str = "node") -> DataFrame:
    """start, node: what each start reaches, itself included. The result has a row for each pair, so keep the starts few or the reach short."""
    steps = keyed(edges.select(F.col(src).alias("node"), F.col(dst).alias("next")).where("node is not null and next is not null").distinct(), "node")
    found = Rounds()
    fresh = found.add(starts.select(F.col(node).alias("start")).where("start is not null").distinct().select("start", F.col("start").alias("node")))
    while not fresh.isEmpty():
        reached = steps.join(fresh, "node").select("start", F.col("next").alias("node")).distinct()
        fresh = found.add(reached.join(found.every(), ["start", "node"], "left_anti"))
    return found.every()


def two_stage_reachable(first: DataFrame, roots: DataFrame, bridge: DataFrame, second: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What first's edges reach from the roots, and what second's edges reach from the nodes that bridge (src, dst) leads to from there."""
    upper = reachable(first, roots)
    seeds = bridge.join(upper.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node"))
    return upper, reachable(second, seeds)


def survivors(nodes: DataFrame, dead: DataFrame, parents: DataFrame) -> DataFrame:
    """The greatest set of nodes without a dead one that holds every parent of its members.

    parents (node, parent) may form cycles: a cycle that no dead node leads into survives, since the set is the
    complement of what the dead reach, the least fixed point, and not grown from nothing.
    """
    gone = reachable(parents.select(F.col("parent").alias("src"), F.col("node").alias("dst")), dead)
    return nodes.join(gone, "node", "left_anti")


def nearest_ancestor(forest: DataFrame, matches: Column, include_self: bool = False) -> DataFrame:
    """node, ancestor, distance: the nearest ancestor of each node that matches, by pointer doubling.

    forest (node, parent) has one row for each node and any columns that `matches` needs; roots have a null parent.
    Nodes without such an ancestor, and those that lead into a cycle without one, have a null ancestor.
    """
    marked = forest.select("node", "parent", F.coalesce(matches, F.lit(False)).alias("hit"))
    above = marked.select(F.col("node").alias("p"), F.col("hit").alias("p_hit"))
    own = F.lit(include_self) & F.col("hit")
    start = marked.join(above, F.col("parent") == F.col("p"), "left")
    # ptr: the node looked at last; done: it matches, or there is nothing above it.
    state = start.select(
        "node",
        F.when(own, F.col("node")).otherwise(F.col("p")).alias("ptr"),
        F.when(own, 0).otherwise(1).cast("long").alias("distance"),
        F.coalesce(F.when(own, True).otherwise(F.col("p_hit")), F.lit(False)).alias("hit"),
    )
    state = written(state.withColumn("done", F.col("hit") | F.col("ptr").isNull()))
    limit = max(1, state.count().bit_length() + 1)
    for _ in range(limit):
        if state.where("not done").isEmpty():
            break
        # A jump goes from what is looked at to what that one looks at; from a node whose own search ended to its parent's.
        jump = state.select(F.col("node").alias("j"), F.col("ptr").alias("j_ptr"), F.col("distance").alias("j_distance"), F.col("hit").alias("j_hit"), F.col("done").alias("j_done"))
        moved = state.join(jump.hint("merge"), (F.col("ptr") == F.col("j")) & ~F.col("done"), "left")  # a broadcast would pass the state through the driver each round
        go = ~F.col("done") & F.col("j").isNotNull()
        state = moved.select(
            "node",
            F.when(go, F.col("j_ptr")).otherwise(F.col("ptr")).alias("ptr"),
            F.when(go, F.col("distance") + F.col("j_distance")).otherwise(F.col("distance")).alias("distance"),
            F.when(go, F.col("j_hit")).otherwise(F.col("hit")).alias("hit"),
            F.when(go, F.col("j_done")).otherwise(F.col("done") | F.col("j").isNull()).alias("done"),
        )
        state = written(state)
    return state.select("node", F.when(F.col("hit"), F.col("ptr")).alias("ancestor"), F.when(F.col("hit"), F.col("distance")).alias("distance"))


def depths(forest: DataFrame) -> DataFrame:
    """node, depth: the number of ancestors; null where the parents form a cycle (a violation)."""
    found = nearest_ancestor(forest, F.col("parent").isNull() & F.lit(True), include_self=True)
    return found.select("node", F.col("distance").alias("depth"))


def cyclic_nodes(forest: DataFrame) -> DataFrame:
    """node: those whose ancestors never end, as they lie on or below a cycle of the relation (node, parent)."""
    return depths(forest).where("depth is null").select("node")


def flag_closure(forest: DataFrame, flag: Column) -> DataFrame:
    """node, below, above: whether a node or an ancestor of it is flagged, and whether it or a descendant is.

    Flags go up by doubling too: after k rounds a node knows of its descendants at a distance below 2**k. On a cycle
    the rounds end once they cover all nodes.
    """
    down = nearest_ancestor(forest, flag, include_self=True).select("node", F.col("ancestor").isNotNull().alias("below"))
    return down.join(flags_above(forest.select("node", "parent", F.coalesce(flag, F.lit(False)).alias("above")), ["above"]), "node")


def flags_above(forest: DataFrame, flags: list[str]) -> DataFrame:
    """node and flags: each of the flags (columns of forest, not null) is true where it is for the node or a descendant."""
    state = written(forest.select("node", F.col("parent").alias("ptr"), *flags))
    for _ in range(state.count().bit_length() + 1):
        if state.where("ptr is not null").isEmpty():
            break
        told = state.where(F.col("ptr").isNotNull() & reduce(Column.__or__, [F.col(f) for f in flags])).groupBy(F.col("ptr").alias("node")).agg(*[F.bool_or(f).alias(f"t_{f}") for f in flags])
        jump = state.where("ptr is not null").select(F.col("node").alias("j"), F.col("ptr").alias("j_ptr"))
        moved = state.join(told, "node", "left").join(jump, F.col("ptr") == F.col("j"), "left")
        state = written(moved.select("node", F.col("j_ptr").alias("ptr"), *[(F.col(f) | F.coalesce(f"t_{f}", F.lit(False))).alias(f) for f in flags]))
    return state.select("node", *flags)


def levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, level: the longest path of edges (src depends on dst) below a node, which orders dependencies first; null on or above a cycle."""
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nodes = bucketed(nodes.select("node").distinct(), "node", parts)
    # Dealt by dst once: neither the nodes nor what repeats shuffle them again.
    known = edges.select("src", "dst").repartition(parts, "dst").join(nodes.withColumnRenamed("node", "dst").hint("merge"), "dst", "left_semi")
    steps = bucketed(known.select("src", "dst").distinct(), "dst", parts)
    # What a node still waits for; each round takes off the edges that lead to what the round before settled.
    # The table stays in buckets of the node, so that a round shuffles the edges that it takes off alone.
    lacking = bucketed(nodes.join(steps.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n")).hint("merge"), "node", "left").select("node", F.coalesce("n", F.lit(0)).alias("n")), "node", parts)
    done, level = Rounds(), 0
    ready = done.add(lacking.where("n = 0").select("node", F.lit(level).alias("level")))
    while not ready.isEmpty():
        level += 1
        off = steps.join(ready.select(F.col("node").alias("dst")), "dst", "left_semi").groupBy(F.col("src").alias("node")).agg(F.count("*").alias("off"))
        lacking = bucketed(lacking.where("n > 0").join(off.hint("merge"), "node", "left").select("node", (F.col("n") - F.coalesce("off", F.lit(0))).alias("n")), "node", parts)
        ready = done.add(lacking.where("n = 0").select("node", F.lit(level).alias("level")))
    return done.every().unionByName(lacking.where("n > 0").select("node", F.lit(None).cast("int").alias("level")))


def _whole(batches: Iterator[pd.DataFrame], by: str = "weak") -> Iterator[pd.DataFrame]:
    """The rows of each weak component, one at a time; rows are sorted by weak."""
    held, at = [], None
    for batch in batches:
        for now, rows in batch.groupby(by):
            if held and now != at:
                yield pd.concat(held)
                held = []
            held.append(rows)
            at = now
    if held:
        yield pd.concat(held)


def _components_of_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """node, component of the strong components of more than one node; rows (weak, src, dst) are sorted by weak, and one weak component is held at a time."""
    yield from map(_of_one, _whole(batches))


def _of_one(edges: pd.DataFrame) -> pd.DataFrame:
    """The strong components of a few edges: depth-first numbers and the least of them that a subtree gets back to, on an explicit stack."""
    out: dict[int, list[int]] = {}
    for a, b in zip(edges["src"].tolist(), edges["dst"].tolist()):
        out.setdefault(a, []).append(b)
    number, low, open_, trail, found = {}, {}, set(), [], []
    for first in out:
        if first in number:
            continue
        number[first] = low[first] = len(number)
        trail.append(first)
        open_.add(first)
        path = [(first, iter(out[first]))]
        while path:
            at, ahead = path[-1]
            for to in ahead:
                if to not in number:
                    number[to] = low[to] = len(number)
                    trail.append(to)
                    open_.add(to)
                    path.append((to, iter(out.get(to, ()))))
                    break
                if to in open_:
                    low[at] = min(low[at], number[to])
            else:
                path.pop()
                if path:
                    low[path[-1][0]] = min(low[path[-1][0]], low[at])
                if low[at] == number[at]:
                    members = [trail.pop()]
                    while members[-1] != at:
                        members.append(trail.pop())
                    open_.difference_update(members)
                    if len(members) > 1:
                        least = min(members)
                        found += [(m, least) for m in members]
    return pd.DataFrame(found, columns=["node", "component"])


def strong_components(edges: DataFrame, nodes: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """node, component (the least node of its strongly connected component); ends that are no nodes count, too.

    Nodes without an edge in or out are trimmed as long as a round takes off a tenth of the edges; each is a component of
    its own. A weak component of at most task_edges of the rest goes to one task; larger ones are coloured, which takes a
    round for each hop.
    """
    every = written(nodes.select("node").union(edges.select("src")).union(edges.select("dst")).where("node is not null").distinct())
    live = written(edges.select("src", "dst").where("src <> dst").distinct())
    n = live.count()
    while n:
        live = written(live.join(live.select(F.col("dst").alias("src")), "src", "left_semi").join(live.select(F.col("src").alias("dst")), "dst", "left_semi").select("src", "dst"))
        before, n = n, live.count()
        if 10 * (before - n) < before:
            break
    if not n:
        return every.select("node", F.col("node").alias("component"))
    weak = connected_components(live, "src", "dst").select(F.col("node").alias("src"), F.col("component").alias("weak"))
    dealt = narrow(live.join(weak, "src"))
    sizes = narrow(dealt.groupBy("weak").agg(F.count("*").alias("n")))
    kind = live.schema["src"].dataType.simpleString()
    few = dealt.join(sizes.where(F.col("n") <= task_edges), "weak", "left_semi").select("weak", "src", "dst")
    found = [few.repartition("weak").sortWithinPartitions("weak").mapInPandas(_components_of_task, f"node {kind}, component {kind}")]
    large = sizes.where(F.col("n") > task_edges)
    if not large.isEmpty():
        rest = written(dealt.join(large, "weak", "left_semi").select("src", "dst"))
        found.append(_coloured(rest, rest.select(F.col("src").alias("node")).union(rest.select("dst"))))
    known = written(_union(found))
    return every.join(known, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def component_facts(components: DataFrame, edges: DataFrame, gates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(component, unit: the gates of all its nodes; component, parent: other components that its nodes' edges lead to), each once.

    components (node, component), edges (src, dst: the node and its parent), gates (node, unit). The children are the second
    table read the other way. Both are joins on nodes; they form a graph without cycles.
    """
    of = components.select("node", "component")
    units = gates.join(of, "node").select("component", "unit").distinct()
    ends = edges.join(of.withColumnRenamed("node", "src"), "src").join(of.select(F.col("node").alias("dst"), F.col("component").alias("parent")), "dst")
    return units, ends.where("component <> parent").select("component", "parent").distinct()


def _coloured(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, component, by colouring.

    In each round the least node that reaches a node is its colour; a colour's component is what its own node is
    reached from within the colour. Every round settles one component of each colour at least.
    """
    left = written(nodes.select("node").distinct())
    live = written(edges.select("src", "dst").where("src <> dst").distinct())
    done: list[DataFrame] = []
    while not left.isEmpty():
        colour = written(left.withColumn("colour", F.col("node")))
        while True:
            offer = live.join(colour.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("new"))
            better = colour.join(offer, "node", "left").select("node", F.least("colour", F.coalesce("new", "colour")).alias("colour"), (F.col("new") < F.col("colour")).alias("moved"))
            better = written(better)
            colour = better.select("node", "colour")
            if better.where("moved").isEmpty():
                break
        named = live.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("c1")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("c2")), "dst").where("c1 = c2")
        within = written(named.select("src", "dst"))
        back = reachable(within.select(F.col("dst").alias("src"), F.col("src").alias("dst")), colour.where("node = colour").select("node"))
        settled = written(colour.join(back, "node", "left_semi").select("node", F.col("colour").alias("component")))
        done.append(settled)
        left = written(left.join(settled, "node", "left_anti"))
        keep = left.select("node")
        live = written(within.join(keep.withColumnRenamed("node", "src"), "src", "left_semi").join(keep.withColumnRenamed("node", "dst"), "dst", "left_semi"))
    return _union(done) if done else nodes.select("node", F.col("node").alias("component")).limit(0)


def contributor_union(local: DataFrame, parents: DataFrame) -> DataFrame:
    """set_id, unit_id: the units of a set and of all its ancestors; local (set_id, unit_id), parents (set_id, parent_set_id)."""
    sets = local.select(F.col("set_id").alias("node")).union(parents.select("set_id"))
    above = reachable_pairs(parents.select(F.col("set_id").alias("src"), F.col("parent_set_id").alias("dst")), sets)
    return above.join(local.withColumnRenamed("set_id", "node"), "node").select(F.col("start").alias("set_id"), "unit_id").distinct()


def contributor_totals(local: DataFrame, parents: DataFrame, weights: DataFrame, set_links: int = SET_LINKS, block_units: int = BLOCK_UNITS) -> DataFrame:
    """set_id, n, total: how many of the units with a weight a set and all its ancestors hold, and the sum of the weights.

    local (set_id, unit_id), parents (set_id, parent_set_id; bigints), weights (unit_id, weight: a whole number; one row a
    unit). Units are dealt to blocks; a task closes a block over the sets with one bit for each set and unit, and hands on
    sums alone, so that no row stands for a set and a unit of its ancestors. The links of the sets, but not the units, go
    to every task; with more than set_links of them, the pairs of contributor_union() are counted.
    """
    held = local.join(weights.select("unit_id", F.coalesce("weight", F.lit(0)).cast("long").alias("weight")), "unit_id")
    links = written(parents.select("set_id", "parent_set_id").where("set_id <> parent_set_id").distinct())
    if links.count() > set_links:
        rows = contributor_union(local, parents).join(weights.select("unit_id", F.coalesce("weight", F.lit(0)).cast("long").alias("weight")), "unit_id")
        return rows.groupBy("set_id").agg(F.count("*").alias("n"), F.sum("weight").alias("total"))
    ends = links.select(F.col("set_id").cast("long"), F.col("parent_set_id").cast("long")).toPandas()
    dag = local.sparkSession.sparkContext.broadcast((ends["set_id"].to_numpy(), ends["parent_set_id"].to_numpy()))
    blocks = weights.count() // block_units + 1
    rows = held.where("set_id is not null").select(F.pmod(F.xxhash64("unit_id"), F.lit(blocks)).alias("block"), F.col("set_id").cast("long").alias("set_id"), "unit_id", "weight").distinct()
    sums = rows.repartition("block").sortWithinPartitions("block").mapInPandas(lambda batches: _totals_of_task(batches, *dag.value), "set_id long, n long, total long")
    return sums.groupBy("set_id").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def _upper_first(low: np.ndarray, high: np.ndarray, n: int) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Links (low, high) in groups whose upper ends are done by earlier groups, and those on and below cycles; a group has its lower ends, where the links of each begin, and the upper ends."""

    def grouped(of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        of = of[np.argsort(low[of], kind="stable")]
        lower, starts = np.unique(low[of], return_index=True)
        return lower, starts, high[of]

    by_high = np.argsort(high, kind="stable")
    begins = np.searchsorted(high[by_high], np.arange(n + 1))
    waits, by_low = np.bincount(low, minlength=n), np.argsort(low, kind="stable")
    low_begins = np.searchsorted(low[by_low], np.arange(n + 1))

    def spread(nodes: np.ndarray, starts: np.ndarray, order: np.ndarray) -> np.ndarray:
        sizes = starts[nodes + 1] - starts[nodes]
        return order[np.repeat(starts[nodes] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]

    groups, ready, left = [], np.flatnonzero(waits == 0), np.ones(n, bool)
    while len(ready):
        left[ready] = False
        lower, counts = np.unique(low[spread(ready, begins, by_high)], return_counts=True)
        waits[lower] -= counts
        ready = lower[waits[lower] == 0]
        if len(ready):
            groups.append(grouped(spread(ready, low_begins, by_low)))
    rest = np.flatnonzero(left[low])
    return groups, [grouped(rest)] if len(rest) else []


def _totals_of_task(batches: Iterator[pd.DataFrame], low: np.ndarray, high: np.ndarray) -> Iterator[pd.DataFrame]:
    """set_id, n, total of the blocks of one task; rows (block, set_id, unit_id, weight) are sorted by block."""
    sets = np.unique(np.concatenate([low, high]))
    groups, circles = _upper_first(np.searchsorted(sets, low), np.searchsorted(sets, high), len(sets))
    n, total = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
    for rows in _whole(batches, "block"):
        linked = np.isin(rows["set_id"].to_numpy(), sets)
        if not linked.all():
            yield rows[~linked].groupby("set_id", as_index=False).agg(n=("weight", "size"), total=("weight", "sum"))
            rows = rows[linked]
        if not len(rows):
            continue
        unit, units = pd.factorize(rows["unit_id"])
        weight = np.zeros(len(units), np.int64)
        weight[unit] = rows["weight"]
        bits = np.zeros((len(sets), -(-len(units) // 64)), np.uint64)
        np.bitwise_or.at(bits, (np.searchsorted(sets, rows["set_id"].to_numpy()), unit >> 6), np.uint64(1) << (unit & 63).astype(np.uint64))
        for lower, starts, upper in groups:
            bits[lower] |= np.bitwise_or.reduceat(bits[upper], starts, axis=0)
        for lower, starts, upper in circles:
            while True:
                more = bits[lower] | np.bitwise_or.reduceat(bits[upper], starts, axis=0)
                if (more == bits[lower]).all():
                    break
                bits[lower] = more
        here, least = np.bitwise_count(bits).sum(axis=1, dtype=np.int64), int(weight.min())
        n += here
        total += least * here
        for k in range(int(weight.max() - least).bit_length()):  # the weights above the least, one binary digit at a time
            digit = np.zeros(bits.shape[1] * 64, np.uint8)
            digit[: len(units)] = (weight - least) >> k & 1
            mask = np.packbits(digit, bitorder="little").view("<u8")
            total += np.bitwise_count(bits & mask).sum(axis=1, dtype=np.int64) << k
    held = n > 0
    yield pd.DataFrame({"set_id": sets[held], "n": n[held], "total": total[held]})


def parent_unions(local: DataFrame, parents: DataFrame, unions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sets that stand for unions of others, added without renumbering: roots (union_id, set_id), their parents, violations.

    local (set_id, unit_id), parents (set_id, parent_set_id), unions (union_id, set_id) with union_id from 0. The root
    of a union of one set is that set; of several, the set without units that has just these parents: the least
    there is, or else a new one, numbered behind all sets by the least union that needs it. Equal lists of parents
    share a set; lists are equal if their number, least, greatest and 128 bits of hashes are. Repeated rows count
    once. Violations (union_id): unions with a null or an unknown set; they get no root.
    """
    sets = written(local.select("set_id").union(parents.select("set_id")).union(parents.select("parent_set_id")).where("set_id is not null").distinct())
    greatest = sets.agg(F.max("set_id")).first()[0]
    behind = F.lit(0 if greatest is None else greatest + 1).cast("long")
    asked = unions.select("union_id", "set_id").distinct().join(sets.withColumn("known", F.lit(True)), "set_id", "left")
    listed = [F.count("*").alias("n"), F.min("set_id").alias("first"), F.max("set_id").alias("last")]
    listed += [F.expr(f"bit_xor(xxhash64(set_id, {i}))").alias(f"h{i}") for i in (0, 1)]
    same = ["n", "first", "last", "h0", "h1"]
    wanted = written(asked.groupBy("union_id").agg(*listed, F.bool_and(F.coalesce("known", F.lit(False))).alias("good")))
    bare = parents.join(local.select("set_id"), "set_id", "left_anti").select(F.col("set_id").alias("of"), F.col("parent_set_id").alias("set_id")).where("set_id is not null").distinct()
    there = bare.groupBy("of").agg(*listed).groupBy(*same).agg(F.min("of").alias("old"))
    several = wanted.where("good and n > 1")
    made = several.groupBy(*same).agg(F.min("union_id").alias("by")).join(there, same, "left")
    made = written(made.select(*same, "by", F.col("old").isNull().alias("new"), F.coalesce("old", behind + F.col("by")).alias("root")))
    roots = wanted.where("good and n = 1").select("union_id", F.col("first").alias("set_id")).union(several.join(made, same).select("union_id", "root"))
    added = made.where("new").select(F.col("by").alias("union_id"), F.col("root").alias("set_id"))
    new_parents = unions.select("union_id", F.col("set_id").alias("parent_set_id")).distinct().join(added, "union_id").select("set_id", "parent_set_id")
    return roots, new_parents, wanted.where("not good").select("union_id")


def least_paths(edges: DataFrame, roots: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """node, path: the least path (arrays of labels in lexicographic order, a prefix first) that leads from a root to each node.

    edges (src, dst, label). A path is always greater than its prefixes, so that the least paths are those of a search that
    goes down by ascending labels. Weak components of at most task_edges edges are searched within a task each. Of larger
    ones only what the roots reach is left, and what still is larger is relaxed, in as many rounds as the longest path has
    labels. Equal paths to one node count once; null ends and labels are left out.
    """
    tops = written(roots.select("node").distinct())
    live = written(edges.where("src is not null and dst is not null and label is not null").select("src", "dst", F.col("label").cast("long").alias("label")).distinct())
    few, rest = _dealt_by_size(live, tops, task_edges)
    parts = [few]
    if rest is not None:
        reached = reachable(rest, tops.join(rest.select(F.col("src").alias("node")), "node", "left_semi"))
        few, rest = _dealt_by_size(narrow(rest.join(reached.withColumnRenamed("node", "src"), "src", "left_semi")), tops, task_edges)
        parts.append(few)
    kind = live.schema["dst"].dataType.simpleString()
    found = [p.repartition("weak").sortWithinPartitions("weak").mapInPandas(_paths_of_task, f"node {kind}, path array<long>") for p in parts]
    if rest is not None:
        found.append(_relaxed(rest, tops.join(rest.select(F.col("src").alias("node")), "node", "left_semi")))
    below = _union(found).join(tops, "node", "left_anti")
    return tops.select("node", F.array().cast("array<long>").alias("path")).unionByName(below)


def _dealt_by_size(edges: DataFrame, tops: DataFrame, task_edges: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows (weak, src, dst, label, root) of weak components with a root and at most task_edges edges, and the edges of larger ones, if any.

    A row with root names a root by both ends.
    """
    parts = connected_components(edges, "src", "dst")
    dealt = narrow(edges.join(parts.withColumnRenamed("node", "src").withColumnRenamed("component", "weak"), "src"))
    starts = written(parts.join(tops, "node", "left_semi").select(F.col("component").alias("weak"), F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0).cast("long").alias("label"), F.lit(True).alias("root")))
    sizes = narrow(dealt.groupBy("weak").agg(F.count("*").alias("n")).join(starts.select("weak"), "weak", "left_semi"))
    few = sizes.where(F.col("n") <= task_edges).select("weak")
    rows = dealt.join(few, "weak", "left_semi").select("weak", "src", "dst", "label", F.lit(False).alias("root")).union(starts.join(few, "weak", "left_semi"))
    large = sizes.where(F.col("n") > task_edges).select("weak")
    return rows, None if large.isEmpty() else written(dealt.join(large, "weak", "left_semi").select("src", "dst", "label"))


def _paths_of_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in _whole(batches):
        yield from _paths_of_one(rows)


def _paths_of_one(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """node, path of one weak component: nodes of equal paths are left together, by ascending labels, deeper ones first."""
    edges, seen = rows[~rows["root"]], set(rows.loc[rows["root"], "src"].tolist())
    ahead: dict[int, dict[int, list[int]]] = {}
    for a, label, b in zip(*(edges[c].tolist() for c in ("src", "label", "dst"))):
        ahead.setdefault(a, {}).setdefault(label, []).append(b)

    def onward(nodes: set[int]) -> Iterator[tuple[int, list[int]]]:
        found: dict[int, list[int]] = {}
        for node in nodes:
            for label, to in ahead.get(node, {}).items():
                found.setdefault(label, []).extend(to)
        return iter(sorted(found.items()))

    trail, path, out, held = [onward(set(seen))], array("q"), [], 0
    while trail:
        label, to = next(trail[-1], (0, None))
        if to is None:
            trail.pop()
            if trail:
                path.pop()
            continue
        fresh = set(to) - seen
        if fresh:
            seen |= fresh
            path.append(label)
            out += [(node, np.array(path)) for node in fresh]
            held += len(path) * len(fresh)
            trail.append(onward(fresh))
            if held > PATH_LABELS:
                yield pd.DataFrame(out, columns=["node", "path"])
                out, held = [], 0
    yield pd.DataFrame(out, columns=["node", "path"])


def _relaxed(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """node, path: least_paths() by rounds that try longer paths while any becomes less."""
    steps = keyed(edges.withColumnRenamed("src", "node"), "node")
    best = written(roots.select("node", F.array().cast("array<long>").alias("path")).distinct())
    fresh = best
    while not fresh.isEmpty():
        tried = steps.join(fresh, "node").groupBy(F.col("dst").alias("node")).agg(F.min(F.concat("path", F.array("label"))).alias("offer"))
        fresh = written(tried.join(best, "node", "left").where("path is null or offer < path").select("node", F.col("offer").alias("path")))
        best = written(best.join(fresh, "node", "left_anti").unionByName(fresh))
    return best


def atomic_groups(members: DataFrame, group: str = "group_id", anchor: str = "anchor") -> DataFrame:
    """group_id, merged_id: groups that share an anchor, directly or by others, take the least of their ids."""
    pairs = members.select(F.col(group).alias("group_id"), F.col(anchor).alias("anchor"))
    least = pairs.groupBy("anchor").agg(F.min("group_id").alias("b"))
    edges = pairs.join(least, "anchor").select(F.col("group_id").alias("a"), "b")
    return connected_components(edges).select(F.col("node").alias("group_id"), F.col("component").alias("merged_id"))


def frontier_intersection(parents: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """node: the lowest common ancestors of two sets, those of which no descendant is common too.

    parents (node, parent); what both sets reach upwards is closed, and its lowest nodes describe it.
    """
    up = parents.select(F.col("node").alias("src"), F.col("parent").alias("dst"))
    common = written(reachable(up, first).join(reachable(up, second), "node", "left_semi"))
    covered = parents.join(common, "node", "left_semi").select(F.col("parent").alias("node")).distinct()
    return common.join(covered, "node", "left_anti")


def inherited(forest: DataFrame, value: str) -> DataFrame:
    """node, value: a node's own value or, if that is null, its nearest ancestor's that has one; null where none has."""
    found = nearest_ancestor(forest, F.col(value).isNotNull(), include_self=True)
    of = forest.where(F.col(value).isNotNull()).select(F.col("node").alias("ancestor"), F.col(value).alias("value"))
    return found.join(of, "ancestor", "left").select("node", "value")


def active_reach(edges: DataFrame, seeds: DataFrame, active: DataFrame) -> DataFrame:
    """node: the active seeds and what they reach along edges of which both ends are active."""
    steps = edges.join(active.withColumnRenamed("node", "src"), "src", "left_semi").join(active.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return reachable(steps, seeds.join(active, "node", "left_semi"))
