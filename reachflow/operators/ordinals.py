"""Ordinals and canonical numbers by windows: siblings, filtered ordinals, pre-order ids, subtree ranks, contiguity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reachflow.operators.closure import _union, depths
from reachflow.sources.scratch import keyed, written


#: Trees of a block in the numbering of a forest.
BLOCK_TREES = 100_000


def sibling_ordinals(rows: DataFrame, keys: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """rows with ordinal (from 0 in each key, by order), and violations: keys and values of order that several rows share."""
    numbered = rows.withColumn("ordinal", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)
    return numbered, rows.groupBy(*keys, order).agg(F.count("*").alias("n")).where("n > 1")


def filtered_ordinals(rows: DataFrame, keys: list[str], raw: str, excluded: str) -> DataFrame:
    """rows with ordinal: raw less the excluded rows before it in its key; null for excluded rows."""
    before = F.sum(F.col(excluded).cast("long")).over(Window.partitionBy(*keys).orderBy(raw).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("ordinal", F.when(~F.col(excluded), F.col(raw) - F.coalesce(before, F.lit(0))))


def gaps_in_ordinals(rows: DataFrame, keys: list[str], ordinal: str = "ordinal") -> DataFrame:
    """Violations: rows whose ordinal isn't their place (from 0) in their key; also the check that dense ids equal places."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(ordinal)) - 1
    return rows.withColumn("place", place).where(F.col("place") != F.col(ordinal))


def first_occurrence_ordinals(rows: DataFrame, keys: list[str], order: str, target: str) -> DataFrame:
    """rows with ordinal: how many distinct targets other than its own first occur earlier in its key."""
    first = F.row_number().over(Window.partitionBy(*keys, target).orderBy(order)) == 1
    own = F.min(order).over(Window.partitionBy(*keys, target))
    marked = rows.withColumn("o_first", first.cast("long")).withColumn("o_at", own)
    rank = F.sum("o_first").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    firsts = marked.withColumn("o_rank", F.coalesce(rank, F.lit(0)))
    number = F.max(F.when(F.col("o_first") == 1, F.col("o_rank"))).over(Window.partitionBy(*keys, target))
    return firsts.withColumn("ordinal", number).drop("o_first", "o_at", "o_rank")


def preorder_ids(forest: DataFrame, label: str) -> DataFrame:
    """node, path, id: dense numbers of a depth-first walk with siblings in order of label, then node.

    forest (node, parent, label). Ancestors' sibling numbers make a path; paths in array order are pre-order. Numbers
    are dealt in two passes, within and between ranges of first path elements, so that no task sorts all rows.
    """
    numbered = forest.withColumn("s", F.row_number().over(Window.partitionBy("parent").orderBy(label, "node")).cast("long"))
    level = written(numbered.where("parent is null").select("node", F.array("s").alias("path")))
    parts = [level]
    while True:
        level = written(numbered.join(level.select(F.col("node").alias("parent"), F.col("path").alias("p_path")), "parent").select("node", F.concat("p_path", F.array("s")).alias("path")))
        if level.isEmpty():
            break
        parts.append(level)
    rows = _union(parts).withColumn("tree", F.element_at("path", 1))
    sizes = written(rows.groupBy("tree").agg(F.count("*").alias("n")))
    # Trees' sizes add up in two passes, within and between blocks of trees, of which a single window sees one number each.
    blocks = sizes.withColumn("block", F.floor(F.col("tree") / BLOCK_TREES))
    within = F.sum("n").over(Window.partitionBy("block").orderBy("tree")) - F.col("n")
    ahead = blocks.groupBy("block").agg(F.sum("n").alias("n")).select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("ahead"))
    before = blocks.withColumn("within", within).join(ahead, "block").select("tree", (F.col("ahead") + F.col("within")).alias("before"))
    place = F.row_number().over(Window.partitionBy("tree").orderBy("path")) - 1
    return rows.withColumn("place", place).join(before, "tree").select("node", "path", (F.col("before") + F.col("place")).alias("id"))


def subtree_ranks(forest: DataFrame, leaf: str) -> DataFrame:
    """node, depth, shape: a digest that two nodes share exactly if their subtrees are equal, siblings' order aside.

    Bottom up, level by level: the digest of the node's own leaf value and its children's sorted digests.
    """
    own = written(forest.select("node", "parent", F.col(leaf).cast("string").alias("leaf")).join(depths(forest), "node"))
    deepest = own.agg(F.max("depth")).first()[0]
    parts: list[DataFrame] = []
    below = None
    for d in range(deepest if deepest is not None else -1, -1, -1):
        here = own.where(F.col("depth") == d)
        if below is not None:
            children = below.groupBy(F.col("parent").alias("node")).agg(F.array_sort(F.collect_list("shape")).alias("children"))
            here = here.join(children, "node", "left")
        else:
            here = here.withColumn("children", F.lit(None).cast("array<string>"))
        below = written(here.select("node", "parent", "depth", F.sha2(F.concat_ws("|", F.coalesce("leaf", F.lit("")), F.array_join(F.coalesce("children", F.array().cast("array<string>")), ",")), 256).alias("shape")))
        parts.append(below)
    return _union(parts).select("node", "depth", "shape") if parts else own.select("node", "depth", "leaf").limit(0)


def witness_ordinals(rows: DataFrame, keys: list[str], witnesses: list[str], raw: str) -> DataFrame:
    """rows with ordinal: siblings of equal keys ordered by the first witness that tells all of them apart, else by raw.

    A witness decides a group if no sibling lacks it and all differ; a later witness is tried only where every sibling
    lacks the earlier ones. A single sibling gets 0, wherever it stood.
    """
    group = Window.partitionBy(*keys)
    marked = rows.withColumn("y_n", F.count("*").over(group))
    for i, w in enumerate(witnesses):
        first = F.row_number().over(Window.partitionBy(*keys, w).orderBy(raw)) == 1
        marked = marked.withColumn(f"y_first{i}", (first & F.col(w).isNotNull()).cast("int"))
    rule = F.lit(len(witnesses))
    for i in range(len(witnesses) - 1, -1, -1):
        have, distinct = F.count(witnesses[i]).over(group), F.sum(f"y_first{i}").over(group)
        marked = marked.withColumn(f"y_have{i}", have).withColumn(f"y_distinct{i}", distinct)
        decides = (F.col(f"y_have{i}") == F.col("y_n")) & (F.col(f"y_distinct{i}") == F.col("y_n"))
        rule = F.when(decides, i).when(F.col(f"y_have{i}") == 0, rule).otherwise(len(witnesses))
    order = [F.when(F.col("y_rule") == i, F.col(w).cast("string")) for i, w in enumerate(witnesses)]
    placed = marked.withColumn("y_rule", rule).withColumn("ordinal", F.when((F.col("y_rule") == len(witnesses)) & (F.col("y_n") > 1), F.col(raw)).otherwise(F.row_number().over(group.orderBy(*order, raw)) - 1))
    return placed.select(*rows.columns, "ordinal")


def _digest(text: Column) -> Column:
    """128 bits of SHA-256 in 22 characters."""
    return F.substring(F.base64(F.substring(F.unhex(F.sha2(text, 256)), 1, 16)), 1, 22)


def _below(up: Column, own: Column) -> Column:
    """The identity of a node with this digest below the identity up."""
    return _digest(F.concat(up, own))


def _by_doubling(core: DataFrame) -> DataFrame:
    """node, identity of the nodes of core (node, parent, own) whose ancestors end at a root; paths double in each round."""
    state = written(core.select("node", F.col("parent").alias("ptr"), F.array("own").alias("path")))
    for _ in range(state.count().bit_length() + 1):
        if state.where("ptr is not null").isEmpty():
            break
        jump = state.select(F.col("node").alias("j"), F.col("ptr").alias("j_ptr"), F.col("path").alias("j_path"))
        # A parent that is not there stays, and its node never ends.
        moved = state.join(jump, F.col("ptr") == F.col("j"), "left")
        state = written(moved.select("node", F.when(F.col("j").isNull(), F.col("ptr")).otherwise(F.col("j_ptr")).alias("ptr"), F.when(F.col("j").isNull(), F.col("path")).otherwise(F.concat("j_path", "path")).alias("path")))
        if state.where("ptr is not null").join(state.select(F.col("node").alias("ptr")), "ptr", "left_semi").isEmpty():
            break
    return state.where("ptr is null").select("node", F.aggregate("path", F.lit(""), _below).alias("identity"))


def identities(rows: DataFrame, keys: list[str], private: list[str], raw: str) -> DataFrame:
    """rows with rank (by raw within parent, keys and private ones), identity, up (the parent's, empty for roots), both null where ancestors don't end at a root, and dealt.

    rows (node, parent, ...), one a node. An identity is a digest of keys and rank chained to the parent's, so that it does
    not change with numbers of nodes. Rows are dealt once by parent, roots by their keys (the column dealt), and written so:
    neither ranks nor a parent's identity shuffle them again. Only nodes with children are looked for by node, and those
    without grandchildren are left aside as long as that halves them; what is then left, as in long chains, doubles its paths.
    """
    dealt = F.coalesce("parent", F.hash(*keys).cast(rows.schema["parent"].dataType))
    placed = keyed(rows.withColumn("dealt", dealt), "dealt")
    cohort = Window.partitionBy("dealt", "parent", *keys, *private).orderBy(raw, "node")
    ranked = placed.withColumn("rank", F.row_number().over(cohort) - 1)
    own = _digest(F.to_json(F.struct(*keys, *private, "rank"), {"ignoreNullFields": "false"}))
    parents = placed.where("parent is not null").select(F.col("dealt").alias("node")).distinct()
    inner = written(ranked.select("node", "parent", *keys, *private, "rank").join(parents.hint("merge"), "node", "left_semi"))
    sets, n = [inner], inner.count()
    while n:
        above = written(sets[-1].join(sets[-1].select(F.col("parent").alias("node")).distinct(), "node", "left_semi"))
        m = above.count()
        if 2 * m > n:
            break
        sets.append(above)
        n = m
    found = _by_doubling(sets.pop().withColumn("own", own))
    for few in reversed(sets):  # the parents of each set that are there stand in the set after it
        of = found.select(F.col("node").alias("p"), F.col("identity").alias("up"))
        found = few.join(of, F.col("parent") == F.col("p"), "left").select("node", _below(F.when(F.col("parent").isNull(), "").otherwise(F.col("up")), own).alias("identity")).where("identity is not null")
    of = keyed(found.select(F.col("node").alias("p"), "identity"), "p").select("p", F.col("identity").alias("p_identity"))
    up = F.when(F.col("parent").isNull(), "").otherwise(F.col("p_identity"))
    told = ranked.join(of.hint("merge"), (F.col("dealt") == F.col("p")) & F.col("parent").isNotNull(), "left").withColumn("up", up)
    return told.select(*rows.columns, "rank", _below(F.col("up"), own).alias("identity"), "up", "dealt")


def structural_ordinals(rows: DataFrame, keys: list[str], private: list[str], raw: str, expected: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with rank, identity, up and ordinal; violations node, reason): ordinals of siblings of equal keys.

    Without expected, siblings of equal keys are numbered by raw. With expected (identity, ordinal: what an earlier run
    without it gave), each takes the ordinal of its identity, whatever siblings are gone; siblings of equal private
    keys, too, are expected to stay or go together, as their ranks are part of the identities.

    Reasons: `ancestors` (a parent that is not there or a cycle), `cohort` (equal raw ordinals in a cohort of equal keys
    and private ones), `siblings` (equal ordinals of siblings, or equal raw ones without expected), `absent` (an identity
    that expected lacks; its ordinal is null). A node may have several.
    """
    known = identities(rows, keys, private, raw)
    wrong = [known.where("identity is null").select("node", F.lit("ancestors").alias("reason"))]
    same = F.count("*").over(Window.partitionBy("dealt", "parent", *keys, *private, raw))
    wrong.append(known.withColumn("n_same", same).where("n_same > 1").select("node", F.lit("cohort").alias("reason")))
    whole = known.where("identity is not null")
    siblings = ["dealt", "parent", *keys]
    if expected is None:
        placed = whole.withColumn("ordinal", F.row_number().over(Window.partitionBy(*siblings).orderBy(raw, "node")) - 1)
        by = raw
    else:
        told = expected.select("identity", F.col("ordinal").cast("int").alias("ordinal"))
        placed, by = whole.join(told, "identity", "left"), "ordinal"
        wrong.append(placed.where("ordinal is null").select("node", F.lit("absent").alias("reason")))
    n_alike = F.count("*").over(Window.partitionBy(*siblings, by))
    wrong.append(placed.withColumn("n_alike", n_alike).where((F.col("n_alike") > 1) & F.col(by).isNotNull()).select("node", F.lit("siblings").alias("reason")))
    return placed.select(*rows.columns, "rank", "identity", "up", "ordinal"), _union(wrong)
