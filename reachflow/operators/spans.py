"""Half-open spans of byte offsets: containment, innermost owners, coalescing, complements, runs and coordinate maps.

Spans stand in columns `start` and `end`, per source in `source_id`. Range joins go by equal keys: a container is dealt
to the one or two dyadic cells of its size that cover it, a point looks up its own cell of each size that containers
have, so that the sides multiply by two and by the logarithm of the longest span, however long single spans are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reachflow.functions.text import slices
from reachflow.sources.scratch import written

#: Cells have sizes of 2**SHIFT, 2**(2 * SHIFT) ... bytes, up to 2**40.
SHIFT, LARGEST = 4, 40


def _size(start: Column, end: Column) -> Column:
    """The least size, as a power of two, of cells of which two cover the span."""
    width, size = end - start, F.lit(LARGEST)
    for k in range(LARGEST - SHIFT, 0, -SHIFT):
        size = F.when(width <= F.lit(1 << k), k).otherwise(size)
    return size


def _cells(start: Column, end: Column) -> Column:
    """The (size, cell) pairs, at most two unless a span is longer than the largest cell, that cover [start, end], its end included."""
    size = _size(start, end)
    low, high = F.lit(None).cast("bigint"), F.lit(None).cast("bigint")
    for k in range(SHIFT, LARGEST + 1, SHIFT):  # shiftright takes a literal; the size is one of few
        low = F.when(size == k, F.shiftright(start.cast("bigint"), k)).otherwise(low)
        high = F.when(size == k, F.shiftright(F.greatest(end, start).cast("bigint"), k)).otherwise(high)
    return F.transform(F.sequence(low, high), lambda c: F.struct(size.cast("int").alias("size"), c.alias("cell")))


def _sizes(spans: DataFrame, start: str = "start", end: str = "end") -> list[int]:
    """The few sizes of cells that the spans are dealt to; points look up no others."""
    found = spans.where(F.col(start).isNotNull() & F.col(end).isNotNull()).select(_size(F.col(start), F.col(end)).alias("size")).distinct()
    return sorted(r["size"] for r in found.collect())


def _points(at: Column, sizes: list[int]) -> Column:
    """The (size, cell) pairs of one offset."""
    return F.array(*[F.struct(F.lit(k).cast("int").alias("size"), F.shiftright(at.cast("bigint"), k).alias("cell")) for k in sizes or [SHIFT]])


def containing(inner: DataFrame, outer: DataFrame, prefix: str = "o_") -> DataFrame:
    """The pairs of spans of one source with the inner within the outer, ends included; outer's columns get the prefix.

    Rows with a null source or offset meet nothing. Repeated rows give repeated pairs.
    """
    o = outer.select([F.col(c).alias(prefix + c) for c in outer.columns])
    o = o.withColumn(prefix + "at", F.explode(_cells(F.col(prefix + "start"), F.col(prefix + "end"))))
    i = inner.withColumn("i_at", F.explode(_points(F.col("start"), _sizes(outer))))
    on = (F.col("source_id") == F.col(prefix + "source_id")) & (F.col("i_at") == F.col(prefix + "at"))
    within = (F.col(prefix + "start") <= F.col("start")) & (F.col("end") <= F.col(prefix + "end"))
    return i.join(o, on & within).drop("i_at", prefix + "at")


def overlapping(left: DataFrame, right: DataFrame, prefix: str = "o_") -> DataFrame:
    """The pairs of non-empty spans of one source that share a byte: one of them begins within the other."""
    r = right.select([F.col(c).alias(prefix + c) for c in right.columns])
    a, b = (F.col("start"), F.col("end")), (F.col(prefix + "start"), F.col(prefix + "end"))
    same = F.col("source_id") == F.col(prefix + "source_id")
    l1, r1 = left.withColumn("l_at", F.explode(_points(a[0], _sizes(right)))), r.withColumn("r_at", F.explode(_cells(*b)))
    l2, r2 = left.withColumn("l_at", F.explode(_cells(*a))), r.withColumn("r_at", F.explode(_points(b[0], _sizes(left))))
    first = l1.join(r1, same & (F.col("l_at") == F.col("r_at")) & (b[0] <= a[0]) & (a[0] < b[1]) & (a[0] < a[1]))
    second = l2.join(r2, same & (F.col("l_at") == F.col("r_at")) & (a[0] < b[0]) & (b[0] < a[1]) & (b[0] < b[1]))
    return first.unionByName(second).drop("l_at", "r_at")


def innermost_owners(sites: DataFrame, units: DataFrame) -> DataFrame:
    """site columns and owner: every unit that holds the site with the least (length, -depth), ties included.

    sites (source_id, site_id, start, end), units (source_id, unit_id, start, end, depth).
    """
    pairs = containing(sites, units)
    turn = F.rank().over(Window.partitionBy("source_id", "site_id").orderBy(F.col("o_end") - F.col("o_start"), F.desc("o_depth")))
    return pairs.withColumn("turn", turn).where("turn = 1").select(*sites.columns, F.col("o_unit_id").alias("owner"))


def unique_owners(sites: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sites with their one innermost owner; and violations: sites with none or several, with their number n."""
    owners = innermost_owners(sites, units)
    counts = sites.select("source_id", "site_id").join(owners.groupBy("source_id", "site_id").agg(F.count("*").alias("n"), F.min("owner").alias("owner")), ["source_id", "site_id"], "left")
    counts = counts.withColumn("n", F.coalesce("n", F.lit(0)))
    return counts.where("n = 1").select("source_id", "site_id", "owner"), counts.where("n <> 1").select("source_id", "site_id", "n")


def piece_owners(pieces: DataFrame, units: DataFrame) -> DataFrame:
    """One owner for each piece: the deepest, then shortest, then of greatest kind rank, then of least id."""
    pairs = containing(pieces, units)
    order = (F.desc("o_depth"), F.col("o_end") - F.col("o_start"), F.desc("o_kind_rank"), F.col("o_unit_id"))
    turn = F.row_number().over(Window.partitionBy("source_id", "piece_id").orderBy(*order))
    return pairs.withColumn("turn", turn).where("turn = 1").select(*pieces.columns, F.col("o_unit_id").alias("owner"))


def deepest(pieces: tuple[np.ndarray, ...], units: tuple[np.ndarray, ...]) -> np.ndarray:
    """For each piece the place of its owner among the units, as piece_owners() has it, or -1.

    pieces are columns source, start, end; units source, start, end, depth, kind_rank, id. Units of one depth that lie apart
    are looked up by bisection; where they cross or touch an empty piece, a piece is held against those of its source.
    """
    (p_source, p_start, p_end), (u_source, u_start, u_end, u_depth, u_rank, u_id) = pieces, units
    found = np.full(len(p_source), -1)
    width = max([int(x.max()) for x in (p_start, u_start) if len(x)], default=0) + 1
    for depth in np.unique(u_depth)[::-1].tolist():
        own = np.flatnonzero(u_depth == depth)
        own = own[np.lexsort((u_id[own], -u_rank[own], u_end[own] - u_start[own], u_start[own], u_source[own]))]
        left = np.flatnonzero(found < 0)
        source, start, end = p_source[left], p_start[left], p_end[left]
        apart = np.all((u_source[own[1:]] != u_source[own[:-1]]) | (u_start[own[1:]] >= u_end[own[:-1]]))
        at = own[np.searchsorted(u_source[own] * width + u_start[own], source * width + start, "right") - 1]
        within = (u_source[at] == source) & (u_start[at] <= start) & (end <= u_end[at])
        several = (start >= end) if apart else np.ones(len(left), bool)
        found[left] = np.where(within & ~several, at, -1)
        for k in left[several].tolist():
            near = own[np.searchsorted(u_source[own], p_source[k]) : np.searchsorted(u_source[own], p_source[k], "right")]
            near = near[(u_start[near] <= p_start[k]) & (p_end[k] <= u_end[near])]
            if len(near):
                found[k] = near[np.lexsort((u_id[near], -u_rank[near], u_end[near] - u_start[near]))[0]]
    return found


def owners_within(sources: DataFrame, cut: Callable[[list[bytes]], tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]]) -> DataFrame:
    """source_id, start, end, owner: piece_owners() where a text says its pieces and units itself, found in the task that reads it.

    sources (source_id, text); cut gives the pieces and the units of some texts as deepest() takes them, their source being
    the place of the text. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text"):
            pieces, units = cut(texts)
            at = deepest(pieces, units)
            got = at >= 0
            columns = [part.column("source_id").take(pa.array(pieces[0][got])), *[pa.array(x[got], pa.int64()) for x in pieces[1:]], pa.array(units[5][at[got]], pa.int64())]
            yield pa.record_batch(columns, ["source_id", "start", "end", "owner"])

    rows = sources.where("text is not null").select("source_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"source_id {rows.schema['source_id'].dataType.simpleString()}, start long, end long, owner long")


def exact_lookup(ranges: DataFrame, units: DataFrame) -> DataFrame:
    """range columns, n, unit_id: units of exactly that range; unit_id is null where there are none or several."""
    found = units.groupBy("source_id", "start", "end").agg(F.count("*").alias("n"), F.min("unit_id").alias("unit_id"))
    joined = ranges.join(found, ["source_id", "start", "end"], "left")
    return joined.select(*ranges.columns, F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") == 1, F.col("unit_id")).alias("unit_id"))


def coalesced(spans: DataFrame, *keys: str) -> DataFrame:
    """keys, start, end: spans that overlap or touch (start <= the greatest end before) become one; nulls come last."""
    w = Window.partitionBy(*keys).orderBy(F.asc_nulls_last("start"), F.asc_nulls_last("end"))
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("c_before", before)
    marked = marked.withColumn("c_group", F.sum(F.when(F.col("c_before").isNull() | (F.col("start") > F.col("c_before")), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "c_group").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("c_group")


def remaining_pieces(sources: DataFrame, deletions: DataFrame) -> DataFrame:
    """source_id, out_start, out_end, orig_start, orig_end: what is left of [0, byte_len) outside coalesced deletions.

    sources (source_id, byte_len). A source with nothing left has no piece.
    """
    edges = deletions.select("source_id", "start", "end").unionByName(sources.select("source_id", F.col("byte_len").alias("start"), F.col("byte_len").alias("end")))
    w = Window.partitionBy("source_id").orderBy("start", "end")
    gaps = edges.select("source_id", F.coalesce(F.lag("end").over(w), F.lit(0)).cast("long").alias("orig_start"), F.col("start").cast("long").alias("orig_end")).where("orig_start < orig_end")
    length = F.col("orig_end") - F.col("orig_start")
    out_end = F.sum(length).over(Window.partitionBy("source_id").orderBy("orig_start").rowsBetween(Window.unboundedPreceding, 0))
    return gaps.withColumn("out_end", out_end).select("source_id", (F.col("out_end") - length).alias("out_start"), "out_end", "orig_start", "orig_end")


def to_original(ranges: DataFrame, pieces: DataFrame) -> DataFrame:
    """Ranges of the output with orig_start, orig_end: at a seam a start takes the right piece, an end the left one.

    ranges (source_id, range_id, start, end; not empty); a range outside the output has nulls.
    """
    spans = pieces.select("source_id", F.col("out_start").alias("start"), F.col("out_end").alias("end"), "orig_start")
    first = containing(ranges.select("source_id", "range_id", "start", (F.col("start") + 1).alias("end")), spans)
    first = first.select("source_id", "range_id", (F.col("o_orig_start") + F.col("start") - F.col("o_start")).alias("orig_start"))
    last = containing(ranges.select("source_id", "range_id", (F.col("end") - 1).alias("start"), "end"), spans)
    last = last.select("source_id", "range_id", (F.col("o_orig_start") + F.col("end") - F.col("o_start")).alias("orig_end"))
    return ranges.join(first, ["source_id", "range_id"], "left").join(last, ["source_id", "range_id"], "left")


def runs(rows: DataFrame, keys: list[str], at: str, value: Column) -> DataFrame:
    """keys, value, first, last, n: maximal runs of equal values over consecutive positions (gaps and islands)."""
    marked = rows.select(*keys, F.col(at).alias("r_at"), value.alias("value"))
    island = F.col("r_at") - F.row_number().over(Window.partitionBy(*keys, "value").orderBy("r_at"))
    return marked.withColumn("r_island", island).groupBy(*keys, "value", "r_island").agg(F.min("r_at").alias("first"), F.max("r_at").alias("last"), F.count("*").alias("n")).drop("r_island")


def outermost(spans: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """The spans that lie within no other of their key, each once; and violations: those that partly overlap an earlier one."""
    w = Window.partitionBy(*keys).orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    marked = spans.select(*keys, "start", "end").distinct().withColumn("reach", F.max("end").over(w))
    return marked.where("reach is null or start >= reach").drop("reach"), marked.where("start < reach and end > reach").drop("reach")


def crossings(spans: DataFrame, *keys: str) -> DataFrame:
    """keys, start, end: violations of nesting; spans that begin within another of their key and end outside it."""
    plain = spans.select(F.struct(*keys).alias("source_id") if len(keys) > 1 else F.col(keys[0]).alias("source_id"), "start", "end").distinct()
    met = overlapping(plain, plain).where("o_start < start and o_end < end")
    return met.select("source_id", "start", "end").distinct()


def least_enclosing(leaves: DataFrame, braces: DataFrame) -> DataFrame:
    """group_id, brace_id: the shortest brace (then the first, then of least id) that holds all leaves of a group."""
    hull = leaves.groupBy("source_id", "group_id").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    pairs = containing(hull, braces)
    turn = F.row_number().over(Window.partitionBy("source_id", "group_id").orderBy(F.col("o_end") - F.col("o_start"), "o_start", "o_brace_id"))
    return pairs.withColumn("turn", turn).where("turn = 1").select("source_id", "group_id", F.col("o_brace_id").alias("brace_id"))


def child_containing(ranges: DataFrame, children: DataFrame) -> tuple[DataFrame, DataFrame]:
    """source_id, range_id, child_id: the shortest child around each range; and violations: ties of the shortest, and partial overlaps.

    ranges (source_id, range_id, start, end), children (source_id, child_id, start, end); a range without a child has no row.
    """
    pairs = containing(ranges, children)
    size, child = F.col("o_end") - F.col("o_start"), F.col("o_child_id").alias("child_id")
    ends = F.min(F.struct(size.alias("n"), child)).alias("best"), F.max(F.struct((-size).alias("n"), child)).alias("last")
    best = written(pairs.groupBy("source_id", "range_id").agg(*ends).select("source_id", "range_id", F.col("best.child_id").alias("child_id"), F.col("last.child_id").alias("last")))
    ties = best.where("child_id < last").select("source_id", "range_id", F.lit("tie").alias("why"))
    met = overlapping(ranges, children).where("not (o_start <= start and end <= o_end) and not (start <= o_start and o_end <= end)")
    partial = met.select("source_id", "range_id", F.lit("partial").alias("why")).distinct()
    return best.select("source_id", "range_id", "child_id"), ties.unionByName(partial)


def site_retained(owners: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """site_id, kept: whether a site's owners are kept; and violations: sites whose owners disagree. owners (site_id, owner), kept (owner)."""
    state = owners.join(kept.select("owner", F.lit(True).alias("in")).distinct(), "owner", "left").groupBy("site_id")
    state = state.agg(F.bool_and(F.coalesce("in", F.lit(False))).alias("all"), F.bool_or(F.coalesce("in", F.lit(False))).alias("any"))
    return state.where(F.col("all") == F.col("any")).select("site_id", F.col("all").alias("kept")), state.where(F.col("all") != F.col("any")).select("site_id")


def shallowest_in(targets: DataFrame, anchors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """target_id, owner: the shallowest anchor within each target; and violations: targets with several of that depth.

    targets (source_id, target_id, start, end), anchors (source_id, node, depth, start, end).
    """
    pairs = containing(anchors, targets).select(F.col("source_id"), F.col("o_target_id").alias("target_id"), "node", "depth")
    best = pairs.withColumn("turn", F.rank().over(Window.partitionBy("source_id", "target_id").orderBy("depth"))).where("turn = 1")
    found = best.groupBy("source_id", "target_id").agg(F.count("*").alias("n"), F.min("node").alias("owner"))
    return found.where("n = 1").select("source_id", "target_id", "owner"), found.where("n > 1").select("source_id", "target_id", "n")


def active_owners(sites: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """unique_owners() among the units that are active: the smallest one around each site, and sites with none or several."""
    return unique_owners(sites, units.where("active"))


def touched(discarded: DataFrame, live: DataFrame) -> DataFrame:
    """Violations: the discarded spans (source_id, start, end) that share a byte with a live one."""
    return overlapping(discarded.select("source_id", "start", "end").distinct(), live.select("source_id", "start", "end").distinct()).select("source_id", "start", "end").distinct()
