"""Reduction of texts: which spans go, in lists with their commas, and what remains, with its coordinates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reachflow.functions.text import joined_in_order, slices
from reachflow.operators import spans
from reachflow.operators.closure import flags_above
from reachflow.sources.scratch import keyed, written


def frontier(units: DataFrame, kept: DataFrame, managed: list[str]) -> DataFrame:
    """source_id, start, end: units that aren't kept below a kept parent, but for kinds that lists manage.

    units (source_id, unit_id, parent_id, kind, start, end), kept (source_id, unit_id).
    """
    gone = units.where(~F.col("kind").isin(managed)).join(kept, ["source_id", "unit_id"], "left_anti")
    return gone.join(kept.select("source_id", F.col("unit_id").alias("parent_id")), ["source_id", "parent_id"], "left_semi").select("source_id", "start", "end")


def list_deletions(elements: DataFrame, dropped: Column) -> DataFrame:
    """source_id, list_id, start, end: each dropped element with the separator behind it, the last ones with the one before.

    elements (source_id, list_id, i, start, end) are numbered from 0 in their list; between two lies one separator.
    A dropped element ends where the next begins; if no kept element follows, it begins where the one before ends.
    """
    w = Window.partitionBy("source_id", "list_id").orderBy("i")
    # Read from the end: a frame up to the end of the list would be computed anew for each row.
    later = F.max((~dropped).cast("int")).over(Window.partitionBy("source_id", "list_id").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, -1))
    marked = elements.withColumn("d_gone", dropped).withColumn("d_later", F.coalesce(later, F.lit(0)) == 1).withColumn("d_next", F.lead("start").over(w)).withColumn("d_before", F.lag("end").over(w))
    start = F.when(F.col("d_later"), F.col("start")).otherwise(F.coalesce("d_before", "start"))
    end = F.when(F.col("d_later"), F.coalesce("d_next", "end")).otherwise(F.col("end"))
    return marked.where("d_gone").select("source_id", "list_id", start.alias("start"), end.alias("end"))


def nested_deletions(elements: DataFrame, kept: DataFrame) -> DataFrame:
    """source_id, start, end: what goes of lists within lists, each element with the separator behind it, else the one before.

    elements (source_id, node, parent, leaf, start, end, ahead, behind): parent is the element around an element's
    list, or null; ahead is the start of the separator before it and behind the end of the one after it, or null.
    An element goes as a whole if it holds leaves and none of kept (node); one that keeps some is cut inside, and one
    without leaves stays. Levels are found by doubling, whatever their number.
    """
    marked = elements.join(kept.select("node", F.lit(True).alias("stays")).distinct(), "node", "left")
    marked = keyed(marked.withColumn("stays", F.col("leaf") & F.coalesce("stays", F.lit(False))), "node")
    # Elements tell the ones around them once; what has something within it is few, and levels are looked for among that alone.
    told = marked.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.bool_or("leaf").alias("t_leaf"), F.bool_or("stays").alias("t_stays"))
    around = marked.select("node", "parent", "leaf", "stays").join(told, "node")
    around = around.select("node", "parent", (F.col("leaf") | F.col("t_leaf")).alias("n_leaf"), (F.col("stays") | F.col("t_stays")).alias("n_stays"))
    around = written(flags_above(around, ["n_leaf", "n_stays"]))
    state = marked.join(around, "node", "left")
    gone = state.where(F.coalesce("n_leaf", "leaf") & ~F.coalesce("n_stays", "stays")).select(*elements.columns)
    cut = gone.join(around.where("n_leaf and not n_stays").select(F.col("node").alias("parent")), "parent", "left_anti")
    start = F.when(F.col("behind").isNull(), F.coalesce("ahead", "start")).otherwise(F.col("start"))
    return cut.select("source_id", start.alias("start"), F.coalesce("behind", "end").alias("end"))


def nested_gone(parent: np.ndarray, leaf: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Whether each element goes, as nested_deletions() has it, by arrays, and none around it does; parent is a place or -1."""
    holds, stays, depth, up = leaf.copy(), leaf & kept, np.zeros(len(parent), np.int64), parent
    while np.any(up >= 0):
        depth += up >= 0
        up = np.where(up >= 0, parent[up], -1)
    for level in range(int(depth.max(initial=0)), 0, -1):
        at = np.flatnonzero(depth == level)
        holds[parent[at[holds[at]]]] = True
        stays[parent[at[stays[at]]]] = True
    gone = holds & ~stays
    return gone & ~((parent >= 0) & gone[parent]) if len(gone) else gone


def without(texts: list[bytes], gone: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[bytes]:
    """The texts after deletions of text, start, end, which may overlap."""
    flat, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    change = np.zeros(len(flat) + 1, np.int32)
    np.add.at(change, ends[gone[0]] + gone[1], 1)
    np.add.at(change, ends[gone[0]] + gone[2], -1)
    left = np.cumsum(change[:-1]) == 0
    data, cuts = flat[left].tobytes(), np.append(0, np.cumsum(left))[ends].tolist()
    return [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def nested_within(sources: DataFrame, lists: Callable[[list[bytes]], tuple[np.ndarray, ...]]) -> DataFrame:
    """source_id, text after nested_deletions() where a text says its lists itself, cut in the task that reads it; null texts have no row.

    sources (source_id, text); lists gives the elements of some texts: the place of the text, the place of the element around it
    or -1, leaf, kept, start, end, and ahead and behind, -1 where there is no separator. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text"):
            text, parent, leaf, kept, start, end, ahead, behind = lists(texts)
            gone = nested_gone(parent, leaf, kept)
            begin = np.where((behind < 0) & (ahead >= 0), ahead, start)
            cut = without(texts, tuple(c[gone] for c in (text, begin, np.where(behind < 0, end, behind))))
            yield pa.record_batch([part.column("source_id"), pa.array(cut, pa.binary()).cast(pa.string())], ["source_id", "text"])

    rows = sources.where("text is not null").select("source_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"source_id {rows.schema['source_id'].dataType.simpleString()}, text string")


def repetition_deletions(elements: DataFrame, inputs: DataFrame) -> DataFrame:
    """source_id, rep_id, start, end: runs of elements that aren't kept, with one separator beside; the whole input if all go.

    elements (source_id, rep_id, i, start, end, kept), inputs (source_id, rep_id, input_start, input_end).
    """
    counts = elements.groupBy("source_id", "rep_id").agg(F.bool_or("kept").alias("any_kept"))
    whole = counts.where("not any_kept").join(inputs, ["source_id", "rep_id"]).select("source_id", "rep_id", F.col("input_start").alias("start"), F.col("input_end").alias("end"))
    some = elements.join(counts.where("any_kept").select("source_id", "rep_id"), ["source_id", "rep_id"], "left_semi")
    w = Window.partitionBy("source_id", "rep_id").orderBy("i")
    marked = some.withColumn("r_next", F.lead("start").over(w)).withColumn("r_before", F.lag("end").over(w))
    island = F.col("i") - F.row_number().over(Window.partitionBy("source_id", "rep_id", "kept").orderBy("i"))
    gone = marked.withColumn("r_island", island).where("not kept").groupBy("source_id", "rep_id", "r_island")
    ends = gone.agg(F.min("start").alias("s"), F.max("end").alias("e"), F.max_by("r_next", "i").alias("behind"), F.min_by("r_before", "i").alias("ahead"))
    part = ends.select("source_id", "rep_id", F.when(F.col("behind").isNull(), F.coalesce("ahead", "s")).otherwise(F.col("s")).alias("start"), F.coalesce("behind", "e").alias("end"))
    return whole.unionByName(part)


def attribute_deletions(elements: DataFrame, dropped: Column, lists: DataFrame) -> DataFrame:
    """source_id, list_id, start, end: list_deletions(), but for lists that lose all elements, which go as a whole.

    lists (source_id, list_id, list_start, list_end) are the spans of the attributes around the lists.
    """
    state = elements.groupBy("source_id", "list_id").agg(F.bool_and(dropped).alias("all_gone"))
    whole = lists.join(state.where("all_gone"), ["source_id", "list_id"]).select("source_id", "list_id", F.col("list_start").alias("start"), F.col("list_end").alias("end"))
    part = list_deletions(elements.join(state.where("not all_gone").select("source_id", "list_id"), ["source_id", "list_id"], "left_semi"), dropped)
    return whole.unionByName(part)


def repetition_plan(repetitions: DataFrame, elements: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rep_id, n: the kept elements of each repetition whose parent is kept; and violations, where n is out of bounds.

    repetitions (rep_id, parent, least, most; a null bound doesn't count), elements (rep_id, unit), kept (unit).
    """
    live = repetitions.join(kept.select(F.col("unit").alias("parent")), "parent", "left_semi")
    n = elements.join(kept, "unit", "left_semi").groupBy("rep_id").agg(F.count("*").alias("n"))
    counted = live.join(n, "rep_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return counted.select("rep_id", "n"), counted.where("n < least or n > most").select("rep_id", "n")


def capture_deletions(slots: DataFrame, inputs: DataFrame, kept: DataFrame) -> DataFrame:
    """source_id, start, end: the ranges of all inputs of slots of which no trigger unit is kept; slots (source_id, slot_id, unit_id), inputs (source_id, slot_id, start, end)."""
    live = slots.join(kept, ["source_id", "unit_id"], "left_semi").select("source_id", "slot_id").distinct()
    return inputs.join(live, ["source_id", "slot_id"], "left_anti").select("source_id", "start", "end")


def rewritten(sources: DataFrame, deletions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """source_id, text after the deletions, and the piece map (out_start, out_end, orig_start, orig_end).

    sources (source_id, text), deletions (source_id, start, end): byte spans on borders of characters; empty spans
    delete nothing. A source of which all goes has an empty text and no piece; null texts stay null.
    """
    gone = spans.coalesced(deletions.where("start < end"), "source_id")
    sized = sources.select("source_id", F.octet_length("text").cast("long").alias("byte_len"))
    pieces = spans.remaining_pieces(sized, gone)
    data = F.encode(F.col("text"), "UTF-8")
    # The pieces of one source are few numbers; its text joins them once and is cut in place.
    lists = pieces.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("orig_start", "orig_end"))).alias("cuts"))
    joined = sources.join(lists, "source_id", "left").withColumn("data", data)
    cut = F.transform(F.coalesce("cuts", F.array().cast("array<struct<orig_start:bigint,orig_end:bigint>>")), lambda c: F.struct(c["orig_start"].alias("start"), F.decode(F.substring(F.col("data"), (c["orig_start"] + 1).cast("int"), (c["orig_end"] - c["orig_start"]).cast("int")), "UTF-8").alias("text")))
    text = F.when(F.col("text").isNotNull(), joined_in_order(cut))
    return joined.select("source_id", text.alias("text")), pieces


def map_gaps(pieces: DataFrame) -> DataFrame:
    """Violations of a piece map: pieces that don't begin where the output of the one before ends, or go back in the original."""
    w = Window.partitionBy("source_id").orderBy("out_start")
    marked = pieces.withColumn("g_out", F.coalesce(F.lag("out_end").over(w), F.lit(0))).withColumn("g_orig", F.coalesce(F.lag("orig_end").over(w), F.lit(0)))
    return marked.where("out_start <> g_out or orig_start < g_orig or out_end - out_start <> orig_end - orig_start").select(*pieces.columns)
