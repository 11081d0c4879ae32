"""Ordered greedy choice: a disjunction asks for its cheapest alternative unless an earlier pick or a kept one serves it.

What a disjunction would pick is fixed in advance; whether it picks depends on the picks of smaller index. A round
decides at once all disjunctions for which no undecided one of smaller index may pick their trigger or one of their
alternatives; each sees only picks of smaller index. Only links to what an undecided one of smaller index may pick
go on to the next round. Disjunctions without a common link don't see each other, so that any set of whole components
of these links may be scanned in order within a task: what is left at all, once that is few rows, or each component of
few rows, once a round settles less than half. Larger components go on in rounds, at most as many as their longest
chain of dependencies. All three ways give the result of the scan in order of the index.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reachflow.operators.closure import _union
from reachflow.operators.components import connected_components
from reachflow.sources.scratch import Rounds, narrow, written

#: A task scans so many links of one component at most; it holds one batch and the items picked so far.
SCAN_ROWS = 1_000_000


def cheapest(choices: DataFrame, rank: list[str]) -> DataFrame:
    """disj, item: the alternative of least rank (columns of rank, then item; nulls first) of each disjunction."""
    turn = F.row_number().over(Window.partitionBy("disj").orderBy(*rank, "item"))
    return choices.withColumn("turn", turn).where("turn = 1").select("disj", "item")


def shared_cheapest(choices: DataFrame, members: DataFrame, offers: DataFrame, rank: list[str]) -> DataFrame:
    """disj, item: cheapest() of the choices and of the lists that disjunctions share: members (disj, list), offers (list, item and rank).

    A list is ranked once, whoever asks for it; nothing has a row for each disjunction and item of its lists.
    """
    turn = F.row_number().over(Window.partitionBy("list").orderBy(*rank, "item"))
    best = offers.select("list", "item", *rank).withColumn("turn", turn).where("turn = 1").drop("turn")
    return cheapest(choices.select("disj", "item", *rank).union(members.join(best, "list").select("disj", "item", *rank)), rank)


def shared_links(choices: DataFrame, members: DataFrame, offers: DataFrame, picks: DataFrame, kept: DataFrame) -> DataFrame:
    """disj, item: the choices, and of shared lists all that a wave can tell apart: what anyone may pick, and one kept item.

    Any kept item serves all that ask for its list, so that the others of the list don't matter then.
    """
    there = offers.join(kept.select("item").distinct(), "item", "left_semi").groupBy("list").agg(F.min("item").alias("item"))
    wanted = offers.join(picks.select("item").distinct(), "item", "left_semi").select("list", "item").distinct().join(there, "list", "left_anti")
    return choices.select("disj", "item").union(members.join(there.union(wanted), "list").select("disj", "item"))


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """disj, pick of those that pick; rows are links in order of disj, and all of a disjunction's follow each other."""
    made, now, pick, woken, served = set(), None, None, False, False
    for batch in batches:
        out = []
        for disj, own, awake, item, is_trigger, there in zip(*(batch[c] for c in ("disj", "pick", "woken", "item", "is_trigger", "there"))):
            if disj != now:
                if woken and not served:
                    made.add(pick)
                    out.append((now, pick))
                now, pick, woken, served = disj, own, awake, False
            if there or item in made:
                woken, served = woken or is_trigger, served or not is_trigger
        yield pd.DataFrame(out, columns=["disj", "pick"])
    yield pd.DataFrame([(now, pick)] if woken and not served else [], columns=["disj", "pick"])


def _scanned(links: DataFrame, waiting: DataFrame, made: DataFrame, by: list[str]) -> DataFrame:
    """disj, pick of those that pick among whole components; each value of by is scanned by one task, and a task may scan several.

    made (item, by): the picks of the last round, which links don't know of yet.
    """
    there = F.coalesce(F.col("by") < F.col("disj"), F.lit(False)).alias("there")
    rows = links.join(waiting, "disj").join(made, "item", "left").select("disj", "pick", "woken", "item", "is_trigger", there, *by)
    dealt = rows.repartition(*by) if by else rows.repartition(1)
    fields = {f.name: f.dataType.simpleString() for f in waiting.schema}
    return dealt.sortWithinPartitions("disj").drop(*by).mapInPandas(_scan, f"disj {fields['disj']}, pick {fields['pick']}")


def wave(disjunctions: DataFrame, choices: DataFrame, picks: DataFrame, kept: DataFrame, scan_rows: int = SCAN_ROWS) -> DataFrame:
    """disj, item: what one scan in ascending disj picks.

    disjunctions (disj, trigger; a null trigger is always there; one row a disj), choices (disj, item), picks (disj,
    item), kept (item). A disjunction whose trigger is only picked at a greater or its own index waits for the next wave.
    """
    asked = written(disjunctions.join(picks.withColumnRenamed("item", "pick"), "disj").select("disj", "trigger", "pick"))
    waiting = asked.select("disj", "pick", F.col("trigger").isNull().alias("woken"))
    triggers = asked.where("trigger is not null").select("disj", F.col("trigger").alias("item"), F.lit(True).alias("is_trigger"))
    links = choices.select("disj", "item", F.lit(False).alias("is_trigger")).join(asked.select("disj"), "disj", "left_semi").union(triggers)
    made = kept.select("item").distinct().withColumn("by", F.lit(-1).cast("long"))
    acted, before, looked = Rounds(), None, None
    while True:
        earlier = waiting.groupBy(F.col("pick").alias("item")).agg(F.min("disj").alias("waits_for"))
        there = F.coalesce(F.col("by") < F.col("disj"), F.lit(False))
        seen = links.join(earlier, "item", "left").join(made, "item", "left")
        seen = seen.select("disj", "item", "is_trigger", there.alias("there"), F.when((F.col("waits_for") < F.col("disj")) & ~there, F.col("waits_for")).alias("waits_for"))
        seen = narrow(seen.where("there or waits_for is not null"))
        state = seen.groupBy("disj").agg(
            F.bool_or(F.col("there") & ~F.col("is_trigger")).alias("served"),
            F.bool_or(F.col("there") & F.col("is_trigger")).alias("called"),
            F.bool_or(F.col("waits_for").isNotNull()).alias("open"),
            F.bool_or(F.col("waits_for").isNotNull() & F.col("is_trigger")).alias("may_wake"),
        )
        served, open_, may_wake = (F.coalesce(c, F.lit(False)) for c in ("served", "open", "may_wake"))
        woken = F.col("woken") | F.coalesce("called", F.lit(False))
        ready = served | ~open_ | (~woken & ~may_wake)
        step = narrow(waiting.join(state, "disj", "left").select("disj", "pick", woken.alias("woken"), ready.alias("ready"), (ready & ~served & woken).alias("acts")))
        fresh = acted.add(step.where("acts").select("disj", "pick"))
        waiting = step.where("not ready").select("disj", "pick", "woken")
        links = narrow(seen.where("waits_for is not null").join(waiting.select("disj"), "disj", "left_semi").select("disj", "item", "is_trigger", "waits_for"))
        made = fresh.groupBy(F.col("pick").alias("item")).agg(F.min("disj").alias("by"))
        left = links.count()
        if left <= scan_rows:
            if left:
                acted.add(_scanned(links, waiting, made, []))
            return acted.every().select("disj", F.col("pick").alias("item"))
        slow, before = before is not None and 2 * left > before, left
        if slow and (looked is None or 2 * left <= looked):
            looked = left
            parts = connected_components(links, "disj", "waits_for").withColumnRenamed("node", "disj")
            linked = narrow(links.join(parts, "disj"))
            few = linked.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") <= scan_rows).select("component")
            small = narrow(linked.join(few, "component", "left_semi"))
            acted.add(_scanned(small, waiting, made, ["component"]))
            waiting = narrow(waiting.join(small.select("disj"), "disj", "left_anti"))
            links = narrow(links.join(small.select("disj"), "disj", "left_anti"))
        links = links.drop("waits_for")


def lanes(disjunctions: DataFrame, choices: DataFrame, picks: DataFrame, present: DataFrame, demanded: DataFrame) -> DataFrame:
    """lane, disj, item: one wave over what is present and one over what is demanded; present and demanded have node.

    Neither sees what the other picks. What the demanded lane picks becomes present, too, but only after both waves.
    """
    out = []
    for name, lane in (("present", present), ("demanded", demanded)):
        out.append(wave(disjunctions, choices, picks, lane.select(F.col("node").alias("item"))).select(F.lit(name).alias("lane"), "disj", "item"))
    return _union(out)


def chosen(disjunctions: DataFrame, choices: DataFrame, rank: list[str], kept: DataFrame) -> DataFrame:
    """wave, disj, item: the picks of all waves, until a wave picks nothing; a pick wakes those with it as trigger."""
    picks, out, number = written(cheapest(choices, rank)), [], 0
    while True:
        now = _union([kept.select("item"), *(o.select("item") for o in out)])
        new = written(wave(disjunctions, choices, picks, now).withColumn("wave", F.lit(number)))
        if new.isEmpty():
            return _union(out).select("wave", "disj", "item") if out else new.select("wave", "disj", "item")
        out.append(new)
        number += 1


def mixed(disjunctions: DataFrame, choices: DataFrame, rank: list[str], units: DataFrame, nodes: DataFrame, shared: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """disj, domain, item: one wave whose choices are units (domain `unit`) or nodes (`node`), which may have equal numbers.

    disjunctions (disj, trigger: a node; those without one are always awake), choices (disj, domain, item and columns of
    rank), units (unit) and nodes (node) that are there. Both kinds share one space of numbers while the wave runs.
    shared: members (disj, list) and offers (list, domain, item and rank), more choices of disjunctions with equal lists.
    """
    coded = written(_coded(choices))
    asks = disjunctions.select("disj", (F.col("trigger") * 2 + 1).alias("trigger"))
    there = units.select((F.col("unit") * 2).alias("item")).union(nodes.select(F.col("node") * 2 + 1))
    links, picks = coded.select("disj", "item"), cheapest(coded, rank)
    if shared:
        members, offers = shared[0], written(_coded(shared[1]))
        picks = written(shared_cheapest(coded, members, offers, rank))
        links = written(shared_links(coded, members, offers, picks, there))
    found = wave(asks, links, picks, there)
    return found.select("disj", F.when(F.col("item") % 2 == 1, "node").otherwise("unit").alias("domain"), F.expr("(item - pmod(item, 2)) div 2").alias("item"))


def _coded(choices: DataFrame) -> DataFrame:
    return choices.withColumn("item", F.col("item") * 2 + (F.col("domain") == "node").cast("int"))
