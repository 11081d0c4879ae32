"""The least set of facts closed under rules, as one network of arcs and counted gates that only new facts drive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachflow.sources.scratch import Rounds, keyed, narrow, written

#: Rules of one fact that a task may read; a fact with more is dealt to parts.
SPLIT = 65_536


class Network:
    """arcs (fact, head): the head holds once the fact does. gates (gate, head, fact): a gate's one head, once all its facts hold.

    Facts are strings; arcs with a null are left out, a gate with a null fact never opens, repeated rows count once.
    implied gives more facts that hold with new ones (column fact). Each pair of a fact and a rule is visited once, in the
    round behind the fact's, however often add() is called: a gate keeps the count of its facts seen, and leaves the table of
    counts once it opens. A fact of many rules leads to numbered parts of itself, each with a share of them.
    """

    def __init__(self, arcs: DataFrame, gates: DataFrame, implied: Callable[[DataFrame], DataFrame] | None = None, split: int = SPLIT):
        arcs = written(arcs.select("fact", "head").where("fact is not null and head is not null").distinct())
        body = gates.where("gate is not null and head is not null").select("gate", "head", F.coalesce("fact", F.lit("?")).alias("fact")).distinct()
        need = body.groupBy("gate").agg(F.count("*").alias("need"))
        body = written(body.join(need, "gate"))
        counts = arcs.select("fact").union(body.select("fact")).groupBy("fact").agg(F.count("*").alias("n"))
        large = written(counts.where(F.col("n") > split).select("fact", F.expr(f"n div {split} + 1").alias("parts")))
        if not large.isEmpty():
            part = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
            to_parts = large.select("fact", part.alias("part")).select("fact", F.concat(F.lit("#"), "part", F.lit("|"), "fact").alias("head"))
            arcs = self._dealt(arcs, large, "head").unionByName(to_parts)
            body = self._dealt(body, large, "gate")
        self.arcs, self.body = keyed(arcs, "fact"), keyed(body, "fact")
        self.has_gates = not self.body.isEmpty()
        self.counts: DataFrame | None = None
        self.implied, self.known = implied, Rounds()

    @staticmethod
    def _dealt(rows: DataFrame, large: DataFrame, by: str) -> DataFrame:
        part = F.concat(F.lit("#"), F.pmod(F.xxhash64(by), F.col("parts")), F.lit("|"), "fact")
        return rows.join(large, "fact", "left").withColumn("fact", F.coalesce(part, "fact")).drop("parts")

    def _new(self, facts: DataFrame) -> DataFrame:
        facts = facts.select("fact").where("fact is not null")
        if self.implied:
            facts = facts.union(self.implied(facts))
        facts = facts.distinct()
        return self.known.add(facts.join(self.every(), "fact", "left_anti") if self.known.paths else facts)

    def add(self, facts: DataFrame) -> None:
        """Takes in facts (fact) and all that follows."""
        fresh = self._new(facts)
        while not fresh.isEmpty():
            heads = self.arcs.join(fresh, "fact", "left_semi").select(F.col("head").alias("fact"))
            if self.has_gates:
                hits = self.body.join(fresh, "fact", "left_semi").select("gate", "head", "need", F.lit(1).cast("long").alias("n"))
                if self.counts is not None:
                    hits = hits.union(self.counts)
                counted = narrow(hits.groupBy("gate").agg(F.min("head").alias("head"), F.min("need").alias("need"), F.sum("n").alias("n")))
                heads = heads.union(counted.where("n = need").select("head"))
                self.counts = counted.where("n < need").select("gate", "head", "need", "n")
            fresh = self._new(heads)

    def every(self) -> DataFrame:
        """fact: all that hold."""
        return self.known.every()
