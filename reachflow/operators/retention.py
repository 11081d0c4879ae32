"""What must be kept of a graph of nodes and source units: rules of two lanes and ordered choices, to a common fixed point.

Presence (compile lane) holds all that demand (actual lane) holds; keeping a unit makes its definition present, not
of choices is made, of units first, then of mixed carriers, then of nodes in both lanes, which may set it going again.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reachflow.operators.choice import cheapest, lanes, shared_cheapest, shared_links, wave
from reachflow.operators.closure import component_facts, strong_components
from reachflow.operators.network import Network
from reachflow.sources.scratch import written

#: The relations of facts and their columns; all ids are bigints, except that edges and sites may have any type.
SCHEMAS = {
    "roots": "node long",
    "edges": "edge long, src long, dst long",
    "sites": "edge long, site string, owner long",
    "binding": "node long, unit long",
    "selected": "node long, unit long",
    "opaque": "node long",
    "delegated": "node long",
    "single": "trigger long, required long",
    "double": "left_unit long, right_unit long, required long",
    "groups": "unit long, group_id long",
    "members": "trigger long, required long",
    "members2": "left_node long, right_node long, required long",
    "parents": "node long, parent long",
    "gates": "node long, unit long",
    "classes": "node long, class long",
    "set_units": "set_id long, unit long",
    "set_parents": "set_id long, parent_set_id long",
    "triggers": "node long, mgroup long",
    "mgroup_roots": "mgroup long, set_id long",
    "mgroup_products": "mgroup long, node long",
    "mgroup_owners": "mgroup long, owner long, member long",
    "producers": "mgroup long, producer long, intrinsic boolean",
    "meanings": "producer long, child long",
    "mgroup_children": "mgroup long, child long",
    "demand_triggers": "node long, producer long",
    "clauses": "clause long, producer long, mgroup long, opaque boolean",
    "clause_carriers": "clause long, node long",
    "clause_required": "clause long, child long",
    "clause_children": "clause long, child long",
    "disjunctions": "disj long, trigger long",
    "choices": "disj long, item long, cost long",
    "choice_lists": "disj long, list long",
    "list_offers": "list long, item long, cost long",
    "carrier_disjunctions": "disj long, trigger long",
    "carrier_choices": "disj long, domain string, item long, cost long",
    "member_disjunctions": "disj long, trigger long",
    "member_choices": "disj long, item long, cost long",
}


@dataclass
class Facts:
    """The relations of SCHEMAS.

    binding ties a definition and its one unit, both ways; selected leads from an expansion to the rule that it chose.
    An opaque node keeps all units of groups. Edges to delegated nodes don't count. gates and parents decide which
    expansions survive. A macro group is asked for by triggers, keeps the units of its root sets and their parents,
    and gives its products once those sets are complete. A group's producer means something once the group is complete
    and has output of its own (intrinsic), was triggered, or has a child that means something; so does a producer with
    such a child (meanings). A trigger that is such a producer or child itself only counts once it means something.
    A clause holds once a carrier is demanded and it has required children, or is opaque, or one of its other children
    is demanded as a producer or a required child; it demands its required children and its producer, or asks for its
    group. demand_triggers lead from demanded nodes to producers. Choices are between units, carriers (`unit` or
    `node`) and nodes; the columns of rank order them. Units that many disjunctions have as choices may stand once in a
    list (list_offers) that these disjunctions name (choice_lists).
    """

    roots: DataFrame
    edges: DataFrame
    sites: DataFrame
    binding: DataFrame
    selected: DataFrame
    opaque: DataFrame
    delegated: DataFrame
    single: DataFrame
    double: DataFrame
    groups: DataFrame
    members: DataFrame
    members2: DataFrame
    parents: DataFrame
    gates: DataFrame
    classes: DataFrame
    set_units: DataFrame
    set_parents: DataFrame
    triggers: DataFrame
    mgroup_roots: DataFrame
    mgroup_products: DataFrame
    mgroup_owners: DataFrame
    producers: DataFrame
    meanings: DataFrame
    mgroup_children: DataFrame
    demand_triggers: DataFrame
    clauses: DataFrame
    clause_carriers: DataFrame
    clause_required: DataFrame
    clause_children: DataFrame
    disjunctions: DataFrame
    choices: DataFrame
    choice_lists: DataFrame
    list_offers: DataFrame
    carrier_disjunctions: DataFrame
    carrier_choices: DataFrame
    member_disjunctions: DataFrame
    member_choices: DataFrame
    rank: list[str]

    @classmethod
    def of(cls, spark: SparkSession, rank: list[str], **known: DataFrame) -> Facts:
        """Facts of the relations that are known; the others are empty in a way that Spark sees, so that their rules drop out of plans."""
        names = [f.name for f in fields(cls) if f.name != "rank"]
        return cls(rank=rank, **{n: known[n] if n in known else spark.createDataFrame([], SCHEMAS[n]).where(F.lit(False)) for n in names})


@dataclass
class Kept:
    """present (node), demanded (node), units (unit), picks (kind, item; `present` for what that lane picks alone)."""

    present: DataFrame
    demanded: DataFrame
    units: DataFrame
    picks: DataFrame


def _fact(kind: str, *columns: str) -> Column:
    """A fact of columns; P, D and K with a number are a present or demanded node and a kept unit, other kinds are within the network."""
    return F.concat(F.lit(kind), F.concat_ws("|", *[F.col(c).cast("string") for c in columns])) if len(columns) > 1 else F.concat(F.lit(kind), F.col(columns[0]).cast("string"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _reached(facts: Facts) -> DataFrame:
    """reached: every node that a root, an edge, another rule or a choice may make present; edges from others never count."""
    heads = [facts.roots.select("node"), facts.edges.where("src is not null").select("dst"), facts.binding.select("node"), facts.members.select("required"), facts.members2.select("required"), facts.classes.select("node"), facts.mgroup_products.select("node"), facts.mgroup_owners.select("member")]
    heads += [facts.clause_required.select("child"), facts.clauses.select("producer"), facts.demand_triggers.select("producer"), facts.carrier_choices.where("domain = 'node'").select("item"), facts.member_choices.select("item")]
    return _union(heads).toDF("reached").where("reached is not null").distinct()


def _rules(facts: Facts) -> tuple[DataFrame, DataFrame, DataFrame]:
    arcs: list[DataFrame] = []
    gates: list[DataFrame] = []
    seeds = [facts.roots.select(_fact("D", "node").alias("fact"))]  # 1; what is demanded is present (2)

    def arc(rows: DataFrame, fact: Column, head: Column) -> None:
        arcs.append(rows.select(fact.alias("fact"), head.alias("head")))

    def gate(rows: DataFrame, name: Column, *body: Column, head: Column | None = None) -> None:
        rows = rows.where(name.isNotNull())
        gates.extend(rows.select(name.alias("gate"), (name if head is None else head).alias("head"), b.alias("fact")) for b in body)

    arc(facts.binding, _fact("P", "node"), _fact("K", "unit"))  # 3
    arc(facts.binding, _fact("K", "unit"), _fact("P", "node"))  # 4
    arc(facts.selected, _fact("P", "node"), _fact("K", "unit"))  # 5
    arc(facts.opaque, _fact("P", "node"), F.lit("all"))  # 6
    arc(facts.groups, F.lit("all"), _fact("K", "unit"))
    arc(facts.groups, _fact("K", "unit"), _fact("group", "group_id"))  # 7
    arc(facts.groups, _fact("group", "group_id"), _fact("K", "unit"))
    arc(facts.single, _fact("K", "trigger"), _fact("K", "required"))  # 8
    pairs = facts.double.where("left_unit is not null and right_unit is not null")
    gate(pairs, _fact("units", "left_unit", "right_unit", "required"), _fact("K", "left_unit"), _fact("K", "right_unit"), head=_fact("K", "required"))

    key = F.when(F.col("edge").isNotNull(), F.to_json(F.struct("edge")))  # 9-12
    sites = facts.sites.select(key.alias("key"), F.to_json(F.struct("site")).alias("site"), "owner")
    gate(sites, _fact("site", "key", "site"), _fact("K", "owner"), head=_fact("open", "key"))
    edges = facts.edges.where("src is not null and dst is not null").join(facts.delegated.select(F.col("node").alias("dst")), "dst", "left_anti")
    edges = edges.join(_reached(facts), F.col("src") == F.col("reached"), "left_semi")
    edges = edges.select(key.alias("key"), "src", "dst").join(sites.select("key", F.lit(True).alias("sited")).distinct(), "key", "left")
    ends = facts.gates.select("node").union(facts.parents.select("node")).where("node is not null").distinct()
    up = facts.parents.select(F.col("node").alias("src"), F.col("parent").alias("dst")).where("src is not null and dst is not null")
    components = written(strong_components(up, ends))
    shut, above = component_facts(components, up, facts.gates)
    gate(shut, _fact("alive", "component"), _fact("K", "unit"))
    gate(above, _fact("alive", "component"), _fact("alive", "parent"))
    free = components.select("component").distinct().join(shut.select("component").union(above.select("component")), "component", "left_anti")
    seeds.append(free.select(_fact("alive", "component")))
    edges = written(edges.join(components.join(ends, "node", "left_semi").select(F.col("node").alias("dst"), "component"), "dst", "left").select("key", "src", "dst", "sited", "component"))
    for lane in "PD":
        src, dst, name = _fact(lane, "src"), _fact(lane, "dst"), _fact(f"edge{lane}", "key", "src", "dst")
        arc(edges.where("sited is null and component is null"), src, dst)
        held = edges.where("sited is not null or component is not null")
        gate(held, name, src, head=dst)
        gate(held.where("sited is not null"), name, _fact("open", "key"), head=dst)
        gate(held.where("component is not null"), name, _fact("alive", "component"), head=dst)
        arc(facts.members, _fact(lane, "trigger"), _fact(lane, "required"))  # 13
        two = facts.members2.where("left_node is not null and right_node is not null")
        gate(two, _fact(f"nodes{lane}", "left_node", "right_node", "required"), _fact(lane, "left_node"), _fact(lane, "right_node"), head=_fact(lane, "required"))
    arc(facts.classes, _fact("D", "node"), _fact("class", "class"))  # 14
    arc(facts.classes, _fact("class", "class"), _fact("D", "node"))

    known = facts.producers.select(F.col("producer").alias("node")).union(facts.meanings.select("producer")).union(facts.meanings.select("child")).where("node is not null").distinct()
    arc(facts.triggers.join(known, "node", "left_anti"), _fact("P", "node"), _fact("triggered", "mgroup"))  # 15
    meant = facts.triggers.join(known, "node", "left_semi")
    gate(meant.select("node").distinct(), _fact("trigger", "node"), _fact("P", "node"), _fact("meant", "node"))
    arc(meant, _fact("trigger", "node"), _fact("triggered", "mgroup"))
    groups = facts.mgroup_roots.select("mgroup").distinct()
    arc(facts.triggers, _fact("triggered", "mgroup"), _fact("asked", "mgroup"))
    arc(facts.mgroup_roots, _fact("asked", "mgroup"), _fact("wanted", "set_id"))  # 16
    arc(facts.set_parents, _fact("wanted", "set_id"), _fact("wanted", "parent_set_id"))
    arc(facts.set_units, _fact("wanted", "set_id"), _fact("K", "unit"))
    gate(facts.set_units, _fact("set", "set_id"), _fact("K", "unit"))  # 17
    gate(facts.set_parents, _fact("set", "set_id"), _fact("set", "parent_set_id"))
    lower = facts.set_units.select("set_id").union(facts.set_parents.select("set_id"))
    seeds.append(facts.set_parents.select(F.col("parent_set_id").alias("set_id")).distinct().join(lower, "set_id", "left_anti").select(_fact("set", "set_id")))
    gate(facts.mgroup_roots, _fact("made", "mgroup"), _fact("set", "set_id"))
    arc(facts.mgroup_products, _fact("made", "mgroup"), _fact("P", "node"))  # 18
    owners = facts.mgroup_owners.join(groups, "mgroup", "left_semi").where("owner is not null")
    gate(owners.select("mgroup", "owner").distinct(), _fact("owner", "mgroup", "owner"), _fact("made", "mgroup"), _fact("P", "owner"))
    arc(owners, _fact("owner", "mgroup", "owner"), _fact("P", "member"))
    arc(facts.producers.where("intrinsic"), _fact("made", "mgroup"), _fact("meant", "producer"))  # 19
    arc(facts.triggers, _fact("triggered", "mgroup"), _fact("leads", "mgroup"))
    arc(facts.mgroup_children, _fact("meant", "child"), _fact("leads", "mgroup"))
    led = facts.producers.where("producer is not null and mgroup is not null")
    gate(led, _fact("means", "mgroup", "producer"), _fact("made", "mgroup"), _fact("leads", "mgroup"), head=_fact("meant", "producer"))
    arc(facts.meanings, _fact("meant", "child"), _fact("meant", "producer"))
    arc(facts.clause_carriers, _fact("D", "node"), _fact("carried", "clause"))  # 20
    sure = facts.clauses.where("opaque").select("clause").union(facts.clause_required.where("child is not null").select("clause")).distinct()
    arc(sure, _fact("carried", "clause"), _fact("clause", "clause"))
    arc(facts.clause_children, _fact("asks", "child"), _fact("child", "clause"))
    gate(facts.clauses.select("clause").distinct(), _fact("fires", "clause"), _fact("carried", "clause"), _fact("child", "clause"), head=_fact("clause", "clause"))
    arc(facts.clause_required, _fact("clause", "clause"), _fact("asks", "child"))
    arc(facts.clauses, _fact("clause", "clause"), _fact("asks", "producer"))
    arc(facts.clauses, _fact("clause", "clause"), _fact("asked", "mgroup"))
    arc(facts.demand_triggers, _fact("D", "node"), _fact("asks", "producer"))  # 21
    asked = facts.clause_required.select("child").union(facts.clauses.select("producer")).union(facts.demand_triggers.select("producer")).distinct()
    arc(asked, _fact("asks", "child"), _fact("D", "child"))
    return _union(arcs), _union(gates), _union(seeds)


def _present(facts: DataFrame) -> DataFrame:
    return facts.where("fact like 'D%'").select(F.concat(F.lit("P"), F.substr("fact", F.lit(2))).alias("fact"))


def _coded(rows: DataFrame) -> DataFrame:
    """Carrier choices with units and nodes in one space of numbers."""
    return rows.withColumn("item", F.col("item") * 2 + (F.col("domain") == "node").cast("int"))


def retained(facts: Facts) -> Kept:
    """The least sets that hold the roots and satisfy all rules, with the choices made in order.

    The network keeps its state between waves, so that each fact sets off each of its rules once in all.
    """
    picks = written(shared_cheapest(facts.choices, facts.choice_lists, facts.list_offers, facts.rank))
    carriers = written(_coded(facts.carrier_choices))
    carrier_picks, member_picks = written(cheapest(carriers, facts.rank)), written(cheapest(facts.member_choices, facts.rank))
    carrier_asks = facts.carrier_disjunctions.withColumn("trigger", F.col("trigger") * 2 + 1)
    made: list[DataFrame] = []
    arcs, gates, new_facts = _rules(facts)
    network = Network(arcs, gates, _present)
    while True:
        network.add(new_facts)
        every = network.every()
        present, demanded, units = (every.where(F.col("fact").startswith(k)).select(F.substr("fact", F.lit(2)).cast("long").alias(c)) for k, c in (("P", "node"), ("D", "node"), ("K", "unit")))
        kept = units.withColumnRenamed("unit", "item")
        links = written(shared_links(facts.choices, facts.choice_lists, facts.list_offers, picks, kept))
        of_units = written(wave(facts.disjunctions, links, picks, kept))
        there = units.union(of_units.select("item")).distinct().select((F.col("unit") * 2).alias("item")).union(present.select(F.col("node") * 2 + 1))
        mixed = written(wave(carrier_asks, carriers.select("disj", "item"), carrier_picks, there))
        nodes = mixed.where("item % 2 = 1").select(F.expr("item div 2").alias("node"))
        members = written(lanes(facts.member_disjunctions, facts.member_choices.select("disj", "item"), member_picks, present.union(nodes), demanded))
        both = [members.where("lane = 'demanded'")]
        both.append(members.where("lane = 'present'").join(both[0].select("item"), "item", "left_anti"))
        new = written(_union([of_units.select(F.lit("unit").alias("kind"), "item"), mixed.select(F.lit("carrier"), "item"), both[0].select(F.lit("demanded"), "item"), both[1].select(F.lit("present"), "item")]))
        if new.isEmpty():
            return Kept(present, demanded, units, _union(made or [new]))
        made.append(new)
        kind = F.when(F.col("kind") == "demanded", "D").when((F.col("kind") == "unit") | ((F.col("kind") == "carrier") & (F.col("item") % 2 == 0)), "K").otherwise("P")
        number = F.when(F.col("kind") == "carrier", F.expr("item div 2")).otherwise(F.col("item"))
        new_facts = new.select(F.concat(kind, number.cast("string")).alias("fact"))
