"""Property graph: edges of facts, the entity registry, expansion and traversal.

Traversals take any number of starts at once. Depth is bounded by a parameter, each step is
one equi-join with the edges, and what was reached before is taken out by an anti-join.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import entity_id, stable_id
from ..sources.storage import kept
from .matching import names_holding


def edges_of_facts(facts: DataFrame, fact: str, user: str, objects: str, day: Column, quantity: Column) -> DataFrame:
    """(src, edge_type, dst): who, what, when and how much of each fact, in one pass over the facts.

    objects is an array column of entity names.
    """
    named = F.transform(F.col(objects), lambda o: F.struct(F.lit("OBJECT_OF").alias("edge_type"), entity_id(o).alias("dst")))
    mentions = F.transform(F.col(objects), lambda o: F.struct(F.lit("MENTIONS").alias("edge_type"), entity_id(o).alias("dst")))
    one = lambda kind, dst: F.struct(F.lit(kind).alias("edge_type"), dst.cast("string").alias("dst"))
    every = F.concat(F.array(one("SUBJECT_OF", entity_id(F.col(user))), one("OCCURRED_DURING", day), one("HAS_QUANTITY", quantity)), named, mentions)
    return facts.select(F.col(fact).alias("src"), F.explode(every).alias("_e")).where(F.col("_e.dst").isNotNull()).select("src", "_e.edge_type", "_e.dst")


@dataclass(frozen=True)
class Confidence:
    # How sure an edge of each kind is.
    evidences: float = 0.98
    roles: float = 0.90
    mentions: float = 0.90
    mention_link: float = 0.91
    occurred: float = 0.86
    quantity: float = 0.86


def _roles(facts: DataFrame) -> DataFrame:
    """facts with _e: (role, entity_id, entity_name) of the roles that have a name; of one entity in one role the last, as its edges have one id."""
    named = F.filter(F.coalesce("roles", F.array()), lambda r: F.coalesce(r["name"] != "", F.lit(False)))
    made = facts.withColumn("_e", F.transform(named, lambda r: F.struct(r["role"].alias("role"), entity_id(r["name"]).alias("entity_id"), r["name"].alias("entity_name"))))
    again = lambda x, i: F.exists(F.slice("_e", i + 2, F.size("_e")), lambda y: (y["entity_id"] == x["entity_id"]) & (y["role"].eqNullSafe(x["role"])))
    return made.withColumn("_e", F.filter("_e", lambda x, i: ~again(x, i)))


def materialise(facts: DataFrame, sure: Confidence = Confidence()) -> DataFrame:
    """(edge_id, user_id, src, edge_type, dst, predicate_raw, predicate, confidence): all edges of each fact, in one pass without a shuffle.

    facts (fact_id, user_id, span_ids, roles array of (role, name), day, quantity_value,
    quantity_unit). A span EVIDENCES the fact; the role "subject" is SUBJECT_OF, others are OBJECT_OF, and both
    are MENTIONS too; OCCURRED_DURING with a day, HAS_QUANTITY with a value or unit. Null and empty names make no
    edges. Edges have ids of what they connect, so writing a fact twice changes nothing.
    """
    text = lambda c: F.coalesce(c.cast("string"), F.lit("None"))

    def edge(kind: str, dst: Column, said: Column, predicate: Column, confidence: float, role: Column | None = None) -> Column:
        # What the id is made of is put together here and hashed after the explode, once an edge.
        parts = dst if role is None else F.concat_ws("|", dst, role)
        return F.struct(F.lit(kind).alias("edge_type"), dst.alias("dst"), said.alias("predicate_raw"), predicate.alias("predicate"), F.lit(confidence).alias("confidence"), parts.alias("parts"))

    def role_edge(e: Column) -> Column:
        ends = (e["entity_id"], F.concat(e["role"], F.lit(": "), e["entity_name"]), e["role"], sure.roles, e["role"])
        return F.when(e["role"] == "subject", edge("SUBJECT_OF", *ends)).otherwise(edge("OBJECT_OF", *ends))

    spans = F.transform(F.array_distinct(F.filter(F.coalesce("span_ids", F.array().cast("array<string>")), lambda s: s.isNotNull())), lambda s: edge("EVIDENCES", s, F.lit("source trace evidences memory unit"), F.lit("evidenced_by_source_trace"), sure.evidences))
    mentions = F.transform("_e", lambda e: edge("MENTIONS", e["entity_id"], F.concat(F.lit("mentions "), e["entity_name"]), F.lit("mentions"), sure.mentions, e["role"]))
    value, unit = F.col("quantity_value"), F.col("quantity_unit")
    some = F.array(
        F.when(F.col("day").isNotNull(), edge("OCCURRED_DURING", F.col("day"), F.lit("fact occurred during date"), F.lit("occurred_during"), sure.occurred)),
        F.when(value.isNotNull() | F.coalesce(unit != "", F.lit(False)), edge("HAS_QUANTITY", F.concat_ws(":", text(value), text(unit)), F.lit("fact has quantity"), F.lit("has_quantity"), sure.quantity)),
    )
    each = _roles(facts).select("user_id", F.col("fact_id").alias("src"), F.explode(F.concat(spans, F.transform("_e", role_edge), mentions, some)).alias("_x")).where("_x IS NOT NULL")
    made = stable_id("fact_edge", F.col("src"), F.col("_x.parts"), F.col("_x.edge_type"))
    return each.select(made.alias("edge_id"), "user_id", "src", "_x.edge_type", "_x.dst", "_x.predicate_raw", "_x.predicate", "_x.confidence")


def mention_rows(facts: DataFrame, sure: Confidence = Confidence()) -> DataFrame:
    """(mention_id, user_id, entity_id, entity_name, span_id, fact_id, role, link_confidence): each role's entity in each of the fact's spans.

    facts as in ``materialise``; a name that a role repeats in another spelling of one entity is written once, as the last one.
    """
    each = _roles(facts).select("user_id", "fact_id", F.explode(F.array_distinct("span_ids")).alias("span_id"), "_e").where("span_id IS NOT NULL")
    rows = each.select("user_id", "fact_id", "span_id", F.explode("_e").alias("_m"))
    made = stable_id("mention", F.col("span_id"), F.col("fact_id"), F.col("_m.role"), F.col("_m.entity_id"))
    return rows.select(made.alias("mention_id"), "user_id", "_m.entity_id", "_m.entity_name", "span_id", "fact_id", "_m.role", F.lit(sure.mention_link).alias("link_confidence"))


def registry(mentions: DataFrame, name: str, kind: str, mention: str, seq: str) -> DataFrame:
    """(entity_id, entity_type, surface_forms, mention_count): forms in first-seen order, the first type that is not 'concept'."""
    seen = mentions.select(entity_id(F.col(name)).alias("entity_id"), F.col(name).alias("_n"), F.col(kind).alias("_k"), F.col(mention).alias("_m"), F.col(seq).alias("_s"))
    forms = seen.groupBy("entity_id", "_n").agg(F.min("_s").alias("_s"))
    forms = forms.groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_s", "_n"))), lambda x: x["_n"]).alias("surface_forms"))
    rest = seen.groupBy("entity_id").agg(F.coalesce(F.min_by(F.when(F.col("_k") != "concept", F.col("_k")), F.when(F.col("_k") != "concept", F.col("_s"))), F.lit("concept")).alias("entity_type"), F.countDistinct("_m").alias("mention_count"))
    return rest.join(forms, "entity_id").select("entity_id", "entity_type", "surface_forms", "mention_count")


def explore(starts: DataFrame, edges: DataFrame, depth: int, types: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """(start, step, src, edge_type, dst): outgoing edges in breadth-first order; a node is expanded once a start.

    With limit, a start stops after the step in which it has so many edges, and keeps the first.
    """
    usable = edges if types is None else edges.where(F.col("edge_type").isin(types))
    front = starts.select("start", F.col("start").alias("node"))
    seen, steps = front, []
    for step in range(1, depth + 1):
        out = front.join(usable, F.col("node") == F.col("src")).select("start", F.lit(step).alias("step"), "src", "edge_type", "dst")
        if step < depth:
            out = kept(out, "explored")
        steps.append(out)
        if step < depth:
            if limit is not None:
                full = reduce(DataFrame.unionByName, steps).groupBy("start").count().where(F.col("count") >= limit).select("start")
                out = out.join(full, "start", "left_anti")
            front = out.select("start", F.col("dst").alias("node")).distinct().join(seen, ["start", "node"], "left_anti")
            seen = seen.union(front)
    found = reduce(DataFrame.unionByName, steps)
    if limit is None:
        return found
    order = Window.partitionBy("start").orderBy("step", "src", "edge_type", "dst")
    return found.select("*", F.row_number().over(order).alias("_r")).where(F.col("_r") <= limit).drop("_r")


def two_hop(heads: DataFrame, members: DataFrame, most: int) -> DataFrame:
    """(head, other, via): units that share an entity with a head, at most so many a head, by entity and unit.

    heads (head), members (unit, entity, degree): entities in more units are asked last. Of an entity no unit after its first
    most besides the head can count, as these all come before it; so heads meet them only, not all the entity's units.
    """
    via = heads.join(members, F.col("head") == F.col("unit")).select("head", "entity", "degree")
    units = members.where(F.col("unit").isNotNull()).select(F.col("unit").alias("other"), "entity").distinct()
    first = Window.partitionBy("entity").orderBy("other")
    units = units.select("entity", "other", F.row_number().over(first).alias("_n")).where(F.col("_n") <= most + 1)
    near = via.join(units, "entity").where(F.col("other") != F.col("head"))
    least = near.groupBy("head", "other").agg(F.min(F.struct("degree", "entity")).alias("_v"))
    order = Window.partitionBy("head").orderBy("_v.degree", "_v.entity", "other")
    return least.select("head", "other", F.col("_v.entity").alias("via"), F.row_number().over(order).alias("rank")).where(F.col("rank") <= most)


def mentions_of(terms: DataFrame, names: DataFrame, most: int) -> DataFrame:
    """(term, unit, name, rank): names that hold a term, per term in the order of confidence, then newest.

    Terms and names meet through grams (``matching.names_holding``); of each term the first most are kept.
    """
    held = names.join(names_holding(terms, names), "name")
    order = Window.partitionBy("term").orderBy(F.desc("confidence"), F.desc("seq"))
    return held.select("term", "unit", "name", F.row_number().over(order).alias("rank")).where(F.col("rank") <= most)


def whole_lineage(facts: DataFrame, edges: DataFrame) -> DataFrame:
    """(fact_id, head, n_steps, cyclic): the fact that each one leads to over all its successors.

    edges (src, dst): src supersedes dst; of several that supersede one the greatest id counts. Paths are doubled in each round, so a chain of n
    facts takes log2(n) rounds. Facts that lead into a circle have its least id as head, and n_steps null.
    """
    after = edges.where(F.col("src") != F.col("dst")).groupBy("dst").agg(F.max("src").alias("to"))
    now = kept(after.select(F.col("dst").alias("id"), "to", F.lit(1).cast("long").alias("n"), F.least("dst", "to").alias("low")), "lineage")
    for _ in range(now.count().bit_length() + 1):
        on = now.select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col("n").alias("_n"), F.col("low").alias("_low"))
        joined = now.join(on, "to", "left")
        far = joined.select("id", F.coalesce("_to", "to").alias("to"), (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"), F.least("low", F.coalesce("_low", F.col("low"))).alias("low"), F.col("_to").isNotNull().alias("_moved"))
        now = kept(far, "lineage")
        if not now.where("_moved").limit(1).count():
            break
        now = now.drop("_moved")
    # What still has a successor after as many doublings as there are facts is in a circle.
    circle = now.select(F.col("id").alias("to"), F.col("low").alias("_low"))
    ends = now.join(circle, "to", "left").select(F.col("id").alias("fact_id"), F.coalesce("_low", "to").alias("head"), F.when(F.col("_low").isNull(), F.col("n")).alias("n_steps"), F.col("_low").isNotNull().alias("cyclic"))
    out = facts.select("fact_id").join(ends, "fact_id", "left")
    return out.select("fact_id", F.coalesce("head", "fact_id").alias("head"), F.when(F.col("head").isNull(), F.lit(0)).otherwise(F.col("n_steps")).cast("long").alias("n_steps"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"))
