"""A facade over the operators: one object for all users, every method a DataFrame.

tables are DataFrames by name: turns (user_id, session_id, turn_id, idx, role, content,
timestamp) and, where facts have been extracted, facts (fact_id, user_id, predicate, object,
valid_from, seq, support). Queries are DataFrames too: (query_id, user_id, text).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions.runs import Limits
from .functions.text import entity_id
from .operators import context, facts, filters, fusion, graph, ingest, lexical, refining
from .operators.index import Index
from .sources.storage import Store


class MemoryFrame:
    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame], weights: fusion.Weights = fusion.Weights(), index: Index | None = None):
        """index: a stored index of the turns by user, which ``search`` reads and ``ingest`` adds to; without one it is made at each search."""
        self.spark, self.tables, self.weights, self.index = spark, dict(tables), weights, index

    @classmethod
    def open(cls, spark: SparkSession, root: str, snapshot: int, versions: Mapping[str, str] | None = None) -> MemoryFrame:
        """The tables of a store's snapshot; refuses a store of other versions."""
        store = Store(spark, root, versions)
        store.check()
        return cls(spark, {name: store.read(name, snapshot) for name in ("turns", "facts")})

    def ingest(self, turns: DataFrame) -> MemoryFrame:
        """A new frame with turns added; a turn that is there already is taken as sent again."""
        old = self.tables["turns"]
        new = turns.join(old.select("turn_id"), "turn_id", "left_anti").select(old.columns)
        if self.index:
            self.index.append(new, "user_id", "turn_id", "content")
        return MemoryFrame(self.spark, self.tables | {"turns": old.unionByName(new)}, self.weights, self.index)

    def windows(self, most_tokens: int = 1200, most_turns: int = 12) -> DataFrame:
        return ingest.extract_windows(self.tables["turns"], Limits(most_tokens, most_turns))

    def search(self, queries: DataFrame, limit: int = 10, route: str = "fusion", scope: Mapping[str, str] | None = None, scopes: DataFrame | None = None) -> DataFrame:
        """(query_id, user_id, unit, rank, score): the best turns and facts of each query's user."""
        asked = queries.select("query_id", F.col("user_id").alias("corpus"), "text")
        turns = self.tables["turns"]
        hits = {"turn": self.index.score(asked, 80) if self.index else lexical.score(lexical.build(turns, "user_id", "turn_id", "content"), asked, 80)}
        if "facts" in self.tables:
            held = self.tables["facts"].withColumn("_text", F.concat_ws(" | ", "predicate", "object", "support"))
            hits["fact"] = lexical.score(lexical.build(held, "user_id", "fact_id", "_text"), asked, 80)
        if route == "fusion":
            weight = {"turn": self.weights.weak_direct, "fact": self.weights.strong_direct}
            found = fusion.fuse([fusion.channel(h, name, weight[name], k, self.weights.heads) for k, (name, h) in enumerate(hits.items())]).withColumnRenamed("confidence", "score")
        elif route == "wide":
            routes = None
            for name, h in hits.items():
                part = h.select("query_id", F.col("unit").cast("string").alias("unit"), F.lit(name).alias("route"), "rank", "score")
                routes = part if routes is None else routes.unionByName(part)
            found = filters.page(fusion.reciprocal(routes), ["query_id"], [F.desc("score"), F.col("unit")], 0, limit).withColumnRenamed("position", "rank")
        else:
            raise ValueError(f"no such route: {route!r}")
        kept = found.where(F.col("rank") <= limit).join(queries.select("query_id", "user_id"), "query_id").select("query_id", "user_id", "unit", "rank", "score")
        if scope and scopes is not None:  # after the limit, so it can only shorten the list
            sessions = turns.select(F.col("turn_id").alias("unit"), "session_id")
            kept = filters.narrow(kept.join(sessions, "unit", "left"), scopes, scope).drop("session_id")
        return kept

    def _cards(self) -> DataFrame:
        """(unit, user_id, at) and the columns of a card: of facts and of turns."""
        turns = self.tables["turns"].select(F.col("turn_id").alias("unit"), "user_id", F.col("timestamp").alias("at"), "session_id", "role", "content", F.lit("turn").alias("kind"), F.timestamp_seconds("timestamp").cast("timestamp_ntz").cast("string").alias("created"))
        out = refining.cards(turns)
        if "facts" in self.tables:
            held = self.tables["facts"].withColumns({"unit": F.col("fact_id"), "at": F.col("valid_from") / 1e6, "valid_from": F.timestamp_micros("valid_from").cast("timestamp_ntz").cast("string")})
            given = {"kind": F.lit("fact"), "content": F.concat_ws(" ", "predicate", "object", "support"), "predicate_raw": F.col("predicate"), "roles": F.array(F.struct(F.lit("object").alias("role"), F.col("object").alias("name")))}
            held = held.withColumns({c: v for c, v in given.items() if c not in held.columns})
            out = out.unionByName(refining.cards(held).select(*out.columns))
        return out

    def refine(self, queries: DataFrame, wanted: refining.CardFilter, limit: int = 10, offset: int = 0) -> DataFrame:
        """(query_id, user_id, unit, rank, score, position, total): a page of a wide search, of which only what is wanted stays."""
        found = self.search(queries, max(limit * 10 + offset, 120), "wide").join(self._cards(), ["user_id", "unit"])
        kept = refining.refine_cards(found, wanted).select("query_id", "user_id", "unit", "rank", "score")
        return filters.page(kept, ["query_id"], [F.col("rank")], offset, limit)

    def result(self, asked: DataFrame) -> DataFrame:
        """(id, kind, row as JSON) of what ids (user_id, id) stand for, with or without the prefix of an evidence id, within their user's rows.

        kind is fact, turn or not_found.
        """
        named = asked.withColumn("id", F.concat_ws("\x1f", "user_id", filters.strip_evidence_prefix(F.trim("id"))))
        own = lambda name, key: self.tables[name].withColumn("_key", F.concat_ws("\x1f", "user_id", key))
        tables = [("fact", own("facts", "fact_id"), "_key")] if "facts" in self.tables else []
        found = filters.lookup("id", [*tables, ("turn", own("turns", "turn_id"), "_key")], named.select("id").distinct())
        parts = F.split("id", "\x1f")
        return found.select(parts[0].alias("user_id"), parts[1].alias("id"), "kind", "row")

    def session(self, asked: DataFrame) -> DataFrame:
        """(user_id, session_id, position, turn_id, role, content): all turns of sessions (user_id, session_id) in their order."""
        turns = self.tables["turns"].join(asked.select("user_id", "session_id").distinct(), ["user_id", "session_id"])
        order = Window.partitionBy("user_id", "session_id").orderBy("idx", "turn_id")
        return turns.select("user_id", "session_id", F.row_number().over(order).alias("position"), "turn_id", "role", "content")

    def event_timeline(self, phrases: DataFrame, limit: int = 5, low: float | None = None, high: float | None = None) -> DataFrame:
        """(query_id, user_id, event, unit, at, rank, position): the best evidence of each phrase (query_id, user_id, event), and its place in time.

        low and high limit the time in seconds; what has none stays, and comes last.
        """
        one = F.concat_ws("\x1f", "query_id", "event")
        found = self.search(phrases.select(one.alias("query_id"), "user_id", F.col("event").alias("text")).distinct(), limit)
        named = phrases.select(one.alias("_q"), "query_id", "event").distinct()
        each = found.withColumnRenamed("query_id", "_q").join(named, "_q").join(self._cards().select("user_id", "unit", "at"), ["user_id", "unit"])
        order = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("at"), "rank", "event", "unit")
        return filters.window(each, "at", low, high).select("query_id", "user_id", "event", "unit", "at", "rank", F.row_number().over(order).alias("position"))

    def evidence_count(self, queries: DataFrame, limit: int = 20, low: float | None = None, high: float | None = None) -> DataFrame:
        """(query_id, unit, labels, day, position): what speaks for the labels of queries (query_id, user_id, text, labels array), each unit once with all its labels.

        Labels of a query may mean the same, so their hits are united, not added up.
        """
        each = queries.select("query_id", "user_id", "text", F.posexplode("labels").alias("_pos", "label"))
        one = F.concat_ws("\x1f", "query_id", F.lpad(F.col("_pos").cast("string"), 9, "0"))
        found = self.search(each.select(one.alias("query_id"), "user_id", F.trim(F.concat_ws(" ", "text", "label")).alias("text")), limit)
        hits = found.withColumnRenamed("query_id", "_q").join(each.select(one.alias("_q"), "query_id", "label", "_pos"), "_q").join(self._cards().select("user_id", "unit", "at"), ["user_id", "unit"])
        seen = hits.withColumns({"day": F.timestamp_seconds("at").cast("timestamp_ntz").cast("date").cast("string"), "_seen": F.col("_pos").cast("long") * 1_000_000 + F.col("rank")})
        return context.roster(filters.window(seen, "at", low, high), "unit", "label", "day", "_seen", ["query_id"])

    def build_context(self, queries: DataFrame, tokens: int, limit: int = 24) -> DataFrame:
        """(query_id, position, line, unit): what fits a reader's budget, best first."""
        texts = self.tables["turns"].select(F.col("turn_id").alias("unit"), F.concat_ws(": ", "role", "content").alias("line"))
        if "facts" in self.tables:
            texts = texts.unionByName(self.tables["facts"].select(F.col("fact_id").alias("unit"), F.concat_ws(" ", "predicate", "object").alias("line")))
        rows = self.search(queries, limit).join(texts, "unit")
        return context.budget(rows, ["query_id"], [F.col("rank")], F.col("line"), tokens).select("query_id", "position", "line", "unit")

    def current(self, at: Column) -> DataFrame:
        """The version of each (user, predicate) slot that holds at a time."""
        return facts.as_of(self.tables["facts"], at, ("user_id", "predicate"), ("valid_from", "seq"))

    def timeline(self, entity: str) -> DataFrame:
        """(fact_id, predicate, valid_from): facts about an entity in the order of their time, undated first."""
        named = self.tables["facts"].where(entity_id(F.col("object")) == entity_id(F.lit(entity)))
        return named.select("user_id", "fact_id", "predicate", "valid_from").orderBy(F.coalesce("valid_from", F.lit(0)), "seq")

    def explore(self, starts: DataFrame, depth: int = 2, types: list[str] | None = None, limit: int = 25) -> DataFrame:
        if not 1 <= depth <= 3:
            raise ValueError("the depth is 1 to 3")
        edges = graph.edges_of_facts(self.tables["facts"].withColumn("_o", F.array("object")), "fact_id", "user_id", "_o", F.date_format(F.timestamp_micros("valid_from"), "yyyy-MM-dd"), F.lit(None).cast("string"))
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.concat(F.lit("OF_"), "edge_type").alias("edge_type"), F.col("src").alias("dst")))
        return graph.explore(starts, both, depth, types, limit)

    def dream(self, batch: int = 50, order: str = "staleness") -> DataFrame:
        """(user_id, entity_id, text, n_rows): profiles of the next stale entities of each user."""
        named = self.tables["facts"].withColumn("entity_id", entity_id(F.col("object")))
        due = ingest.drain(ingest.stale_entities(named), batch, order).select("user_id", "entity_id")
        return context.ordered_text(named.join(due, ["user_id", "entity_id"]), ["user_id", "entity_id"], ["valid_from", "fact_id"], F.concat_ws(" ", "predicate", "object"), " | ", most_chars=1800)
