import pytest
from pyspark.sql import functions as F

from factloom.functions import text as tx
from factloom.operators import context, evidence, facts, filters, fusion, graph, ingest, items, lexical, maintenance, ops, vectors
from factloom.sources.storage import Store, VersionMismatch


def values(df):
    return [tuple(r) for r in df.collect()]


def test_search_tokens_stem_and_split(spark):
    row = spark.createDataFrame([("State-of-a cities' buses cats 你好吗",)], "t string").select(tx.search_tokens(F.col("t"))).first()[0]
    assert sorted(row) == sorted(["state-of-a", "state", "of", "cities'", "buses", "bus", "cats", "cat", "你", "好", "吗", "你好", "好吗"])


def test_ids(spark):
    row = spark.createDataFrame([("  The  Ünit 7!", None)], "a string, b string").select(tx.entity_id(F.col("a")), tx.entity_id(F.col("b")), tx.entity_id(F.lit("中文")), tx.entity_id(F.lit("中文"), unicode=True), tx.canonical(F.col("a"))).first()
    assert tuple(row) == ("entity_the_nit_7", "entity_unknown", "entity_unknown", "entity_中文", "the ünit 7!")


def test_noisy_or_grows_with_each_head(spark):
    hits = spark.createDataFrame([("q", "a", "h1", 0.4, 1), ("q", "a", "h2", 0.2, 2), ("q", "a", "h2", 0.1, 3), ("q", "b", "h1", 0.4, 4)], "query_id string, unit string, head string, contribution double, ordinal long")
    assert [(u, round(c, 6), n) for _, u, c, n, *_ in values(fusion.fuse([hits]).orderBy("rank"))] == [("a", 0.52, 2), ("b", 0.4, 1)]


def test_date_prefixes_and_boost(spark):
    df = spark.createDataFrame([("May 2023 or 2022-03-04",), ("in 2021",), ("never",)], "q string").select(fusion.date_prefixes(F.col("q")).alias("p"))
    assert [r[0] for r in df.collect()] == [["2022-03-04", "2023-05"], ["2021"], []]
    seen = df.select(fusion.temporal_boost(F.col("p"), F.lit(1640995200.0), 0.3), fusion.temporal_boost(F.col("p"), F.lit(1640995200.0), 0.3, exact=True))
    assert values(seen) == [(0.3, 0.0), (0.0, 0.0), (0.0, 0.0)]


def test_upsert_keeps_first_creation_and_takes_the_last_row(spark):
    old = spark.createDataFrame([("a", 1, 10, 1), ("b", 2, 11, 2)], "k string, v int, created int, seq int")
    new = spark.createDataFrame([("a", 5, 99, 3), ("a", 6, 98, 4), ("c", 7, 97, 5)], "k string, v int, created int, seq int")
    assert sorted((k, v, c) for k, v, c, _ in values(facts.upsert(old, new, ["k"], keep=["created"]).select("k", "v", "created", "seq"))) == [("a", 6, 10), ("b", 2, 11), ("c", 7, 97)]


FACT = "user_id string, fact_id string, seq int, predicate string, event_type string, kind string, unit string, roles array<string>, valid_from double, document_time double, quantity double, low double, high double, role string, update_like boolean"


def fold(spark, rows):
    full = [("u", i, k, "p", "other", "state", "", roles, start, float(k), q, low, high, role, upd) for k, (i, roles, start, q, low, high, role, upd) in enumerate(rows)]
    return {r["fact_id"]: (r["status"], r["superseded_by"]) for r in maintenance.fold(spark.createDataFrame(full, FACT)).collect()}


def test_fold_rules(spark):
    newer = fold(spark, [("a", [], 1000.0, None, None, None, "user", True), ("b", [], 2000.0, None, None, None, "user", True)])
    assert newer == {"a": ("superseded", "b"), "b": ("active", None)}
    late = fold(spark, [("b", [], 2000.0, None, None, None, "user", True), ("a", [], 1000.0, None, None, None, "user", True)])
    assert late["a"] == ("superseded", "b")
    assistant = fold(spark, [("a", [], 1000.0, None, None, None, "user", True), ("b", [], 2000.0, None, None, None, "assistant", True)])
    assert assistant["a"] == ("active", None)
    inside = fold(spark, [("a", [], 1000.0, None, 20.0, 30.0, "user", True), ("b", [], 2000.0, 25.0, None, None, "user", True)])
    assert inside["a"] == ("active", None)
    roles = fold(spark, [("a", ["item"], 1000.0, None, None, None, "user", True), ("b", ["place"], 2000.0, None, None, None, "user", True)])
    assert roles["a"] == ("active", None)


def test_refine_and_windows(spark):
    rows = spark.createDataFrame([("a", "Blue bus", 5.0), ("b", "red car", None), ("c", None, 9.0)], "id string, t string, time double")
    assert [r[0] for r in values(filters.refine(rows, filters.Refinement(include={"t": ["BUS"]})))] == ["a"]
    assert [r[0] for r in values(filters.refine(rows, filters.Refinement(exclude={"t": ["bus"]})))] == ["b", "c"]
    assert [r[0] for r in values(filters.window(rows, "time", 6, None))] == ["b", "c"]
    with pytest.raises(ValueError):
        filters.window(rows, "time", 9, 6)


@pytest.mark.parametrize(("value", "upper", "wanted"), [("2024-01-01", False, 1704067200.0), ("2024-01-01", True, 1704153599.999999), ("2024-01-01T01:00:00+01:00", False, 1704067200.0), (5, False, 5.0), ("12.5", True, 12.5)])
def test_boundaries(value, upper, wanted):
    assert filters.boundary(value, upper) == pytest.approx(wanted)


@pytest.mark.parametrize("value", [None, "", True, "soon", float("inf")])
def test_no_boundaries(value):
    with pytest.raises(ValueError):
        filters.boundary(value)


def test_session_times(spark):
    said = ["2023-06-15T10:30", "2019", "2023-06", "2023/03/04 (Sat) 16:45", "1700000000", "soon", "", None]
    found = spark.createDataFrame([(s,) for s in said], "s string").select(ingest.session_time(F.col("s")))
    assert [r[0] for r in found.collect()] == [1686825000.0, 1546300800.0, 1685577600.0, 1677948300.0, 1700000000.0, None, None, None]


def test_budget_stops_at_the_first_line_that_does_not_fit(spark):
    rows = spark.createDataFrame([(1, "aaaa"), (2, "b" * 40), (3, "c")], "i int, t string").withColumn("g", F.lit(1))
    assert [r["i"] for r in context.budget(rows, ["g"], [F.col("i")], F.col("t"), 5).collect()] == [1]


def test_dedup_keeps_the_rich_row_in_the_first_place(spark):
    rows = spark.createDataFrame([(1, "Same, text!", None), (2, "same text", 5), (3, "other", None), (4, "", 1)], "i int, t string, q int")
    assert sorted((r["i"], r["slot"]) for r in context.dedup_rows(rows.withColumn("s", F.lit(1)), ["s"], "t", F.col("q").isNotNull(), "i").collect()) == [(2, 1), (3, 3)]


def test_explore_expands_each_node_once_and_stops(spark):
    edges = spark.createDataFrame([("a", "E", "b"), ("b", "E", "a"), ("b", "E", "c"), ("c", "F", "d")], "src string, edge_type string, dst string")
    start = spark.createDataFrame([("a",)], "start string")
    assert [(s, t) for _, _, s, _, t in sorted(values(graph.explore(start, edges, 3)))] == [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d")]
    assert graph.explore(start, edges, 3, types=["E"], limit=2).count() == 2


def test_mcnemar(spark):
    x = spark.createDataFrame([(i, i < 7) for i in range(10)], "k int, label boolean")
    y = spark.createDataFrame([(i, i in (0, 1, 8)) for i in range(10)], "k int, label boolean")
    n, b, c, p = ops.mcnemar(x, y, "k").first()
    assert (n, b, c) == (10, 5, 1) and p == pytest.approx(2 * (1 + 6) / 64)
    assert ops.mcnemar(x, x, "k").first()["p"] is None


def test_lookup_prefers_the_first_table(spark):
    a, b = spark.createDataFrame([("1", "x")], "fid string, v string"), spark.createDataFrame([("1", "y"), ("2", "z")], "sid string, v string")
    asked = spark.createDataFrame([("1",), ("2",), ("3",)], "id string")
    assert {r["id"]: r["kind"] for r in filters.lookup(F.col("id"), [("fact", a, "fid"), ("span", b, "sid")], asked).collect()} == {"1": "fact", "2": "span", "3": "not_found"}


def test_vectors_approximate_mode_finds_exact_neighbours(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.lit(0).alias("corpus"), F.col("vec_id").alias("unit"), F.col("embedding").alias("v"))
    q = e.where(F.col("unit") % 20 == 0).select(F.col("unit").alias("query_id"), "corpus", F.col("v").alias("q"))
    exact = {(r["query_id"], r["unit"]) for r in vectors.nearest(e, q, 1).collect()}
    near = {(r["query_id"], r["unit"]) for r in vectors.lsh_nearest(e, q, 1).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_store_refuses_drift(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), {"prompts": "1"})
    store.provision()
    store.check()
    with pytest.raises(VersionMismatch):
        Store(spark, str(tmp_path / "s"), {"prompts": "2"}).check()
    store.write("facts", spark.createDataFrame([("u", 1)], "user_id string, v int"), 1)
    assert store.read("facts", 1).count() == 1
    moved = store.migrate(store.read("facts", 1), {"v": "value"}, {"note": "string"})
    assert moved.columns == ["user_id", "value", "note"]


def test_transcript_lines(spark):
    lines = [(1, '{"type":"user","message":{"role":"user","content":"hello"}}'), (2, "broken {"), (3, '{"type":"x","message":{"role":"assistant","content":"[{\\"type\\":\\"text\\",\\"text\\":\\"hi\\"},{\\"type\\":\\"tool\\"}]"}}'), (4, '{"message":{"role":"system","content":"no"}}')]
    good, bad = ingest.jsonl_messages(spark.createDataFrame(lines, "n int, value string"))
    assert sorted(values(good)) == [(1, "user", "hello"), (3, "assistant", "hi")]
    assert [r["n"] for r in bad.collect()] == [2]
    assert [r["n"] for r in ingest.jsonl_messages(spark.createDataFrame(lines, "n int, value string"), after=1)[0].collect()] == [3]


def test_answers_are_parsed(spark):
    said = [('```json\n[{"kind": "fact"}]\n```',), ('{"kind": "state"}',), ("none",)]
    found = ingest.parse_items(spark.createDataFrame(said, "t string"), "t", "struct<kind: string>").select(F.col("items.kind")).collect()
    assert [r[0] for r in found] == [["fact"], ["state"], None]


def test_fold_slots_by_rules_and_by_plain_windows(spark):
    """The fold against one fact after the other, over all routes to a slot."""
    import random

    rng = random.Random(11)
    given = []
    for k in range(400):
        low = rng.choice([None] * 9 + [10.0])
        given.append((
            rng.choice("uv"), f"f{k:03d}", k, rng.choice(["", "p", "q", "r", "message_unit_statement"]), rng.choice(["trip", "other", "work"]), rng.choice(["state"] * 5 + ["profile"]), rng.choice(["", "", "", "kg"]),
            rng.choice([[], [], ["item"], ["place", "subject"], ["value"]]), float(rng.randrange(50)), float(k), rng.choice([None, 15.0]), low, low and low + 10, rng.choice(["user"] * 6 + ["assistant"]), rng.random() < 0.9,
        ))
    found = {r["fact_id"]: (r["status"], r["superseded_by"]) for r in maintenance.fold(spark.createDataFrame(given, FACT)).collect()}
    names = [c.split()[0] for c in FACT.split(", ")]
    state: list[dict] = []
    for row in given:
        new = dict(zip(names, row, strict=True)) | {"status": "active", "by": None}
        best = None
        for old in state:
            a, b = (set(f["roles"]) - {"subject", *maintenance.VALUE_ROLES} for f in (old, new))
            same, kinds = old["predicate"] == new["predicate"], {old["kind"], new["kind"]}
            slot = old["predicate"] not in maintenance.NO_SLOT and new["predicate"] not in maintenance.NO_SLOT and old["user_id"] == new["user_id"]
            if "profile" in kinds:
                slot = slot and same
            else:
                by_type = old["event_type"] == new["event_type"] != "other" and a and a == b
                slot = slot and old["unit"] == new["unit"] and not (a and b and a != b) and (same or by_type)
            worded = new["update_like"] or (new["quantity"] is not None and old["update_like"])
            ranged = any(x["low"] is not None and y["low"] is None and y["quantity"] is not None and x["low"] <= y["quantity"] <= x["high"] for x, y in ((old, new), (new, old)))
            if old["status"] != "active" or not slot or not worded or ranged:
                continue
            rank = lambda f: (f["valid_from"], f["document_time"], f["fact_id"])
            winner, loser = (old, new) if rank(old) >= rank(new) else (new, old)
            if (winner["role"], loser["role"]) == ("assistant", "user"):
                continue
            if loser is old:
                old |= {"status": "superseded", "by": new["fact_id"]}
            elif best is None or rank(old) > rank(best):
                best = old
        if best:
            new |= {"status": "superseded", "by": best["fact_id"]}
        state.append(new)
    assert found == {f["fact_id"]: (f["status"], f["by"]) for f in state}
    assert {s for s, _ in found.values()} == {"active", "superseded"}


def test_events_are_the_same_if_they_share_an_object(spark):
    given = [("u", "flight", "fly", "past_event", "2024-01-01", "event", o, k, f"f{k}") for k, o in enumerate([["rome"], ["oslo"], ["oslo", "bonn"], ["bonn"], None, ["rome"]])]
    given += [("u", "flight", "fly", "past_event", "2024-01-02", "event", ["rome"], 9, "g0"), ("u", "flight", "fly", "past_event", "2024-01-02", "event", ["rome"], 10, "g1"), ("u", "flight", "fly", "past_event", "2024-01-02", "state", ["rome"], 11, "g2")]
    frame = spark.createDataFrame(given, "user_id string, event_type string, predicate string, modality string, day string, kind string, objects array<string>, seq int, fact_id string")
    assert {r["fact_id"]: r["event_id"] for r in maintenance.same_event(frame).collect()} == {"f0": "f0", "f1": "f1", "f2": "f1", "f3": "f1", "f4": "f4", "f5": "f0", "g0": "g0", "g1": "g0", "g2": "g2"}


def test_most_heads_decide_before_completeness(spark):
    heads = spark.createDataFrame([("q", "a", "h1", 0.4, 0), ("q", "b", "h1", 0.1, 1), ("q", "b", "h2", 0.2, 1), ("q", "c", "h9", 0.4, 2)], "query_id string, unit string, head string, c double, ordinal int")
    prints = spark.createDataFrame([("a", "x", 9), ("b", "x", 1)], "unit string, fingerprint string, completeness int")
    found = {r["unit"]: (r["members"], r["n_heads"], round(r["confidence"], 6), r["ordinal"]) for r in fusion.merge_events(heads, prints).collect()}
    assert found == {"c": (1, 1, 0.4, 1), "b": (2, 2, 0.52, 2)}


def test_date_policy(spark):
    rows = [("", "yesterday", "", "2024-03-10", "past", ""), ("2020-01-01", "session_date", "", "2024-03-10", "past", ""), ("2020", "before session_date", "", "2024-03-10", "past", ""), ("2020-02-02", "", "", "2024-03-10", "past", "yesterday"), ("", "", "", "2024-03-10", "past", "yesterday"), ("2020", "tomorrow", "", "", "past", ""), ("2021", "some day", "", "2024-03-10", "past", "")]
    frame = spark.createDataFrame(rows, "raw string, expr string, anchor string, day string, prefer string, text string")
    assert [r[0] for r in items.field_date(frame, "raw", "expr", "anchor", "day", "prefer", "text", "out").select("out").collect()] == ["2024-03-09", "2024-03-10", "2020", "2020-02-02", "2024-03-09", "2020", "2021"]


def test_a_pool_of_external_rows_alone_stays(spark):
    rows = spark.createDataFrame([("a", 1, "external_info", "where"), ("b", 1, "external_info", "where"), ("b", 2, None, "where"), ("c", 1, "external_info", "What did you say?"), ("c", 2, "fact", "What did you say?")], "q string, n int, modality string, question string")
    assert sorted((r["q"], r["n"]) for r in evidence.drop_external(rows, "q", "question").collect()) == [("a", 1), ("b", 2), ("c", 1), ("c", 2)]


def test_an_index_is_read_again_by_version(spark, tmp_path):
    docs = spark.createDataFrame([("c", "a", "red bus"), ("c", "b", "red car")], "corpus string, unit string, text string")
    first = lexical.stored(docs, "corpus", "unit", "text", str(tmp_path), "1")
    again = lexical.stored(docs.limit(0), "corpus", "unit", "text", str(tmp_path), "1")
    assert first.count() == again.count() == 4
    assert lexical.stored(docs.limit(1), "corpus", "unit", "text", str(tmp_path), "2").count() == 2


def test_claims_keep_their_place_and_lose_unknown_evidence(spark):
    from factloom.operators import settling

    rows = [
        (1, 0, "upsert", " c1 ", "first  version", ["e1", "x"], None), (1, 1, "upsert", "c2", "second", ["x"], "supported"), (2, 0, "upsert", "c1", "newer", ["e2", "e1", "e2"], "disputed"),
        (3, 0, "retract", "c2", None, None, None), (3, 0, "upsert", "c3", "", ["e1"], None), (4, 5, "upsert", "c2", "back", [], "odd"), (4, 6, "upsert", "c4", "none", None, None), (5, 0, "retract", "c4", None, None, None), (5, 1, "upsert", "c4", "again", ["e1"], None), (6, 0, "retract", "c4", None, None, None),
    ]
    updates = spark.createDataFrame([("q", s, o, a, c, t, e, st, None) for s, o, a, c, t, e, st in rows], "question_id string, step int, ordinal int, action string, claim_id string, statement string, evidence_ids array<string>, status string, material boolean")
    known = spark.createDataFrame([("q", "e1"), ("q", "e2"), ("other", "x")], "question_id string, evidence_id string")
    found = [tuple(r)[1:] for r in settling.claims(updates, known).orderBy("position").collect()]
    assert found == [("c1", "newer", ["e2", "e1"], [], "disputed", True, 1), ("c2", "back", [], [], "hypothesis", True, 2)]


def test_a_cycle_can_run_again(spark):
    from pyspark.sql import functions as F

    from factloom.operators import settling

    made = spark.createDataFrame([("u", "e", "text")], "user_id string, entity_id string, text string")
    none = spark.createDataFrame([], "user_id string, entity_id string, profile_id string, text string, status string, valid_from long, valid_until long")
    stale = spark.createDataFrame([("u", "e"), ("u", "f")], "user_id string, entity_id string")
    one, edges, left = settling.profile_cycle(none, made, stale, F.lit(5).cast("long"))
    assert edges.count() == 0 and [r["entity_id"] for r in left.collect()] == ["f"]
    again, edges, _ = settling.profile_cycle(one, made, stale, F.lit(6).cast("long"))
    assert edges.count() == 0 and again.collect() == one.collect()
    new, edges, _ = settling.profile_cycle(one, made.withColumn("text", F.lit("other")), stale, F.lit(7).cast("long"))
    assert sorted((r["text"], r["status"], r["valid_from"], r["valid_until"]) for r in new.collect()) == [("other", "active", 7, None), ("text", "superseded", 5, 7)] and edges.count() == 1


def test_turns_of_failed_jobs_are_sent_again(spark):
    from factloom.operators import settling

    cursors = spark.createDataFrame([("a", 0, 2, "j1"), ("b", 1, 2, "j2"), ("c", 1, 2, "j3"), ("d", 1, 0, None)], "session_id string, committed long, pending long, job_id string")
    jobs = spark.createDataFrame([("j1", "succeeded"), ("j2", "failed"), ("j9", "failed")], "job_id string, status string")
    settled = settling.settle_cursors(cursors, jobs)
    assert sorted(map(tuple, settled.collect()), key=str) == [("a", 2, 0, None), ("b", 1, 0, None), ("c", 1, 2, "j3"), ("d", 1, 0, None)]
    turns = spark.createDataFrame([(s, k) for s in "abcde" for k in range(3)], "session_id string, idx long")
    due = settling.unsent(turns, settled)
    assert sorted(map(tuple, due.collect())) == [("a", 2), ("b", 1), ("b", 2), ("d", 1), ("d", 2), ("e", 0), ("e", 1), ("e", 2)]
    accepted = spark.createDataFrame([("a", 3, "k1"), ("b", 3, None), ("e", 3, None)], "session_id string, end long, new_job string")
    assert sorted(map(tuple, settling.sent(settled, accepted).collect()), key=str) == [("a", 2, 3, "k1"), ("b", 3, 0, None), ("c", 1, 2, "j3"), ("d", 1, 0, None), ("e", 3, 0, None)]
