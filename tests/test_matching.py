"""Containment joins, whole lineages, and the fold of facts against plain versions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from factloom.functions.excerpts import excerpt_one
from factloom.operators import context, evidence, graph, maintenance, matching


def test_names_meet_terms_of_every_length(spark):
    rng = random.Random(1)
    names = {"".join(rng.choice("abAB é") for _ in range(rng.randint(0, 9))) for _ in range(300)} | {"%_x", "ab"}
    terms = {"".join(rng.choice("abB é") for _ in range(rng.randint(0, 5))) for _ in range(80)} | {"%", "zzz", "_"}
    found = matching.names_holding(spark.createDataFrame([(t,) for t in [*terms, None]], "term string"), spark.createDataFrame([(n,) for n in [*names, None]], "name string"))
    assert sorted(map(tuple, found.collect())) == sorted((t, n) for t in terms for n in names if t and t.lower() in n.lower())
    assert "NestedLoop" not in found._jdf.queryExecution().toString()


def test_mentions_follow_the_order_of_terms(spark):
    mentions = [("u", k, name, c, k) for k, (name, c) in enumerate([("red car", 0.5), ("Car park", 0.9), ("red", 0.9), ("red hat", 0.9), ("boat", 1.0)])] + [("v", 9, "red car", 1.0, 9)]
    terms = [("q", "u", 0, " "), ("q", "u", 1, "CAR"), ("q", "u", 2, "red"), ("q", "u", 3, "boat"), ("p", "u", 1, "boat"), ("n", "u", 1, None)]
    given = (spark.createDataFrame(terms, "query_id string, user_id string, place int, term string"), spark.createDataFrame(mentions, "user_id string, mention_id long, name string, confidence double, seq long"))
    found = sorted((r["query_id"], r["position"], r["mention_id"]) for r in matching.mentions_by_terms(*given, 4).collect())
    assert found == [("p", 1, 4), ("q", 1, 1), ("q", 2, 0), ("q", 3, 3), ("q", 4, 2)]
    assert [r["mention_id"] for r in matching.mentions_by_terms(*given, 4, 1).where("query_id = 'q'").orderBy("position").collect()] == [1, 0]


def test_terms_of_many_queries_bring_their_mentions_once(spark, monkeypatch):
    mentions = [("u", k, "red car" if k % 2 else f"car {k}", k % 7 / 10, k) for k in range(200)]
    terms = [(q, "u", p, t) for q in range(50) for p, t in enumerate(["car", "red"])]
    ranked = []
    at = matching.Window.partitionBy
    monkeypatch.setattr(matching.Window, "partitionBy", lambda *c: ranked.append(c) or at(*c))
    found = matching.mentions_by_terms(spark.createDataFrame(terms, "query_id long, user_id string, place int, term string"), spark.createDataFrame(mentions, "user_id string, mention_id long, name string, confidence double, seq long"), 5)
    best = lambda t: [m for _, m, n, _, _ in sorted(mentions, key=lambda m: (-m[3], -m[4])) if t in n][:5]
    once = list(dict.fromkeys([*best("car"), *best("red")]))[:5]
    assert sorted((r["query_id"], r["position"], r["mention_id"]) for r in found.collect()) == [(q, k + 1, m) for q in range(50) for k, m in enumerate(once)]
    assert ("user_id", "term") in ranked and ("query_id", "_p") not in ranked


def plain_provenance(items, spans):
    out = {}
    words = lambda t: {w for w in re.findall(r"[a-z0-9]+", t.lower()) if len(w) > 2}
    for item, session, quote in items:
        q = " ".join((quote or "").lower().split())
        if len(q) < 6:
            continue
        here = [(k, i, t) for s, k, i, t in spans if s == session]
        exact = [k for k, _, t in here if q in " ".join((t or "").lower().split())]
        qt = words(q)
        if exact:
            if len(exact) == 1:
                out[item] = exact[0]
        elif len(qt) >= 3:
            best = min(((-len(qt & words(t or "")) / len(qt), i, k) for k, i, t in here), default=(0, 0, None))
            if best[0] <= -0.8:
                out[item] = best[2]
    return out


def test_provenance_equals_comparing_all_spans(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 4)))
    spans = [("s" if k < 400 else "t", f"span{k:04d}", k, " ".join(word() for _ in range(rng.randint(0, 25)))) for k in range(500)] + [("s", "span9", 9999, None)]
    items = []
    for k in range(250):
        session, _, _, text = spans[rng.randrange(500)]
        w = text.split()
        rng.random() < 0.5 and rng.shuffle(w)
        w = [x if rng.random() < 0.93 else "other" for x in w[: rng.randint(0, 25)]]
        items.append((k, session, " ".join(w)[rng.randint(0, 2) :]))
    items += [(900, "s", None), (901, "nowhere", "some words here"), (902, "s", "abc")]
    found = matching.recover_provenance(spark.createDataFrame(items, "item_id long, session_id string, quote string"), spark.createDataFrame(spans, "session_id string, span_id string, idx long, text string"))
    assert {r["item_id"]: r["span_id"] for r in found.collect()} == plain_provenance(items, spans)


def test_sessions_of_few_items_are_compared_without_grams(spark, monkeypatch):
    spans = [(f"s{n}", f"s{n}_{k}", k, f"the {n} cats of {k} houses sleep until evening {n * k}") for n in range(3) for k in range(5)] + [("hot", f"h{k}", k, f"row number {k} of the hot session") for k in range(100)]
    items = [(k, s, t[4:]) for k, (s, _, _, t) in enumerate(spans)] + [(1000, "s1", "evening until sleep houses cats the")]
    seen = []
    indexed = matching.quotes_in_spans
    monkeypatch.setattr(matching, "quotes_in_spans", lambda q, s: seen.extend(r[0] for r in s.select("session_id").distinct().collect()) or indexed(q, s))
    found = matching.recover_provenance(spark.createDataFrame(items, "item_id long, session_id string, quote string"), spark.createDataFrame(spans, "session_id string, span_id string, idx long, text string"))
    assert {r["item_id"]: r["span_id"] for r in found.collect()} == plain_provenance(items, spans)
    assert seen == ["hot"]


def test_grams_are_never_broadcast_by_the_size_of_their_texts(spark):
    from factloom.sources.storage import kept

    q = kept(spark.createDataFrame([(k, "s", f"quote number {k}", ["quote", "number", str(k)]) for k in range(70)], "item_id long, session_id string, _q string, _qt array<string>"), "quotes")
    s = kept(spark.createDataFrame([("s", f"p{k}", f"a quote number {k} in here", ["quote", "number", str(k)]) for k in range(70)], "session_id string, span_id string, _s string, _st array<string>"), "spans")
    for found in (matching.quotes_in_spans(q, s), matching.spans_covering(q, s, 0.8)):
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
        assert {r["item_id"] for r in found.collect()} == set(range(70))


def test_a_long_chain_and_circles_have_heads(spark):
    chain = [(f"c{k + 1:04d}", f"c{k:04d}") for k in range(1000)]
    circle = [("x2", "x1"), ("x3", "x2"), ("x1", "x3"), ("x1", "tail")]
    facts = spark.createDataFrame([(i,) for i in [*(f"c{k:04d}" for k in range(1001)), "x1", "x2", "x3", "tail", "alone"]], "fact_id string")
    found = {r["fact_id"]: tuple(r)[1:] for r in graph.whole_lineage(facts, spark.createDataFrame([*chain, *circle, ("alone", "alone")], "src string, dst string")).collect()}
    assert all(found[f"c{k:04d}"] == ("c1000", 1000 - k, False) for k in range(1001))
    assert {found[k] for k in ("x1", "x2", "x3", "tail")} == {("x1", None, True)}
    assert found["alone"] == ("alone", 0, False)


def test_two_hop_meets_the_first_units_of_an_entity_only(spark):
    rng = random.Random(3)
    pairs = {(f"u{rng.randrange(60):02d}", f"e{rng.randrange(9)}") for _ in range(150)} | {(f"u{k:02d}", "hub") for k in range(60)}
    degree = {e: sum(x == e for _, x in pairs) for _, e in pairs}
    members = spark.createDataFrame([(u, e, degree[e]) for u, e in [*pairs, ("u00", "hub")]] + [(None, "hub", 60), ("u99", None, 1)], "unit string, entity string, degree int")
    found = graph.two_hop(spark.createDataFrame([(f"u{k:02d}",) for k in range(60)], "head string"), members, 4)
    wanted = []
    for head in (f"u{k:02d}" for k in range(60)):
        via = {}
        for o, e in pairs:
            if o != head and (head, e) in pairs:
                via[o] = min(via.get(o, (99, "")), (degree[e], e))
        wanted += [(head, o, e, k + 1) for k, ((_, e), o) in enumerate(sorted((v, o) for o, v in via.items())[:4])]
    assert sorted(map(tuple, found.collect())) == wanted
    limits = graph.two_hop(members.select(F.col("unit").alias("head")), members, 4)._jdf.queryExecution().executedPlan().toString()
    assert limits.count("WindowGroupLimit [entity") >= 1


def test_chains_of_aliases_have_no_longest_length(spark):
    rows = [(f"e{k}", [f"e{k - 1}"] if k else [], 10_000 - k, "q") for k in range(300)]
    found = evidence.resolve_aliases(spark.createDataFrame(rows, "evidence_id string, aliases array<string>, place int, q string"), ["q"])
    assert {r["canonical"] for r in found.collect()} == {"e299"}


def test_excerpts_take_the_longest_terms_first_and_all_places():
    text = "an " * 3000 + "needle " + "an " * 3000
    assert "needle" in excerpt_one(text, ["an", "needle"], most=1)
    assert excerpt_one("x" * 5000 + "y" * 1 + "x" * 5000, ["y"], around=3) == "xxxyxx"


SCHEMA = "user_id string, fact_id string, seq long, predicate string, event_type string, kind string, unit string, roles array<string>, valid_from double, document_time double, quantity double, low double, high double, role string, update_like boolean, occurred_start double, support string"


def random_facts(rng, n, plain_slots):
    out = []
    for k in range(n):
        low = None if plain_slots or rng.random() < 0.8 else float(rng.randint(0, 3))
        out.append((
            "u", f"f{rng.random()}", k, rng.choice(["p", "q"]), rng.choice(["trip", "other"]) if not plain_slots else "other", "state", "" if plain_slots else rng.choice(["", "kg"]),
            [] if plain_slots else rng.choice([[], ["place"], ["place", "value"]]), rng.choice([None, 0.0, 1.0, 2.0, 3.0, float("nan")]), rng.choice([None, 1.0, 2.0]), rng.choice([None, 1.0, 2.0]), low, None if low is None else low + 2,
            "user" if plain_slots else rng.choice(["user", "assistant"]), True if plain_slots else rng.random() < 0.8, rng.choice([None, 1.5, 2.5]), rng.choice(["a", "b", None]),
        ))
    return out


def outcome(df):
    return sorted((r["fact_id"], r["status"], r["valid_until"], r["superseded_by"]) for r in df.collect())


@pytest.mark.parametrize("seed", range(4))
def test_windows_and_fold_agree(spark, seed):
    facts = spark.createDataFrame(random_facts(random.Random(seed), 60, True), SCHEMA)
    keyed = maintenance.order_key(facts).withColumn("_roles", maintenance.slot_roles(F.col("roles")))
    folded = keyed.groupBy("user_id", "predicate").applyInPandas(maintenance._fold_group, "user_id string, fact_id string, status string, valid_until double, superseded_by string")
    assert outcome(maintenance._fold_windows(keyed)) == outcome(folded) == outcome(maintenance.fold(facts))


def test_a_null_time_and_a_range_do_not_change_who_wins(spark):
    base = ("u", "b", 0, "p", "other", "state", "", [], 5.0, 1.0, 1.0, None, None, "user", True, None, "x")
    other = ("u", "c", 1, "p", "other", "state", "", [], None, 1.0, 2.0, None, None, "user", True, None, "y")
    ranged = ("u", "r", 2, "p", "other", "state", "", [], 1.0, 1.0, None, 50.0, 60.0, "user", True, None, "z")
    for rows in ([base, other], [base, other, ranged]):
        found = {r["fact_id"]: tuple(r)[2:] for r in maintenance.fold(spark.createDataFrame(rows, SCHEMA)).collect()}
        assert found["b"] == ("active", None, None) and found["c"] == ("superseded", 5.0, "b")


@pytest.mark.parametrize("seed", range(3))
def test_fold_with_ranges_roles_and_assistants_equals_a_loop(spark, seed):
    rows = random_facts(random.Random(10 + seed), 50, False)
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    keyed = maintenance.order_key(spark.createDataFrame(rows, SCHEMA)).withColumn("_roles", maintenance.slot_roles(F.col("roles")))
    keys = {r["fact_id"]: (r["_time"], r["_said"], r["_content"], r["_closes"]) for r in keyed.collect()}
    done = []
    for new in (dict(zip(names, r, strict=True)) for r in rows):
        new |= {"status": "active", "until": None, "by": None, "own": sorted({x for x in new["roles"] if x != "value"})}
        best = None
        for old in done:
            if old["status"] != "active" or old["unit"] != new["unit"] or (old["own"] and new["own"] and old["own"] != new["own"]):
                continue
            if old["predicate"] != new["predicate"] and not (old["event_type"] == new["event_type"] == "trip" and old["own"] and old["own"] == new["own"]):
                continue
            if not (new["update_like"] or (new["quantity"] is not None and old["update_like"])):
                continue
            if any(a["low"] is not None and b["low"] is None and b["quantity"] is not None and a["low"] <= b["quantity"] <= a["high"] for a, b in ((old, new), (new, old))):
                continue
            a, b = keys[old["fact_id"]], keys[new["fact_id"]]
            if a[:3] >= b[:3]:
                if not (old["role"] == "assistant" and new["role"] == "user") and (best is None or a[:3] > keys[best["fact_id"]][:3]):
                    best = old
            elif not (new["role"] == "assistant" and old["role"] == "user"):
                old |= {"status": "superseded", "until": b[3], "by": new["fact_id"]}
        if best is not None:
            new |= {"status": "superseded", "until": keys[best["fact_id"]][3], "by": best["fact_id"]}
        done.append(new)
    assert outcome(maintenance.fold(spark.createDataFrame(rows, SCHEMA))) == sorted((f["fact_id"], f["status"], f["until"], f["by"]) for f in done)


def test_same_event_keeps_repeated_rows_and_several_objects(spark):
    rows = [("u", "trip", "p", "past", "2024-01-01", "event", o, k, f) for k, (f, o) in enumerate([("a", ["x", "y"]), ("a", ["x", "y"]), ("b", ["z"]), ("c", ["z", "y"]), ("d", None), ("e", ["w"])])]
    found = maintenance.same_event(spark.createDataFrame(rows, "user_id string, event_type string, predicate string, modality string, day string, kind string, objects array<string>, seq long, fact_id string"))
    assert [(r["fact_id"], r["event_id"]) for r in found.orderBy("seq").collect()] == [("a", "a"), ("a", "a"), ("b", "b"), ("c", "a"), ("d", "d"), ("e", "e")]


def test_roster_has_undated_facts_last(spark):
    hits = spark.createDataFrame([("q", "f1", "b", None, 1), ("q", "f2", "a", "2024-02-01", 2), ("q", "f3", "a", "2024-01-01", 9), ("q", "f3", "b", "2024-01-01", 3), ("r", "f1", "b", None, 1)], "q string, fact string, label string, day string, seen int")
    found = [tuple(r) for r in context.roster(hits, "fact", "label", "day", "seen", ["q"]).select("q", "position", "fact", "labels").orderBy("q", "position").collect()]
    assert found == [("q", 1, "f3", ["b", "a"]), ("q", 2, "f2", ["a"]), ("q", 3, "f1", ["b"]), ("r", 1, "f1", ["b"])]


def test_neighbours_by_cells_equal_all_comparisons(spark):
    import numpy as np

    from factloom.operators import vectors

    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8))
    rows = [("c" if k % 5 else "d", k, list(map(float, centres[k % 6] + 0.1 * rng.normal(size=8)))) for k in range(400)]
    rows += [("c", 1000 + k, rows[1][2]) for k in range(15)] + [("c", 2000, [0.0] * 8), ("e", 3000, [1.0] * 8)]
    v = spark.createDataFrame(rows, "corpus string, unit long, v array<double>")
    q = v.where("unit % 20 = 0 and unit <> 2000").select(F.col("unit").alias("query_id"), "corpus", F.col("v").alias("q"))
    near, cost = vectors.nearest_by_cells(v, q, 7, 12)
    wanted = vectors.nearest(v.where("unit <> 2000"), q, 7)
    as_rows = lambda df: sorted((r["query_id"], r["rank"], r["unit"], round(r["similarity"], 8)) for r in df.collect())
    assert as_rows(near) == as_rows(wanted)
    total = cost.agg(F.sum("cells"), F.sum("searched")).first()
    assert 2 * total[1] < total[0]
    assert vectors.nearest_by_cells(v.limit(0), q, 7)[0].count() == 0


def test_neighbours_in_blocks_equal_all_comparisons(spark, monkeypatch):
    import numpy as np

    from factloom.operators import vectors

    monkeypatch.setattr(vectors, "BLOCK", 400)  # 50 vectors, 25 queries
    rng = np.random.default_rng(6)
    rows = [("c" if k % 5 else "d", k, list(map(float, rng.integers(-2, 3, 8)))) for k in range(400)]
    rows = [(c, u, x if any(x) else [1.0] * 8) for c, u, x in rows]
    rows += [("c", 1000 + k, rows[1][2]) for k in range(60)] + [("e", 3000, [1.0] * 8), ("o", 3020, [1.0, 2.0]), ("o", 3021, [1.0, 1.0]), ("o", 3022, None)]
    v = spark.createDataFrame(rows, "corpus string, unit long, v array<double>")
    q = v.where("unit % 20 = 0 or unit = 1").select(F.col("unit").alias("query_id"), "corpus", F.col("v").alias("q"))
    found, wanted = vectors.nearest_in_blocks(v, q, 7), vectors.nearest(v, q, 7)
    as_rows = lambda df: sorted((r["query_id"], r["corpus"], r["rank"], r["unit"], r["similarity"]) for r in df.collect())
    some = lambda df: [r for r in as_rows(df.where("corpus <> 'o'"))]
    assert some(found) == some(wanted)
    assert [(r["unit"], r["rank"]) for r in found.where("corpus = 'o'").orderBy("rank").collect()] == [(3020, 1), (3021, 2), (3022, 3)]
    zero = spark.createDataFrame([("z", 1, [0.0, 0.0]), ("z", 2, [1.0, 0.0])], "corpus string, unit long, v array<double>")
    ranked = vectors.nearest_in_blocks(zero, zero.where("unit = 2").select(F.col("unit").alias("query_id"), "corpus", F.col("v").alias("q")), 5).orderBy("rank").collect()
    assert [r["unit"] for r in ranked] == [1, 2]


def test_an_embedder_gets_batches_without_nulls(spark):
    import numpy as np

    from factloom.operators.vectors import embedder

    embed = embedder(lambda texts: np.array([[len(t), t.count("a")] for t in texts]))
    found = spark.createDataFrame([(1, "banana"), (2, None), (3, "")], "k int, t string").select("k", embed("t").alias("v")).orderBy("k").collect()
    assert [r["v"] for r in found] == [[6.0, 3.0], None, [0.0, 0.0]]


def test_superseded_facts_take_no_place_and_spans_share_heads(spark):
    from factloom.operators import fusion

    hits = spark.createDataFrame([("q", f"f{k}", k + 1) for k in range(5)], "query_id string, unit string, rank int")
    units = spark.createDataFrame([(f"f{k}", k not in (0, 2)) for k in range(5)], "unit string, eligible boolean")
    direct = fusion.direct(hits, units, "bm25", 0.4, 1, 2)
    assert [r["unit"] for r in direct.orderBy("ordinal").collect()] == ["f1", "f3"]
    spans = spark.createDataFrame([("q", "s1", 1), ("q", "s2", 2), ("q", "s3", 3)], "query_id string, unit string, rank int")
    links = spark.createDataFrame([("s1", "f0", 1), ("s1", "f1", 2), ("s2", "f2", 1), ("s3", "f4", 1)], "span string, unit string, seq int")
    through = fusion.through_spans(spans, links, units, "bm25", 0.4, 2, 2)
    assert [(r["unit"], r["head"]) for r in through.orderBy("ordinal").collect()] == [("f1", "bm25:f1"), ("s2", "bm25:span:s2")]
    fused = {r["unit"]: (r["n_heads"], round(r["confidence"], 4)) for r in fusion.fuse([direct, through]).collect()}
    assert fused == {"f1": (1, 0.4), "f3": (1, 0.4), "s2": (1, 0.4)}
