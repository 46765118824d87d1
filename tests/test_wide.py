"""Wide recall and whole edges on small fixtures."""

from factloom.operators import graph, wide

FACT = "fact_id string, user_id string, span_ids array<string>, roles array<struct<role string, name string>>, day string, quantity_value double, quantity_unit string"


def test_edges_of_a_fact_once_each(spark):
    rows = [
        ("f", "u", ["s1", "s1", None, "s2"], [("subject", "Ann Lee"), ("object", "Tea"), ("object", "TEA!"), ("place", "tea"), ("object", ""), ("object", None)], "2024-01-01", None, "cup"),
        ("g", "u", None, None, None, None, ""), ("h", "u", [], [], None, 2.0, None),
    ]
    facts = spark.createDataFrame(rows, FACT)
    found = sorted((r.src, r.edge_type, r.dst, r.predicate_raw) for r in graph.materialise(facts).collect())
    assert found == [
        ("f", "EVIDENCES", "s1", "source trace evidences memory unit"), ("f", "EVIDENCES", "s2", "source trace evidences memory unit"), ("f", "HAS_QUANTITY", "None:cup", "fact has quantity"),
        ("f", "MENTIONS", "entity_ann_lee", "mentions Ann Lee"), ("f", "MENTIONS", "entity_tea", "mentions TEA!"), ("f", "MENTIONS", "entity_tea", "mentions tea"),
        ("f", "OBJECT_OF", "entity_tea", "object: TEA!"), ("f", "OBJECT_OF", "entity_tea", "place: tea"), ("f", "OCCURRED_DURING", "2024-01-01", "fact occurred during date"),
        ("f", "SUBJECT_OF", "entity_ann_lee", "subject: Ann Lee"), ("h", "HAS_QUANTITY", "2.0:None", "fact has quantity"),
    ]
    edges = graph.materialise(facts)
    assert edges.select("edge_id").distinct().count() == edges.count() == len(found)
    mentions = graph.mention_rows(facts)
    assert sorted((r.span_id, r.role, r.entity_name) for r in mentions.collect()) == [(s, r, n) for s in ("s1", "s2") for r, n in (("object", "TEA!"), ("place", "tea"), ("subject", "Ann Lee"))]
    assert "Exchange" not in edges._jdf.queryExecution().executedPlan().toString()


def test_ten_routes_and_their_evidence(spark):
    hit = lambda rows: spark.createDataFrame(rows, "query_id string, unit string, rank int, score double")
    facts, spans, sums = hit([("q", "f1", 1, 3.0), ("q", "f2", 2, 1.0)]), hit([("q", "s1", 1, 9.0), ("q", "s9", 81, 1.0)]), hit([("q", "m", 1, 2.0), ("q", "n", 21, 2.0)])
    near = hit([("q", "f1", 1, 0.0), ("q", "f3", 61, 0.0)]).drop("score")
    near_spans = hit([("q", "s2", 3, 0.0)]).drop("score")
    said = spark.createDataFrame([("q", "s3", "f1", 1, 0.91), ("q", "s3", None, 2, 0.5)], "query_id string, span_id string, fact_id string, rank int, confidence double")
    links = spark.createDataFrame([("s1", "f1", 0), ("s1", "f4", 1), ("s2", "f4", 0)], "span string, fact string, seq int")
    members = spark.createDataFrame([("m", f"x{k}", k) for k in range(40)] + [("n", "y", 0)], "summary string, fact string, seq int")
    hits = wide.routes(facts, near, spans, near_spans, sums, said, links, members)
    found = sorted((r.asked, r.unit, r.rank, round(r.score, 3)) for r in hits.collect() if not r.unit.startswith("x"))
    assert found == [
        (0, "f1", 1, 3.0), (0, "f2", 2, 1.0), (1, "f1", 1, 1.0), (2, "s1", 1, 9.0), (3, "f1", 1, 9.1), (3, "f4", 1, 9.1), (4, "s2", 3, 0.94), (5, "f4", 3, 0.86), (6, "m", 1, 2.0),
        (8, "s3", 1, 0.91), (8, "s3", 2, 0.5), (9, "f1", 1, 0.96),
    ]
    assert sorted(r.unit for r in hits.where("asked = 7").collect()) == sorted(f"x{k}" for k in range(30))
    status = spark.createDataFrame([("f1", "active"), ("f4", "active"), ("f2", "expired"), *((f"x{k}", "active") for k in range(29))], "unit string, status string")
    kept, gone = wide.active(hits, status)
    assert sorted(map(tuple, gone.collect())) == [("q", "f2", "status=expired"), ("q", "x29", "status=unknown")]
    units = spark.createDataFrame([("f4", 1, False, 5), ("f1", 1, False, 5), ("s1", 1, True, 1)], "unit string, tier int, has_quantity boolean, n_chars int")
    best = wide.evidence(kept, units, 4).orderBy("rank").collect()
    assert [(r.unit, r.kind) for r in best][:3] == [("s1", "span"), ("f1", "fact"), ("f4", "fact")]
    assert best[1].routes == ["memory_unit_bm25", "memory_unit_vector", "message_unit_linked_memory", "mention_memory_unit"]
    assert best[1].score == round(4 / 61 + 5 * 0.05, 6) and len(best) == 4
    assert wide.evidence(kept.limit(0), units, 4).count() == 0
