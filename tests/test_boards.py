"""Boards of current values with a case for each reason, and a planner's state against a plain loop."""

import random

import pytest

from factloom.operators import board, settling

PLAN = "query_id string, confidence double, answer_shape string, temporal_intent string, metric string, entities array<string>, value_type string, total_vs_delta string, object_type string, actions array<string>, question string"
ROW = "query_id string, evidence_id string, place int, text string, predicate_canonical string, predicate_raw string, entity_roles string, quantity_value double, quantity_unit string, modality string, time string"
GOOD = dict(confidence=0.9, answer_shape="current_value", temporal_intent="current", metric="piano", entities=[], value_type="count", total_vs_delta="unknown", object_type="", actions=[], question="how many")


def row(e, value, time, text="my piano", predicate="owns", unit="item_count", modality=None, place=0):
    return ("q", e, place, text, predicate, None, None, value, unit, modality, time)


TWO = [row("a", 2.0, "2024-01-02"), row("b", 1.0, "2024-01-01")]
CASES = {
    "low_plan_confidence": (dict(confidence=0.7), TWO),
    "history_intent_question": (dict(question="how many before that, originally"), TWO),
    "not_current_value_shape": (dict(answer_shape="historical_value"), TWO),
    "not_current_or_latest": (dict(temporal_intent="past"), TWO),
    "unsupported_value_type": (dict(value_type="location"), TWO),
    "delta_metric": (dict(total_vs_delta="delta"), TWO),
    "aggregate_scope": (dict(metric="piano expenses"), TWO),
    "state_scope": (dict(metric="piano place"), TWO),
    "enumeration_hint_present": (dict(actions=["buy"]), TWO),
    "no_competing_values": ({}, TWO[:1]),
    # Rows whose canonical predicate is of the future are no candidates, but the raw one may be; and what a predicate and its text say together is not in one of them.
    "top_future_plan": ({}, [(*TWO[0][:4], "", "plan_buy", *TWO[0][6:]), TWO[1]]),
    "top_delta_for_total": (dict(total_vs_delta="total"), [row("a", 2.0, "2024-01-02", text="few weeks of piano", predicate="last"), TWO[1]]),
    "top_time_missing": ({}, [row("a", 2.0, None), row("b", 1.0, "")]),
    "no_different_same_unit_value": ({}, [row("a", 2.0, "2024-01-02"), row("b", 2.0, "2024-01-01"), row("c", 3.0, "2024-01-01", unit="count")]),
    "competing_time_missing": ({}, [row("a", 2.0, "2024-01-02"), row("b", 1.0, "")]),
    "single_slot_current_value": ({}, TWO),
}


@pytest.mark.parametrize("reason", CASES)
def test_each_reason(spark, reason):
    change, rows = CASES[reason]
    plan = {"query_id": "q", **GOOD, **change}
    plans = spark.createDataFrame([tuple(plan[c.split()[0]] for c in PLAN.split(", "))], PLAN)
    [out] = board.boards(plans, spark.createDataFrame(rows, ROW)).collect()
    assert (out.reason, out.evidence_id, out.narrowed) == (reason, "a", reason == board.SAFE)


def test_every_objection_has_a_case(spark):
    assert {name for name, _ in board._objections(0.75)} == set(CASES) - {board.SAFE} and len(CASES) == 16


def test_candidates_by_unit_text_and_score(spark):
    rows = [
        row("years", 3.0, "2024-01-05", unit="years"), row("plan", 4.0, "2024-01-06", predicate="plan_buy"), row("other", 5.0, "2024-01-07", text="a violin"), row("news", 6.0, "2024-01-08", modality="external_info"),
        row("range", None, "2024-01-03", text="a piano for Two - three weeks"), row("none", None, "2024-01-03"), row("gain", 7.0, "2024-01-09", text="new\u00a0follower of a piano"), row("total", 8.0, "2024-01-01", predicate="piano_total", unit=None),
    ]
    plan = {"query_id": "q", **GOOD, "total_vs_delta": "total"}
    empty = {**plan, "query_id": "r", "metric": None, "entities": None}
    plans = spark.createDataFrame([tuple(p[c.split()[0]] for c in PLAN.split(", ")) for p in (plan, empty)], PLAN)
    rows += [("r", *x[1:]) for x in rows]
    found = {r.evidence_id: (r.query_id, r.value, r.unit, r.score) for r in board.candidates(plans, spark.createDataFrame(rows, ROW)).collect()}
    assert found == {"range": ("q", "2-3", "weeks", 2), "total": ("q", "8.0", "count", 5)}
    clock = board.candidates(spark.createDataFrame([("q", "piano", None, "Time", None)], "query_id string, metric string, entities array<string>, value_type string, total_vs_delta string"), spark.createDataFrame([row("t", None, "x", text="Piano at 7:30 PM")], ROW))
    assert [(r.value, r.unit) for r in clock.collect()] == [("7:30 pm", "time")]


def test_narrowed_boards_keep_four_and_others_eight(spark):
    rows = [row(f"e{k}", float(k), "2024-01-01", place=-k) for k in range(12)]
    plans = spark.createDataFrame([tuple({"query_id": "q", **GOOD}[c.split()[0]] for c in PLAN.split(", "))], PLAN)
    data = spark.createDataFrame(rows, ROW)
    [strong], [weak] = board.boards(plans, data).collect(), board.boards(plans, data, strong=False).collect()
    assert strong.kept_ids == [f"e{k}" for k in (11, 10, 9, 8)] and strong.narrowed
    assert weak.kept_ids == [f"e{k}" for k in range(11, 3, -1)] and weak.reason is None
    [line] = board.lines(plans, board.boards(plans, data)).collect()
    assert line.text.split("\n")[0] == "resolved value: 11.0 item_count (verify against the evidence)"
    assert board.boards(plans.limit(0), data).count() == board.boards(plans, data.limit(0)).count() == 0


UPDATE = "run_id string, step int, objective string, kind string, needs_numbers boolean, questions array<struct<question string, material boolean>>, resolved array<string>, conflicts array<struct<description string, evidence_ids array<string>, resolved boolean, resolution string>>"


def _replay(updates, known):
    """The same state by going through the updates one after another."""
    line = lambda x: " ".join((x or "").split(" ")).strip()[:500]
    objective, kind, needs, questions, clashes = "start", None, None, [], []
    for _, _, o, k, n, asked, resolved, listed in updates:
        objective = line(o) or objective
        if k in settling.CLASSES:
            kind, needs = k, bool(n) and k == "comparison"
        gone = {line(r) for r in resolved or []}
        questions = [q for q in questions if q[0] not in gone]
        if asked is not None:
            questions = [(line(q), m is None or m) for q, m in asked[:3] if line(q)]
        if listed is not None:
            clashes = [(line(d), [known[i] for i in ids or [] if i in known], bool(r), line(s)) for d, ids, r, s in listed[:3]]
    return (objective, kind, needs), questions, clashes


def test_planner_state_equals_a_plain_loop(spark):
    draw = random.Random(5)
    some = lambda f, n: None if draw.random() < 0.5 else [f() for _ in range(draw.randrange(n))]
    text = lambda: draw.choice(["a", " b ", "c", "d", "", None])
    yes = lambda: draw.choice([True, False, None])
    runs = {}
    for k in range(60):
        runs[f"r{k}"] = [
            (f"r{k}", step, draw.choice([None, " ", "x", "y"]), draw.choice([None, "sum", "comparison", "odd"]), yes(), some(lambda: (text(), yes()), 6), some(text, 3), some(lambda: (text(), some(lambda: draw.choice(["e1", "e2", "alias", "no"]), 5), yes(), text()), 6))
            for step in range(draw.randrange(7))
        ]
    known = {"e1": "e1", "e2": "e2", "alias": "e1"}
    updates = spark.createDataFrame([u for us in runs.values() for u in us], UPDATE).repartition(4)
    ids = spark.createDataFrame([(r, a, b) for r in runs for a, b in known.items()], "run_id string, given string, evidence_id string")
    aims = {r.run_id: (r.objective, r.kind, r.needs_numbers) for r in settling.aims(spark.createDataFrame([(r, "start") for r in runs], "run_id string, objective string"), updates).collect()}
    asked, clashes = {}, {}
    for r in settling.open_questions(updates, 3).orderBy("run_id", "position").collect():
        asked.setdefault(r.run_id, []).append((r.question, r.material))
    for r in settling.conflicts(updates, ids, 3).orderBy("run_id", "position").collect():
        clashes.setdefault(r.run_id, []).append((r.description, r.evidence_ids, r.resolved, r.resolution))
    for run, us in runs.items():
        assert (aims[run], asked.get(run, []), clashes.get(run, [])) == _replay(us, known)
