import pytest
from pyspark.sql import functions as F

from factloom.functions.excerpts import excerpt_one, excerpts
from factloom.functions.text import query_terms
from factloom.memory import MemoryFrame
from factloom.operators.resolve import resolve


@pytest.fixture(scope="module")
def memory(spark):
    turns = [("u", "s1", "s1_0", 0, "user", "I flew with Lufthansa to Oslo", 1.0), ("u", "s1", "s1_1", 1, "assistant", "How was the flight?", 1.001), ("u", "s2", "s2_0", 0, "user", "We adopted a puppy named Max", 2.0), ("v", "s3", "s3_0", 0, "user", "I started a new job in Oslo", 3.0)]
    facts = [("f1", "u", "travel", "Oslo", 1_000_000, 1, "flew to Oslo"), ("f2", "u", "pet", "Max", 2_000_000, 2, "adopted a puppy"), ("f3", "u", "travel", "Rome", 3_000_000, 3, "flew to Rome")]
    return MemoryFrame(spark, {
        "turns": spark.createDataFrame(turns, "user_id string, session_id string, turn_id string, idx long, role string, content string, timestamp double"),
        "facts": spark.createDataFrame(facts, "fact_id string, user_id string, predicate string, object string, valid_from long, seq int, support string"),
    })


def asked(spark, text):
    return spark.createDataFrame([("q", "u", text)], "query_id string, user_id string, text string")


@pytest.mark.parametrize("route", ["fusion", "wide"])
def test_search_stays_with_its_user(spark, memory, route):
    found = [r["unit"] for r in memory.search(asked(spark, "adopted puppy"), route=route).orderBy("rank").collect()]
    assert set(found) == {"f2", "s2_0"} and (route == "wide" or found[0] == "f2")
    with pytest.raises(ValueError):
        memory.search(asked(spark, "x"), route="other")


def test_scope_only_shortens(spark, memory):
    scopes = spark.createDataFrame([("u", "s2", "b")], "user_id string, session_id string, agent_id string")
    found = memory.search(asked(spark, "adopted puppy"), scope={"agent_id": "a"}, scopes=scopes)
    assert {r["unit"] for r in found.collect()} == {"f2"}


def test_context_versions_timeline_profiles(spark, memory):
    assert memory.build_context(asked(spark, "adopted puppy"), 5).count() == 1
    assert {r["object"] for r in memory.current(F.lit(2_500_000)).collect()} == {"Oslo", "Max"}
    assert [r["fact_id"] for r in memory.timeline("OSLO").collect()] == ["f1"]
    assert {r["text"] for r in memory.dream().collect()} == {"travel Oslo", "pet Max", "travel Rome"}
    near = memory.explore(spark.createDataFrame([("entity_oslo",)], "start string"))
    assert "f1" in {r["dst"] for r in near.collect()}
    with pytest.raises(ValueError):
        memory.explore(near, depth=4)


def test_ingest_again_changes_nothing(spark, memory):
    assert memory.ingest(memory.tables["turns"]).tables["turns"].count() == 4
    assert memory.windows().count() == 3


def test_resolution(spark):
    registry = spark.createDataFrame([("e1", "New York City", 5), ("e2", "The Beatles", 3), ("e3", "Robert Smith", 2), ("e4", "Robert Jones Lee", 9)], "entity_id string, surface string, mention_count int")
    names = ["beatles", "NYC", "Robert", "new york", "Robert Smith Jr", "nobody"]
    found = {r["name"]: (r["entity_id"], r["how"]) for r in resolve(spark.createDataFrame([(n,) for n in names], "name string"), registry).collect()}
    assert found == {"beatles": ("e2", "exact"), "NYC": ("e1", "acronym"), "Robert": ("e4", "prefix"), "new york": (None, None), "Robert Smith Jr": (None, None), "nobody": (None, None)}


def test_excerpts(spark):
    text = "x" * 4000 + " needle " + "y" * 4000
    got = excerpt_one(text, ["needle"])
    assert "needle" in got and len(got) < 1000 and excerpt_one("short", ["a"]) == "short" and len(excerpt_one(text, [])) == 3200
    row = spark.createDataFrame([(text,), (None,)], "t string").select(excerpts("t", query_terms(F.lit("the needle")))).collect()
    assert "needle" in row[0][0] and row[1][0] == ""


def test_refined_results_sessions_and_counts(spark, memory):
    from factloom.operators.refining import CardFilter

    q = asked(spark, "flew flight Oslo puppy")
    units = lambda df: {r["unit"] for r in df.collect()}
    assert units(memory.refine(q, CardFilter(types=["fact"], exclude_terms=["puppy"]))) == {"f1", "f3"}
    assert units(memory.refine(q, CardFilter(source_roles=["assistant"]))) == {"s1_1"}
    assert units(memory.refine(q, CardFilter(entity_roles={"object": ["osl"]}))) == {"f1"}
    page = memory.refine(q, CardFilter(include_terms=["o"]), limit=1, offset=1).collect()
    assert len(page) == 1 and page[0]["total"] > 1 and page[0]["position"] == 2
    ids = spark.createDataFrame([("u", "ev_fact:f1"), ("u", "ev_turn:s1:s1_0"), ("v", "f1"), ("u", "no")], "user_id string, id string")
    assert {(r["user_id"], r["id"], r["kind"]) for r in memory.result(ids).collect()} == {("u", "f1", "fact"), ("u", "s1_0", "turn"), ("v", "f1", "not_found"), ("u", "no", "not_found")}
    whole = memory.session(spark.createDataFrame([("u", "s1"), ("v", "s1")], "user_id string, session_id string"))
    assert [(r["position"], r["turn_id"]) for r in whole.orderBy("position").collect()] == [(1, "s1_0"), (2, "s1_1")]


def test_timelines_of_phrases_and_rosters_of_labels(spark, memory):
    phrases = spark.createDataFrame([("q", "u", "adopted puppy"), ("q", "u", "flew Rome")], "query_id string, user_id string, event string")
    found = memory.event_timeline(phrases).orderBy("position").collect()
    assert [r["at"] for r in found] == sorted(r["at"] for r in found)
    assert {r["unit"] for r in found if r["event"] == "adopted puppy"} == {"f2", "s2_0"} and any(r["unit"] == "f3" and r["event"] == "flew Rome" for r in found)
    assert {r["unit"] for r in memory.event_timeline(phrases, high=2.5).collect()}.isdisjoint({"f3"})
    asks = spark.createDataFrame([("q", "u", "flew", ["Oslo", "Rome"])], "query_id string, user_id string, text string, labels array<string>")
    counted = {r["unit"]: r["labels"] for r in memory.evidence_count(asks).collect()}
    assert set(counted["f1"]) == {"Oslo", "Rome"} and set(counted["f3"]) == {"Oslo", "Rome"}
