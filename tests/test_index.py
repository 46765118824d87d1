"""A lexical index that grows, and trees in JSON as rows of their leaves."""

import json
import os

import pytest
from pyspark.sql import functions as F

from factloom.memory import MemoryFrame
from factloom.operators import lexical, nested
from factloom.operators.index import Index

DOCS = [("c", "a", "red bus and red car"), ("c", "b", "red car"), ("c", "d", ""), ("e", "f", "blue bus"), ("c", "g", None), ("c", "h", "the cars of the buses")]


def docs(spark, rows):
    return spark.createDataFrame(rows, "corpus string, unit string, text string")


def scores(df):
    return sorted((r["query_id"], r["unit"], round(r["score"], 9), r["rank"]) for r in df.collect())


def test_versions_and_compactions_score_as_one_index(spark, tmp_path):
    queries = spark.createDataFrame([("q", "c", "red cars"), ("r", "e", "bus"), ("s", "none", "bus"), ("t", "c", "")], "query_id string, corpus string, text string")
    wanted = scores(lexical.score(lexical.postings(docs(spark, DOCS), "corpus", "unit", "text"), queries, 5))
    assert wanted
    index = Index(spark, str(tmp_path))
    for k in range(0, 6, 2):
        index.append(docs(spark, DOCS[k : k + 2]), "corpus", "unit", "text")
    assert index.versions() == [1, 2, 3] and scores(index.score(queries, 5)) == wanted
    assert index.compact() == 4 and index.versions() == [4] and scores(index.score(queries, 5)) == wanted
    index.append(docs(spark, [("e", "z", "bus bus")]), "corpus", "unit", "text")
    more = scores(lexical.score(lexical.postings(docs(spark, [*DOCS, ("e", "z", "bus bus")]), "corpus", "unit", "text"), queries, 5))
    assert index.versions() == [4, 5] and scores(index.score(queries, 5)) == more


def test_a_version_without_a_mark_is_not_read_and_is_written_again(spark, tmp_path):
    index = Index(spark, str(tmp_path))
    index.append(docs(spark, DOCS[:2]), "corpus", "unit", "text")
    before = index.postings().count()
    docs(spark, DOCS).withColumn("bucket", F.lit(1)).write.partitionBy("bucket").parquet(f"{tmp_path}/versions/2/postings")  # a writer died here
    assert index.postings().count() == before
    old = {p: os.path.getmtime(os.path.join(r, p)) for r, _, names in os.walk(f"{tmp_path}/versions/1") for p in names}
    assert index.append(docs(spark, DOCS[2:]), "corpus", "unit", "text") == 2
    assert index.postings().where("unit = 'a'").count() == 4
    assert old == {p: os.path.getmtime(os.path.join(r, p)) for r, _, names in os.walk(f"{tmp_path}/versions/1") for p in names}


def test_a_stored_version_without_a_mark_is_made_again(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/version=1/postings")
    assert lexical.stored(docs(spark, DOCS[:1]), "corpus", "unit", "text", str(tmp_path), "1").columns == ["corpus", "unit", "length", "term", "tf"]


def test_the_facade_reads_and_grows_the_index(spark, tmp_path):
    schema = "user_id string, session_id string, turn_id string, idx long, role string, content string, timestamp double"
    turns = spark.createDataFrame([("u", "s", f"t{k}", k, "user", text, float(k)) for k, text in enumerate(["red bus", "blue car", "green bus", "no"])], schema)
    more = spark.createDataFrame([("u", "s", "t9", 9, "user", "a bus again", 9.0), ("u", "s", "t0", 0, "user", "red bus", 0.0)], schema)
    queries = spark.createDataFrame([("q", "u", "bus")], "query_id string, user_id string, text string")
    index = Index(spark, str(tmp_path))
    index.append(turns, "user_id", "turn_id", "content")
    plain, grown = MemoryFrame(spark, {"turns": turns}).ingest(more), MemoryFrame(spark, {"turns": turns}, index=index).ingest(more)
    found = sorted(map(tuple, grown.search(queries).collect()))
    assert found == sorted(map(tuple, plain.search(queries).collect())) and {r[2] for r in found} == {"t0", "t2", "t9"}


TREES = [
    ("u", 1, {"x": {"n": 1, "m": {"k": 2.5, "l": [1, "b"], "served": ["g", "h"]}}, "t": "first", "e": {}, 'q"x': []}),
    ("u", 2, {"x": {"n": 4, "m": {"k": 1, "l": ["c", None], "served": ["h", "i"]}, "z": None}, "t": "second", "odd": 5}),
    ("u", 3, {"odd": {"now": "a tree"}}),
    ("v", 1, [1, {"a": ["b"]}]),
]


@pytest.fixture
def trees(spark):
    return spark.createDataFrame([(g, s, json.dumps(t)) for g, s, t in TREES] + [("w", 1, "no json"), ("w", 2, None)], "g string, s long, j string")


def test_trees_are_taken_apart_and_put_together(trees):
    again = {(r["g"], r["s"]): json.loads(r["json"]) for r in nested.tree(nested.leaves(trees, ["g", "s"], "j"), ["g", "s"]).collect()}
    assert again == {(g, s): t if not isinstance(t, dict) or "x" not in t else json.loads(json.dumps(t)) for g, s, t in TREES}


def test_trees_are_merged_at_every_depth(trees):
    found = nested.merged(trees.where("g = 'u' and s < 3"), ["g"], "s", "j", ["served"])
    merged = json.loads(nested.tree(found, ["g"]).first()["json"])
    assert merged == {"x": {"n": 5, "m": {"k": 3.5, "l": [1, "b", "c", None], "served": ["g", "h", "i"]}, "z": None}, "t": "first", "e": {}, 'q"x': [], "odd": 5}


def test_ids_are_replaced_at_every_depth(spark, trees):
    aliases = spark.createDataFrame([("u", "h", "e1"), ("u", "b", 'e"2'), ("v", "b", "e3"), ("v", "first", "no")], "g string, id string, alias string")
    found = {(r["g"], r["s"]): json.loads(r["json"]) for r in nested.aliased(trees, ["g", "s"], "j", aliases, "id", "alias", ["g"]).collect()}
    assert found["u", 1]["x"]["m"] == {"k": 2.5, "l": [1, 'e"2'], "served": ["g", "e1"]} and found["u", 1]["t"] == "first"
    assert found["v", 1] == [1, {"a": ["e3"]}]
