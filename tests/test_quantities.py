"""Numbers in words and figures, ranges, and facts of items with quantities and times."""

import pytest
from pyspark.sql import functions as F

from factloom.functions import quantities
from factloom.operators import items


@pytest.mark.parametrize(
    ("text", "values", "span"),
    [
        ("between 3 and 5 times", [3, 5], (3, 5)), ("20-30 pages", [20, 30], (20, 30)), ("from Thirty five to ninety-nine", [35, 99], (35, 99)), ("1,200 – 1,500.5 km", [1200, 1500.5], (1200, 1500.5)),
        ("5 to 3", [5, 3], None), ("one of someone's nineteen", [1, 19], None), ("eleven through 12", [11, 12], (11, 12)), ("", [], None), (None, [], None), ("no number", [], None), ("sixty", [60], None), ("seventeen", [17], None),
    ],
)
def test_numbers_and_ranges(spark, text, values, span):
    r = spark.createDataFrame([(text,)], "t string").select(quantities.numbers(F.col("t")).alias("n"), quantities.stated_range(F.col("t")).alias("r")).first()
    assert r["n"] == values and (r["r"] and tuple(r["r"])) == span


def test_all_words_up_to_99(spark):
    rows = spark.createDataFrame(list(quantities.WORDS.items()), "w string, n int").select("w", "n", quantities.numbers(F.concat(F.lit("about "), F.upper("w"), F.lit(" of them"))).alias("v"))
    assert rows.where(F.size("v") != 1).count() == 0 and rows.where(F.col("v")[0] != F.col("n")).count() == 0 and set(range(1, 100)) == set(quantities.WORDS.values())


def test_ranges_only_where_they_hold_the_value_or_count(spark):
    rows = [(25.0, "money", "20-30 euros"), (50.0, "money", "20-30 euros"), (50.0, "count", "20-30"), (None, "count", "20-30"), (None, "money", "20-30")]
    found = spark.createDataFrame(rows, "v double, u string, t string").select(quantities.quantity_range(F.col("v"), F.col("u"), F.col("t")).alias("r")).collect()
    assert [r["r"] and tuple(r["r"]) for r in found] == [(20, 30), None, (20, 30), (20, 30), None]


def test_items_with_times_objects_and_spans(spark):
    schema = "item_id string, user_id string, session_id string, span_id string, role string, session_time double, session_date string, predicate_raw string, event_type string, kind string, modality string, subject string, support_text string, occurred_start string, occurred_expr string, occurred_anchor string, confidence string, valid_from string, valid_until string, objects array<string>"
    base = ("u", "s", "sp", "user", 100.0, "2024-05-10", "lives in Rome", "other", "state", "current_state", "", "lives in old Rome", "", "", "", "0.9")
    rows = [("a", *base, "2024-02", "2024-03-05", ["Rome", " ", None, "rome"]), ("b", *base, "2024-03-05", "2023", None), ("c", *base, None, None, [])]
    spans = spark.createDataFrame([("sp", "She  LIVES in Old rome.")], "span_id string, text string")
    found = {r["item_id"]: r for r in items.facts_of_items(spark.createDataFrame(rows, schema), spans).collect()}
    assert [found[k]["valid_from"] for k in "abc"] == [1706745600.0, 1709596800.0, 100.0]
    assert [found[k]["valid_until"] for k in "abc"] == [1709596800.0, None, None]
    assert found["a"]["object_ids"] == ["entity_rome"] and found["a"]["exact"] and found["a"]["aligned"] == 1.0
    far = items.facts_of_items(spark.createDataFrame(rows, schema), spans.withColumn("text", F.lit("nothing of it"))).first()
    assert not far["exact"] and far["aligned"] == 0.0 and far["confidence"] < found["a"]["confidence"]
