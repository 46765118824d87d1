"""Trees in JSON: merged, and with ids replaced, as rows of their leaves.

A tree is taken apart level by level (``leaves``), changed or aggregated as rows, and put together from the deepest level
up (``tree``), so that trees of any depth are handled by a few joins for all rows at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.storage import kept

_PATH = "array<struct<key:string,pos:int>>"


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def quoted(text: Column) -> Column:
    """A text as JSON: that of a list of it, without the brackets."""
    one = F.to_json(F.array(text))
    return F.substring(one, F.lit(2), F.length(one) - 2)


def leaves(rows: DataFrame, group: Sequence[str], text: str, into_lists: bool = True) -> DataFrame:
    """(group, path, value, kind): one row a leaf of each row's JSON; value is its JSON text, path the keys and places that lead to it.

    kind is 'number', 'list', 'object' or 'other'. Lists are leaves unless into_lists; empty lists and objects are leaves always. A text
    that is no JSON, or null, has no leaves.
    """
    now = rows.select(*group, F.array().cast(_PATH).alias("path"), F.try_parse_json(text).alias("v")).where(F.col("v").isNotNull())
    now = kept(now.select(*group, "path", F.to_json("v").alias("value"), _kind(F.col("v")).alias("kind")), "leaves")
    found = None
    while True:
        inner = F.col("kind").startswith("OBJECT") & (F.col("value") != "{}")
        if into_lists:
            inner = inner | (F.col("kind").startswith("ARRAY") & (F.col("value") != "[]"))
        done = now.where(~inner)
        found = done if found is None else found.unionByName(done)
        more = now.where(inner)
        if not more.limit(1).count():
            break
        child = more.sparkSession.tvf.variant_explode(F.parse_json(F.col("value").outer())).select(F.col("pos"), F.col("key"), F.col("value").alias("v"))
        below = more.lateralJoin(child).select(*group, F.array_append("path", F.struct("key", "pos")).cast(_PATH).alias("path"), F.coalesce(F.to_json("v"), F.lit("null")).alias("value"), F.coalesce(_kind(F.col("v")), F.lit("VOID")).alias("kind"))
        now = kept(below, "leaves")
    named = F.when(F.col("kind").rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|TINYINT|SMALLINT)"), "number").when(F.col("kind").startswith("ARRAY"), "list").when(F.col("kind").startswith("OBJECT"), "object").otherwise("other")
    return found.withColumn("kind", named)


def tree(leaf_rows: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, json): trees put together from rows (group, path, value). Keys come in alphabetical order, list entries by place."""
    now = kept(leaf_rows.select(*group, "path", "value"), "tree")
    depth = now.agg(F.max(F.size("path"))).first()[0] or 0
    for level in range(depth, 0, -1):
        at = now.where(F.size("path") == level).select(*group, F.slice("path", 1, level - 1).alias("path"), F.element_at("path", -1).alias("_e"), "value")
        entry = F.when(F.col("_e.key").isNull(), F.col("value")).otherwise(F.concat(quoted(F.col("_e.key")), F.lit(":"), F.col("value")))
        listed = at.groupBy(*group, "path").agg(F.array_sort(F.collect_list(F.struct(F.col("_e.key").alias("k"), F.col("_e.pos").alias("p"), entry.alias("t")))).alias("_l"))
        inner = F.array_join(F.transform("_l", lambda x: x["t"]), ",")
        joined = listed.select(*group, "path", F.when(F.col("_l")[0]["k"].isNull(), F.concat(F.lit("["), inner, F.lit("]"))).otherwise(F.concat(F.lit("{"), inner, F.lit("}"))).alias("value"))
        now = kept(now.where(F.size("path") < level).unionByName(joined), "tree")
    return now.select(*group, F.col("value").alias("json"))


def names(path: Column) -> Column:
    """A path's keys, joined by dots; places of lists in brackets."""
    return F.array_join(F.transform(path, lambda p: F.coalesce(p["key"], F.concat(F.lit("["), p["pos"].cast("string"), F.lit("]")))), ".")


def merged(rows: DataFrame, group: Sequence[str], order: str, text: str, sets: Sequence[str] = ()) -> DataFrame:
    """(group, path, value, kind): the leaves of a group's trees as one tree; ``tree`` puts it together.

    Numbers at one path are added, lists follow each other in order, those under a key in ``sets`` keep each
    entry once, of anything else the first counts. Where kinds differ at a path the last kind counts.
    """
    every = leaves(rows, [*group, order], text, into_lists=False)
    # Keys alone say where a leaf is: places differ with the keys that a tree has.
    every = every.withColumn("path", F.transform("path", lambda p: F.struct(p["key"].alias("key"), F.lit(0).alias("pos"))).cast(_PATH))
    last = Window.partitionBy(*group, "path")
    same = every.withColumn("_last", F.max_by("kind", order).over(last)).where(F.col("kind") == F.col("_last"))
    lists = F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "list", F.struct(order, "value")))), lambda x: F.transform(F.parse_json(x["value"]).cast("array<variant>"), lambda e: F.coalesce(F.to_json(e), F.lit("null")))))
    whole = F.bool_and(F.col("value").rlike(r"^-?\d+$"))
    total = F.when(whole, F.sum(F.col("value").try_cast("decimal(38,0)")).cast("string")).otherwise(F.sum(F.col("value").try_cast("double")).cast("string"))
    by = same.groupBy(*group, "path", "kind").agg(total.alias("_n"), lists.alias("_l"), F.min_by("value", order).alias("_first"))
    distinct = F.element_at("path", -1)["key"].isin(*sets) if sets else F.lit(False)
    entries = F.when(distinct, F.array_distinct("_l")).otherwise(F.col("_l"))
    value = F.when(F.col("kind") == "number", F.col("_n")).when(F.col("kind") == "list", F.concat(F.lit("["), F.array_join(entries, ","), F.lit("]"))).otherwise(F.col("_first"))
    return by.select(*group, "path", value.alias("value"), "kind")


def aliased(rows: DataFrame, group: Sequence[str], text: str, aliases: DataFrame, id_: str, alias: str, within: Sequence[str] | None = None) -> DataFrame:
    """(group, json): each row's tree with every text that is an id replaced by its alias, at any depth.

    group tells rows from each other; aliases (within, id, alias) hold for all rows of ``within``, a part of group (all of it if not given).
    """
    found, within = leaves(rows, group, text), list(group if within is None else within)
    known = aliases.select(*within, quoted(F.col(id_)).alias("value"), quoted(F.col(alias)).alias("_alias"))
    return tree(found.join(known, [*within, "value"], "left").withColumn("value", F.coalesce("_alias", "value")), group)
