"""From turns to facts: windows, provenance, session times and the maintenance fold.

The extractor's answers are an input table (items); nothing here calls a model.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.runs import Limits, Run
from ..functions.text import plain


def session_time(value: Column) -> Column:
    """Epoch seconds of a session's time string; null if it names none (a caller may then reject the row).

    Epoch numbers stay; partial dates mean the start of their period; a weekday in brackets is left out.
    """
    text = F.trim(F.regexp_replace(plain(value), r"\s*\([A-Za-z]+\)\s*", " "))
    dashed = F.regexp_replace(text, "/", "-")
    formats = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy-MM", "yyyy")
    parsed = F.coalesce(*(F.unix_micros(F.try_to_timestamp(dashed, F.lit(f))) for f in formats)) / 1_000_000
    number = F.when(text.rlike(r"^-?\d{5,}(\.\d+)?$"), text.try_cast("double"))
    return F.coalesce(number, parsed.cast("double"))


def spans(turns: DataFrame) -> DataFrame:
    """One span a turn with content, with its id and text hash; blank turns go, their places stay counted."""
    body = F.trim(plain(F.col("content")))
    return turns.where(body != "").select("user_id", "session_id", "turn_id", F.concat(F.lit("span_"), "session_id", F.lit("_"), F.col("idx").cast("string")).alias("span_id"), "idx", "role", F.col("content").alias("text"), F.sha2(F.col("content").cast("binary"), 256).alias("text_hash"), F.col("timestamp").alias("session_time"))


def extract_windows(turns: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """(user_id, session_id, window, first_idx, last_idx, n_turns, n_tokens, reason): greedy runs of a session's turns.

    A turn that would take a window over its tokens or characters opens the next one; a window with all
    its turns is closed; turns may overlap (``Limits``). Sessions are bounded conversations; they are folded one by one.
    """

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        run, closed = Run(limits), []
        for idx, tokens, chars in group.sort_values("idx")[["idx", "cost", "chars"]].itertuples(index=False):
            closed += run.add(int(idx), int(tokens), int(chars))
        closed += run.end()
        key = (group["user_id"].iloc[0], group["session_id"].iloc[0])
        return pd.DataFrame([(*key, *c) for c in closed], columns=["user_id", "session_id", "window", "first_idx", "last_idx", "n_turns", "n_tokens", "reason"])

    return costed(turns).groupBy("user_id", "session_id").applyInPandas(fold, "user_id string, session_id string, window int, first_idx long, last_idx long, n_turns int, n_tokens long, reason string")


def costed(turns: DataFrame) -> DataFrame:
    """Turns with content (user_id, session_id, idx, cost in tokens, chars and the other columns but content)."""
    cost = F.greatest(F.lit(1), F.floor(F.length(plain(F.col("content"))) / 4)).cast("long")
    there = turns.where(F.trim(plain(F.col("content"))) != "").withColumn("idx", F.col("idx").cast("long"))
    return there.withColumn("cost", cost).withColumn("chars", F.length("content").cast("long")).drop("content")


def parse_items(answers: DataFrame, text: str, schema: str) -> DataFrame:
    """answers with items: the JSON array in a model's answer, fenced or not; null if there is none."""
    body = F.regexp_replace(plain(F.col(text)), r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", "")
    array = F.regexp_extract(body, r"(?s)(\[.*\])", 1)
    one = F.regexp_extract(body, r"(?s)(\{.*\})", 1)
    chosen = F.when(F.trim(body).startswith("{"), F.concat(F.lit("["), one, F.lit("]"))).otherwise(array)
    return answers.withColumn("items", F.from_json(chosen, f"array<{schema}>"))


def stale_entities(facts: DataFrame, entity: str = "entity_id", time: str = "valid_from") -> DataFrame:
    """(user_id, entity, first_time, last_time, n_new): what a profile refresh has to look at."""
    return facts.groupBy("user_id", entity).agg(F.min(time).alias("first_time"), F.max(time).alias("last_time"), F.count(F.lit(1)).alias("n_new"))


def drain(stale: DataFrame, batch: int, order: str = "staleness") -> DataFrame:
    """The next entities of each user to refresh: by oldest change, by most new facts, or first in first out."""
    by = {"staleness": [F.col("last_time")], "delta": [F.desc("n_new")], "fifo": [F.col("first_time")]}[order]
    return stale.select("*", F.row_number().over(Window.partitionBy("user_id").orderBy(*by, stale.columns[1])).alias("position")).where(F.col("position") <= batch)


def jsonl_messages(lines: DataFrame, after: int = 0) -> tuple[DataFrame, DataFrame]:
    """(messages, bad lines) of a transcript's lines (n, value): text blocks of users and assistants after a line."""
    parsed = lines.where(F.col("n") > after).select("n", "value", F.from_json("value", "type string, message struct<role: string, content: string>, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    bad = parsed.where(F.col("r._bad").isNotNull() | F.col("r").isNull()).select("n", "value")
    blocks = F.from_json("r.message.content", "array<struct<type: string, text: string>>")
    text = F.when(F.col("r.message.content").startswith("["), F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")).otherwise(F.col("r.message.content"))
    good = parsed.where(F.col("r._bad").isNull() & F.col("r.message.role").isin("user", "assistant")).select("n", F.col("r.message.role").alias("role"), text.alias("content"))
    return good.where(F.trim(plain(F.col("content"))) != ""), bad

