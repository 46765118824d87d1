"""Chat formatting by quotation linking.

Lines that begin with ``>`` are quoted, as deep as they have such marks. Quoted passages
and their lines are normalised and hashed, and so are the texts, paragraphs and lines that
messages write themselves. A message answers the earlier message that wrote most of what it
quotes at the shallowest level that any earlier message wrote: one of its own conversation
or, for what is quoted from elsewhere, the earliest writer anywhere (on a tie its own
conversation's). Without such a quotation it answers the turn before it. Conversations that
quotations tie together become one thread, in an order in which every reply follows what it
answers, and quotations are left out of the texts.

Links within a conversation are found by an equi-join on conversation and hash; all levels
are looked up, here and there. Across conversations only the earliest writer of each hash is looked up, which is aggregated
before it is shuffled: a passage in very many messages makes no pairs.

Defined results for edge cases: a null or empty text writes and quotes nothing and stays as
an empty message; very long texts are parsed whole; repeated rows (same conversation and
turn) each stay, next to each other; a null conversation or turn sorts first and answers
nothing; an empty table gives an empty result; further columns of the input do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise
from .components import components

_MARKS = re.compile(r"^((?:[ \t]*>)+)[ \t]?(.*)$", re.S)
#: A line that only introduces a quotation ("On Monday X wrote:").
_INTRODUCES = re.compile(r"^\s*(?:on\b.*\bwrote|.*\b(?:wrote|said|schrieb|écrit|escribió))\s*:\s*$", re.I)


def levels(text: str | None) -> list[tuple[int, str]]:
    """(quote level, passage) of a text: neighbouring lines of one level are one passage."""
    out: list[list] = []
    for line in (text or "").split("\n"):
        m = _MARKS.match(line)
        depth, body = (m[1].count(">"), m[2]) if m else (0, line)
        if out and out[-1][0] == depth:
            out[-1][1].append(body)
        else:
            out.append([depth, [body]])
    return [(d, "\n".join(b)) for d, b in out]


def own_text(parts: list[tuple[int, str]]) -> str:
    """What the message says itself; lines that only introduce a quotation go."""
    kept = []
    for k, (depth, body) in enumerate(parts):
        if depth == 0:
            lines = body.rstrip("\n").split("\n")
            if k + 1 < len(parts) and _INTRODUCES.match(lines[-1]):
                lines.pop()
            kept.append("\n".join(lines))
    return "\n".join(kept).strip()


def normalise(passage: str) -> str:
    return " ".join(passage.lower().split())


def units(passage: str) -> dict[str, int]:
    """Hash and length of a passage, its paragraphs and its lines."""
    parts = {normalise(p) for p in (passage, *re.split(r"\n\s*\n", passage), *passage.split("\n"))}
    return {xxhash.xxh3_128_hexdigest(p.encode("utf-8", "replace")): len(p) for p in parts if p}


def _parse(messages: DataFrame, conv: str, turn: str, text: str) -> DataFrame:
    """(conv, turn, said, n_quotes, wrote array, quoted array of (depth, hash, size)) of each distinct message."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t in b["_text"]:
                parts = levels(t)
                quotes = [(d, p) for d, p in parts if d > 0 and p.strip()]
                said = own_text(parts)
                quoted = {(d, h): n for d, p in quotes for h, n in units(p).items()}
                rows.append((said, len(quotes), list(units(said)), [{"depth": d, "hash": h, "size": n} for (d, h), n in quoted.items()]))
            yield pd.concat([b[["conv", "turn", "role"]].reset_index(drop=True), pd.DataFrame(rows, columns=["said", "n_quotes", "wrote", "quoted"])], axis=1)

    # Numbers travel as text: pandas would turn whole numbers with nulls among them into floats.
    given = messages.select(F.col(conv).cast("string").alias("conv"), F.col(turn).cast("string").alias("turn"), F.col("role").cast("string").alias("role"), F.col(text).alias("_text"))
    done = given.mapInPandas(parse, "conv string, turn string, role string, said string, n_quotes int, wrote array<string>, quoted array<struct<depth: int, hash: string, size: long>>")
    return done.withColumns({"conv": F.col("conv").cast("long"), "turn": F.col("turn").cast("long")})


def link(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """(conv, turn, role, thread_id, position, parent_conv, parent_turn, link, n_quotes, text) of each message.

    link is quote, turn or root, for how the message is tied to its parent.
    """
    parsed = materialise(_parse(messages, conv, turn, text), "messages")
    wrote = parsed.select("conv", "turn", F.explode("wrote").alias("hash"))
    quoted = parsed.where(F.size("quoted") > 0).select("conv", "turn", F.explode("quoted").alias("_q")).select("conv", "turn", "_q.depth", "_q.hash", "_q.size").distinct()
    near = quoted.join(wrote.select("conv", F.col("turn").alias("p_turn"), "hash").distinct(), ["conv", "hash"]).where(F.col("p_turn") < F.col("turn"))
    near = near.groupBy("conv", "turn", "depth", F.col("conv").alias("p_conv"), "p_turn").agg(F.sum("size").alias("size"))
    # Only hashes that are quoted are looked up, each at its earliest writer.
    earliest = wrote.join(quoted.select("hash").distinct(), "hash", "left_semi").groupBy("hash").agg(F.min(F.struct("conv", "turn")).alias("_e"))
    far = quoted.join(earliest, "hash").where((F.struct(F.col("_e.conv"), F.col("_e.turn")) < F.struct("conv", "turn")) & ~F.col("_e.conv").eqNullSafe(F.col("conv")))
    far = far.groupBy("conv", "turn", "depth", F.col("_e.conv").alias("p_conv"), F.col("_e.turn").alias("p_turn")).agg(F.sum("size").alias("size"))
    either = near.withColumn("home", F.lit(True)).unionByName(far.withColumn("home", F.lit(False)))
    best = either.groupBy("conv", "turn").agg(F.max(F.struct((-F.col("depth")).alias("level"), "size", "home", "p_conv", "p_turn")).alias("_b"))
    best = materialise(best.select("conv", "turn", F.col("_b.p_conv").alias("p_conv"), F.col("_b.p_turn").alias("p_turn")), "quotation-links")

    tied = components(best.where(F.col("conv") != F.col("p_conv")).select("conv", "p_conv"), "conv", "p_conv")
    turns = parsed.select("conv", "turn").distinct().select("*", F.lag("turn").over(Window.partitionBy("conv").orderBy("turn")).alias("before"))
    placed = turns.join(best, ["conv", "turn"], "left").join(tied, F.col("conv") == F.col("node"), "left")
    placed = placed.select(
        "conv", "turn", F.coalesce("component", "conv").alias("thread_id"),
        F.when(F.col("p_turn").isNotNull(), F.col("p_conv")).when(F.col("before").isNotNull(), F.col("conv")).alias("parent_conv"),
        F.coalesce("p_turn", "before").alias("parent_turn"),
        F.when(F.col("p_turn").isNotNull(), "quote").when(F.col("before").isNotNull(), "turn").otherwise("root").alias("link"),
    )
    joined = parsed.alias("m").join(placed.alias("p"), F.col("m.conv").eqNullSafe(F.col("p.conv")) & F.col("m.turn").eqNullSafe(F.col("p.turn")))
    # A parent is always earlier by (conversation, turn), so this order is one of replies.
    order = Window.partitionBy("thread_id").orderBy(F.col("m.conv"), F.col("m.turn"), "role", "said")
    return joined.select(F.col("m.conv").alias(conv), F.col("m.turn").alias(turn), "role", "thread_id", F.row_number().over(order).alias("position"), "parent_conv", "parent_turn", "link", "n_quotes", F.col("said").alias("text"))


def threads(linked: DataFrame) -> DataFrame:
    """(thread_id, messages): each thread as an array of (role, content) in reply order."""
    each = F.struct("position", "role", F.col("text").alias("content"))
    return linked.groupBy("thread_id").agg(F.transform(F.sort_array(F.collect_list(each)), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


#: The same in DuckDB's SQL, where no message quotes at several levels or from home and elsewhere.
ORACLE = r"""
WITH RECURSIVE lines AS (
  SELECT conv_id, turn, role, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k
  FROM conversations),
leveled AS (
  SELECT *, length(regexp_replace(regexp_extract(line, '^((?:[ \t]*>)+)', 1), '[^>]', '', 'g')) AS depth,
         regexp_replace(line, '^(?:[ \t]*>)+[ \t]?', '') AS body
  FROM lines),
runs AS (SELECT *, k - row_number() OVER (PARTITION BY conv_id, turn, role, depth ORDER BY k) AS run FROM leveled),
passage AS (
  SELECT conv_id, turn, role, depth, string_agg(body, chr(10) ORDER BY k) AS p, min(k) AS k
  FROM runs GROUP BY conv_id, turn, role, depth, run),
intro AS (
  SELECT *, lead(depth) OVER (PARTITION BY conv_id, turn, role ORDER BY k) AS next_depth,
         regexp_replace(p, '\n+$', '') AS trimmed
  FROM passage),
said AS (
  SELECT conv_id, turn, role, k, depth, p,
         CASE WHEN depth = 0 THEN CASE WHEN next_depth IS NOT NULL AND regexp_matches(string_split(trimmed, chr(10))[-1], '(?i)^\s*(?:on\b.*\bwrote|.*\b(?:wrote|said|schrieb|écrit|escribió))\s*:\s*$')
              THEN array_to_string(string_split(trimmed, chr(10))[:-2], chr(10)) ELSE trimmed END END AS own
  FROM intro),
msg AS (
  SELECT conv_id, turn, role, coalesce(regexp_replace(string_agg(own, chr(10) ORDER BY k), '^\s+|\s+$', '', 'g'), '') AS text,
         (count(*) FILTER (depth > 0 AND regexp_matches(p, '\S')))::INT AS n_quotes,
         min(depth) FILTER (depth > 0 AND regexp_matches(p, '\S')) AS first_depth
  FROM said GROUP BY conv_id, turn, role),
unit_text AS (
  SELECT conv_id, turn, 'w' AS kind, unnest(list_concat([text], list_concat(regexp_split_to_array(text, '\n\s*\n'), string_split(text, chr(10))))) AS u FROM msg
  UNION ALL
  SELECT s.conv_id, s.turn, 'q', unnest(list_concat([p], list_concat(regexp_split_to_array(p, '\n\s*\n'), string_split(p, chr(10)))))
  FROM said s JOIN msg m ON s.conv_id = m.conv_id AND s.turn = m.turn AND s.depth = m.first_depth),
unit AS (
  SELECT DISTINCT conv_id, turn, kind, trim(regexp_replace(lower(u), '\s+', ' ', 'g')) AS u FROM unit_text),
w AS (SELECT * FROM unit WHERE kind = 'w' AND u <> ''),
q AS (SELECT * FROM unit WHERE kind = 'q' AND u <> ''),
near AS (
  SELECT q.conv_id, q.turn, w.conv_id AS p_conv, w.turn AS p_turn, sum(length(q.u)) AS size
  FROM q JOIN w ON q.conv_id = w.conv_id AND q.u = w.u AND w.turn < q.turn GROUP BY ALL),
far AS (
  SELECT q.conv_id, q.turn, e.conv_id AS p_conv, e.turn AS p_turn, sum(length(q.u)) AS size
  FROM q JOIN (SELECT u, min_by(conv_id, (conv_id, turn)) AS conv_id, min_by(turn, (conv_id, turn)) AS turn FROM w GROUP BY u) e ON q.u = e.u
  WHERE (e.conv_id, e.turn) < (q.conv_id, q.turn) AND NOT EXISTS (SELECT 1 FROM near n WHERE n.conv_id = q.conv_id AND n.turn = q.turn) GROUP BY ALL),
best AS (
  SELECT conv_id, turn, max((size, p_conv, p_turn)) AS b FROM (SELECT * FROM near UNION ALL SELECT * FROM far) GROUP BY conv_id, turn),
tie AS (
  SELECT conv_id AS a, b[2] AS b FROM best WHERE conv_id <> b[2] UNION SELECT b[2], conv_id FROM best WHERE conv_id <> b[2]),
reach AS (SELECT DISTINCT conv_id AS c, conv_id AS o FROM msg UNION SELECT r.c, t.b FROM reach r JOIN tie t ON r.o = t.a),
thread AS (SELECT c, min(o) AS thread_id FROM reach GROUP BY c)
SELECT m.conv_id, m.turn, m.role, thread_id, (row_number() OVER (PARTITION BY thread_id ORDER BY m.conv_id, m.turn, m.role, m.text))::INT AS position,
       CASE WHEN b IS NOT NULL THEN b[2] WHEN lag(m.turn) OVER w IS NOT NULL THEN m.conv_id ELSE -1 END AS parent_conv,
       coalesce(b[3], lag(m.turn) OVER w, -1) AS parent_turn,
       CASE WHEN b IS NOT NULL THEN 'quote' WHEN lag(m.turn) OVER w IS NOT NULL THEN 'turn' ELSE 'root' END AS link,
       n_quotes, m.text
FROM msg m LEFT JOIN best ON m.conv_id = best.conv_id AND m.turn = best.turn JOIN thread ON m.conv_id = c
WINDOW w AS (PARTITION BY m.conv_id ORDER BY m.turn)
"""
