"""Queries of streams that come in several runs: timers, resumption, late and repeated rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.runs import Limits
from ..operators import ingest
from ..sources.adapters import START, facts, turns
from ..sources.storage import shared_folder
from ..streaming import recent, state, windows
from ..streaming.ledger import Ledger, run_in_slices, undrained
from .writing import SQL_FACTS, SQL_TURNS

QUERIES: dict = {}
ORACLES: dict = {}


def _query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


#: Microseconds at which slices of the events begin: the 8th, 16th and 24th of January 2024.
DAYS = [1704672000000000, 1705363200000000, 1706054400000000]
#: Late arrival: each fact comes up to six days after its time.
LATE = 86400000000
SQL_LATE = f"WITH {SQL_FACTS}, late AS (SELECT *, valid_from + (seq % 7) * {LATE} AS arrived FROM facts), sliced AS (SELECT *, CASE WHEN arrived < {DAYS[0]} THEN 0 WHEN arrived < {DAYS[1]} THEN 1 WHEN arrived < {DAYS[2]} THEN 2 ELSE 3 END AS slice FROM late)"


def _run(df: DataFrame, bounds: list, by: str, make: Callable[[DataFrame], DataFrame], mode: str, again: bool = False, fail: Callable[[int], None] | None = None, sink: Callable[[Ledger], Callable] | None = None) -> Ledger:
    """The ledger of a stream over df that comes in slices, each read by a run of its own. sink: what writes its batches, if not the ledger."""
    spark = df.sparkSession
    root = shared_folder(spark, "stream")
    ledger = Ledger(spark, f"{root}/out")

    def start(k: int):
        stream = make(spark.readStream.schema(df.schema).parquet(f"{root}/in"))
        return stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(sink(ledger) if sink else ledger.sink(fail)).start()

    with windows.state_store(spark):
        run_in_slices(df, f"{root}/in", bounds, by, start, again)
    return ledger


def _fails_once(at: int) -> Callable[[int], None]:
    """Stops a stream after batch ``at`` is written and before the stream's own commit, the first time."""
    left = [at]

    def fail(batch: int) -> None:
        if batch in left:
            left.remove(batch)
            raise RuntimeError("stopped between the sink and the commit")

    return fail


def _arrivals(spark: SparkSession, d: str) -> DataFrame:
    return facts(spark, d).withColumn("arrived", F.col("valid_from") + (F.col("seq") % 7) * LATE).withColumn("time", F.timestamp_micros("valid_from"))


@_query("stream_windows", f"""
WITH RECURSIVE {SQL_TURNS}, c AS (SELECT user_id, session_id, idx, greatest(1, length(content) // 4) AS cost, length(content) AS chars, row_number() OVER (PARTITION BY session_id ORDER BY idx) AS k,
    (substr(session_id, 2)::BIGINT * 3600 + {int(START)}) * 1000 + idx AS ms FROM turns WHERE trim(content) <> ''),
walk AS (
  SELECT user_id, session_id, k, idx, ms, cost, chars, 0 AS win, idx AS first, 1 AS n, cost AS tokens, chars AS total,
    NULL::INTEGER AS w, NULL::BIGINT AS w_first, NULL::BIGINT AS w_last, NULL::INTEGER AS w_n, NULL::BIGINT AS w_tokens, NULL::VARCHAR AS reason FROM c WHERE k = 1
  UNION ALL
  SELECT user_id, session_id, k, idx, ms, cost, chars,
    CASE WHEN why IS NULL THEN win ELSE win + 1 END, CASE WHEN why = 'max_turns' THEN idx WHEN why IS NOT NULL THEN p_idx ELSE first END, CASE WHEN why = 'max_turns' THEN 1 WHEN why IS NOT NULL THEN 2 ELSE n + 1 END,
    CASE WHEN why = 'max_turns' THEN cost WHEN why IS NOT NULL THEN p_cost + cost ELSE tokens + cost END, CASE WHEN why = 'max_turns' THEN chars WHEN why IS NOT NULL THEN p_chars + chars ELSE total + chars END,
    CASE WHEN why IS NOT NULL THEN win END, CASE WHEN why IS NOT NULL THEN first END, CASE WHEN why = 'max_turns' THEN idx WHEN why IS NOT NULL THEN p_idx END,
    CASE WHEN why = 'max_turns' THEN n + 1 WHEN why IS NOT NULL THEN n END, CASE WHEN why = 'max_turns' THEN tokens + cost WHEN why IS NOT NULL THEN tokens END, why
  FROM (SELECT c.*, w.win, w.first, w.n, w.tokens, w.total, w.idx AS p_idx, w.cost AS p_cost, w.chars AS p_chars,
          CASE WHEN w.tokens + c.cost > 400 THEN 'max_tokens' WHEN w.total + c.chars > 1500 THEN 'max_chars' WHEN w.n + 1 >= 4 THEN 'max_turns' END AS why
        FROM walk w JOIN c ON c.session_id = w.session_id AND c.k = w.k + 1) s),
ends AS (SELECT session_id, max(k) AS k, max(ms) AS ms FROM c GROUP BY session_id)
SELECT user_id, session_id, w AS "window", w_first AS first_idx, w_last AS last_idx, w_n AS n_turns, w_tokens::BIGINT AS n_tokens, reason FROM walk WHERE reason IS NOT NULL
UNION ALL SELECT user_id, session_id, win, first, idx, n, tokens::BIGINT, 'session_end' FROM walk JOIN ends USING (session_id, k) WHERE ends.ms + 600000 <= (SELECT max(ms) FROM c) - 60000""")  # fmt: skip
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Sessions end by a timer, ten minutes after their last turn; one that is that late at the end is still open."""
    ms = F.expr(f"(cast(substr(session_id, 2) as bigint) * 3600 + {int(START)}) * 1000 + idx")
    given = ingest.costed(turns(spark, d)).select("user_id", "session_id", "idx", "cost", "chars", ms.alias("ms"))
    given = given.withColumn("time", F.timestamp_millis("ms"))
    low, high = given.agg(F.min("ms"), F.max("ms")).first()
    bounds = [low + (high - low) * k // 4 for k in (1, 2, 3)] if low is not None else []
    make = lambda stream: windows.extract_windows(stream, Limits(400, 4, 1500, 1), "time", "1 minute", 600_000)
    return _run(given, bounds, "ms", make, "append").read().drop("batch")


@_query("stream_dirty_bits", f"WITH {SQL_FACTS} SELECT user_id, count(*) AS n_new, min(valid_from) AS first, max(valid_from) AS last FROM facts GROUP BY user_id")
def stream_dirty_bits(spark: SparkSession, d: str) -> DataFrame:
    """Running counts in update mode over four runs, one of which is stopped before its commit."""
    f = facts(spark, d).select("user_id", "valid_from")
    ledger = _run(f, DAYS, "valid_from", lambda s: state.dirty_counters(s, "user_id"), "update", fail=_fails_once(2))
    return ledger.latest("user_id").drop("batch")


@_query("stream_undrained", f"WITH {SQL_FACTS} SELECT user_id, count(*) FILTER (valid_from >= {DAYS[1]}) AS n_new, min(valid_from) AS first, max(valid_from) AS last FROM facts GROUP BY user_id HAVING count(*) FILTER (valid_from >= {DAYS[1]}) > 0")
def stream_undrained(spark: SparkSession, d: str) -> DataFrame:
    """What is left to refresh after the counts of the first two runs were drained."""
    f = facts(spark, d).select("user_id", "valid_from")
    ledger = _run(f, DAYS, "valid_from", lambda s: state.dirty_counters(s, "user_id"), "update")
    drained = ledger.read().where(F.col("batch") < 2).select("user_id", F.col("n_new").alias("n"))
    return undrained(ledger.latest("user_id").drop("batch"), drained, "user_id")


@_query("stream_resume", f"WITH {SQL_TURNS} SELECT turn_id, user_id, session_id, 1::BIGINT AS times FROM turns")
def stream_resume(spark: SparkSession, d: str) -> DataFrame:
    """Each turn once, although a run is stopped between its sink and its commit and written again."""
    t = turns(spark, d).select("turn_id", "user_id", "session_id", "timestamp")
    low, high = t.agg(F.min("timestamp"), F.max("timestamp")).first()
    bounds = [low + (high - low) * k / 3 for k in (1, 2)] if low is not None else []
    rows = _run(t, bounds, "timestamp", lambda s: s, "append", fail=_fails_once(1)).read()
    return rows.groupBy("turn_id", "user_id", "session_id").agg(F.count(F.lit(1)).alias("times"))


@_query("stream_idempotent", f"WITH {SQL_FACTS} SELECT user_id, count(*) AS n, sum(seq)::BIGINT AS total FROM facts GROUP BY user_id")
def stream_idempotent(spark: SparkSession, d: str) -> DataFrame:
    """Each fact once, although each slice also brings the one before again."""
    f = facts(spark, d).select("user_id", "fact_id", "seq", "valid_from", F.timestamp_micros("valid_from").alias("time"))
    rows = _run(f, DAYS, "valid_from", lambda s: state.idempotent(s, "fact_id", "time", "9 days"), "append", again=True).read()
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("total"))


@_query("stream_late_windows", SQL_LATE + f""",
marks AS (SELECT s.slice, coalesce(max(l.valid_from), 0) - 3 * {LATE} AS mark FROM (SELECT DISTINCT slice FROM sliced) s LEFT JOIN sliced l ON l.slice < s.slice GROUP BY s.slice),
w AS (SELECT slice, valid_from, valid_from // 21600000000 * 21600000000 AS start FROM sliced)
SELECT start, count(*) AS n FROM w JOIN marks USING (slice) WHERE start + 21600000000 > mark GROUP BY start HAVING start + 21600000000 <= (SELECT max(valid_from) FROM facts) - 3 * {LATE}""")
def stream_late_windows(spark: SparkSession, d: str) -> DataFrame:
    """Counts of six hours by a stream in order of arrival: rows are taken up to three days late, later ones are not."""
    f = _arrivals(spark, d).select("event_type", F.col("quantity").alias("value"), "arrived", "time")
    rows = _run(f, DAYS, "arrived", lambda s: state.windowed(s, "time", "6 hours", None, "3 days", []), "append").read()
    return rows.select(F.unix_micros("window.start").alias("start"), "n")


@_query("stream_ring", f"""WITH {SQL_FACTS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY valid_from DESC, seq DESC) AS k FROM facts)
SELECT user_id, count(*) AS n, min(valid_from) AS first, max(valid_from) AS last, min(quantity) AS least, max(quantity) AS most FROM r WHERE k <= 20 GROUP BY user_id""")
def stream_ring(spark: SparkSession, d: str) -> DataFrame:
    """The last twenty samples of each user, from facts that come late."""
    f = _arrivals(spark, d).select("user_id", F.col("valid_from").alias("at"), F.col("seq").alias("id"), F.col("quantity").cast("double").alias("value"), "arrived")
    ledger = _run(f, DAYS, "arrived", lambda s: recent.ring(s.drop("arrived"), ["user_id"], 20), "update")
    return ledger.latest("user_id").drop("batch")


@_query("stream_supersede", SQL_LATE + """, k AS (SELECT *, 'f' || lpad(seq::VARCHAR, 12, '0') AS id FROM sliced),
r AS (SELECT *, max((valid_from, id)) OVER (PARTITION BY user_id, event_type ORDER BY slice, valid_from, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM k),
m AS (SELECT *, top IS NULL OR (valid_from, id) > top AS leads FROM r),
n AS (SELECT *, lead((valid_from, id)) OVER (PARTITION BY user_id, event_type, leads ORDER BY slice, valid_from, id) AS nxt FROM m)
SELECT user_id, event_type, id AS loser, CASE WHEN leads THEN nxt[2] ELSE top[2] END AS winner, CASE WHEN leads THEN nxt[1] ELSE top[1] END AS valid_until FROM n WHERE NOT leads OR nxt IS NOT NULL""")
def stream_supersede(spark: SparkSession, d: str) -> DataFrame:
    """Closings of facts that come late: a fact that its slot's head outranks is closed on arrival."""
    f = _arrivals(spark, d).select("user_id", "event_type", F.concat(F.lit("f"), F.lpad(F.col("seq").cast("string"), 12, "0")).alias("fact_id"), "valid_from", "arrived")
    sink = lambda ledger: state.superseding(ledger, Ledger(spark, f"{ledger.root}-heads"), ["user_id", "event_type"])
    return _run(f, DAYS, "arrived", lambda s: s, "append", sink=sink).read().drop("batch")
