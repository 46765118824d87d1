"""Windows of extraction over a stream of turns, closed by their limits or by a timer."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.runs import Limits, Run

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The state store that list state and timers need, for queries that start inside."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


class _Sessions(StatefulProcessor):
    """State of a session: the turns of its open window, its number, and the time of its last turn."""

    def __init__(self, limits: Limits, idle_ms: int):
        self.limits, self.idle_ms = limits, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "idx long, tokens long, chars long")
        self.at = handle.getValueState("at", "number int, last_ms long")

    def _rows(self, key: tuple, closed: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(*key, *c) for c in closed], columns=["user_id", "session_id", "window", "first_idx", "last_idx", "n_turns", "n_tokens", "reason"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at = self.at.get() if self.at.exists() else None
        run = Run(self.limits, at[0] if at else 0, [tuple(t) for t in self.open.get()] if at else [])
        last, closed = at[1] if at else None, []
        batch = pd.concat(list(rows)).sort_values("idx")
        for idx, cost, chars, ms in batch[["idx", "cost", "chars", "ms"]].itertuples(index=False):
            if last is not None and ms - last > self.idle_ms:
                closed += run.end()  # the timer's work, where later turns come in the batch that would fire it
            closed += run.add(int(idx), int(cost), int(chars))
            last = int(ms) if last is None else max(last, int(ms))
        self.open.put(run.turns) if run.turns else self.open.clear()
        self.at.update((run.number, last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last + self.idle_ms)
        yield self._rows(key, closed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        run = Run(self.limits, self.at.get()[0], [tuple(t) for t in self.open.get()])
        self.open.clear()
        self.at.clear()
        yield self._rows(key, run.end())

    def close(self) -> None:
        pass


def extract_windows(turns: DataFrame, limits: Limits, time: str, delay: str, idle_ms: int) -> DataFrame:
    """Windows of a stream's sessions: (user_id, session_id, window, first_idx, last_idx, n_turns, n_tokens, reason).

    turns (user_id, session_id, idx, cost, chars, ms and the column ``time``, a timestamp; ms is the same in
    milliseconds). A session ends when no turn comes for more than idle_ms of event time: by a timer once
    the watermark (``delay`` behind the latest turn) has passed that time, or when a later turn of the same session
    shows it. Its state is then gone, and windows are numbered from 0 again. Within a session turns
    are taken in the order of idx within a batch, and a batch is expected to bring later turns than the
    one before. The state of a session is one open window.
    """
    out = "user_id string, session_id string, window int, first_idx long, last_idx long, n_turns int, n_tokens long, reason string"
    late = turns.withWatermark(time, delay)
    return late.groupBy("user_id", "session_id").transformWithStateInPandas(_Sessions(limits, idle_ms), out, "Append", "EventTime")
