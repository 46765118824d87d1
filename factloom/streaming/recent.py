"""The last samples of a key over a stream, in any order of arrival."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class _Ring(StatefulProcessor):
    def __init__(self, most: int, ttl_ms: int | None, keys: list[str]):
        self.most, self.ttl_ms, self.keys = most, ttl_ms, keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getValueState("ring", "at array<long>, id array<long>, value array<double>", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = {(int(at), int(i)): v for at, i, v in zip(*self.ring.get(), strict=True)} if self.ring.exists() else {}
        for batch in rows:
            held.update({(int(at), int(i)): None if pd.isna(v) else float(v) for at, i, v in batch[["at", "id", "value"]].itertuples(index=False)})
            held = {k: held[k] for k in sorted(held)[-self.most :]}
        self.ring.update(([k[0] for k in held], [k[1] for k in held], list(held.values())))
        values = [v for v in held.values() if v is not None]
        yield pd.DataFrame([(*key, len(held), min(held)[0], max(held)[0], min(values, default=None), max(values, default=None))], columns=[*self.keys, "n", "first", "last", "least", "most"])

    def close(self) -> None:
        pass


def ring(samples: DataFrame, keys: list[str], most: int, ttl_ms: int | None = None) -> DataFrame:
    """(keys, n, first, last, least, most) of the last ``most`` samples of each key, at each batch that brings one.

    samples (keys, at long, id long, value double). Late samples go to their place by (at, id) or fall out;
    a sample that comes again is held once. With ttl_ms, state that gets no sample for that processing time is
    gone; such a stream looks at the clock for ever, so it needs a trigger other than availableNow. To
    be written in update mode.
    """
    kinds = {f.name: f.dataType.simpleString() for f in samples.schema}
    out = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "n long, first long, last long, least double, most double"])
    return samples.groupBy(*keys).transformWithStateInPandas(_Ring(most, ttl_ms, keys), out, "Update", "ProcessingTime" if ttl_ms else "None")
