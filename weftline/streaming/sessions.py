"""Sessions that grow and merge as events come, kept by key in Spark's state store.

Events may come in any order; one that falls within the gap of two sessions makes them one. Every batch tells what changed:
sessions that are no more with -1, new forms with +1, so the sum of all changes is the set of sessions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STATE = "start LONG, end LONG, events LONG"


def merged(held: list[tuple[int, int, int]], times: list[int], gap: int) -> list[tuple[int, int, int]]:
    """Sessions (start, end, events) after further event times; ends at most `gap` before the next start join."""
    out: list[tuple[int, int, int]] = []
    for s, e, n in sorted([*held, *[(t, t, 1) for t in times]]):
        if out and s - out[-1][1] <= gap:
            a, b, m = out[-1]
            out[-1] = (a, max(b, e), m + n)
        else:
            out.append((s, e, n))
    return out


class Sessionizer(StatefulProcessor):
    def __init__(self, key: str, time: str, gap: int) -> None:
        self.key, self.time, self.gap = key, time, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("sessions", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        was = [tuple(map(int, r)) for r in self.held.get()]
        now = list(was)
        for batch in rows:
            now = merged(now, [int(t) for t in batch[self.time].dropna()], self.gap)
        if now:
            self.held.put(now)
        gone, came = sorted(set(was) - set(now)), sorted(set(now) - set(was))
        told = [(key[0], *s, -1) for s in gone] + [(key[0], *s, 1) for s in came]
        yield pd.DataFrame(told, columns=[self.key, "start", "end", "events", "__w"])

    def close(self) -> None:
        pass


def session_changes(stream: DataFrame, key: str, time: str, gap: int) -> DataFrame:
    """key, start, end, events, __w: changes of the sessions of a stream (time in whole units). Needs the RocksDB state store."""
    kind = dict(stream.dtypes)[key]
    return stream.select(key, time).groupBy(key).transformWithStateInPandas(statefulProcessor=Sessionizer(key, time, gap), outputStructType=f"{key} {kind}, start long, end long, events long, __w long", outputMode="Update", timeMode="None")
