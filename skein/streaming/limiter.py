"""An exact sliding-window limiter: refused hits are not remembered.

``admit`` replays a table key by key; ``admit_stream`` keeps the same state in a stream.  State
for a key is at most ``limit`` times, so it is bounded whatever the traffic.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "id long, key long, at double, admitted boolean"


def _replay(times: deque, rows: pd.DataFrame, limit: int, seconds: float) -> list[bool]:
    out = []
    for at in rows["at"]:
        while times and times[0] <= at - seconds:
            times.popleft()
        if ok := len(times) < limit:
            times.append(at)
        out.append(ok)
    return out


def admit(df: DataFrame, limit: int, seconds: float) -> DataFrame:
    """(id, key, at, admitted) of rows (id, key, at): sorted by Spark, streamed through key by key.

    Rows of a key stay in one sorted partition and are read batch after batch, so even a key with
    a third of all rows needs no more memory than its window.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, times = None, deque()
        for frame in frames:
            out = []
            for k, part in frame.groupby("key", sort=False):
                if k != key:
                    key, times = k, deque()
                out += _replay(times, part, limit, seconds)
            yield frame.assign(admitted=out)[["id", "key", "at", "admitted"]]

    return df.select("id", "key", "at").repartition("key").sortWithinPartitions("key", "at", "id").mapInPandas(run, OUT)


def admit_stream(df: DataFrame, limit: int, seconds: float) -> DataFrame:
    """The same over a streaming frame of (id, key, at), in the order in which batches arrive."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times = deque(state.get[0]) if state.exists else deque()
        rows = pd.concat(list(frames)).sort_values(["at", "id"])
        admitted = _replay(times, rows, limit, seconds)
        state.update((list(times),))
        yield rows.assign(admitted=admitted)[["id", "key", "at", "admitted"]]

    return df.select("id", "key", "at").groupBy("key").applyInPandasWithState(step, OUT, "times array<double>", "append", GroupStateTimeout.NoTimeout)
