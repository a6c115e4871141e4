"""Structured Streaming forms of the volume aggregates and of the windowed dedup."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def volume(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows a window of event time (ts); a window is final `late` after it ends."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width)).agg(F.count("*").alias("count")).select("window.start", "window.end", "count")


def dedup_window(events: DataFrame, window: int = 5) -> DataFrame:
    """row_idx, query of the rows that the batch operator of this name keeps. State: the last kept row of a query. Rows of a query come in order."""

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        until = state.get[0] if state.exists else -1
        for frame in frames:
            kept = []
            for i in sorted(frame["row_idx"].tolist()):
                if i >= until:
                    kept.append(i)
                    until = i + window + 1
            yield pd.DataFrame({"row_idx": kept, "query": key[0]})
        state.update((until,))

    return events.groupBy("query").applyInPandasWithState(run, "row_idx bigint, query string", "until bigint", "append", GroupStateTimeout.NoTimeout)
