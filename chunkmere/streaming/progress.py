"""The progress of hosts as a stream (T6): when may a collection's fossils go?

Snapshot headers arrive as a stream; state is kept for each host: its last end time and whether it has
ended a snapshot since the collection.  A host reports when it has, or, by an event-time timer, when it
has been silent for DORMANT_DAYS.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.paths import host_of
from ..model import DAY
from ..operators.prune import DORMANT_DAYS, SLACK

RESULT = "host string, reason string, last_end long"


def host_progress(headers: DataFrame, collected_at: int, consistent: bool = True, late: str = "1 day") -> DataFrame:
    """A stream of ``host, reason, last_end`` from headers ``id, end_time``: ``progressed`` or ``dormant``, once a host."""
    limit = collected_at + (0 if consistent else SLACK)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last, done = state.get
            state.update((last, True))
            if not done:
                yield pd.DataFrame([(key[0], "dormant", last)], columns=["host", "reason", "last_end"])
            return
        last, done = state.get if state.exists else (0, False)
        for p in parts:
            last = max(last, int(p["end_time"].max()))
        now = not done and last > limit
        state.update((last, done or now))
        if not (done or now):
            state.setTimeoutTimestamp(max((last + DORMANT_DAYS * DAY) * 1000, state.getCurrentWatermarkMs() + 1))
        if now:
            yield pd.DataFrame([(key[0], "progressed", last)], columns=["host", "reason", "last_end"])

    held = headers.withColumn("at", F.timestamp_seconds("end_time")).withWatermark("at", late).select(host_of(F.col("id")).alias("host"), "end_time", "at")
    return held.groupBy("host").applyInPandasWithState(step, RESULT, "last long, done boolean", "append", GroupStateTimeout.EventTimeTimeout)


def new_chunks(refs: DataFrame, late: str = "1 day") -> DataFrame:
    """A stream of chunk references ``chunk_id, at``, each chunk once within the watermark (J4 on a stream)."""
    return refs.withWatermark("at", late).dropDuplicatesWithinWatermark(["chunk_id"])
