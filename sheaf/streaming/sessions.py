"""Sessions that end: one summary per session, once its time is over.

A session is a run of events of one id in which no two neighbours are further apart than a gap. It
ends when the watermark has passed its last event by the gap; an event timer then emits the summary
and drops the state. Until then later rows within the watermark may lengthen a session or join two.
State is held per id: one row for every open session and event name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = "start bigint, end bigint, event string, n bigint"
_SUMMARY = "sessionId string, start bigint, end bigint, totalEvents bigint, eventCounts map<string,bigint>"

#: Start, end (in microseconds) and counts by event name.
Session = tuple[int, int, Counter]


def _joined(sessions: list[Session], gap: int) -> list[Session]:
    """Sessions in order of time, with those at most a gap apart made one."""
    out: list[Session] = []
    for start, end, counts in sorted(sessions, key=lambda s: s[0]):
        if out and start - out[-1][1] <= gap:
            out[-1] = (out[-1][0], max(out[-1][1], end), out[-1][2] + counts)
        else:
            out.append((start, end, counts))
    return out


class SessionProcessor(StatefulProcessor):
    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("open", _STATE)

    def _load(self) -> list[Session]:
        found: dict[tuple[int, int], Counter] = {}
        for start, end, event, n in self.held.get():
            found.setdefault((start, end), Counter())[event] = n
        return [(start, end, counts) for (start, end), counts in found.items()]

    def _store(self, sessions: list[Session]) -> None:
        """Keep the open sessions, and a timer for the first of them to end."""
        if not sessions:
            self.held.clear()
            return
        self.held.put([(start, end, event, n) for start, end, counts in sessions for event, n in counts.items()])
        first = min(end for _, end, _ in sessions) + self.gap
        self.handle.registerTimer(-(-first // 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        sessions = self._load()
        for frame in rows:
            new = [(at, at, Counter((event,))) for at, event in zip(frame["at"].tolist(), frame["event"].tolist())]
            sessions = _joined(sessions + _joined(new, self.gap), self.gap)
        self._store(sessions)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs() * 1000
        over, still = [], []
        for session in self._load():
            (over if session[1] + self.gap <= now else still).append(session)
        self._store(still)
        if over:
            yield pd.DataFrame({
                "sessionId": [key[0]] * len(over), "start": [s[0] for s in over], "end": [s[1] for s in over],
                "totalEvents": [sum(s[2].values()) for s in over], "eventCounts": [dict(s[2]) for s in over],
            })


def ended_sessions(log: DataFrame, gap_seconds: int, delay: str = "0 seconds") -> DataFrame:
    """``sessionId, startTime, endTime, totalEvents, eventCounts`` of a stream of log rows, each once
    its session has ended.

    ``delay`` is how late events may come. Rows behind the watermark are left out and counted, see
    :func:`late_rows`; rows without a time belong to no session. A null event counts as ''.
    """
    rows = log.filter("timestamp IS NOT NULL").withWatermark("timestamp", delay).select(
        "sessionId", "timestamp", F.coalesce("event", F.lit("")).alias("event"), F.unix_micros("timestamp").alias("at"))
    ended = rows.groupBy("sessionId").transformWithStateInPandas(
        SessionProcessor(gap_seconds * 1_000_000), _SUMMARY, "Append", "EventTime")
    return ended.select(
        "sessionId", F.timestamp_micros("start").alias("startTime"), F.timestamp_micros("end").alias("endTime"),
        "totalEvents", "eventCounts")


def run_sessions(ended: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append the summaries of :func:`ended_sessions` to Parquet, each exactly once. Timers need the
    RocksDB state store, which this query alone is started with."""
    conf = ended.sparkSession.conf
    before = conf.get(_PROVIDER)
    conf.set(_PROVIDER, _ROCKS)
    try:
        writer = ended.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
        if available_now:
            writer = writer.trigger(availableNow=True)
        return writer.start(path)
    finally:
        conf.set(_PROVIDER, before)


def late_rows(query: StreamingQuery) -> int:
    """Rows that came behind the watermark, as far as the query's recent progress reaches."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
