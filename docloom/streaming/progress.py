"""What a streaming run did, as rows: a listener that turns its progress into the events of an indexing run."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener

from docloom.operators.store import one_at_a_time
from docloom.sources.records import EVENT

#: The latest events that a log keeps.
KEPT = 10_000


class ProgressLog(StreamingQueryListener):
    """started, progress, idle, done and error events of the queries of a session, oldest first."""

    def __init__(self, kept: int = KEPT) -> None:
        self.events: deque[dict] = deque(maxlen=kept)

    def _add(self, event: str, stage: str | None = None, text: str | None = None, payload: str | None = None, error: str | None = None) -> None:
        self.events.append({"event": event, "stage": stage, "t": time.time(), "text": text, "payload": payload, "error": error})

    def onQueryStarted(self, event) -> None:
        self._add("started", text=event.name or str(event.id))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._add("progress", f"batch {p.batchId}", f"{p.numInputRows} rows", p.json)

    def onQueryIdle(self, event) -> None:
        self._add("idle", text=str(event.id))

    def onQueryTerminated(self, event) -> None:
        self._add("error", error=event.exception) if event.exception else self._add("done", text=str(event.id))

    def rows(self, spark: SparkSession) -> DataFrame:
        """The events with the columns of parse_events, in order."""
        return spark.createDataFrame([tuple(e[c] for c in ("event", "stage", "t", "text", "payload", "error")) for e in self.events], EVENT)


@contextmanager
def watched(spark: SparkSession, kept: int = KEPT) -> Iterator[ProgressLog]:
    """A log of the streaming queries that run within the block. No other indexing run of this driver may begin meanwhile."""
    with one_at_a_time():
        log = ProgressLog(kept)
        spark.streams.addListener(log)
        try:
            yield log
        finally:
            spark.streams.removeListener(log)
