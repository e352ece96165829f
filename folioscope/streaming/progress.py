"""What streams did, as a table: one row for each event of a query's life and each batch that it worked off."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

SCHEMA = "kind string, query string, run string, batch long, input_rows long, state_rows long, state_removed long, state_late long, watermark string, duration_ms long, error string"


class ProgressLog(StreamingQueryListener):
    """Appends rows to the Parquet table ``path``, at most ``held`` in memory between writes.

    Events come in their own thread, after the query has gone on, so a run is known to be whole
    once its end has been seen: ``wait`` waits for that.
    """

    def __init__(self, spark: SparkSession, path: str, held: int = 1000):
        self.spark, self.path, self.held = spark, path, held
        self._rows: list[tuple] = []
        self._ended: set[str] = set()
        self._lock, self._writing = threading.Condition(), threading.Lock()

    def __enter__(self) -> ProgressLog:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self.spark.streams.removeListener(self)
        self.flush()

    def _note(self, row: tuple, ended: str | None = None) -> None:
        with self._lock:
            self._rows.append(row)
            if ended:
                self._ended.add(ended)
                self._lock.notify_all()
        if len(self._rows) >= self.held:
            self.flush()

    def onQueryStarted(self, event) -> None:
        self._note(("started", event.name, str(event.runId), *(None,) * 8))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        states = p.stateOperators
        total = lambda name: sum(int(getattr(s, name)) for s in states) if states else None
        late = total("numRowsDroppedByWatermark")
        self._note(("batch", p.name, str(p.runId), p.batchId, p.numInputRows, total("numRowsTotal"), total("numRowsRemoved"), late, p.eventTime.get("watermark"), p.batchDuration, None))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._note(("ended", None, str(event.runId), *(None,) * 7, event.exception), str(event.runId))

    def wait(self, query: StreamingQuery, seconds: float = 60) -> None:
        """Until the end of that run has been noted."""
        with self._lock:
            if not self._lock.wait_for(lambda: str(query.runId) in self._ended, seconds):
                raise TimeoutError(f"no end of run {query.runId} within {seconds} seconds")

    def flush(self) -> None:
        # whoever comes second waits until what the first took is written
        with self._writing:
            with self._lock:
                rows, self._rows = self._rows, []
            if rows:
                self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def table(self) -> DataFrame:
        self.flush()
        return self.spark.read.schema(SCHEMA).parquet(self.path)
