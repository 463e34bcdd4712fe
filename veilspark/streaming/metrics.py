"""Gauges of running streams, and the audit statistics over a stream."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQueryListener

from veilspark.operators import audit


class Gauge(StreamingQueryListener):
    """Streams in flight, rows read and seconds since the start."""

    def __init__(self) -> None:
        self.began, self.running, self.rows = time.time(), set(), 0

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.running.add(str(event.id))

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.rows += event.progress.numInputRows

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.running.discard(str(event.id))

    def status(self) -> dict[str, float]:
        return {"in_flight": len(self.running), "rows": self.rows, "uptime_s": time.time() - self.began}


def hourly(log: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Requests and errors an hour and host, of a streaming log; rows later than the watermark are dropped by it. An extension."""
    return audit.metrics(log.withWatermark("ts", late))
