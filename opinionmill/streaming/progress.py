"""Progress of streams: rows and classes of every micro-batch as a table."""

from __future__ import annotations

import threading
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..functions.labels import normalise

OBSERVED = "reviews"
CLASSES = ["positive", "negative", "neutral"]
SCHEMA = "query string, batch long, seconds double, n_rows long, missing long, positive long, negative long, neutral long"


def observed(stream: DataFrame, text_col: str, label_col: str) -> DataFrame:
    """The stream, whose micro-batches report rows, missing texts and rows of each class as they pass."""
    label = normalise(F.col(label_col))
    return stream.observe(OBSERVED, F.count("*").alias("n_rows"), F.count_if(F.col(text_col).isNull()).alias("missing"), *[F.count_if(label == c).alias(c) for c in CLASSES])


class Progress(StreamingQueryListener):
    """Collects the reports of observed streams; a micro-batch that is run again replaces its report."""

    def __init__(self) -> None:
        self._rows: dict[tuple[str, int], tuple] = {}
        self._ended: set[str] = set()
        self._lock = threading.Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        found = event.progress.observedMetrics.get(OBSERVED)
        if found is None:
            return
        values = found.asDict()
        row = (str(event.progress.id), event.progress.batchId, event.progress.batchDuration / 1000, *(values[c] for c in ("n_rows", "missing", *CLASSES)))
        with self._lock:
            self._rows[row[:2]] = row

    def onQueryTerminated(self, event) -> None:
        with self._lock:
            self._ended.add(str(event.id))

    def wait(self, query_id: str, seconds: float = 30) -> None:
        """Until the query's last report is in: reports arrive after the batches they tell of."""
        until = time.monotonic() + seconds
        while query_id not in self._ended and time.monotonic() < until:
            time.sleep(0.05)

    def table(self, spark: SparkSession) -> DataFrame:
        """query, batch, seconds, n_rows, missing and rows of each class, one row a micro-batch."""
        with self._lock:
            rows = sorted(r for r in self._rows.values() if r[3])
        return spark.createDataFrame(rows, SCHEMA)


def watch(spark: SparkSession) -> Progress:
    """A listener that is at work; `spark.streams.removeListener` ends it."""
    listener = Progress()
    spark.streams.addListener(listener)
    return listener
