"""Sinks of streams: keyed upserts that a restart may repeat, and what a running query tells about itself."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from quarry.operators.merge import merge
from quarry.sources.files import Files


class Upserts:
    """The latest rows by key, as Parquet versions v=<batch>. A batch is merged into the version before its own, and one that is
    repeated after a restart replaces its own version, so results are the same as without it."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str]) -> None:
        self.spark, self.root, self.keys, self.files = spark, root, keys, Files(spark, root)

    def _done(self) -> list[int]:
        return sorted(int(n.split("=")[1]) for n in self.files.names("") if n.startswith("v=") and self.files.exists(f"{n}/_SUCCESS"))

    def read(self, before: int | None = None) -> DataFrame | None:
        done = [v for v in self._done() if before is None or v < before]
        return self.spark.read.parquet(f"{self.root}/v={done[-1]}") if done else None

    def write(self, rows: DataFrame, batch: int) -> None:
        if rows.isEmpty():
            return
        old = self.read(before=batch)
        out = rows if old is None else merge(old, rows, self.keys)
        out.write.mode("overwrite").parquet(f"{self.root}/v={batch}")
        for v in self._done()[:-2]:  # the version before stays for a repeat
            self.files.delete(f"v={v}")


def upsert(windows: DataFrame, sink: Upserts, checkpoint: str, *, name: str | None = None, available_now: bool = True, every: str = "30 seconds") -> StreamingQuery:
    """Start a query in update mode that upserts each micro-batch."""
    out = windows.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(lambda df, k: sink.write(df, k))
    out = out.queryName(name) if name else out
    return (out.trigger(availableNow=True) if available_now else out.trigger(processingTime=every)).start()


class Progress(StreamingQueryListener):
    """Rows, and rows that came behind the watermark, of each micro-batch of all queries."""

    def __init__(self) -> None:
        self.rows: list[dict] = []
        self.failed: list[str] = []
        self.seen = threading.Event()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.rows.append({"name": p.name, "batch": p.batchId, "rows": p.numInputRows, "late": sum(s.numRowsDroppedByWatermark for s in p.stateOperators)})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self.failed.append(event.exception)
        self.seen.set()


def late_rows(query: StreamingQuery) -> int:
    """Rows that the query has dropped behind its watermark."""
    return sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)


def stop_all(spark: SparkSession) -> list[str]:
    """Stop the active queries; their names or ids."""
    out = [q.name or q.id for q in spark.streams.active]
    for q in spark.streams.active:
        q.stop()
    return out
