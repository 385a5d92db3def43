"""Structured Streaming into the commit log, and live counts over a stream of commits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftwell.operators.flatten import valid_json
from siftwell.sources.store import Engine


def ingest(changes: DataFrame, engine: Engine, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Appends a stream of changes (op, doc_id, data) to an engine's log, batch by batch.

    Commit ids go on from the log's. Added documents that aren't valid (no JSON object, an empty field name) are left out. A batch that comes again after a
    failure writes over its own files, so that nothing is committed twice.
    """
    def batch(df: DataFrame, number: int) -> None:
        last = engine.last_commit_id()
        base = F.lit(last + 1)
        rows = df.select((base + F.monotonically_increasing_id()).alias("commit_id"), "op", "doc_id", "data", F.lit(None).cast("int").alias("max_depth"), F.current_timestamp().alias("ts"))
        # a change that adds must hold a valid document
        rows = rows.where((F.col("op") != "add") | valid_json("data"))
        rows.write.mode("overwrite").parquet(f"{engine.log_path}/stream-{number}")
        engine._noted(last)

    writer = changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_counts(changes: DataFrame, ts: str = "ts", width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Changes by operation and window of event time; state of windows older than ``late`` is dropped."""
    return changes.withWatermark(ts, late).groupBy(F.window(ts, width), "op").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "op", "n")
