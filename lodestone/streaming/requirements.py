"""Requirements as a stream: masked, matched with a fixed corpus in micro-batches, and written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.functions import masking
from lodestone.operators import lexical, ranking


def masked(stream: DataFrame, column: str = "text") -> DataFrame:
    """A stream with one text column masked."""
    return stream.withColumn(column, masking.mask(column))


def match(stream: DataFrame, docs: DataFrame | None, out: str, checkpoint: str, k: int = 5, index: DataFrame | None = None) -> StreamingQuery:
    """Appends query_id, doc_id, score, rank for each arriving (query_id, text). The batch's number is part of its folder, so that one that runs twice is written once.

    Documents are indexed once, before the stream starts, unless there is a kept ``index`` of them.
    """
    index = lexical.kept(docs) if index is None else index

    def write(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            ranking.bm25(None, batch.select("query_id", masking.mask("text").alias("text")), k, index=index).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_rates(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Events(ts, event_type, value) by window and type. In append or update mode windows that ended ``late`` before the latest event are closed: rows for them are left out, and their state is dropped."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")
