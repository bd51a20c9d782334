"""Structured Streaming: questions answered as they come, appended traces, and windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import retrieve


def hourly(events: DataFrame, late: str | None = None) -> DataFrame:
    """(ts, event_type, value) -> counts and sums per hour and type, of a stream or of a table; ``late`` sets the watermark of a stream."""
    if late:
        events = events.withWatermark("ts", late)
    found = events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value"))
    return found.select(F.col("w.start").alias("window_start"), "event_type", "events", "value")


def answer_stream(questions: DataFrame, terms: DataFrame, trace_path: str, checkpoint: str, k: int = 5) -> StreamingQuery:
    """For each micro-batch of (qid, question) the best chunks of an index (``retrieve.indexed``), appended as one JSON line per question.

    A ranking needs all hits of a question, which a stream cannot rank by itself; so each batch is searched as a table.
    """

    def search(batch: DataFrame, _: int) -> None:
        hits = retrieve.search(batch, terms, k)
        per = hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "score"))).alias("retrieved"))
        batch.join(per, "qid", "left").select(F.to_json(F.struct("qid", "question", "retrieved")).alias("value")).write.mode("append").text(trace_path)

    return questions.writeStream.foreachBatch(search).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
