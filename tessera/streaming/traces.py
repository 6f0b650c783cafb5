"""Streams over traces, conversations and new chunks. An extension: the batch operators above define the results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tessera.operators.retrieval import embed_incrementally


def node_windows(traces: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Turns and milliseconds by node and window of event time; late rows beyond the watermark are left out."""
    t = traces.select(F.timestamp_seconds("start").alias("at"), F.explode("spans").alias("s")).withWatermark("at", late)
    ms = (F.col("s.end") - F.col("s.start")) * 1000
    return t.groupBy(F.window("at", width), F.col("s.name").alias("node")).agg(F.count("*").alias("n"), F.avg(ms).alias("mean_ms"), F.max(ms).alias("max_ms"))


def event_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a user's events."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def conversation_memory(turns: DataFrame, max_turns: int = 6, ttl_ms: int = 86_400_000) -> DataFrame:
    """The last exchanges of each thread as turns (thread_id, question, answer) arrive; idle threads are forgotten."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(zip(*state.get, strict=True)) if state.exists else []
        for b in batches:
            kept += list(zip(b["question"], b["answer"], strict=True))
        kept = kept[-max_turns:]
        state.update(tuple(map(list, zip(*kept, strict=True))))
        state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame({"thread_id": [key[0]], "n": [len(kept)], "last_question": [kept[-1][0]], "last_answer": [kept[-1][1]]})

    return turns.groupBy("thread_id").applyInPandasWithState(update, "thread_id string, n int, last_question string, last_answer string", "questions array<string>, answers array<string>", "update", "ProcessingTimeTimeout")


def keep_embeddings(chunks: DataFrame, cache_path: str, embed: Callable[[Column], Column]) -> DataStreamWriter:
    """Append the embeddings of new or changed chunks of each batch; what the cache has isn't computed again."""

    def each(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            cache = spark.read.parquet(cache_path)
        except Exception as error:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(error):
                raise
            cache = spark.createDataFrame([], "chunk_id string, content_hash string, embedding array<float>")
        fresh = embed_incrementally(batch, cache.limit(0), embed).join(cache, ["chunk_id", "content_hash"], "left_anti")
        fresh.write.mode("append").parquet(cache_path)

    return chunks.writeStream.foreachBatch(each)
