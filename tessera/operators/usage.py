"""Traces of turns and the ledger of model calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.percentiles import interpolated

LOCAL_PROVIDERS = ("ollama",)
MAX_SERIES = 8
RECENT = 40


def node_times(traces: DataFrame) -> DataFrame:
    """Milliseconds of each node in each turn (a node that ran twice counts both), and of the turn."""
    s = traces.select("id", F.explode("spans").alias("s")).groupBy("id", F.col("s.name").alias("node")).agg(F.sum((F.col("s.end") - F.col("s.start")) * 1000).alias("ms"))
    return s.unionByName(traces.select("id", F.lit("total").alias("node"), ((F.col("end") - F.col("start")) * 1000).alias("ms")))


def trace_summary(traces: DataFrame) -> DataFrame:
    return node_times(traces).groupBy("node").agg(F.count("*").alias("n"), interpolated(F.col("ms"), 0.5).alias("p50"), interpolated(F.col("ms"), 0.95).alias("p95"))


def generation_usage(traces: DataFrame) -> DataFrame:
    g = traces.select(F.explode("generations").alias("g")).select("g.*")
    return g.groupBy("name", "model").agg(F.count("*").alias("calls"), F.sum(F.col("cached").cast("int")).alias("cached"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), interpolated(F.col("provider_ms"), 0.5).alias("provider_p50"), interpolated(F.col("provider_ms"), 0.95).alias("provider_p95"))


def call_kind(text: Column) -> Column:
    """What a call was for, by the fields of its structured output."""
    has = lambda f: F.array_contains(F.json_object_keys(text), f)
    return (
        F.when(has("answer"), "Answer").when(has("correctness"), "Judge").when(has("standalone_question"), "Follow-up rewrite").when(has("statements") | has("claims"), "RAGAS metric").otherwise("Other")
    )


def rollup(calls: DataFrame, now: Column, by: list[str]) -> DataFrame:
    """Calls, tokens, those of the last day, and latency percentiles."""
    tokens = F.col("prompt_tokens") + F.col("completion_tokens")
    recent = (now - F.col("ts")) < 86_400
    return calls.groupBy(*by).agg(
        F.count("*").alias("calls"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.sum(tokens).alias("tokens"),
        F.coalesce(F.sum(F.when(recent, tokens)), F.lit(0)).alias("tokens_24h"),
        F.sum(recent.cast("int")).alias("calls_24h"),
        interpolated(F.col("latency_ms"), 0.5).alias("latency_p50_ms"),
        interpolated(F.col("latency_ms"), 0.95).alias("latency_p95_ms"),
    )


def hosted_local_total(calls: DataFrame, now: Column) -> DataFrame:
    c = calls.withColumn("where", F.when(F.col("provider").isin(*LOCAL_PROVIDERS), "local").otherwise("hosted"))
    return rollup(c.unionByName(c.withColumn("where", F.lit("total"))), now, ["where"])


def series_of(calls: DataFrame, most: int = MAX_SERIES) -> DataFrame:
    """model and its series: itself by first use, or Other beyond the palette."""
    first = calls.groupBy("model").agg(F.min(F.struct("ts", "model")).alias("f"))
    n = first.withColumn("place", F.row_number().over(W.orderBy("f"))).withColumn("models", F.count("*").over(W.partitionBy(F.lit(1))))
    return n.select("model", F.when((F.col("models") <= most) | (F.col("place") < most), F.col("model")).otherwise("Other").alias("series"))


def by_day(calls: DataFrame, first_day: Column, last_day: Column) -> DataFrame:
    """Tokens of each series on each day, days without any included."""
    s = series_of(calls)
    c = calls.join(F.broadcast(s), "model").groupBy(F.to_date(F.timestamp_seconds("ts")).alias("day"), "series").agg(F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"))
    days = calls.agg(first_day.alias("a"), last_day.alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    grid = days.join(F.broadcast(s.select("series").distinct()), F.lit(True))
    return grid.join(c, ["day", "series"], "left").select("day", "series", F.coalesce("tokens", F.lit(0)).alias("tokens"))


def recent_calls(calls: DataFrame, n: int = RECENT) -> DataFrame:
    return calls.orderBy(F.desc("ts")).limit(n)


def memory(turns: DataFrame, max_threads: int = 1000, max_turns: int = 6) -> DataFrame:
    """The newest threads (thread_id, seq, question, answer) with their last exchanges."""
    place = F.row_number().over(W.partitionBy("thread_id").orderBy(F.desc("seq")))
    last = turns.withColumn("back", place).where(F.col("back") <= max_turns)
    g = last.groupBy("thread_id").agg(F.max("seq").alias("last_seq"), F.array_sort(F.collect_list(F.struct("seq", "question", "answer"))).alias("turns"))
    return g.orderBy(F.desc("last_seq")).limit(max_threads)
