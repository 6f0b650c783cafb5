"""A question to a checked answer: plan, sources, generation by a callable, verification, and the response."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators import context, verification
from tessera.operators.filters import SearchFilters
from tessera.operators.retrieval import Retriever, search_decomposed, split_filters

BUDGET = 3500


def retrieve(retriever: Retriever, queries: DataFrame, filters: SearchFilters, k: int = 10, mode: str = "hybrid") -> DataFrame:
    """Decomposed if the filters name several companies, years or quarters. query_id, id, score, rank."""
    if len(split_filters(filters)) > 1:
        return search_decomposed(retriever, queries, filters, k, mode).select("query_id", "id", "score", F.col("position").alias("rank"))
    return retriever.search(queries, filters, k, mode).select("query_id", "id", "score", "rank")


def widened(filters: SearchFilters, abstained: bool) -> SearchFilters | None:
    """After abstaining under a section filter, once more without it."""
    from dataclasses import replace

    return replace(filters, sections=None) if abstained and filters.sections else None


def sources(hits: DataFrame, chunks: DataFrame, facts: DataFrame | None = None, budget: int = BUDGET, max_sources: int = context.MAX_SOURCES) -> DataFrame:
    """Facts first, then hits that fit the budget; ids S1, S2 and so on. Chunks have the chunk table's columns and id."""
    kept = context.pack(hits.join(chunks.select("id", "token_count"), "id"), budget, max_sources).select("query_id", "source_no", "id")
    packed = kept.join(hits.select("query_id", "id", "score"), ["query_id", "id"]).join(chunks, "id")
    packed = packed.select("query_id", "source_no", "score", *chunks.columns)
    if facts is not None:
        f = facts.withColumns({"source_no": F.row_number().over(W.partitionBy("query_id").orderBy("id")) - 1000, "score": F.lit(1.0)})
        packed = packed.unionByName(f.select(*packed.columns))
    no = F.row_number().over(W.partitionBy("query_id").orderBy("source_no"))
    packed = packed.withColumn("source_id", F.concat(F.lit("S"), no.cast("string")))
    return packed.withColumns({"citation": context.citation(), "rendered": context.rendered(F.col("source_id"))})


def answer(queries: DataFrame, packed: DataFrame, generate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``generate`` turns (query_id, question, prompt) into (query_id, text, abstained). Claims are those of the text; an answer
    stands if one of them holds."""
    fields = ("text", "rendered", "context", "ticker", "fiscal_year", "fiscal_quarter", "period_end", "chunk_type")
    listed = packed.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("source_id").alias("id"), *fields))).alias("sources"),
        F.map_from_entries(F.collect_list(F.struct("source_id", "citation"))).alias("citations"),
        F.map_from_entries(F.collect_list(F.struct("source_id", "score"))).alias("scores"),
    )
    q = queries.join(listed, "query_id")
    shown = F.array_join(F.transform("sources", lambda s: s["rendered"]), "\n\n")
    said = generate(q.select("query_id", F.col("text").alias("question"), F.concat(F.lit("Sources:\n\n"), shown, F.lit("\n\nQuestion: "), F.col("text")).alias("prompt")))
    a = q.drop("text").join(said.select("query_id", context.normalize_markers(F.trim("text")).alias("text"), "abstained"), "query_id")
    a = a.withColumn("claims", F.when(F.col("abstained"), F.array().cast(f"array<{verification.CLAIM}>")).otherwise(context.claims(F.col("text"))))
    a = a.join(verification.verify(a), "query_id")
    n, good = F.size("verified"), F.filter("verified", lambda v: v["status"] == "supported")
    best = F.array_max(F.transform(F.flatten(F.transform(good, lambda v: v["ids"])), lambda i: F.try_element_at(F.col("scores"), i)))
    repaired = F.exists(good, lambda v: v["repaired"])
    done = context.finalize(a)
    return done.withColumn("confidence", context.confidence(n, F.size(good), best, repaired, F.col("abstained"))).select("query_id", "answer", "abstained", "confidence", "verified", "cited")


def response_sources(packed: DataFrame, hits: DataFrame) -> DataFrame:
    """Sources as a response lists them: the rank of the search, or the place among the sources for facts."""
    j = packed.join(hits.select("query_id", F.col("id"), F.col("rank").alias("hit_rank")), ["query_id", "id"], "left")
    return j.select("query_id", "source_id", "id", "citation", "score", F.coalesce("hit_rank", F.substring("source_id", 2, 9).cast("int")).alias("rank"))
