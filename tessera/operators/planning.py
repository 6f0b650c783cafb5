"""Intent, section prior and the retrieval plan."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.filters import SearchFilters
from tessera.operators.retrieval import Retriever, interleave, split_filters

# Cues for intents and for questions about a reported metric.
COMPARE = r"(?i)\bcompare|\bcompared?\b|\bversus\b|\bvs\.?\b|\bwhich\b.*\b(?:more|less|faster|slower|higher|lower)\b"
TREND = r"(?i)\btrend|\bover time\b|\beach (?:fiscal )?year\b|\bevolve|\bchanged?\b.*\bfrom\b"
HOW_MUCH = r"(?i)\bhow (?:much|many)\b"
METRIC = (
    r"(?i)\b(?:revenues?|net sales|sales|net income|earn(?:ed|ings)?|profit|operating (?:income|loss)|margin|capital expenditures?|capex|cash flows?|"
    r"expenses?|interest income|deliver(?:ed|ies|y)|repurchase[sd]?|buybacks?|growth|grew|grow)\b"
)
SECTION_BONUS = 0.05
MANY_PARTS, MANY_PARTS_POOL = 8, 15
MIN_QUOTA = 2


def intent(question: Column, n_tickers: Column, n_years: Column, n_quarters: Column) -> Column:
    """comparison before trend before numeric before lookup."""
    return (
        F.when((n_tickers > 1) | question.rlike(COMPARE), "comparison")
        .when((n_years > 1) | (n_quarters > 1) | question.rlike(TREND), "trend")
        .when(question.rlike(HOW_MUCH) | question.rlike(METRIC), "numeric")
        .otherwise("lookup")
    )


def prior_applies(question: Column) -> Column:
    """A question about a reported metric favours management's discussion (Item 7)."""
    return question.rlike(METRIC)


@dataclass(frozen=True)
class Plan:
    query: str
    parts: tuple[SearchFilters, ...]
    quota: int
    pool: int
    section_bonus: dict[str, float] = field(default_factory=dict)


def make_plan(query: str, filters: SearchFilters, metric: bool, k: int = 10, pool: int | None = None, min_quota: int = MIN_QUOTA, bonus: float = SECTION_BONUS) -> Plan:
    """``metric``: the question is about a reported metric. With many quarters the rerank pool is halved."""
    parts = tuple(split_filters(filters))
    quota = k if len(parts) == 1 else max(min_quota, math.ceil(k / len(parts)))
    many = bool(filters.fiscal_quarters) and len(parts) > MANY_PARTS
    return Plan(query, parts, quota, pool or (MANY_PARTS_POOL if many else 30), {"Item 7": bonus} if metric and bonus else {})


def apply_prior(hits: DataFrame, bonus: dict[str, float], quota: int, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Add the section's bonus to the score, sort again (equal scores keep their order) and cut at the quota."""
    extra = F.coalesce(*[F.when(F.col("section") == s, F.lit(b)) for s, b in bonus.items()], F.lit(0.0))
    scored = hits.withColumn("section_prior", extra).withColumn("score", F.col("score") + extra).withColumnRenamed("rank", "before")
    return scored.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), "before"))).where(F.col("rank") <= quota)


def execute(retriever: Retriever, plan: Plan, queries: DataFrame, mode: str = "hybrid_rerank") -> DataFrame:
    """Search every part; with a reranker the prior needs the whole reranked pool; then quota and interleaving."""
    rerank = mode == "hybrid_rerank" and retriever.scorer is not None
    depth = max(plan.quota, plan.pool) if rerank and plan.section_bonus else plan.quota
    sections = retriever.chunks.select("id", "section")
    lists = None
    for i, part in enumerate(plan.parts):
        hits = retriever.search(queries, part, depth, mode, plan.pool).join(sections, "id").withColumn("list_no", F.lit(i))
        lists = hits if lists is None else lists.unionByName(hits)
    cut = apply_prior(lists, plan.section_bonus if rerank else {}, plan.quota, ("query_id", "list_no"))
    return interleave(cut)
