"""Evaluation: ranking metrics, run summaries, agreement, gates and consistency checks of a question set."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import numbers, percentiles
from tessera.functions.text import normalize_quotes

CATEGORIES = ("lookup", "numeric", "trend", "comparison", "follow_up", "unanswerable")
GRADES = ("correct", "partially_correct", "incorrect")
GRADE_SCORE = {"correct": 1.0, "partially_correct": 0.5, "incorrect": 0.0}
VERDICT_SCORE = {"supported": 1.0, "partial": 0.5, "unsupported": 0.0}


def covers(hit: str = "h", gold: str = "e") -> Column:
    """Same company and year, and either a page of the evidence within the chunk's pages or, for a release, the same
    quarter and a quote in the text (column quote_found)."""
    h, e = (lambda c: F.col(f"{hit}.{c}")), (lambda c: F.col(f"{gold}.{c}"))
    pages = F.exists(e("pages"), lambda p: p.between(h("page_start"), h("page_end")))
    text = F.lower(normalize_quotes(h("text")))
    quoted = F.exists(e("quotes"), lambda q: F.contains(text, F.lower(normalize_quotes(q))))
    release = h("fiscal_quarter").eqNullSafe(e("fiscal_quarter")) & quoted
    return (h("ticker") == e("ticker")) & (h("fiscal_year") == e("fiscal_year")) & F.when(e("fiscal_quarter").isNotNull() & (e("fiscal_quarter") != 0), release).otherwise(pages)


def ranking_metrics(found: DataFrame, sizes: DataFrame, ks: Sequence[int]) -> DataFrame:
    """By question: mrr, recall@k, hit@k and ndcg at the largest k.

    ``found`` (query_id, rank, item): the evidence items each rank covers; ``sizes`` (query_id, n_items). A rank gains
    in nDCG only for items no earlier rank covered, so only each item's first rank matters."""
    first = found.groupBy("query_id", "item").agg(F.min("rank").alias("rank"))
    top = max(ks)
    gains = first.where(F.col("rank") <= top).select("query_id", "rank").distinct().groupBy("query_id").agg(F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    per = first.groupBy("query_id").agg(F.min("rank").alias("first"), *[F.sum((F.col("rank") <= k).cast("int")).alias(f"n{k}") for k in ks])
    j = sizes.join(per, "query_id", "left").join(gains, "query_id", "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_items"), F.lit(top)).cast("int")), F.lit(0.0), lambda a, r: a + 1 / F.log2(r + 1.0))
    cols = [F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr")]
    for k in ks:
        n = F.coalesce(F.col(f"n{k}"), F.lit(0))
        cols += [(n / F.col("n_items")).alias(f"recall_{k}"), (n > 0).cast("double").alias(f"hit_{k}")]
    return j.select("query_id", *cols, (F.coalesce("dcg", F.lit(0.0)) / ideal).alias(f"ndcg_{top}"))


def run_summary(records: DataFrame, metrics: Sequence[str], latency: str, by: Sequence[str] = ("category",)) -> DataFrame:
    """Mean metrics and latency percentiles (by position) of a run."""
    return records.groupBy(*by).agg(F.count("*").alias("questions"), *[F.avg(m).alias(m) for m in metrics], percentiles.at_share(F.col(latency), 0.5).alias("p50"), percentiles.at_share(F.col(latency), 0.95).alias("p95"))


def generation_summary(r: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Of records (answerable, abstained, error, citation_hit, evidence_recall, claim_support, figure_recall, cached, llm_ms,
    retrieval_ms, prompt_tokens, completion_tokens); missing values are left out of means."""
    ans, una, abst = F.col("answerable"), ~F.col("answerable"), F.col("abstained")
    mean = lambda c, cond: F.avg(F.when(cond, F.col(c)))
    live = F.when(~F.col("cached"), F.col("llm_ms"))
    return r.groupBy(*by).agg(
        F.count("*").alias("questions"),
        F.sum(F.col("error").cast("int")).alias("errors"),
        F.avg(F.when(una, abst.cast("double"))).alias("abstention_recall"),
        F.avg(F.when(abst, una.cast("double"))).alias("abstention_precision"),
        F.avg(F.when(ans, abst.cast("double"))).alias("false_abstention_rate"),
        mean("citation_hit", ans).alias("citation_hit"),
        mean("evidence_recall", ans).alias("evidence_recall"),
        mean("claim_support", ans & ~abst).alias("claim_support"),
        mean("figure_recall", ans).alias("figure_recall"),
        percentiles.at_share(live, 0.5).alias("llm_p50_ms"),
        percentiles.at_share(live, 0.95).alias("llm_p95_ms"),
        percentiles.at_share(F.col("retrieval_ms"), 0.5).alias("retrieval_p50_ms"),
        F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"),
    )


def agent_summary(r: DataFrame, by: Sequence[str] = ("config",)) -> DataFrame:
    """generation_summary() and what only an agent has: filters as expected, facts cited, refusals before retrieval."""
    extra = r.groupBy(*by).agg(F.avg(F.col("filters_ok").cast("double")).alias("filters_ok"), F.avg(F.when(F.col("answerable"), F.col("xbrl_cited").cast("double"))).alias("xbrl_citation_hit"), F.sum(F.col("refused_early").cast("int")).alias("early_refusals"))
    return generation_summary(r, by).join(extra, list(by))


def plan_summary(r: DataFrame, by: Sequence[str] = ("config",)) -> DataFrame:
    """Context recall and coverage, latencies of all and of questions about several entities."""
    several = F.when(F.col("n_entities") > 1, F.col("ms"))
    return r.groupBy(*by).agg(F.avg("context_recall").alias("context_recall"), F.avg("context_coverage").alias("context_coverage"), percentiles.at_share(F.col("ms"), 0.5).alias("p50"), percentiles.at_share(F.col("ms"), 0.95).alias("p95"), percentiles.at_share(several, 0.5).alias("multi_p50"), percentiles.at_share(several, 0.95).alias("multi_p95"))


def context_coverage(hits: DataFrame, grid: DataFrame) -> DataFrame:
    """Share of the asked (ticker, year) cells with a hit, by question."""
    seen = hits.select("query_id", "ticker", "fiscal_year").distinct().withColumn("hit", F.lit(1))
    return grid.join(seen, ["query_id", "ticker", "fiscal_year"], "left").groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("coverage"))


def figure_recall(reference: Column, answer: Column) -> Column:
    """Share of the reference's figures that the answer states; null without any."""
    ref, got = numbers.figures(reference), numbers.figures(answer)
    hit = F.filter(ref, lambda r: F.exists(got, lambda a: numbers.matches(a, r) | numbers.matches(r, a)))
    return F.try_divide(F.size(hit), F.size(ref))


def judged_correctness(answerable: Column, abstained: Column, grade: Column) -> Column:
    """Abstaining is right exactly if there is no answer; otherwise the judge's grade, and nothing for an answer
    where there is none."""
    of_grade = F.coalesce(*[F.when(grade == g, F.lit(s)) for g, s in GRADE_SCORE.items()])
    return F.when(abstained, (~answerable).cast("double")).when(~answerable, 0.0).otherwise(of_grade)


def judge_summary(r: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Of judged records (answerable, abstained, error, judged, correctness, correctness_score, faithfulness, verifier_supported,
    label, answer_unchanged, tokens)."""
    ans = F.col("answerable") & ~F.col("error")
    answered = ans & ~F.col("abstained")
    labelled = F.col("label").isNotNull() & F.col("judged") & F.coalesce("answer_unchanged", F.lit(True))
    same = (F.col("correctness") == F.col("label")).cast("double")
    right = ((F.col("correctness") == "correct") == (F.col("label") == "correct")).cast("double")
    return r.groupBy(*by).agg(
        F.count("*").alias("questions"),
        F.sum(F.col("judged").cast("int")).alias("judged"),
        F.avg(F.when(ans, F.col("correctness_score"))).alias("correctness_all_answerable"),
        F.avg(F.when(answered, F.col("correctness_score"))).alias("correctness_answered"),
        F.avg(F.when(answered, F.col("faithfulness"))).alias("faithfulness"),
        F.avg(F.when(answered, F.col("verifier_supported"))).alias("verifier_claim_support"),
        F.avg(F.when(labelled, same)).alias("label_agreement"),
        F.avg(F.when(labelled, right)).alias("label_agreement_lenient"),
        F.sum(labelled.cast("int")).alias("labelled"),
        F.sum("tokens").alias("judge_tokens"),
    )


def faithfulness(verdicts: Column) -> Column:
    """Mean of 1, 0.5 and 0 for supported, partial and unsupported claims."""
    scored = F.transform(verdicts, lambda v: F.coalesce(*[F.when(v == k, F.lit(s)) for k, s in VERDICT_SCORE.items()], F.lit(0.0)))
    return F.try_divide(F.aggregate(scored, F.lit(0.0), lambda a, x: a + x), F.size(scored))


def confusion(pairs: DataFrame, a: str, b: str, grades: Sequence) -> DataFrame:
    """Counts of (a, b) with a column for each value of b."""
    return pairs.groupBy(a).pivot(b, list(grades)).count().na.fill(0)


def agreement(pairs: DataFrame, a: str, b: str, right: str = "correct") -> DataFrame:
    return pairs.agg(F.count("*").alias("judged_by_both"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("exact"), F.avg(((F.col(a) == right) == (F.col(b) == right)).cast("double")).alias("binary"))


def average_ranks(df: DataFrame, col: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """Ranks from 1, ties sharing their mean rank. Ranks are taken over distinct values with their counts, so only
    these meet in one place."""
    counts = df.groupBy(*by, col).agg(F.count("*").alias("__n"))
    before = W.partitionBy(*by).orderBy(col).rowsBetween(W.unboundedPreceding, -1)
    ranks = counts.select(*by, col, (F.coalesce(F.sum("__n").over(before), F.lit(0)) + (F.col("__n") + 1) / 2).alias(out))
    return df.join(ranks, [*by, col])


def spearman(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank correlation with shared ranks for ties; null with fewer than three pairs or a constant side."""
    r = average_ranks(average_ranks(df, a, "__ra", by), b, "__rb", by)
    # the covariance by hand, as corr() fails on a constant side
    rho = F.when(F.count("*") >= 3, F.try_divide(F.covar_pop("__ra", "__rb"), F.stddev_pop("__ra") * F.stddev_pop("__rb")))
    return r.groupBy(*by).agg(rho.alias("spearman"), F.avg(F.abs(F.col(a) - F.col(b))).alias("mean_abs_difference"), F.sum((F.abs(F.col(a) - F.col(b)) >= 0.5).cast("int")).alias("disagreements"))


def claim_scores(answer_entailed: Column, reference_entailed: Column, beta: float = 1.0) -> Column:
    """struct<precision, coverage, f>: from whether each claim of the answer follows from the reference and the
    other way round."""
    count = lambda x, v: F.size(F.filter(x, lambda e: e == v)).cast("double")
    tp, fp, fn = count(answer_entailed, True), count(answer_entailed, False), count(reference_entailed, False)
    p, r = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    f = F.coalesce(F.try_divide((1 + beta**2) * p * r, beta**2 * p + r), F.lit(0.0))
    coverage = F.try_divide(count(reference_entailed, True), F.size(reference_entailed).cast("double"))
    return F.struct(p.alias("precision"), coverage.alias("coverage"), F.round(f, 2).alias("f"))


def gate(checks: DataFrame, metrics: DataFrame) -> DataFrame:
    """checks (label, metric, min, max) against metrics (metric, value): a missing or non-finite value fails."""
    j = checks.join(metrics, "metric", "left")
    v = F.col("value")
    ok = v.isNotNull() & ~F.isnan(v) & (F.col("min").isNull() | (v >= F.col("min"))) & (F.col("max").isNull() | (v <= F.col("max")))
    bound = F.when(F.col("min").isNotNull(), F.concat(F.lit(">= "), F.col("min").cast("string"))).otherwise(F.concat(F.lit("<= "), F.col("max").cast("string")))
    return j.select("label", "metric", "value", bound.alias("bound"), F.coalesce(ok, F.lit(False)).alias("passed"))


def gate_metrics(records: DataFrame, names: Sequence[str], prefix: Column) -> DataFrame:
    """Means of columns in long form: metric = prefix:name."""
    long = records.select(prefix.alias("p"), F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("v")) for n in names])).alias("m"))
    return long.groupBy(F.concat_ws(":", "p", "m.name").alias("metric")).agg(F.avg("m.v").alias("value"))


def sensitivity(r: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """How a judge grades answers that were made wrong on purpose."""
    n = lambda g: F.sum((F.col("grade") == g).cast("int"))
    return r.groupBy(*by).agg(F.count("*").alias("cases"), n("incorrect").alias("caught"), n("partially_correct").alias("partial"), n("correct").alias("missed"))


def analyzer_summary(r: DataFrame) -> DataFrame:
    flags = [c for c, t in r.dtypes if t == "boolean"]
    return r.agg(F.count("*").alias("questions"), *[F.avg(F.col(c).cast("double")).alias(c) for c in flags])


def retrieval_delta(gold: DataFrame, analyzed: DataFrame, metric: str) -> DataFrame:
    """Analyzed against gold filters; a refused question counts 0."""
    j = gold.select("id", F.col(metric).alias("gold")).join(analyzed.select("id", F.col(metric).alias("analyzed")), "id", "left")
    return j.select("id", "gold", F.coalesce("analyzed", F.lit(0.0)).alias("analyzed"), (F.coalesce("analyzed", F.lit(0.0)) - F.col("gold")).alias("delta"))


def passed_but_wrong(r: DataFrame) -> DataFrame:
    """Answers that the verifier let pass and the judge didn't grade correct."""
    return r.where(F.col("judged") & (F.col("verifier_supported") == 1.0) & (F.col("correctness") != "correct")).select("id", "correctness")


def column_agreement(cells: DataFrame) -> DataFrame:
    """Cells (row_key, period, release, value) told by at least two releases, and whether they agree."""
    g = cells.groupBy("row_key", "period").agg(F.count_distinct("release").alias("releases"), F.array_sort(F.collect_set("value")).alias("values"))
    return g.where("releases >= 2").withColumn("agree", F.size("values") == 1)


def resolve_quotes(pages: DataFrame, quotes: DataFrame) -> DataFrame:
    """pages (…, text) that contain a quote (…, quote), both normalised. Quotes are a stated, small set; every page is
    met with all of them in place, without a shuffle."""
    p = pages.withColumn("__t", F.lower(normalize_quotes(F.col("text")))).drop("text")
    q = quotes.withColumn("__q", F.lower(normalize_quotes(F.col("quote")))).drop("quote")
    return p.join(F.broadcast(q), F.contains(F.col("__t"), F.col("__q"))).drop("__t", "__q")


def validate_questions(questions: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, problem) of a question set against pages (ticker, fiscal_year, page, text)."""
    q, f = questions, F.col("filters")
    problem = lambda df, cond, text: df.where(cond).select("id", (F.lit(text) if isinstance(text, str) else text).alias("problem"))
    has = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    e = q.select("id", "filters", F.explode("evidence").alias("e"))
    outside = lambda c, v: has(f[c]) & ~F.array_contains(f[c], v)
    quarter = F.coalesce(F.col("e.fiscal_quarter"), F.lit(0)) != 0
    paged = e.select("id", F.col("e.ticker").alias("ticker"), F.col("e.fiscal_year").alias("fiscal_year"), F.explode("e.pages").alias("page"), F.col("e.quotes").alias("quotes"))
    j = paged.join(pages.select("ticker", "fiscal_year", "page", F.lower(normalize_quotes(F.col("text"))).alias("t")), ["ticker", "fiscal_year", "page"], "left")
    parts = [
        problem(q.groupBy("id").count(), F.col("count") > 1, "duplicate id"),
        problem(q, ~F.col("category").isin(*CATEGORIES), "unknown category"),
        problem(q, (F.col("category") == "unanswerable") == has("evidence"), "unanswerable questions have no evidence, others some"),
        problem(q, (F.col("category") == "follow_up") & ~(has("history") & F.col("standalone_query").isNotNull()), "follow_up needs history and standalone_query"),
        problem(e, outside("tickers", F.col("e.ticker")), "evidence ticker outside filters"),
        problem(e, outside("fiscal_years", F.col("e.fiscal_year")), "evidence year outside filters"),
        problem(e, quarter & outside("fiscal_quarters", F.col("e.fiscal_quarter")), "evidence quarter outside filters"),
        problem(e, ~quarter & ~has("e.pages"), "evidence without pages"),
        problem(e, ~has("e.quotes"), "evidence without quotes"),
        problem(j, F.col("t").isNull(), "no such page"),
        problem(j, F.col("t").isNotNull() & ~F.exists("quotes", lambda x: F.contains(F.col("t"), F.lower(normalize_quotes(x)))), "no quote on the page"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def grep(pages: DataFrame, pattern: str, width: int = 80) -> DataFrame:
    """Every match of a pattern with the text around it."""
    around = F.regexp_extract_all("text", F.lit(f"(?s)(.{{0,{width}}})({pattern})(.{{0,{width}}})"), F.lit(0))
    return pages.withColumn("context", F.explode(around)).drop("text")


def markdown(rows: list[dict], columns: Sequence[str]) -> str:
    """A small result as a table; the one renderer of all reports."""
    show = lambda v: "" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join([*lines, *("| " + " | ".join(show(r[c]) for c in columns) + " |" for r in rows)]) + "\n"
