"""Structured facts from company filings: own filing first, else the first later filing; series and coverage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.numbers import change_pct, direction, format_value

END_TOLERANCE = 7
YEAR_DAYS = (340, 380)
MAX_FACTS = 8


@dataclass(frozen=True)
class Metric:
    key: str
    label: str
    concepts: tuple[str, ...]
    unit: str = "USD"
    instant: bool = False


# Metrics and the taxonomy concepts that report them, in order of preference.
METRICS = (
    Metric("revenue", "Total revenue", ("Revenues", "RevenueFromContractWithCustomerExcludingAssessedTax", "RevenuesNetOfInterestExpense", "SalesRevenueNet")),
    Metric("net_income", "Net income", ("NetIncomeLoss", "ProfitLoss")),
    Metric("operating_income", "Operating income", ("OperatingIncomeLoss",)),
    Metric("gross_profit", "Gross profit", ("GrossProfit",)),
    Metric("rnd", "Research and development expense", ("ResearchAndDevelopmentExpense", "ResearchAndDevelopmentExpenseExcludingAcquiredInProcessCost")),
    Metric("capex", "Purchases of property and equipment", ("PaymentsToAcquirePropertyPlantAndEquipment", "PaymentsToAcquireProductiveAssets")),
    Metric("operating_cash_flow", "Net cash from operating activities", ("NetCashProvidedByUsedInOperatingActivities",)),
    Metric("buybacks", "Repurchases of common stock", ("PaymentsForRepurchaseOfCommonStock",)),
    Metric("eps_diluted", "Diluted earnings per share", ("EarningsPerShareDiluted",), "USD/shares"),
    Metric("total_assets", "Total assets", ("Assets",), instant=True),
    Metric("total_liabilities", "Total liabilities", ("Liabilities",), instant=True),
    Metric("stockholders_equity", "Stockholders' equity", ("StockholdersEquity", "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest"), instant=True),
    Metric("cash", "Cash and cash equivalents", ("CashAndCashEquivalentsAtCarryingValue", "CashAndDueFromBanks"), instant=True),
)

# Words that ask for a metric, and words that name a part of a company, for which no total is given.
METRIC_CUES = {
    "revenue": r"\b(?:total |net |consolidated )*(?:revenues?|net sales|sales)\b",
    "net_income": r"\bnet (?:income|earnings|profit)\b|\bearned\b",
    "operating_income": r"\boperating (?:income|profit)\b",
    "gross_profit": r"\bgross (?:profit|margin)\b",
    "rnd": r"\bresearch and development\b|\bR&D\b",
    "capex": r"\bcapital expenditures?\b|\bcapex\b",
    "operating_cash_flow": r"\b(?:operating cash flows?|cash (?:flows? )?from operations|cash provided by operating)\b",
    "buybacks": r"\b(?:repurchase[sd]?|buybacks?)\b",
    "eps_diluted": r"\b(?:diluted )?(?:EPS|earnings per share)\b",
    "total_assets": r"\btotal assets\b",
    "total_liabilities": r"\btotal liabilities\b",
    "stockholders_equity": r"\b(?:stockholders'?|shareholders'?) equity\b",
}
SEGMENT_CUES = (
    r"(?i)\b(?:segments?|services|cloud|azure|aws|data center|gaming|search|youtube|advertising|ads|iphone|ipad|mac|wearables|automotive|energy|"
    r"regulatory credits|reality labs|family of apps|international|cross-border|china|greater china|americas|europe|subscriptions?|devices|"
    r"interest income|deliver(?:y|ies|ed)|employees|customers?)\b"
)


def metrics_dim(spark: SparkSession, metrics: tuple[Metric, ...] = METRICS) -> DataFrame:
    """A row for each metric and concept, with the concept's preference."""
    rows = [(i, m.key, m.label, m.unit, m.instant, j, c) for i, m in enumerate(metrics) for j, c in enumerate(m.concepts)]
    return spark.createDataFrame(rows, "metric_no int, metric string, label string, unit string, instant boolean, concept_no int, concept string")


def flatten(company_facts: DataFrame) -> DataFrame:
    """A row for each reported value: ticker, company, concept, concept_label, unit, fact_no (order in the file), start, end,
    val, accn, form, filed."""
    by_concept = company_facts.select("ticker", F.col("entityName").alias("company"), F.explode(F.col("facts")["us-gaap"]).alias("concept", "c"))
    by_unit = by_concept.select("ticker", "company", "concept", F.col("c.label").alias("concept_label"), F.explode("c.units").alias("unit", "values"))
    rows = by_unit.select("ticker", "company", "concept", "concept_label", "unit", F.posexplode("values").alias("fact_no", "f"))
    return rows.select("ticker", "company", "concept", F.coalesce("concept_label", "concept").alias("concept_label"), "unit", "fact_no", "f.start", "f.end", "f.val", "f.accn", "f.form", "f.filed")


def covers_year(start: Column, end: Column, period_end: Column, instant: Column) -> Column:
    """Ends within a week of the period's end; a flow lasts a year, a balance has no start."""
    near = F.abs(F.datediff(F.to_date(end), F.to_date(period_end))) <= END_TOLERANCE
    return near & F.when(instant, start.isNull()).otherwise(F.coalesce(F.datediff(F.to_date(end), F.to_date(start)).between(*YEAR_DAYS), F.lit(False)))


def lookup(facts: DataFrame, filings: DataFrame, metrics: DataFrame) -> DataFrame:
    """One fact for each filing and metric that resolves.

    ``facts`` as from flatten(); ``filings`` (ticker, fiscal_year, accession_number, period_end, filing_date, source_url), annual
    ones. A filing's own values, over all concepts, come before any later filing's comparative; then the concept's
    preference, the filing date of a later filing and the order in the file decide. Joins are on company and year, with
    the dates as a range within them."""
    own_key = ["ticker", "fiscal_year", "metric"]
    f = facts.join(F.broadcast(metrics), ["concept", "unit"])
    # a fact meets the filings whose period ends about its own end, by company and year
    near = F.array_distinct(F.array(*[F.year(F.date_add(F.to_date("period_end"), d)) for d in (-END_TOLERANCE, END_TOLERANCE)]))
    j = f.withColumn("__year", F.year(F.to_date("end"))).join(filings.withColumn("__year", F.explode(near)), ["ticker", "__year"]).drop("__year").where(covers_year(F.col("start"), F.col("end"), F.col("period_end"), F.col("instant")))
    own = F.col("accn") == F.col("accession_number")
    later = (F.col("form") == "10-K") & (F.col("filed") > F.col("filing_date"))
    c = j.where(own | later).withColumn("comparative", ~own)
    order = W.partitionBy(*own_key).orderBy("comparative", "concept_no", F.when(F.col("comparative"), F.col("filed")).otherwise(""), "fact_no")
    best = c.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n", "fact_no")
    prior = facts.select("ticker", "concept", "unit", "accn", F.col("start").alias("p_start"), F.col("end").alias("p_end"), F.col("val").alias("p_val"), F.col("fact_no").alias("p_no"))
    before = F.date_add(F.to_date("end"), -365).cast("string")
    p = best.select(*own_key, "concept", "unit", "accn", "instant", before.alias("prior_end")).join(prior, ["ticker", "concept", "unit", "accn"])
    p = p.where(covers_year(F.col("p_start"), F.col("p_end"), F.col("prior_end"), F.col("instant"))).groupBy(*own_key).agg(F.min_by("p_val", "p_no").alias("prior_value"))
    out = best.join(p, own_key, "left")
    return out.withColumn("change_pct", change_pct(F.col("val"), F.col("prior_value"))).withColumn("direction", direction(F.col("change_pct")))


def conflicts(facts: DataFrame, filings: DataFrame, metrics: DataFrame) -> DataFrame:
    """Own values of a concept and period that differ within one filing."""
    j = facts.join(F.broadcast(metrics), ["concept", "unit"]).join(filings, "ticker").where("accn = accession_number").where(covers_year(F.col("start"), F.col("end"), F.col("period_end"), F.col("instant")))
    return j.groupBy("ticker", "fiscal_year", "concept").agg(F.array_sort(F.collect_set("val")).alias("values")).where(F.size("values") > 1)


def lookup_many(resolved: DataFrame, tickers: list[str], years: list[int], metrics: list[str], limit: int = MAX_FACTS) -> DataFrame:
    """Facts in the order of the request: company, year, metric."""
    place = lambda c, values: F.array_position(F.array(*map(F.lit, values)), F.col(c))
    hit = resolved.where(F.col("ticker").isin(tickers) & F.col("fiscal_year").isin(years) & F.col("metric").isin(metrics))
    return hit.orderBy(place("ticker", tickers), place("fiscal_year", years), place("metric", metrics)).limit(limit)


def detect_metrics(question: Column) -> Column:
    """Company totals a question asks about; none if it names a segment. Plain "earnings" is net income."""
    found = F.filter(F.array(*[F.when(question.rlike(f"(?i){p}"), F.lit(k)) for k, p in METRIC_CUES.items()]), lambda x: x.isNotNull())
    plain = F.array_contains(found, "net_income") & ~question.rlike(r"(?i)\bper share\b|\bEPS\b")
    found = F.when(plain, F.array_remove(found, "eps_diluted")).otherwise(found)
    return F.when(question.rlike(SEGMENT_CUES), F.array().cast("array<string>")).otherwise(found)


def fact_text() -> Column:
    """The fact in words, as a filing would put it."""
    signed = lambda c: F.concat(F.when(c >= 0, "+").otherwise(""), F.format_number(c, 1), F.lit("%"))
    period = F.when(F.col("instant"), F.concat(F.lit("as of "), F.col("end"))).otherwise(F.format_string("fiscal year %d (%s to %s)", "fiscal_year", "start", "end"))
    prior = F.when(F.col("prior_value").isNotNull(), F.concat(F.lit("; prior year: "), format_value(F.col("prior_value"), F.col("unit")), F.coalesce(F.concat(F.lit("; change: "), signed(F.col("change_pct"))), F.lit("")))).otherwise("")
    source = F.when(F.col("comparative"), F.format_string(", comparative in the next 10-K (filed %s); the fiscal %d 10-K does not tag it", "filed", "fiscal_year")).otherwise(F.format_string(", Form 10-K for fiscal %d", "fiscal_year"))
    return F.concat(F.col("label"), F.lit(", "), period, F.lit(": "), format_value(F.col("val"), F.col("unit")), prior, F.lit(". Source: XBRL us-gaap:"), F.col("concept"), F.lit(" ("), F.col("concept_label"), F.lit(")"), source, F.lit("."))


def series(resolved: DataFrame) -> DataFrame:
    """Company and metric with at least two years: the years in order with changes, and the direction overall."""
    rows = F.array_sort(F.collect_list(F.struct("fiscal_year", "val", "change_pct", "direction", "comparative")))
    s = resolved.groupBy("ticker", "metric").agg(rows.alias("years")).where(F.size("years") > 1)
    first, last = F.get("years", F.lit(0)), F.element_at("years", -1)
    return s.withColumn("overall", direction(change_pct(last["val"], first["val"]))).withColumn("first_year", first["fiscal_year"]).withColumn("last_year", last["fiscal_year"])


def coverage(resolved: DataFrame, tickers: list[str], years: list[int]) -> DataFrame:
    """metric by company: a mark for each year in order, c for a comparative and - for none."""
    spark = resolved.sparkSession
    grid = spark.createDataFrame([(m.key, t, y) for m in METRICS for t in tickers for y in years], "metric string, ticker string, fiscal_year int")
    j = grid.join(resolved.select("metric", "ticker", "fiscal_year", "comparative"), ["metric", "ticker", "fiscal_year"], "left")
    mark = F.when(F.col("comparative").isNull(), "-").when(F.col("comparative"), "c").otherwise("x")
    cells = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("fiscal_year", mark.alias("m")))), lambda s: s["m"]), "")
    return j.groupBy("metric").pivot("ticker", tickers).agg(cells)


def filing_periods(manifest: DataFrame) -> DataFrame:
    return manifest.where("form = '10-K'").select("ticker", "fiscal_year", "accession_number", F.col("report_date").alias("period_end"), "filing_date", "source_url")
