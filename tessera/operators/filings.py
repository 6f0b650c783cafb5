"""Filing lists: which filings, of which fiscal period, and the manifest that records them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RELEASE_ITEM, ROUTINE_ITEM = "2.02", "9.01"
MAX_LAG_DAYS = 120
QUARTER_DAYS = 91.3
ARCHIVE = "https://www.sec.gov/Archives/edgar/data/%s/%s/%s"


def rows_of_columns(columns: DataFrame, names: Sequence[str], key: Sequence[str] = ()) -> DataFrame:
    """Equal-length arrays to rows, with their place; the shortest array ends them."""
    n = F.array_min(F.array(*[F.size(c) for c in names]))
    z = F.slice(F.arrays_zip(*names), 1, F.greatest(n, F.lit(0)))
    return columns.select(*key, F.posexplode(z).alias("pos", "r")).select(*key, "pos", "r.*")


def first_per_year(filings: DataFrame, years: Sequence[int], forms: Sequence[str] = ("10-K",), by: Sequence[str] = ("ticker",)) -> DataFrame:
    """The first listed annual filing of each fiscal year; rows without a report date don't count."""
    f = filings.where(F.col("form").isin(*forms) & (F.coalesce("reportDate", F.lit("")) != "")).withColumn("fiscal_year", F.substring("reportDate", 1, 4).cast("int"))
    f = f.where(F.col("fiscal_year").isin(*years))
    return f.withColumn("__n", F.row_number().over(W.partitionBy(*by, "fiscal_year").orderBy("pos"))).where("__n = 1").drop("__n")


def period_ends(filings: DataFrame, by: Sequence[str] = ("ticker",)) -> DataFrame:
    """period_end and whether it ends a fiscal year."""
    f = filings.where(F.col("form").isin("10-K", "10-Q") & (F.coalesce("reportDate", F.lit("")) != ""))
    return f.groupBy(*by, F.to_date("reportDate").alias("period_end")).agg(F.max(F.col("form") == "10-K").alias("ends_year"))


def fiscal_periods(ends: DataFrame, by: Sequence[str] = ("ticker",)) -> DataFrame:
    """Fiscal year and quarter of each period end, counted from the fiscal-year end before it; without one, or
    beyond the third quarter, there is none. The year end before is a running last value."""
    before = W.partitionBy(*by).orderBy("period_end").rowsBetween(W.unboundedPreceding, -1)
    e = ends.withColumn("year_start", F.last(F.when(F.col("ends_year"), F.col("period_end")), ignorenulls=True).over(before))
    quarter = F.bround(F.datediff("period_end", "year_start") / F.lit(QUARTER_DAYS), 0).cast("int")
    year = F.when(F.col("ends_year"), F.year("period_end")).otherwise(F.year(F.date_add("year_start", 365)))
    return e.select(*by, "period_end", year.alias("fiscal_year"), F.when(F.col("ends_year"), 4).otherwise(quarter).alias("fiscal_quarter")).where(F.col("fiscal_quarter").between(1, 4) & F.col("fiscal_year").isNotNull() & (F.col("period_end").isNotNull()))


def latest_before(events: DataFrame, points: DataFrame, event_date: str, point_date: str, by: Sequence[str]) -> DataFrame:
    """As-of join: each event with the last point strictly before it. One sort of both sides by key and date, and a
    running last value; no range join."""
    p = points.select(*by, F.col(point_date).alias("__at"), F.lit(1).alias("__event"), F.struct(*points.columns).alias("__point"), F.lit(None).alias("__row"))
    e = events.select(*by, F.col(event_date).alias("__at"), F.lit(0).alias("__event"), F.lit(None).alias("__point"), F.struct(*events.columns).alias("__row"))
    # at equal dates events sort first, so a point of the same day isn't seen
    order = W.partitionBy(*by).orderBy("__at", "__event").rowsBetween(W.unboundedPreceding, W.currentRow)
    j = p.unionByName(e).withColumn("__point", F.last("__point", ignorenulls=True).over(order)).where("__event = 0")
    return j.select("__row.*", *[F.col(f"__point.{c}").alias(c) for c in points.columns if c not in by])


def release_candidates(filings: DataFrame, years: Sequence[int], by: Sequence[str] = ("ticker",)) -> DataFrame:
    """Current reports on results within the lag after a period end, best first (preference): those without further
    items, then by date."""
    ends = period_ends(filings, by)
    periods = fiscal_periods(ends, by)
    items = F.split(F.coalesce("items", F.lit("")), ",")
    current = filings.where((F.col("form") == "8-K") & F.array_contains(items, RELEASE_ITEM)).withColumn("filed", F.to_date("filingDate"))
    extra = F.size(F.array_except(items, F.array(F.lit(RELEASE_ITEM), F.lit(ROUTINE_ITEM)))) > 0
    last = latest_before(current.withColumn("extra_items", extra), ends.select(*by, "period_end"), "filed", "period_end", by)
    last = last.where(F.datediff("filed", "period_end") <= MAX_LAG_DAYS)
    c = last.join(periods, [*by, "period_end"]).where(F.col("fiscal_year").isin(*years))
    return c.withColumn("preference", F.row_number().over(W.partitionBy(*by, "fiscal_year", "fiscal_quarter").orderBy("extra_items", "filingDate", "pos")))


def looks_like_release(html: Column) -> Column:
    """Carries an income statement: diluted shares, and net income, earnings or loss."""
    text = F.lower(F.regexp_replace(html, "<[^>]+>", " "))
    return F.contains(text, F.lit("diluted")) & (F.contains(text, F.lit("net income")) | F.contains(text, F.lit("net earnings")) | F.contains(text, F.lit("net loss")))


def choose_release(candidates: DataFrame, by: Sequence[str] = ("ticker", "fiscal_year", "fiscal_quarter")) -> DataFrame:
    """Of candidates (preference, html; null html: no exhibit) the first that looks like a release, else the first with an
    exhibit; content is only looked at if there is a choice."""
    n = F.count("*").over(W.partitionBy(*by))
    c = candidates.withColumn("__n", n).where(F.col("html").isNotNull())
    good = F.when(F.col("__n") == 1, True).otherwise(looks_like_release(F.col("html")))
    order = W.partitionBy(*by).orderBy(F.desc("confirmed"), "preference")
    return c.withColumn("confirmed", good).withColumn("__k", F.row_number().over(order)).where("__k = 1").drop("__n", "__k")


def exhibit_document(index_html: Column, exhibit: str = "EX-99.1") -> Column:
    """File name of an exhibit in a filing's index table: the third cell's first word in the row whose fourth cell
    names it."""
    rows = F.regexp_extract_all(index_html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))

    def cells(row: Column) -> Column:
        raw = F.regexp_extract_all(row, F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1))
        return F.transform(raw, lambda c: F.trim(F.replace(F.regexp_replace(c, "<[^>]+>", ""), F.lit("&nbsp;"), F.lit(" "))))

    hits = F.filter(F.transform(rows, cells), lambda c: F.upper(F.coalesce(F.get(c, F.lit(3)), F.lit(""))) == exhibit)
    return F.get(F.split(F.get(F.get(hits, F.lit(0)), F.lit(2)), r"\s+"), F.lit(0))


def document_url(cik: Column, accession: Column, document: Column) -> Column:
    return F.format_string(ARCHIVE, cik.cast("string"), F.replace(accession, F.lit("-"), F.lit("")), document)


def upsert(manifest: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """New rows win on the key."""
    both = manifest.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    n = F.row_number().over(W.partitionBy(*key).orderBy(F.desc("__new")))
    return both.withColumn("__n", n).where("__n = 1").drop("__n", "__new")


def missing_downloads(wanted: DataFrame, manifest: DataFrame, key: Sequence[str], force: bool = False) -> DataFrame:
    return wanted if force else wanted.join(manifest.select(*key), list(key), "left_anti")


def document_id(ticker: Column, year: Column, quarter: Column) -> Column:
    return F.when(quarter.isNotNull() & (quarter != 0), F.format_string("%s-FY%d-Q%d-EX-99.1", ticker, year, quarter)).otherwise(F.format_string("%s-FY%d-10-K", ticker, year))
