"""Sections of annual filings as ordered windows over blocks (doc_id, pos, kind, text, page, furniture)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Items in form order with their titles, and the patterns that find headings.
ITEMS = {
    "1": "Business",
    "1A": "Risk Factors",
    "1B": "Unresolved Staff Comments",
    "1C": "Cybersecurity",
    "2": "Properties",
    "3": "Legal Proceedings",
    "4": "Mine Safety Disclosures",
    "5": "Market for Registrant's Common Equity, Related Stockholder Matters and Issuer Purchases of Equity Securities",
    "6": "[Reserved]",
    "7": "Management's Discussion and Analysis of Financial Condition and Results of Operations",
    "7A": "Quantitative and Qualitative Disclosures About Market Risk",
    "8": "Financial Statements and Supplementary Data",
    "9": "Changes in and Disagreements with Accountants on Accounting and Financial Disclosure",
    "9A": "Controls and Procedures",
    "9B": "Other Information",
    "9C": "Disclosure Regarding Foreign Jurisdictions that Prevent Inspections",
    "10": "Directors, Executive Officers and Corporate Governance",
    "11": "Executive Compensation",
    "12": "Security Ownership of Certain Beneficial Owners and Management and Related Stockholder Matters",
    "13": "Certain Relationships and Related Transactions, and Director Independence",
    "14": "Principal Accountant Fees and Services",
    "15": "Exhibits and Financial Statement Schedules",
    "16": "Form 10-K Summary",
}
CORE_ITEMS = ("1", "1A", "7", "7A", "8")
ITEM = r"(?i)^(?:part\s+(?:iv|i{1,3})\W*)?items?\s+(\d{1,2}[a-c]?)\b"
PART = r"(?i)^part\s+(iv|i{1,3})\b"
ANNEX = (
    ("7", r"(?i)^management.?s discussion and analysis"),
    ("7A", r"(?i)^quantitative and qualitative disclosures? about market risk"),
    ("8", r"(?i)^(notes to (the )?consolidated financial statements|consolidated (balance sheets?|statements? of)|report of independent registered public accounting firm|index to (the )?consolidated financial statements)"),
)
ANNEX_AFTER = ("15", "16")
RELEASE_NO_HEADING = r"(?i)^(exhibit\s+99|for immediate release)"
COVER, COVER_TITLE, RELEASE = "Cover", "Cover Page and Table of Contents", "Earnings release"
HEADING_CHARS, TEXT_HEADING_CHARS = 200, 100
TOC_ITEMS, TOC_GAP = 4, 80
STUB_BLOCKS = 10


def _dim(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def item_candidate(kind: Column, text: Column) -> Column:
    """The item a block's text begins with, if it can be a heading: bold, or short."""
    item = F.upper(F.regexp_extract(text, ITEM, 1))
    fits = (kind != "table") & (F.length(text) <= HEADING_CHARS) & ((kind == "heading") | (F.length(text) <= TEXT_HEADING_CHARS))
    return F.when(fits & item.isin(*ITEMS), item)


def toc_pages(b: DataFrame, key: str = "doc_id") -> DataFrame:
    """Pages that list items with next to no text between them. Running sums of the text give the gaps."""
    upto = W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    size = F.when(F.col("furniture"), 0).otherwise(F.length("text"))
    c = b.withColumn("chars", F.sum(size).over(upto)).withColumn("own", size).where("candidate IS NOT NULL")
    page = W.partitionBy(key, "page").orderBy("pos")
    c = c.withColumn("gap", F.col("chars") - F.col("own") - F.lag("chars").over(page))
    return c.groupBy(key, "page").agg(F.count("*").alias("n"), F.avg("gap").alias("gap")).where((F.col("n") >= TOC_ITEMS) & (F.col("gap") < TOC_GAP)).select(key, "page", F.lit(True).alias("toc"))


def forward_items(b: DataFrame, key: str = "doc_id") -> DataFrame:
    """item_order: items only move forward, so the current item is the running maximum of the headings' order; a heading
    below it is a cross-reference."""
    place = _dim({x: i for i, x in enumerate(ITEMS)})
    upto = W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    order = F.when(F.col("candidate").isNotNull() & ~F.col("toc"), F.element_at(place, F.col("candidate")))
    return b.withColumn("item_order", F.max(order).over(upto)).withColumn("item", F.get(F.array(*map(F.lit, ITEMS)), F.col("item_order")))


def annex_items(b: DataFrame, key: str = "doc_id") -> DataFrame:
    """After the last items, headings of an annex give its blocks the item they stand for, if that item is a stub; a real
    heading ends the annex. Islands between ends, and the last annex heading within an island."""
    n = b.where(~F.col("furniture")).groupBy(key, "item").agg(F.count("*").alias("n"))
    full = n.where(F.col("n") >= STUB_BLOCKS).groupBy(key).agg(F.collect_set("item").alias("full"))
    text = F.replace(F.col("text"), F.lit("’"), F.lit("'"))
    can = (F.col("kind") != "table") & (F.length("text") <= 120) & ((F.col("kind") == "heading") | F.col("furniture"))
    mapped = F.when(can, F.coalesce(*[F.when(text.rlike(p), F.lit(i)) for i, p in ANNEX]))
    after = F.coalesce(F.col("item").isin(*ANNEX_AFTER), F.lit(False))
    order = W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    ends = (~after | F.col("candidate").isNotNull()).cast("int")
    j = b.join(full, key, "left").withColumn("island", F.sum(ends).over(order))
    start = F.when(after & F.col("candidate").isNull() & mapped.isNotNull() & ~F.coalesce(F.array_contains("full", mapped), F.lit(False)), mapped)
    within = W.partitionBy(key, "island").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    j = j.withColumn("annex", F.last(start, ignorenulls=True).over(within))
    return j.withColumn("item", F.coalesce(F.when(after, F.col("annex")), F.col("item"))).drop("full", "island", "annex")


def assign(b: DataFrame, key: str = "doc_id") -> DataFrame:
    """part, section, section_title and subsection of every block of annual filings."""
    b = b.withColumn("candidate", item_candidate(F.col("kind"), F.col("text")))
    b = b.join(toc_pages(b, key), [key, "page"], "left").withColumn("toc", F.coalesce("toc", F.lit(False)))
    b = annex_items(forward_items(b, key), key)
    order = W.partitionBy(key).orderBy("pos")
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    part_here = F.when((F.col("kind") != "table") & ~F.col("toc") & F.col("text").rlike(PART), F.concat(F.lit("Part "), F.upper(F.regexp_extract("text", PART, 1))))
    changed = (F.row_number().over(order) == 1) | ~F.col("item").eqNullSafe(F.lag("item").over(order))
    b = b.withColumn("part_here", part_here).withColumn("run", F.sum(changed.cast("int")).over(upto))
    bare = F.regexp_replace(F.lower("text"), "[^a-z]", "")
    title = F.regexp_replace(F.lower(F.element_at(_dim(ITEMS), F.col("item"))), "[^a-z]", "")
    echo = (bare != "") & F.startswith(title, bare)
    sub = F.when((F.col("kind") == "heading") & ~F.col("furniture") & F.col("item").isNotNull() & F.col("candidate").isNull() & F.col("part_here").isNull() & ~F.coalesce(echo, F.lit(False)), F.col("text"))
    in_run = W.partitionBy(key, "run").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    return b.select(
        *[c for c in b.columns if c not in ("candidate", "toc", "item_order", "item", "part_here", "run")],
        F.last("part_here", ignorenulls=True).over(upto).alias("part"),
        F.when(F.col("item").isNotNull(), F.concat(F.lit("Item "), F.col("item"))).otherwise(COVER).alias("section"),
        F.coalesce(F.element_at(_dim(ITEMS), F.col("item")), F.lit(COVER_TITLE)).alias("section_title"),
        F.last(sub, ignorenulls=True).over(in_run).alias("subsection"),
    )


def assign_release(b: DataFrame, key: str = "doc_id") -> DataFrame:
    """A release is one section; the nearest heading above is its subsection."""
    upto = W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    heading = F.when((F.col("kind") == "heading") & ~F.col("furniture") & ~F.col("text").rlike(RELEASE_NO_HEADING), F.col("text"))
    return b.withColumns({"part": F.lit(None).cast("string"), "section": F.lit(RELEASE), "section_title": F.lit(RELEASE), "subsection": F.last(heading, ignorenulls=True).over(upto)})
