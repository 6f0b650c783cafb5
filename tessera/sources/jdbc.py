"""A chunk table in a relational store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = "chunk_id text, doc_id text, ticker text, company text, fiscal_year integer, form text, filing_date text, period_end text, part text, section text, section_title text, subsection text, page_start integer, page_end integer, page_label_start text, page_label_end text, chunk_type text, context text, text text, token_count integer, source_url text, fiscal_quarter integer, metadata jsonb"
FILTER_COLUMNS = ("ticker", "fiscal_year", "section", "chunk_type", "fiscal_quarter", "form")


def ddl(table: str = "chunks", dim: int = 384, index: str | None = None) -> list[str]:
    """Statements that make the table, its filter indexes and, if asked for, an approximate vector index."""
    out = [f"CREATE TABLE IF NOT EXISTS {table} (row integer PRIMARY KEY, {COLUMNS}, embedding vector({dim}))"]
    out += [f"CREATE INDEX IF NOT EXISTS {table}_{c} ON {table} ({c})" for c in FILTER_COLUMNS]
    if index:
        out.append(f"CREATE INDEX IF NOT EXISTS {table}_{index} ON {table} USING {index} (embedding vector_ip_ops)")
    return out


def write(df: DataFrame, url: str, table: str = "chunks", **options: str) -> None:
    """Truncate and load in one transaction a partition."""
    df.write.format("jdbc").options(url=url, dbtable=table, truncate="true", **options).mode("overwrite").save()


def read(spark: SparkSession, url: str, table: str = "chunks", rows: int | None = None, partitions: int = 8, **options: str) -> DataFrame:
    """By row ranges in parallel if the number of rows is known."""
    r = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if rows:
        r = r.options(partitionColumn="row", lowerBound="0", upperBound=str(rows), numPartitions=str(partitions))
    return r.load()


def check_rows(df: DataFrame) -> None:
    """Rows must be 0 to n - 1 without gaps, as other stores refer to them."""
    x = df.agg(F.count("*").alias("n"), F.count_distinct("row").alias("d"), F.min("row").alias("lo"), F.max("row").alias("hi")).first()
    if x["n"] and (x["d"] != x["n"] or x["lo"] != 0 or x["hi"] != x["n"] - 1):
        raise ValueError("rows must be numbered 0 to n - 1")
