"""Readers and writers, each with its schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schemas
from tessera.operators.filings import upsert


def chunks(spark: SparkSession, annual: str, releases: str | None = None) -> DataFrame:
    """The corpus: annual filings first, then releases if there are any; ``row`` numbers stay within each part."""
    read = lambda p, n: spark.read.schema(schemas.CHUNK).json(p).withColumn("part_no", F.lit(n))
    out = read(annual, 0)
    return out.unionByName(read(releases, 1)) if releases else out


def strict_chunks(spark: SparkSession, path: str) -> DataFrame:
    """As chunks(), but a field that the schema doesn't know is an error."""
    seen = spark.read.json(path).columns
    known = {f.split(" ")[0] for f in schemas.CHUNK.replace("map<string,string>", "map").split(", ")}
    if unknown := set(seen) - known:
        raise ValueError(f"unknown fields: {sorted(unknown)}")
    return chunks(spark, path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.FILING).option("multiLine", True).json(path)


def update_manifest(spark: SparkSession, path: str, out: str, new: DataFrame, key: tuple[str, ...] = ("ticker", "form", "fiscal_year")) -> None:
    """Upsert by key and write sorted to ``out``; the old file stays for a reader at work."""
    upsert(manifest(spark, path), new, key).orderBy(*key).coalesce(1).write.mode("overwrite").json(out)


def raw_html(spark: SparkSession, path: str) -> DataFrame:
    """path and html of the files of a folder."""
    return spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("html"))


def company_facts(spark: SparkSession, path: str) -> DataFrame:
    """One row a company file; the file's name is the ticker."""
    f = spark.read.schema(schemas.COMPANY_FACTS).option("multiLine", True).json(path)
    return f.withColumn("ticker", F.regexp_extract(F.input_file_name(), r"([A-Za-z]+)[^/]*\.json$", 1))


def questions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.GOLD).json(path)


def labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.LABEL).json(path)


def traces(spark: SparkSession, path: str) -> DataFrame:
    """Broken or half-written lines are passed over."""
    return spark.read.schema(schemas.TRACE).option("mode", "DROPMALFORMED").json(path)


def recent_turns(spark: SparkSession, path: str, n: int = 30) -> DataFrame:
    return traces(spark, path).where("id IS NOT NULL").orderBy(F.desc("start")).limit(n)


def call_ledger(spark: SparkSession, path: str) -> DataFrame:
    """One file a call; its modification time is when the call was made. Unreadable files are passed over."""
    c = spark.read.schema(schemas.CALL).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    c = c.select("*", F.unix_timestamp(F.col("_metadata.file_modification_time")).alias("ts"))
    c = c.where(F.col("provider").isNotNull() & F.col("usage").isNotNull() & F.col("latency_ms").isNotNull())
    return c.select("ts", "provider", "model", "text", "usage.prompt_tokens", "usage.completion_tokens", "latency_ms")


def log_tail(spark: SparkSession, path: str, n: int = 400) -> DataFrame:
    """The last lines of a text file, in order."""
    t = spark.read.text(path).withColumn("pos", F.monotonically_increasing_id())
    return t.orderBy(F.desc("pos")).limit(n).orderBy("pos").select("value")


def embedding_cache(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.EMBEDDING).parquet(path)


def gate(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.GATE).option("multiLine", True).json(path).select(F.inline("checks"))


def write_rows(df: DataFrame, path: str, form: str = "parquet", partition_by: tuple[str, ...] = ()) -> None:
    """A sink for chunks, pages and reports; partitioned by form, a search for one reads one."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).format(form).save(path)
