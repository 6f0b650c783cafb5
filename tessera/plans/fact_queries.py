"""Facts, filings, evaluation and usage over orders, line items, events and labels, which stand in for filings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import percentiles
from tessera.operators import chunking, evaluation, facts, filings, usage
from tessera.plans.registry import query, table


def facts_of_orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Order totals by nation and year as reported values: the nation's filing for a year reports that year and the one
    before, but nations divisible by 3 leave their own year to the next filing."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    v = o.groupBy(F.col("c_nationkey").cast("string").alias("ticker"), F.year("o_orderdate").alias("y")).agg(F.round(F.sum("o_totalprice"), 0).alias("val"))
    own = v.where("NOT (CAST(ticker AS INT) % 3 = 0 AND y % 2 = 0)").select("ticker", "y", "val", F.col("y").alias("fy"), F.lit(0).alias("fact_no"))
    comparative = v.select("ticker", "y", "val", (F.col("y") + 1).alias("fy"), F.lit(1).alias("fact_no"))
    day = lambda y, md: F.concat(y.cast("string"), F.lit(md))
    f = own.unionByName(comparative).select(
        "ticker",
        F.lit("nation").alias("company"),
        F.lit("Revenues").alias("concept"),
        F.lit("Revenues").alias("concept_label"),
        F.lit("USD").alias("unit"),
        "fact_no",
        day(F.col("y"), "-01-01").alias("start"),
        day(F.col("y"), "-12-31").alias("end"),
        "val",
        F.concat_ws("-", "ticker", "fy").alias("accn"),
        F.lit("10-K").alias("form"),
        day(F.col("fy") + 1, "-02-01").alias("filed"),
    )
    periods = v.select("ticker", F.col("y").alias("fiscal_year"), F.concat_ws("-", "ticker", "y").alias("accession_number"), day(F.col("y"), "-12-31").alias("period_end"), day(F.col("y") + 1, "-02-01").alias("filing_date"), F.lit("").alias("source_url"))
    return f, periods, facts.metrics_dim(spark)


VALUES = """
v AS (SELECT c_nationkey::VARCHAR AS ticker, year(o_orderdate)::INTEGER AS y, round(sum(o_totalprice), 0) AS val FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
r AS (SELECT v.ticker, v.y AS fiscal_year, v.val, v.ticker::INTEGER % 3 = 0 AND v.y % 2 = 0 AS comparative, p.val AS prior_value
  FROM v LEFT JOIN v p ON p.ticker = v.ticker AND p.y = v.y - 1),
k AS (SELECT ticker, fiscal_year, val, comparative, CASE WHEN NOT comparative THEN prior_value END AS prior_value FROM r)"""


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.lookup(*facts_of_orders(spark, sf_dir))


@query(f"""WITH {VALUES} SELECT ticker, fiscal_year, val, comparative, prior_value FROM k""")
def facts_own_then_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The own filing's value before a later filing's comparative, with the same filing's prior year."""
    return resolved(spark, sf_dir).select("ticker", "fiscal_year", "val", "comparative", "prior_value")


@query(f"""WITH {VALUES}, c AS (SELECT ticker, fiscal_year, val, (val - prior_value) / abs(prior_value) * 100 AS ch FROM k),
s AS (SELECT ticker, min(fiscal_year) AS first_year, max(fiscal_year) AS last_year, arg_min(val, fiscal_year) AS a, arg_max(val, fiscal_year) AS b, count(*) AS n,
  count(*) FILTER (ch >= 1) AS ups FROM c GROUP BY ticker HAVING n > 1)
SELECT ticker, first_year, last_year, n::INTEGER AS n, ups::INTEGER AS ups, CASE WHEN (b - a) / abs(a) * 100 >= 1 THEN 'up' WHEN (b - a) / abs(a) * 100 <= -1 THEN 'down' ELSE 'flat' END AS overall FROM s""")
def facts_series_yoy(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = facts.series(resolved(spark, sf_dir))
    return s.select("ticker", "first_year", "last_year", F.size("years").alias("n"), F.size(F.filter("years", lambda y: y["direction"] == "up")).alias("ups"), "overall")


@query(f"""WITH {VALUES}, g AS (SELECT t.t AS ticker, y.y AS fiscal_year FROM (VALUES ('0'), ('1'), ('3')) t(t), (VALUES (1994), (1995), (1996), (2030)) y(y)),
m AS (SELECT g.ticker, string_agg(CASE WHEN comparative IS NULL THEN '-' WHEN comparative THEN 'c' ELSE 'x' END, '' ORDER BY g.fiscal_year) AS cell FROM g LEFT JOIN k USING (ticker, fiscal_year) GROUP BY g.ticker)
SELECT 'revenue' AS metric, max(cell) FILTER (ticker = '0') AS "0", max(cell) FILTER (ticker = '1') AS "1", max(cell) FILTER (ticker = '3') AS "3" FROM m""")
def facts_coverage_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.coverage(resolved(spark, sf_dir), ["0", "1", "3"], [1994, 1995, 1996, 2030]).where("metric = 'revenue'")


@query(f"""WITH {VALUES} SELECT ticker, fiscal_year, 'Total revenue, fiscal year ' || fiscal_year || ' (' || fiscal_year || '-01-01 to ' || fiscal_year || '-12-31)' AS head FROM k WHERE prior_value IS NULL""")
def fact_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = resolved(spark, sf_dir).where("prior_value IS NULL").select("ticker", "fiscal_year", facts.fact_text().alias("t"))
    return t.select("ticker", "fiscal_year", F.regexp_extract("t", r"^([^:]*):", 1).alias("head"))


def filing_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as filings of their customer: urgent ones annual, high ones quarterly, the rest current reports."""
    o = table(spark, sf_dir, "orders")
    p = F.substring("o_orderpriority", 1, 1)
    form = F.when(p == "1", "10-K").when(p == "2", "10-Q").otherwise("8-K")
    items = F.when(p == "3", "2.02,9.01").when(p == "4", "2.02,7.01").otherwise("5.02")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return o.select(F.col("o_custkey").alias("ticker"), F.col("o_orderkey").alias("pos"), form.alias("form"), F.when(p.isin("1", "2"), day).alias("reportDate"), day.alias("filingDate"), F.when(~p.isin("1", "2"), items).alias("items"))


FILINGS = """
f AS (SELECT o_custkey AS ticker, o_orderkey AS pos, CASE left(o_orderpriority, 1) WHEN '1' THEN '10-K' WHEN '2' THEN '10-Q' ELSE '8-K' END AS form, o_orderdate::DATE AS d,
  CASE left(o_orderpriority, 1) WHEN '3' THEN '2.02,9.01' WHEN '4' THEN '2.02,7.01' WHEN '5' THEN '5.02' END AS items FROM orders),
pe AS (SELECT ticker, d AS period_end, bool_or(form = '10-K') AS ends_year FROM f WHERE form <> '8-K' GROUP BY ALL),
ys AS (SELECT *, max(CASE WHEN ends_year THEN period_end END) OVER (PARTITION BY ticker ORDER BY period_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS year_start FROM pe),
fp AS (SELECT ticker, period_end, CASE WHEN ends_year THEN year(period_end) ELSE year(year_start + 365) END::INTEGER AS fiscal_year,
  CASE WHEN ends_year THEN 4 ELSE round_even((period_end - year_start) / 91.3::DOUBLE, 0) END::INTEGER AS fiscal_quarter FROM ys)"""


@query(f"""WITH {FILINGS} SELECT * FROM fp WHERE fiscal_quarter BETWEEN 1 AND 4 AND fiscal_year IS NOT NULL""")
def fiscal_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filings.fiscal_periods(filings.period_ends(filing_list(spark, sf_dir)))


@query(f"""WITH {FILINGS} SELECT f.ticker, f.pos, max(p.period_end) AS period_end FROM f LEFT JOIN pe p ON p.ticker = f.ticker AND p.period_end < f.d WHERE f.form = '8-K' GROUP BY ALL""")
def asof_previous_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each current report with the last period end strictly before it."""
    f = filing_list(spark, sf_dir)
    events = f.where("form = '8-K'").withColumn("filed", F.to_date("filingDate"))
    return filings.latest_before(events, filings.period_ends(f).select("ticker", "period_end"), "filed", "period_end", ["ticker"]).select("ticker", "pos", "period_end")


@query(f"""WITH {FILINGS}, c AS (SELECT f.ticker, f.pos, f.d, f.items, max(p.period_end) AS period_end FROM f JOIN pe p ON p.ticker = f.ticker AND p.period_end < f.d WHERE f.form = '8-K' AND f.items LIKE '2.02%' GROUP BY ALL),
k AS (SELECT c.*, fp.fiscal_year, fp.fiscal_quarter FROM c JOIN fp USING (ticker, period_end) WHERE c.d - c.period_end <= 120 AND fiscal_quarter BETWEEN 1 AND 4 AND fiscal_year BETWEEN 1992 AND 2030)
SELECT ticker, pos, fiscal_year, fiscal_quarter, row_number() OVER (PARTITION BY ticker, fiscal_year, fiscal_quarter ORDER BY items LIKE '%7.01', d, pos)::INTEGER AS preference FROM k""")
def release_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filings.release_candidates(filing_list(spark, sf_dir), range(1992, 2031)).select("ticker", "pos", "fiscal_year", "fiscal_quarter", "preference")


@query(f"""WITH {FILINGS}, n AS (SELECT ticker, pos, year(d)::INTEGER AS fiscal_year, row_number() OVER (PARTITION BY ticker, year(d) ORDER BY pos) AS k FROM f WHERE form = '10-K' AND year(d) IN (1994, 1995, 1996, 2023, 2024))
SELECT ticker, pos, fiscal_year FROM n WHERE k = 1""")
def first_per_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filings.first_per_year(filing_list(spark, sf_dir), [1994, 1995, 1996, 2023, 2024]).select("ticker", "pos", "fiscal_year")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0""")
def manifest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return filings.upsert(c.where("c_custkey % 2 = 0"), c.where("c_custkey % 3 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1), ["c_custkey"])


@query("""SELECT c_custkey FROM customer WHERE c_custkey % 2 = 1""")
def missing_downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey")
    return filings.missing_downloads(c, c.where("c_custkey % 2 = 0"), ["c_custkey"])


@query("""WITH f AS (SELECT d.lang AS query_id, row_number() OVER (PARTITION BY d.lang ORDER BY n_chars DESC, d.doc_id) AS rank, d.doc_id, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)),
n AS (SELECT query_id, count(*) AS n_items FROM f WHERE toxic = 1 GROUP BY ALL),
g AS (SELECT * FROM f WHERE toxic = 1),
m AS (SELECT query_id, min(rank) AS first, count(*) FILTER (rank <= 5) AS n5, count(*) FILTER (rank <= 10) AS n10, sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1.0::DOUBLE) END) AS dcg FROM g GROUP BY ALL)
SELECT query_id, round(1.0::DOUBLE / first, 8) AS mrr, round(n5 / n_items, 8) AS recall_5, (n5 > 0)::INTEGER::DOUBLE AS hit_5, round(n10 / n_items, 8) AS recall_10, (n10 > 0)::INTEGER::DOUBLE AS hit_10,
  round(coalesce(dcg, 0) / (SELECT sum(1 / log2(r + 1.0::DOUBLE)) FROM range(1, least(n_items, 10)::BIGINT + 1) t(r)), 8) AS ndcg_10 FROM n JOIN m USING (query_id)""")
def recall_mrr_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as evidence, documents by length as the ranking of each language."""
    from pyspark.sql import Window as W

    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    r = d.select(F.col("lang").alias("query_id"), F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id")).alias("rank"), F.col("doc_id").alias("item"), "toxic").where("toxic = 1")
    m = evaluation.ranking_metrics(r, r.groupBy("query_id").agg(F.count("*").alias("n_items")), (5, 10))
    return m.select("query_id", *[F.round(c, 8).alias(c) for c in ("mrr", "recall_5", "hit_5", "recall_10", "hit_10", "ndcg_10")])


@query("""SELECT event_type, round(median(value), 6) AS a, list_sort(list(value))[(floor(0.95::DOUBLE * (count(*) - 1)))::INTEGER + 1] AS b,
list_sort(list(value))[least(count(*) - 1, floor(0.95::DOUBLE * count(*)))::INTEGER + 1] AS c, round(quantile_cont(value, 0.95), 6) AS d FROM events GROUP BY event_type""")
def percentiles_four_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(percentiles.median(v), 6).alias("a"), percentiles.at_floor(v, 0.95).alias("b"), percentiles.at_share(v, 0.95).alias("c"), F.round(percentiles.interpolated(v, 0.95), 6).alias("d"))


@query("""SELECT source, count(*) AS chunks, (count(*) FILTER (n_chars > 2000))::BIGINT AS table_chunks, floor(median(n_chars))::INTEGER AS tokens_p50, list_sort(list(n_chars))[(floor(0.95::DOUBLE * (count(*) - 1)))::INTEGER + 1] AS tokens_p95,
max(n_chars) AS tokens_max, (count(*) FILTER (n_chars > 5000))::BIGINT AS chunks_over_limit, (4 - count(DISTINCT lang))::INTEGER AS missing FROM documents GROUP BY source""")
def doc_quality_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("n_chars").alias("token_count"), F.col("lang").alias("section"), F.when(F.col("n_chars") > 2000, "table").otherwise("text").alias("chunk_type"))
    s = chunking.filing_stats(d, d, ["en", "de", "fr", "es"], 5000)
    return s.withColumnRenamed("doc_id", "source").withColumn("missing", F.size("missing_core")).drop("missing_core")


@query("""SELECT lang AS doc_id, count(*) AS chunks, sum(len(regexp_extract_all(text, '\\d{1,3}(?:,\\d{3})+')))::BIGINT AS figures FROM documents GROUP BY lang""")
def release_quality_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("doc_id"), F.col("n_chars").alias("token_count"), "text", F.lit(None).cast("string").alias("subsection"))
    return chunking.release_stats(d, 5000).select("doc_id", "chunks", "figures")


@query("""SELECT quality, (count(*) FILTER (toxic = 0))::BIGINT AS "0", (count(*) FILTER (toxic = 1))::BIGINT AS "1" FROM labels GROUP BY quality""")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.confusion(table(spark, sf_dir, "labels"), "quality", "toxic", [0, 1])


@query("""SELECT count(*) AS judged_by_both, avg((quality = toxic)::INTEGER) AS exact, avg(((quality = 1) = (toxic = 1))::INTEGER) AS binary FROM labels""")
def judge_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.agreement(table(spark, sf_dir, "labels"), "quality", "toxic", right=1)


@query("""WITH p AS (SELECT source, quality::DOUBLE AS a, (n_chars % 5)::DOUBLE AS b FROM documents JOIN labels USING (doc_id)),
r AS (SELECT source, a, b, rank() OVER (PARTITION BY source ORDER BY a) + (count(*) OVER (PARTITION BY source, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY source ORDER BY b) + (count(*) OVER (PARTITION BY source, b) - 1) / 2 AS rb FROM p)
SELECT source, CASE WHEN count(*) >= 3 AND stddev_pop(ra) > 0 AND stddev_pop(rb) > 0 THEN round(corr(ra, rb), 6) + 0 END AS spearman, round(avg(abs(a - b)), 6) AS mean_abs_difference, (count(*) FILTER (abs(a - b) >= 0.5))::BIGINT AS disagreements FROM r GROUP BY source""")
def spearman_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("source", F.col("quality").cast("double").alias("a"), (F.col("n_chars") % 5).cast("double").alias("b"))
    s = evaluation.spearman(d, "a", "b", ["source"])
    return s.select("source", (F.round("spearman", 6) + 0.0).alias("spearman"), F.round("mean_abs_difference", 6).alias("mean_abs_difference"), "disagreements")


GATES = [("quality", "en:quality", 0.5, None), ("toxicity", "en:toxic", None, 0.05), ("missing", "xx:toxic", 0.0, None)]


@query("""WITH m AS (SELECT lang || ':quality' AS metric, avg(quality) AS value FROM labels JOIN documents USING (doc_id) GROUP BY lang UNION ALL SELECT lang || ':toxic', avg(toxic) FROM labels JOIN documents USING (doc_id) GROUP BY lang),
c(label, metric, lo, hi) AS (VALUES ('quality', 'en:quality', 0.5, NULL), ('toxicity', 'en:toxic', NULL, 0.05), ('missing', 'xx:toxic', 0.0, NULL))
SELECT label, coalesce(value >= lo, true) AND coalesce(value <= hi, true) AND value IS NOT NULL AS passed FROM c LEFT JOIN m USING (metric)""")
def gate_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    m = evaluation.gate_metrics(d, ["quality", "toxic"], F.col("lang"))
    return evaluation.gate(spark.createDataFrame(GATES, "label string, metric string, min double, max double"), m).select("label", "passed")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as records of an evaluation run."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    return e.select(
        i.cast("string").alias("id"),
        F.col("event_type").alias("category"),
        (i % 5 != 0).alias("answerable"),
        (i % 7 == 0).alias("abstained"),
        (i % 101 == 0).alias("error"),
        F.when(i % 5 != 0, (i % 3 != 0).cast("double")).alias("citation_hit"),
        F.when(i % 5 != 0, (i % 4) / 3.0).alias("evidence_recall"),
        F.when(i % 6 != 0, (i % 3) / 2.0).alias("claim_support"),
        F.when(i % 4 != 0, (i % 2).cast("double")).alias("figure_recall"),
        (i % 2 == 0).alias("cached"),
        F.col("value").alias("llm_ms"),
        (F.col("value") * 2).alias("retrieval_ms"),
        (i % 100).alias("prompt_tokens"),
        (i % 10).alias("completion_tokens"),
    )


@query("""WITH r AS (SELECT event_type AS category, event_id AS i, value, event_id % 5 <> 0 AS answerable, event_id % 7 = 0 AS abstained FROM events)
SELECT category, count(*) AS questions, (count(*) FILTER (i % 101 = 0))::BIGINT AS errors, round(avg(abstained::INTEGER) FILTER (NOT answerable), 8) AS abstention_recall, round(avg((NOT answerable)::INTEGER) FILTER (abstained), 8) AS abstention_precision,
round(avg(abstained::INTEGER) FILTER (answerable), 8) AS false_abstention_rate, round(avg((i % 3 <> 0)::INTEGER) FILTER (answerable), 8) AS citation_hit, round(avg((i % 4) / 3.0::DOUBLE) FILTER (answerable), 8) AS evidence_recall,
round(avg((i % 3) / 2.0::DOUBLE) FILTER (answerable AND NOT abstained AND i % 6 <> 0), 8) AS claim_support, round(avg((i % 2)::DOUBLE) FILTER (answerable AND i % 4 <> 0), 8) AS figure_recall,
(sum(i % 100) + sum(i % 10))::BIGINT AS total_tokens FROM r GROUP BY category""")
def generation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = evaluation.generation_summary(records(spark, sf_dir), ["category"]).drop("llm_p50_ms", "llm_p95_ms", "retrieval_p50_ms")
    return s.select(*[F.round(c, 8).alias(c) if t == "double" else F.col(c) for c, t in s.dtypes])


@query("""SELECT event_type AS category, count(*) AS questions, round(avg((event_id % 4) / 3.0::DOUBLE) FILTER (event_id % 5 <> 0), 8) AS evidence_recall,
list_sort(list(value))[least(count(*) - 1, floor(0.5::DOUBLE * count(*)))::INTEGER + 1] AS p50, list_sort(list(value))[least(count(*) - 1, floor(0.95::DOUBLE * count(*)))::INTEGER + 1] AS p95 FROM events GROUP BY event_type""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.run_summary(records(spark, sf_dir), ["evidence_recall"], "llm_ms").withColumn("evidence_recall", F.round("evidence_recall", 8))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as model calls: the type is the model, even users run locally."""
    e = table(spark, sf_dir, "events")
    return e.select(F.unix_timestamp("ts").alias("ts"), F.when(F.col("user_id") % 2 == 0, "ollama").otherwise("hosted").alias("provider"), F.col("event_type").alias("model"), (F.col("event_id") % 500).alias("prompt_tokens"), (F.col("event_id") % 50).alias("completion_tokens"), F.col("value").alias("latency_ms"))


CALLS = "c AS (SELECT ts, floor(epoch(ts))::BIGINT AS s, CASE WHEN user_id % 2 = 0 THEN 'local' ELSE 'hosted' END AS w, event_type AS model, event_id % 500 AS p, event_id % 50 AS q, value FROM events)"


@query(f"""WITH {CALLS}, g AS (SELECT d.d::DATE AS day, m.model AS series FROM (SELECT unnest(generate_series(min(ts)::DATE, max(ts)::DATE, INTERVAL 1 DAY)) AS d FROM c) d, (SELECT DISTINCT model FROM c) m)
SELECT g.day, g.series, coalesce(sum(p + q), 0)::BIGINT AS tokens FROM g LEFT JOIN c ON c.ts::DATE = g.day AND c.model = g.series GROUP BY ALL""")
def usage_by_day_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = calls(spark, sf_dir)
    day = lambda f: F.to_date(F.timestamp_seconds(f("ts")))
    return usage.by_day(c, day(F.min), day(F.max))


@query(f"""WITH {CALLS}, t AS (SELECT w, s, p, q, value FROM c UNION ALL SELECT 'total', s, p, q, value FROM c), n AS (SELECT max(s) AS now FROM c)
SELECT w AS "where", count(*) AS calls, sum(p + q)::BIGINT AS tokens, coalesce(sum(CASE WHEN now - s < 86400 THEN p + q END), 0)::BIGINT AS tokens_24h, (count(*) FILTER (now - s < 86400))::BIGINT AS calls_24h,
round(quantile_cont(value, 0.5), 6) AS latency_p50_ms, round(quantile_cont(value, 0.95), 6) AS latency_p95_ms FROM t, n GROUP BY w""")
def usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = calls(spark, sf_dir)
    now = F.lit(c.agg(F.max("ts")).first()[0])
    r = usage.hosted_local_total(c, now).drop("prompt_tokens", "completion_tokens")
    return r.withColumns({x: F.round(x, 6) for x in ("latency_p50_ms", "latency_p95_ms")})


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user and day as the spans of a turn."""
    e = table(spark, sf_dir, "events")
    start = F.unix_timestamp("ts").cast("double")
    span = F.struct(F.col("event_type").alias("name"), start.alias("start"), (start + F.col("value") / 1000).alias("end"))
    t = e.groupBy("user_id", F.to_date("ts").alias("d")).agg(F.collect_list(span).alias("spans"))
    return t.select(F.concat_ws("-", "user_id", "d").alias("id"), F.array_min(F.transform("spans", lambda s: s["start"])).alias("start"), F.array_max(F.transform("spans", lambda s: s["end"])).alias("end"), "spans")


@query("""WITH e AS (SELECT user_id, ts::DATE AS d, event_type AS node, floor(epoch(ts))::BIGINT::DOUBLE AS s, floor(epoch(ts))::BIGINT::DOUBLE + value / 1000 AS f FROM events),
n AS (SELECT user_id, d, node, sum((f - s) * 1000) AS ms FROM e GROUP BY ALL UNION ALL SELECT user_id, d, 'total', (max(f) - min(s)) * 1000 FROM e GROUP BY ALL)
SELECT node, count(*) AS n, round(quantile_cont(ms, 0.5), 3) AS p50, round(quantile_cont(ms, 0.95), 3) AS p95 FROM n GROUP BY node""")
def trace_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.trace_summary(turns(spark, sf_dir)).withColumns({c: F.round(c, 3) for c in ("p50", "p95")})


@query("""SELECT o_custkey AS row_key, count(DISTINCT o_orderpriority)::BIGINT AS releases, count(DISTINCT o_orderstatus) = 1 AS agree FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) >= 2""")
def cross_release_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("row_key"), F.lit(1).alias("period"), F.col("o_orderpriority").alias("release"), F.col("o_orderstatus").alias("value"))
    return evaluation.column_agreement(o).select("row_key", "releases", "agree")


@query("""WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations), k AS (SELECT conv_id, count(*) AS n, max(turn) AS last_seq FROM t WHERE back <= 6 GROUP BY ALL)
SELECT conv_id AS thread_id, last_seq, n::INTEGER AS n FROM k""")
def thread_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("thread_id"), F.col("turn").alias("seq"), F.col("text").alias("question"), F.col("role").alias("answer"))
    m = usage.memory(c, max_threads=1_000_000)
    return m.select("thread_id", "last_seq", F.size("turns").alias("n"))
