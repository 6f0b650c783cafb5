"""Structure, chunking, reading of questions and checking of claims over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import numbers, text
from tessera.operators import chunking, context, html_blocks, planning, sections, verification
from tessera.plans.registry import query, table


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as filings: a line is a block, ten lines a page; short lines are headings."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    kind = F.when(F.length("text") < 30, "heading").otherwise("text")
    return d.select("doc_id", F.col("pos").cast("int").alias("pos"), kind.alias("kind"), "text", (F.floor(F.col("pos") / 10) + 1).cast("int").alias("page"), F.lit(None).cast("array<array<string>>").alias("rows"), F.lit(0).alias("header_rows"), F.lit(False).alias("furniture"))


LINES = """
x AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
b AS (SELECT doc_id, (pos - 1)::INTEGER AS pos, l[pos] AS text, ((pos - 1) // 10 + 1)::INTEGER AS page, CASE WHEN length(l[pos]) < 30 THEN 'heading' ELSE 'text' END AS kind
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS pos FROM x))"""


@query(f"""WITH {LINES},
k AS (SELECT doc_id, page, regexp_replace(lower(text), '\\d+', '#', 'g') AS line_key FROM b WHERE length(text) <= 100 AND NOT regexp_matches(text, '(?i)million|billion|thousand|%|except')),
n AS (SELECT doc_id, max(page) AS n FROM b GROUP BY doc_id)
SELECT k.doc_id, line_key, count(DISTINCT page) AS pages FROM k JOIN n USING (doc_id) GROUP BY k.doc_id, line_key, n HAVING count(DISTINCT page) >= greatest(5, n * 0.25)""")
def boilerplate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.running_lines(lines(spark, sf_dir))


@query(f"""WITH {LINES}, h AS (SELECT *, CASE WHEN kind = 'heading' AND NOT regexp_matches(text, '(?i)^(exhibit\\s+99|for immediate release)') THEN text END AS h FROM b)
SELECT doc_id, pos, last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS subsection FROM h""")
def section_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.assign_release(lines(spark, sf_dir)).select("doc_id", "pos", "subsection")


ITEM_ROWS = """
e AS (SELECT user_id, event_id, ts, event_type, CASE WHEN event_type IN ('signup', 'purchase') THEN (event_id % 23)::INTEGER END AS candidate FROM events)"""


@query(f"""WITH {ITEM_ROWS} SELECT user_id, event_id, max(candidate) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS item_order FROM e""")
def running_max_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forward-only items: a candidate below the running maximum is a cross-reference."""
    names = F.array(*map(F.lit, sections.ITEMS))
    candidate = F.when(F.col("event_type").isin("signup", "purchase"), F.get(names, (F.col("event_id") % 23).cast("int")))
    b = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_id").alias("pos"), candidate.alias("candidate"), F.lit(False).alias("toc"))
    return sections.forward_items(b, "user_id").select("user_id", "event_id", "item_order")


@query("""WITH e AS (SELECT user_id, event_id, event_type AS section, (event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id))::INTEGER AS new FROM events),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM e)
SELECT user_id, run::BIGINT AS run, any_value(section) AS section, min(event_id) AS first_pos, count(*) AS n FROM r GROUP BY user_id, run""")
def islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive groups: a section that comes again is another run."""
    b = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("pos"), F.col("event_type").alias("section"), F.lit(False).alias("furniture"))
    # lag() of a run's first row is null, which differs from any section
    return chunking.section_runs(b, "user_id").groupBy("user_id", "run").agg(F.first("section").alias("section"), F.min("pos").alias("first_pos"), F.count("*").alias("n"))


@query("""WITH raw AS (SELECT conv_id, turn + 1 AS page, turn + CASE WHEN length(text) % 7 = 0 THEN 9 ELSE 3 END AS n FROM conversations WHERE length(text) % 5 <> 0),
v AS (SELECT *, coalesce(lag(page) OVER w = page - 1 AND lag(n) OVER w = n - 1, false) OR coalesce(lead(page) OVER w = page + 1 AND lead(n) OVER w = n + 1, false) AS ok FROM raw WINDOW w AS (PARTITION BY conv_id ORDER BY page)),
g AS (SELECT *, lead(page) OVER w - page AS gap, lead(n) OVER w - n AS d FROM v WHERE ok WINDOW w AS (PARTITION BY conv_id ORDER BY page)),
f AS (SELECT conv_id, page, n, unnest(range(0, CASE WHEN gap > 1 AND d = gap THEN gap ELSE 1 END)) AS i FROM g)
SELECT conv_id, page + i AS page, (n + i)::VARCHAR AS label FROM f""")
def near_label_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as pages, with a number some of them print."""
    c = table(spark, sf_dir, "conversations").where(F.length("text") % 5 != 0)
    raw = c.select("conv_id", (F.col("turn") + 1).alias("page"), (F.col("turn") + F.when(F.length("text") % 7 == 0, 9).otherwise(3)).cast("string").alias("label"))
    return html_blocks.validated_labels(raw, "conv_id")


@query("""WITH u AS (SELECT conv_id, turn, text, regexp_extract(text, '(?i) (the|ing|der|que|les) ', 1) AS s FROM conversations WHERE role = 'user')
SELECT conv_id, turn, last_value(nullif(lower(s), '') IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS subject FROM u""")
def followup_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last earlier user turn that names a subject."""
    u = table(spark, sf_dir, "conversations").where("role = 'user'")
    s = F.nullif(F.lower(F.regexp_extract("text", "(?i) (the|ing|der|que|les) ", 1)), F.lit(""))
    before = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    return u.select("conv_id", "turn", F.last(s, ignorenulls=True).over(before).alias("subject"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns worded as questions about companies, years and quarters."""
    names = F.array(*map(F.lit, ["Apple", "AWS", "nvidia's Blackwell", "Visa and Mastercard", "it"]))
    when = F.array(*map(F.lit, ["in fiscal 2024", "from 2022 to 2024", "in Q3 FY25", "over the last two years", "the year before", "in the quarter ended October 27, 2024", "in 2019"]))
    what = F.array(*map(F.lit, ["total revenue", "risk factors", "outlook", "net income and diluted EPS", "quarterly deliveries", "stock price right now"]))
    u = table(spark, sf_dir, "conversations").where("role = 'user'")
    n = F.length("text")
    pick = lambda a, k: F.get(a, F.pmod(n + F.col("turn") * k, F.size(a)).cast("int"))
    q = F.concat(F.lit("What was "), pick(what, 1), F.lit(" of "), pick(names, 3), F.lit(" "), pick(when, 5), F.lit("?"))
    return u.select("conv_id", "turn", "role", q.alias("text"))


@query("""SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(?i)\\bcompare|\\bcompared?\\b|\\bversus\\b|\\bvs\\.?\\b|\\bwhich\\b.*\\b(?:more|less|faster|slower|higher|lower)\\b') THEN 'comparison'
WHEN regexp_matches(text, '(?i)\\btrend|\\bover time\\b|\\beach (?:fiscal )?year\\b|\\bevolve|\\bchanged?\\b.*\\bfrom\\b') THEN 'trend' WHEN regexp_matches(text, '(?i)\\bhow (?:much|many)\\b') THEN 'numeric' ELSE 'lookup' END AS intent
FROM (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'how much ' WHEN 1 THEN 'compare ' WHEN 2 THEN 'trend of ' ELSE '' END || conv_id::VARCHAR AS text FROM conversations WHERE role = 'user')""")
def question_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "conversations").where("role = 'user'")
    lead = F.when(F.col("turn") % 4 == 0, "how much ").when(F.col("turn") % 4 == 1, "compare ").when(F.col("turn") % 4 == 2, "trend of ").otherwise("")
    q = u.select("conv_id", "turn", F.concat(lead, F.col("conv_id").cast("string")).alias("q"))
    return q.select("conv_id", "turn", planning.intent(F.col("q"), F.lit(0), F.lit(0), F.lit(0)).alias("intent"))


@query("SELECT doc_id, len(regexp_extract_all(text, '\\d{1,3}(?:,\\d{3})+')) AS grouped FROM documents")
def figures_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comma-grouped figures of a document."""
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.regexp_extract_all("text", F.lit(chunking.FIGURE), F.lit(0))).cast("bigint").alias("grouped"))


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice, l_linenumber % 2 = 1 OR round(l_extendedprice / 1000.0::DOUBLE) = round(l_extendedprice / 1000.0::DOUBLE + 1) AS matched FROM lineitem
WHERE abs((l_extendedprice / 1000.0::DOUBLE) - floor(l_extendedprice / 1000.0::DOUBLE) - 0.5) > 1e-9""")
def claim_numbers_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rounded figure in thousands against the exact one, and one that is a thousand off. Exact halves, of which the last
    binary digit decides, are tested apart."""
    p = F.col("l_extendedprice").cast("double")
    li = table(spark, sf_dir, "lineitem").where(F.abs(p / 1000 - F.floor(p / 1000) - 0.5) > 1e-9)
    number = lambda v, d, s, raw: F.struct(v.cast("double").alias("value"), d.cast("int").alias("decimals"), F.lit(s).alias("scale"), F.lit(False).alias("percent"), F.lit(raw).alias("raw"))
    said = F.round(p / 1000) + F.when(F.col("l_linenumber") % 2 == 1, 0).otherwise(1)
    return li.select("l_orderkey", "l_linenumber", "l_extendedprice", numbers.matches(number(said, F.lit(0), 1e3, "x thousand"), number(p, F.lit(2), 1.0, "x")).alias("matched"))


def chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into chunks; the state of the packer has no SQL form."""
    return chunking.chunk(sections.assign_release(lines(spark, sf_dir)))


query()(chunk_pack)


def html_blocks_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of web pages; a walk over markup has no SQL form."""
    return html_blocks.blocks(table(spark, sf_dir, "pages"), "page_id").select("page_id", "pos", "kind", "text", "page")


query()(html_blocks_of_pages)


def filing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = html_blocks.with_furniture(html_blocks.blocks(table(spark, sf_dir, "pages"), "page_id"), "page_id")
    return html_blocks.pages_of(b, "page_id")


query()(filing_pages)


def _ranked_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    rank = F.row_number().over(W.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    return d.select("source", F.col("doc_id").alias("id"), rank.alias("rank"), F.floor(F.col("n_chars") / 4).alias("token_count")).where("rank <= 60")


@query("""WITH RECURSIVE r AS (SELECT source, doc_id AS id, (row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id))::INTEGER AS rank, n_chars // 4 AS token_count FROM documents),
w AS (SELECT source, 0 AS rank, 0::BIGINT AS used, 0 AS n, false AS kept, NULL::BIGINT AS id FROM (SELECT DISTINCT source FROM r)
  UNION ALL SELECT w.source, r.rank, CASE WHEN w.used + r.token_count + 30 <= 3500 AND w.n < 12 THEN w.used + r.token_count + 30 ELSE w.used END,
    CASE WHEN w.used + r.token_count + 30 <= 3500 AND w.n < 12 THEN w.n + 1 ELSE w.n END, w.used + r.token_count + 30 <= 3500 AND w.n < 12, r.id
  FROM w JOIN r ON r.source = w.source AND r.rank = w.rank + 1 WHERE r.rank <= 60)
SELECT source, id, rank, n AS source_no FROM w WHERE kept""")
def context_budget_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources within a budget: one that doesn't fit is passed over."""
    return context.pack(_ranked_docs(spark, sf_dir), 3500, by="source").select("source", "id", "rank", "source_no")


def answer_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with citations in several styles, cut into claims; look-behinds again."""
    d = table(spark, sf_dir, "documents")
    a = F.concat(F.left("text", F.lit(120)), F.lit(". Revenue rose 12% [S1, S2]. It was $3.5 billion (Source 3). "), F.substr("text", F.lit(121)))
    return d.select("doc_id", F.posexplode(context.claims(a)).alias("pos", "c")).select("doc_id", "pos", "c.text", "c.ids")


query()(answer_claims)


def claims_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of figures against two sources each, with repair."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    source = lambda i, t: F.struct(F.lit(i).alias("id"), t.alias("text"), t.alias("rendered"), F.lit("").alias("context"), F.lit("AAPL").alias("ticker"), F.lit(2024).alias("fiscal_year"), F.lit(None).cast("int").alias("fiscal_quarter"), F.lit("2024-09-28").alias("period_end"), F.lit("text").alias("chunk_type"))
    n = F.format_number(F.col("doc_id") * 37 + 1000, 0)
    claim = lambda t, i: F.struct(t.alias("text"), F.array(F.lit(i)).alias("ids"))
    said = F.concat(F.lit("Services revenue across regions was $"), n, F.lit(" million."))
    q = d.select(
        F.col("doc_id").alias("query_id"),
        F.array(claim(said, "S1"), claim(said, "S2"), claim(F.lit("Margin was 77.7%."), "S1")).alias("claims"),
        F.array(source("S1", F.concat(said, F.lit(" "), F.col("t"))), source("S2", F.col("t"))).alias("sources"),
    )
    v = verification.verify(q).select("query_id", F.posexplode("verified").alias("pos", "v"))
    return v.select("query_id", "pos", "v.status", "v.ids", "v.repaired")


query()(claims_verified)


@query("""WITH w AS (SELECT doc_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z][a-z&''-]{2,}'), lambda x: x NOT IN ('%s'))) AS w FROM documents)
SELECT doc_id, len(w)::INTEGER AS n_words FROM w""" % "', '".join(text.CLAIM_STOPWORDS))
def content_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.content_words(F.col("text"))).alias("n_words"))
