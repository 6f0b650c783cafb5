"""Rules over whole tables: structure of filings, figures and sentences, reading of questions, citations, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import numbers, text
from tessera.operators import chunking, context, entities, evaluation, facts, filings, filters, planning, sections
from tessera.plans.document_queries import LINES, asked, lines
from tessera.plans.registry import query, table
from tessera.plans.retrieval_queries import CHUNKS, chunks


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


# --- structure of filings -------------------------------------------------------------------------------------------

HEADINGS = f"""{LINES},
nm AS (SELECT [{quoted(f"Item {i}. {t}" for i, t in sections.ITEMS.items())}] AS names, [{quoted(sections.ITEMS)}] AS ids, [{quoted(sections.ITEMS.values())}] AS titles),
f AS (SELECT doc_id, pos, page, CASE WHEN pos < 8 THEN names[pos + 1] WHEN pos % 12 = 3 THEN names[least(pos // 12, 22) + 1] WHEN pos % 24 = 9 THEN 'PART II - the rest' ELSE text END AS text,
  CASE WHEN pos < 8 OR pos % 12 IN (3, 7) THEN 'heading' ELSE 'text' END AS kind FROM b, nm),
c AS (SELECT f.*, CASE WHEN length(text) <= 200 AND (kind = 'heading' OR length(text) <= 100) AND list_contains(ids, upper(regexp_extract(text, '(?i)^(?:part\\s+(?:iv|i{{1,3}})\\W*)?items?\\s+(\\d{{1,2}}[a-c]?)\\b', 1)))
  THEN upper(regexp_extract(text, '(?i)^(?:part\\s+(?:iv|i{{1,3}})\\W*)?items?\\s+(\\d{{1,2}}[a-c]?)\\b', 1)) END AS candidate FROM f, nm),
s AS (SELECT *, sum(length(text)) OVER (PARTITION BY doc_id ORDER BY pos) AS chars FROM c),
g AS (SELECT *, chars - length(text) - lag(chars) OVER (PARTITION BY doc_id, page ORDER BY pos) AS gap FROM s WHERE candidate IS NOT NULL),
t AS (SELECT doc_id, page FROM g GROUP BY doc_id, page HAVING count(*) >= 4 AND avg(gap) < 80)"""


def headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as filings: a table of contents, then an item heading every twelve lines, other headings, parts."""
    names = F.array(*[F.lit(f"Item {i}. {t}") for i, t in sections.ITEMS.items()])
    b, at = lines(spark, sf_dir), F.col("pos")
    item = F.when(at < 8, F.get(names, at)).when(at % 12 == 3, F.get(names, F.least(F.floor(at / 12), F.lit(22)).cast("int")))
    t = F.coalesce(item, F.when(at % 24 == 9, F.lit("PART II - the rest")), F.col("text"))
    return b.withColumn("kind", F.when((at < 8) | (at % 12).isin(3, 7), "heading").otherwise("text")).withColumn("text", t)


@query(f"""WITH {HEADINGS},
o AS (SELECT c.*, t.page IS NOT NULL AS toc FROM c LEFT JOIN t ON c.doc_id = t.doc_id AND c.page = t.page),
m AS (SELECT o.*, titles, ids, max(CASE WHEN candidate IS NOT NULL AND NOT toc THEN list_position(ids, candidate) END) OVER (PARTITION BY doc_id ORDER BY pos) AS n, CASE WHEN NOT toc AND regexp_matches(o.text, '(?i)^part\\s+(iv|i{{1,3}})\\b') THEN 'Part ' || upper(regexp_extract(o.text, '(?i)^part\\s+(iv|i{{1,3}})\\b', 1)) END AS part_here FROM o, nm),
h AS (SELECT *, CASE WHEN kind = 'heading' AND n IS NOT NULL AND candidate IS NULL AND part_here IS NULL
  AND NOT (regexp_replace(lower(text), '[^a-z]', '', 'g') <> '' AND starts_with(regexp_replace(lower(titles[n]), '[^a-z]', '', 'g'), regexp_replace(lower(text), '[^a-z]', '', 'g'))) THEN text END AS sub FROM m)
SELECT doc_id, pos, last_value(part_here IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS part, CASE WHEN n IS NULL THEN 'Cover' ELSE 'Item ' || ids[n] END AS section,
  last_value(sub IGNORE NULLS) OVER (PARTITION BY doc_id, n ORDER BY pos ROWS UNBOUNDED PRECEDING) AS subsection FROM h""")
def filing_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items, parts and subsections of every block."""
    return sections.assign(headed(spark, sf_dir)).select("doc_id", "pos", "part", "section", "subsection")


@query(f"WITH {HEADINGS} SELECT doc_id, page, true AS toc FROM t")
def contents_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = headed(spark, sf_dir)
    return sections.toc_pages(b.withColumn("candidate", sections.item_candidate(F.col("kind"), F.col("text"))))


@query("""SELECT doc_id, len(list_filter(string_split(regexp_replace(text, '([.!?;])[ \\t\\n\\x0B\\f\\r]+([A-Z0-9(\"“$•])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: s <> '')) AS n_sentences,
md5(array_to_string(list_filter(string_split(regexp_replace(text, '([.!?;])[ \\t\\n\\x0B\\f\\r]+([A-Z0-9(\"“$•])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: s <> ''), chr(2))) AS sentences_md5 FROM documents""")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of whole texts, as a digest."""
    s = text.sentences(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(s).cast("bigint").alias("n_sentences"), F.md5(F.array_join(s, "\x02").cast("binary")).alias("sentences_md5"))


@query("""WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.;])[ \\t\\x0B\\f\\r\\n]+|\\n', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '') AS l FROM documents)
SELECT doc_id, len(l) AS n_segments, sum(length(x))::BIGINT AS chars FROM (SELECT doc_id, l, unnest(CASE WHEN len(l) > 0 THEN l ELSE [''] END) AS x FROM s) GROUP BY doc_id, l""")
def segment_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences and table rows in which figures are looked for."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", text.segments(F.col("text")).alias("l"))
    return d.select("doc_id", F.size("l").cast("bigint").alias("n_segments"), F.aggregate("l", F.lit(0).cast("bigint"), lambda n, x: n + F.length(x)).alias("chars"))


NUMBERS = """
raw AS (SELECT doc_id, generate_subscripts(m, 1) - 1 AS pos, unnest(m) AS r FROM (SELECT doc_id, regexp_extract_all(text, '(?i)(?:^|[^\\w.])(\\$?\\(?(?:\\d{1,3}(?:,\\d{3})+|\\d+)(?:\\.\\d+)?\\)?(?:\\s*(?:%|percent|billion|million|thousand|bn|mn)|[BM]\\b)?)', 1) AS m FROM documents)),
p AS (SELECT doc_id, pos, regexp_extract(r, '(\\d{1,3}(?:,\\d{3})+|\\d+)', 1) AS whole, regexp_extract(r, '\\d(\\.\\d+)', 1) AS fraction, lower(regexp_extract(r, '(?i)(%|percent|billion|million|thousand|bn|mn|[BM])\\s*$', 1)) AS unit FROM raw),
n AS (SELECT doc_id, pos, (replace(whole, ',', '') || fraction)::DOUBLE AS value, greatest(length(fraction) - 1, 0)::INTEGER AS decimals,
  CASE WHEN unit IN ('billion', 'bn', 'b') THEN 1e9 WHEN unit IN ('million', 'mn', 'm') THEN 1e6 WHEN unit = 'thousand' THEN 1e3 ELSE 1.0 END::DOUBLE AS scale, unit IN ('%', 'percent') AS percent, contains(whole, ',') OR fraction <> '' OR unit <> '' AS marked FROM p)"""


@query(f"WITH {NUMBERS} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::INTEGER AS pos, value, decimals, scale, percent FROM n WHERE marked OR NOT value BETWEEN 1990 AND 2035")
def number_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every figure of whole texts with scale and decimals."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(numbers.figures(F.col("text"))).alias("pos", "n"))
    return d.select("doc_id", "pos", "n.value", "n.decimals", "n.scale", "n.percent")


@query("SELECT doc_id, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+'))::INTEGER AS n_words FROM documents WHERE text IS NOT NULL")
def word_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default token counter."""
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", text.word_count(F.col("text")).alias("n_words"))


# --- questions ------------------------------------------------------------------------------------------------------

# What the questions of asked() mean, part by part, from the parts' wording alone.
PARTS = """
q AS (SELECT conv_id, turn, role, length(text) AS n FROM conversations WHERE role = 'user'),
what(i, what, metric_words, metrics, item, guided, by_quarter, market) AS (VALUES
  (0, 'total revenue', true, ['revenue'], NULL, false, false, false), (1, 'risk factors', false, []::VARCHAR[], 'Item 1A', false, false, false), (2, 'outlook', false, [], NULL, true, false, false),
  (3, 'net income and diluted EPS', true, ['net_income', 'eps_diluted'], NULL, false, false, false), (4, 'quarterly deliveries', true, [], NULL, false, true, false), (5, 'stock price right now', false, [], NULL, false, false, true)),
names(i, name, tickers, segment, back) AS (VALUES
  (0, 'Apple', ['AAPL'], false, false), (1, 'AWS', ['AMZN'], true, false), (2, 'nvidia''s Blackwell', ['NVDA'], false, false), (3, 'Visa and Mastercard', ['V', 'MA'], false, false), (4, 'it', []::VARCHAR[], false, true)),
times(i, times, years, quarters, relative, dated) AS (VALUES
  (0, 'in fiscal 2024', [2024], []::INTEGER[], NULL, false), (1, 'from 2022 to 2024', [2022, 2023, 2024], [], NULL, false), (2, 'in Q3 FY25', [2025], [3], NULL, false), (3, 'over the last two years', [2024, 2025], [], NULL, false),
  (4, 'the year before', []::INTEGER[], [], 'prior', false), (5, 'in the quarter ended October 27, 2024', [2024], [], NULL, true), (6, 'in 2019', [2019], [], NULL, false)),
x AS (SELECT conv_id, turn, role, 'What was ' || what || ' of ' || name || ' ' || times || '?' AS text, what.*, names.*, times.* FROM q JOIN what ON what.i = (n + turn) % 6 JOIN names ON names.i = (n + turn * 3) % 5 JOIN times ON times.i = (n + turn * 5) % 7),
y AS (SELECT *, dated AND len(tickers) = 1 AS by_date, CASE WHEN len(quarters) > 0 THEN quarters WHEN by_quarter THEN [1, 2, 3, 4] ELSE [] END AS own_quarters FROM x),
z AS (SELECT *,
  CASE WHEN by_date THEN [CASE tickers[1] WHEN 'AMZN' THEN 2024 ELSE 2025 END] ELSE years END AS all_years,
  CASE WHEN by_date THEN [CASE tickers[1] WHEN 'AAPL' THEN 1 WHEN 'AMZN' THEN 4 WHEN 'NVDA' THEN 3 END] WHEN len(own_quarters) = 1 AND guided THEN [own_quarters[1] - 1] ELSE own_quarters END AS fiscal_quarters FROM y),
e AS (SELECT *, list_filter(all_years, lambda v: v BETWEEN 2022 AND 2025)::INTEGER[] AS fiscal_years, list_filter(all_years, lambda v: v NOT BETWEEN 2022 AND 2025)::INTEGER[] AS out_of_range_years, len(fiscal_quarters) > 0 OR dated AS release FROM z)"""


@query(f"""WITH {PARTS}
SELECT conv_id, turn, text, array_to_string(tickers, ',') AS tickers, array_to_string(fiscal_years, ',') AS fiscal_years, array_to_string(out_of_range_years, ',') AS out_of_range_years, array_to_string(fiscal_quarters, ',') AS fiscal_quarters, release,
  CASE WHEN release OR item IS NULL THEN '' ELSE item END AS sections, relative AS relative_year, CASE WHEN len(out_of_range_years) > 0 AND len(fiscal_years) = 0 THEN 'out_of_range' WHEN market THEN 'live_data' ELSE 'in_corpus' END AS scope,
  CASE WHEN len(tickers) > 1 THEN 'comparison' WHEN len(fiscal_years) > 1 OR len(fiscal_quarters) > 1 THEN 'trend' WHEN metric_words THEN 'numeric' ELSE 'lookup' END AS intent,
  CASE WHEN segment THEN '' ELSE array_to_string(list_filter(metrics, lambda m: true), ',') END AS metrics FROM e""")
def question_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities, scope, intent and metrics of questions."""
    q = entities.scope(entities.extract(asked(spark, sf_dir), "text"), "text")
    sizes = [F.size(c) for c in ("tickers", "fiscal_years", "fiscal_quarters")]
    listed = [F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("tickers", "fiscal_years", "out_of_range_years", "fiscal_quarters")]
    return q.select("conv_id", "turn", "text", *listed, "release", F.array_join("sections", ",").alias("sections"), "relative_year", "scope", planning.intent(F.col("text"), *sizes).alias("intent"), F.array_join(facts.detect_metrics(F.col("text")), ",").alias("metrics"))


@query(f"""WITH {PARTS},
w AS (SELECT *, last_value(CASE WHEN len(tickers) > 0 OR len(fiscal_years) > 0 THEN {{'t': tickers, 'y': fiscal_years, 'q': fiscal_quarters}} END IGNORE NULLS) OVER p AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 AS first FROM e WINDOW p AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
a AS (SELECT *, first OR (len(tickers) > 0 AND len(fiscal_years) > 0 AND relative IS NULL AND NOT back) AS alone FROM w)
SELECT conv_id, turn, text, array_to_string(CASE WHEN alone OR len(tickers) > 0 OR s IS NULL THEN tickers ELSE s.t END, ',') AS tickers,
  array_to_string(CASE WHEN alone OR len(fiscal_years) > 0 OR s IS NULL THEN fiscal_years WHEN relative = 'prior' THEN list_filter(list_transform(s.y, lambda v: v - 1), lambda v: v BETWEEN 2022 AND 2025) ELSE s.y END, ',') AS fiscal_years,
  array_to_string(CASE WHEN alone OR len(fiscal_quarters) > 0 OR len(fiscal_years) > 0 OR release OR s IS NULL THEN fiscal_quarters ELSE s.q END, ',') AS fiscal_quarters, NOT alone AND len(tickers) = 0 AND s IS NOT NULL AS carried FROM a""")
def question_follow_ups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each user turn takes over from the turns before."""
    f = entities.follow_ups(asked(spark, sf_dir))
    return f.select("conv_id", "turn", "text", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("tickers", "fiscal_years", "fiscal_quarters")], "carried")


@query("""WITH o AS (SELECT o_orderkey, ['AAPL', 'MSFT', 'NVDA', 'V', 'TSLA'][o_orderkey % 5 + 1] AS ticker, [9, 6, 1, 9, 12][o_orderkey % 5 + 1] AS ends, o_orderdate::DATE - CASE WHEN day(o_orderdate::DATE) <= 7 THEN 7 ELSE 0 END AS d FROM orders)
SELECT o_orderkey, ticker, (year(d) + (month(d) > ends)::INTEGER)::INTEGER AS fiscal_year, ((month(d) - ends + 11) % 12 // 3 + 1)::INTEGER AS quarter FROM o""")
def fiscal_period_of_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Period ends by companies' calendars: a year may end in the first days of the next month."""
    o = table(spark, sf_dir, "orders")
    t = F.get(F.array(*map(F.lit, ["AAPL", "MSFT", "NVDA", "V", "TSLA"])), (F.col("o_orderkey") % 5).cast("int"))
    d = F.to_date("o_orderdate")
    return o.select("o_orderkey", t.alias("ticker"), entities.fiscal_period(t, F.month(d), F.dayofmonth(d), F.year(d)).alias("p")).select("o_orderkey", "ticker", "p.*")


# --- filters, headers, citations ------------------------------------------------------------------------------------


@query(f"WITH {CHUNKS} SELECT 'none' AS filters, count(*) AS n FROM c UNION ALL SELECT 'empty', count(*) FROM c WHERE form = '10-K' UNION ALL SELECT 'quarters', count(*) FROM c WHERE form = '8-K EX-99.1' AND fiscal_quarter IN (1, 2)")
def unfiltered_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No filters at all, empty filters (the default form), and quarters (releases)."""
    c = chunks(spark, sf_dir)
    count = lambda name, f: c.where(filters.unfiltered(f)).agg(F.lit(name).alias("filters"), F.count("*").alias("n"))
    return count("none", None).unionByName(count("empty", filters.SearchFilters())).unionByName(count("quarters", filters.SearchFilters(fiscal_quarters=(1, 2))))


@query("""WITH x AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE list_filter(['a', 'b', 'c'], lambda v: (event_id // (ascii(v) - 96)) % 2 = 0) END AS p, list_filter(['a', 'b', 'c'], lambda v: (event_id // (100 - ascii(v))) % 2 = 0) AS g FROM events)
SELECT event_id, p IS NULL OR list_has_all(p, g) AS compatible, list_sort(coalesce(p, [])) = list_sort(g) AS exact FROM x""")
def filter_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted filters that exclude nothing of the gold ones, and those equal to them."""
    i = F.col("event_id")
    pick = lambda d: F.filter(F.array(*map(F.lit, "abc")), lambda v: F.floor(i / d(F.ascii(v))) % 2 == 0)
    e = table(spark, sf_dir, "events").select("event_id", F.when(i % 4 != 0, pick(lambda a: a - 96)).alias("p"), pick(lambda a: F.lit(100) - a).alias("g"))
    return e.select("event_id", filters.compatible(F.col("p"), F.col("g")).alias("compatible"), filters.exact(F.col("p"), F.col("g")).alias("exact"))


SOURCES = """
s AS (SELECT doc_id, upper(source) AS ticker, source || ' Inc.' AS company, (2022 + doc_id % 4)::INTEGER AS fiscal_year, CASE WHEN doc_id % 5 = 0 THEN (1 + doc_id % 4)::INTEGER END AS q, '2024-0' || (1 + doc_id % 9)::VARCHAR || '-28' AS period_end,
  CASE WHEN doc_id % 7 = 0 THEN 'XBRL' ELSE 'Item 7' END AS section, CASE WHEN doc_id % 7 = 0 THEN 'us-gaap: ' ELSE '' END || lang AS title, CASE WHEN doc_id % 3 = 0 THEN left(text, 200) END AS sub,
  CASE WHEN doc_id % 2 = 0 THEN (doc_id % 90)::VARCHAR END AS l1, CASE WHEN doc_id % 4 = 0 THEN (doc_id % 90 + 1)::VARCHAR ELSE CASE WHEN doc_id % 2 = 0 THEN (doc_id % 90)::VARCHAR END END AS l2, (doc_id % 30)::INTEGER AS page, doc_id % 14 = 0 AS series, text FROM documents)"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sources: facts, releases and annual filings with printed page labels."""
    i = F.col("doc_id")
    fact, first = i % 7 == 0, F.when(i % 2 == 0, (i % 90).cast("string"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.upper("source").alias("ticker"), F.concat("source", F.lit(" Inc.")).alias("company"), (2022 + i % 4).cast("int").alias("fiscal_year"), F.when(i % 5 == 0, (1 + i % 4).cast("int")).alias("fiscal_quarter"),
        F.concat(F.lit("2024-0"), (1 + i % 9).cast("string"), F.lit("-28")).alias("period_end"), F.lit("10-K").alias("form"), F.when(fact, "XBRL").otherwise("Item 7").alias("section"), F.concat(F.when(fact, "us-gaap: ").otherwise(""), F.col("lang")).alias("section_title"),
        F.when(i % 3 == 0, F.left("text", F.lit(200))).alias("subsection"), first.alias("page_label_start"), F.when(i % 4 == 0, (i % 90 + 1).cast("string")).otherwise(first).alias("page_label_end"), (i % 30).cast("int").alias("page_start"),
        F.create_map(F.lit("series"), (i % 14 == 0).cast("string")).alias("metadata"), F.lit("fact context").alias("context"), "text",
    )


PAGE = "coalesce(CASE WHEN coalesce(l1, '') = '' THEN NULL WHEN l2 IS NULL OR l2 = '' OR l2 = l1 THEN l1 ELSE l1 || '-' || l2 END, '#' || page::VARCHAR)"


@query(f"""WITH {SOURCES} SELECT doc_id, CASE WHEN section = 'XBRL' THEN '[XBRL ' || ticker || CASE WHEN series THEN '' ELSE ' FY' || fiscal_year::VARCHAR END || ' ' || replace(title, 'us-gaap: ', '') || ']' WHEN q IS NOT NULL THEN '[' || ticker || ' Q' || q::VARCHAR || ' FY' || fiscal_year::VARCHAR || ' release]'
  ELSE '[' || ticker || ' FY' || fiscal_year::VARCHAR || ' p.' || {PAGE} || ']' END AS citation,
  md5('[S1] ' || CASE WHEN section = 'XBRL' THEN 'fact context' ELSE CASE WHEN q IS NOT NULL THEN company || ' (' || ticker || ') earnings release, Q' || q::VARCHAR || ' fiscal year ' || fiscal_year::VARCHAR || ', quarter ended ' || period_end
  ELSE company || ' (' || ticker || ') Form 10-K, fiscal year ' || fiscal_year::VARCHAR || ', ' || section || ': ' || title || ', page ' || {PAGE} END || coalesce(' | ' || sub, '') END || chr(10) || text) AS rendered_md5 FROM s WHERE ticker IS NOT NULL AND title IS NOT NULL""")
def source_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How sources are cited and shown."""
    s = sources(spark, sf_dir).where("ticker IS NOT NULL AND section_title IS NOT NULL")
    return s.select("doc_id", context.citation().alias("citation"), F.md5(context.rendered(F.lit("S1")).cast("binary")).alias("rendered_md5"))


@query(f"""WITH {SOURCES} SELECT doc_id, CASE WHEN q IS NOT NULL THEN company || ' (' || ticker || ') earnings release, Q' || q::VARCHAR || ' fiscal year ' || fiscal_year::VARCHAR || ', quarter ended ' || period_end
  ELSE company || ' (' || ticker || ') Form 10-K, fiscal year ' || fiscal_year::VARCHAR || ' | ' || section || ': ' || title END || coalesce(' | ' || left(sub, 150), '') AS header FROM s WHERE ticker IS NOT NULL AND title IS NOT NULL""")
def chunk_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a chunk is from, in words."""
    return sources(spark, sf_dir).where("ticker IS NOT NULL AND section_title IS NOT NULL").select("doc_id", chunking.context_header().alias("header"))


@query("""WITH d AS (SELECT doc_id, doc_id % 20 AS a, doc_id % 13 AS b, text FROM documents WHERE text IS NOT NULL AND NOT contains(text, '[') AND NOT contains(text, '('))
SELECT doc_id, md5('It rose [S' || a::VARCHAR || '][S' || b::VARCHAR || ']. ' || text || ' So [S3][S' || a::VARCHAR || '].') AS marked_md5, md5('It rose [AAPL FY2024 p.' || a::VARCHAR || ']' || CASE WHEN a = b THEN '[AAPL FY2024 p.' || a::VARCHAR || ']' ELSE '[S' || b::VARCHAR || ']' END || '. ' || text) AS cited_md5 FROM d""")
def citation_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citation groups of several styles in one style, and known sources in the place of their numbers."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL AND NOT contains(text, '[') AND NOT contains(text, '(')")
    a, b = (F.col("doc_id") % 20).cast("string"), (F.col("doc_id") % 13).cast("string")
    styles = F.concat(F.lit("It rose [S"), a, F.lit(", Source "), b, F.lit("]. "), F.col("text"), F.lit(" So (source 3; S"), a, F.lit(")."))
    plain = F.concat(F.lit("It rose [S"), a, F.lit("][S"), b, F.lit("]. "), F.col("text"))
    known = F.create_map(F.concat(F.lit("S"), a), F.concat(F.lit("[AAPL FY2024 p."), a, F.lit("]")))
    return d.select("doc_id", F.md5(context.normalize_markers(styles).cast("binary")).alias("marked_md5"), F.md5(context.render_citations(plain, known).cast("binary")).alias("cited_md5"))


@query("""SELECT event_id, CASE WHEN event_id % 11 = 0 OR event_id % 5 = 0 THEN 'none' WHEN least(event_id % 4, event_id % 5) = event_id % 5 AND coalesce(value, 0) >= 0.5 AND event_id % 6 <> 0 THEN 'high' WHEN least(event_id % 4, event_id % 5) / (event_id % 5)::DOUBLE >= 0.5 THEN 'medium' ELSE 'low' END AS confidence FROM events""")
def confidence_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", context.confidence(i % 5, F.least(i % 4, i % 5), F.col("value"), i % 6 == 0, i % 11 == 0).alias("confidence"))


# --- filings and facts ----------------------------------------------------------------------------------------------


@query("""WITH f AS (SELECT c_custkey, generate_series(1, c_custkey % 4) AS p FROM customer), r AS (SELECT c_custkey, unnest(p) AS p FROM f)
SELECT c_custkey, (p - 1)::INTEGER AS pos, '10-' || p::VARCHAR AS form, (c_custkey * 10 + p)::BIGINT AS accession FROM r""")
def columns_to_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal-length arrays of a listing as rows."""
    n = F.sequence(F.lit(0), (F.col("c_custkey") % 4).cast("int"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.slice(n, 2, 9).alias("n"))
    c = c.select("c_custkey", F.transform("n", lambda p: F.concat(F.lit("10-"), p.cast("string"))).alias("form"), F.transform("n", lambda p: F.col("c_custkey") * 10 + p).alias("accession"))
    return filings.rows_of_columns(c, ["form", "accession"], ["c_custkey"])


@query("""SELECT o_orderkey, 'https://www.sec.gov/Archives/edgar/data/' || o_custkey::VARCHAR || '/000' || o_orderkey::VARCHAR || '24/doc.htm' AS url,
'C' || o_custkey::VARCHAR || '-FY' || year(o_orderdate::DATE)::VARCHAR || CASE WHEN o_orderkey % 3 = 0 THEN '-10-K' ELSE '-Q' || quarter(o_orderdate::DATE)::VARCHAR || '-EX-99.1' END AS document_id FROM orders""")
def filing_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses and ids of filings."""
    o, d = table(spark, sf_dir, "orders"), F.to_date("o_orderdate")
    ticker = F.concat(F.lit("C"), F.col("o_custkey").cast("string"))
    url = filings.document_url(F.col("o_custkey"), F.concat(F.lit("000-"), F.col("o_orderkey").cast("string"), F.lit("-24")), F.lit("doc.htm"))
    return o.select("o_orderkey", url.alias("url"), filings.document_id(ticker, F.year(d), F.when(F.col("o_orderkey") % 3 != 0, F.quarter(d))).alias("document_id"))


@query("""WITH c AS (SELECT page_id // 3 AS g, page_id % 3 AS preference, CASE WHEN page_id % 7 <> 0 THEN html || CASE WHEN page_id % 2 = 0 THEN '<p>Diluted EPS and <b>net</b> income</p>' WHEN page_id % 5 = 0 THEN '<p>diluted; net loss</p>' ELSE '' END END AS html, page_id FROM pages),
n AS (SELECT *, count(*) OVER (PARTITION BY g) AS n, lower(regexp_replace(html, '<[^>]+>', ' ', 'g')) AS t FROM c),
k AS (SELECT *, n = 1 OR (contains(t, 'diluted') AND (contains(t, 'net income') OR contains(t, 'net earnings') OR contains(t, 'net loss'))) AS confirmed FROM n WHERE html IS NOT NULL)
SELECT g, page_id, confirmed FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY confirmed DESC, preference) AS r FROM k) WHERE r = 1""")
def chosen_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several candidates the first that carries an income statement."""
    i = F.col("page_id")
    more = F.when(i % 2 == 0, "<p>Diluted EPS and <b>net</b> income</p>").when(i % 5 == 0, "<p>diluted; net loss</p>").otherwise("")
    c = table(spark, sf_dir, "pages").select(F.floor(i / 3).alias("g"), (i % 3).alias("preference"), F.when(i % 7 != 0, F.concat("html", more)).alias("html"), "page_id")
    return filings.choose_release(c, ["g"]).select("g", "page_id", "confirmed")


@query("SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN 'ex' || page_id::VARCHAR || '.htm' END AS document FROM pages")
def exhibit_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names of exhibits in index tables, with a page's markup around them."""
    i = F.col("page_id").cast("string")
    row = lambda kind: F.concat(F.lit("<TR class='x'><td>1</td><td>results</td><td><a href='/e'>ex"), i, F.lit(".htm</a> &nbsp; iXBRL</td><td> "), F.lit(kind), F.lit("</td></TR>"))
    other = F.lit("<tr><td>2</td><td>report</td><td>main.htm</td><td>8-K</td></tr>")
    page = F.concat(F.col("html"), F.lit("<table>"), other, F.when(F.col("page_id") % 3 != 0, row("ex-99.1")).otherwise(row("EX-99.2")), F.lit("</table>"))
    return table(spark, sf_dir, "pages").select("page_id", filings.exhibit_document(page).alias("document"))


@query("""WITH l AS (SELECT l_suppkey, l_partkey % 3 AS c, l_linenumber % 2 AS u, row_number() OVER (PARTITION BY l_suppkey, l_partkey % 3, l_linenumber % 2 ORDER BY l_orderkey, l_linenumber, l_extendedprice) - 1 AS no, l_extendedprice AS val, l_orderkey FROM lineitem)
SELECT 'S' || l_suppkey::VARCHAR AS ticker, 'Concept' || c::VARCHAR AS concept, CASE WHEN c = 0 THEN 'Concept0' ELSE 'label ' || c::VARCHAR END AS concept_label, CASE WHEN u = 0 THEN 'USD' ELSE 'shares' END AS unit, no::INTEGER AS fact_no, val::DOUBLE AS val, l_orderkey::VARCHAR AS accn FROM l""")
def facts_flattened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company facts, nested by concept and unit, as rows in the order of the file."""
    li = table(spark, sf_dir, "lineitem")
    value = F.struct(*[F.lit(None).cast("string").alias(x) for x in ("start", "end")], F.col("l_extendedprice").cast("double").alias("val"), F.col("l_orderkey").cast("string").alias("accn"), F.lit("10-K").alias("form"), F.lit(None).cast("string").alias("filed"))
    sort = F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_extendedprice", value.alias("v"))))
    units = li.groupBy("l_suppkey", (F.col("l_partkey") % 3).alias("c"), F.when(F.col("l_linenumber") % 2 == 0, "USD").otherwise("shares").alias("u")).agg(F.transform(sort, lambda x: x["v"]).alias("vs"))
    concepts = units.groupBy("l_suppkey", "c").agg(F.map_from_entries(F.collect_list(F.struct("u", "vs"))).alias("units"))
    entry = F.struct(F.concat(F.lit("Concept"), F.col("c").cast("string")).alias("k"), F.struct(F.when(F.col("c") != 0, F.concat(F.lit("label "), F.col("c").cast("string"))).alias("label"), "units").alias("c"))
    nested = concepts.groupBy("l_suppkey").agg(F.map_from_entries(F.collect_list(entry)).alias("gaap"))
    nested = nested.select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("ticker"), F.lit("x").alias("entityName"), F.create_map(F.lit("us-gaap"), F.col("gaap")).alias("facts"))
    return facts.flatten(nested).select("ticker", "concept", "concept_label", "unit", "fact_no", "val", "accn")


# --- evaluation -----------------------------------------------------------------------------------------------------

GRADES = "['correct', 'partially_correct', 'incorrect'][event_id % 3 + 1]"


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as judged answers; the type is the configuration."""
    i = F.col("event_id")
    grade = lambda n: F.get(F.array(*map(F.lit, evaluation.GRADE_SCORE)), (n % 3).cast("int"))
    e = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("config"), (i % 5 != 0).alias("answerable"), (i % 7 == 0).alias("abstained"), (i % 101 == 0).alias("error"), (i % 4 != 0).alias("judged"), grade(i).alias("correctness"),
        ((i % 9) / 8).alias("faithfulness"), F.when(i % 6 != 0, (i % 2).cast("double")).alias("verifier_supported"), F.when(i % 2 == 0, grade(F.floor(i / 2))).alias("label"), F.when(i % 8 != 0, i % 3 != 0).alias("answer_unchanged"), (i % 400).alias("tokens"),
        grade(i).alias("grade"), F.col("value").alias("ms"), (i % 4).alias("n_entities"),
    )
    return e.withColumn("correctness_score", evaluation.judged_correctness(F.col("answerable"), F.col("abstained"), F.col("correctness")))


GRADED = f"""
g AS (SELECT event_id AS id, event_type AS config, event_id % 5 <> 0 AS answerable, event_id % 7 = 0 AS abstained, event_id % 101 = 0 AS error, event_id % 4 <> 0 AS judged, {GRADES} AS correctness, (event_id % 9) / 8.0::DOUBLE AS faithfulness,
  CASE WHEN event_id % 6 <> 0 THEN (event_id % 2)::DOUBLE END AS verifier_supported, CASE WHEN event_id % 2 = 0 THEN {GRADES.replace("event_id", "(event_id // 2)")} END AS label, CASE WHEN event_id % 8 <> 0 THEN event_id % 3 <> 0 END AS answer_unchanged, event_id % 400 AS tokens, value AS ms, event_id % 4 AS n_entities,
  CASE WHEN event_id % 7 = 0 THEN (event_id % 5 = 0)::INTEGER::DOUBLE WHEN event_id % 5 = 0 THEN 0 ELSE 1 - (event_id % 3) / 2.0::DOUBLE END AS score FROM events)"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 8).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(f"""WITH {GRADED}, l AS (SELECT *, label IS NOT NULL AND judged AND coalesce(answer_unchanged, true) AS labelled FROM g)
SELECT config, count(*) AS questions, sum(judged::INTEGER)::BIGINT AS judged, round(avg(score) FILTER (answerable AND NOT error), 8) AS correctness_all_answerable, round(avg(score) FILTER (answerable AND NOT error AND NOT abstained), 8) AS correctness_answered,
round(avg(faithfulness) FILTER (answerable AND NOT error AND NOT abstained), 8) AS faithfulness, round(avg(verifier_supported) FILTER (answerable AND NOT error AND NOT abstained), 8) AS verifier_claim_support, round(avg((correctness = label)::INTEGER) FILTER (labelled), 8) AS label_agreement,
round(avg(((correctness = 'correct') = (label = 'correct'))::INTEGER) FILTER (labelled), 8) AS label_agreement_lenient, sum(labelled::INTEGER)::BIGINT AS labelled, sum(tokens)::BIGINT AS judge_tokens FROM l GROUP BY config""")
def judge_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.judge_summary(graded(spark, sf_dir), ["config"]))


@query(f"WITH {GRADED} SELECT id, score FROM g")
def judged_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correctness of judged answers, with the rules for abstaining."""
    return graded(spark, sf_dir).select("id", F.col("correctness_score").alias("score"))


@query(f"WITH {GRADED} SELECT id, correctness FROM g WHERE judged AND verifier_supported = 1 AND correctness <> 'correct'")
def passed_but_wrong(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.passed_but_wrong(graded(spark, sf_dir))


@query(f"WITH {GRADED} SELECT config, count(*) AS cases, count(*) FILTER (correctness = 'incorrect') AS caught, count(*) FILTER (correctness = 'partially_correct') AS partial, count(*) FILTER (correctness = 'correct') AS missed FROM g GROUP BY config")
def judge_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.sensitivity(graded(spark, sf_dir), ["config"])


@query(f"WITH {GRADED} SELECT count(*) AS questions, round(avg(answerable::INTEGER), 8) AS answerable, round(avg(abstained::INTEGER), 8) AS abstained, round(avg(error::INTEGER), 8) AS error, round(avg(judged::INTEGER), 8) AS judged, round(avg(answer_unchanged::INTEGER), 8) AS answer_unchanged FROM g")
def analyzer_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the flags of a run."""
    return _rounded(evaluation.analyzer_summary(graded(spark, sf_dir)))


def _at(c: str, p: str, cond: str = "true") -> str:
    return f"list_sort(list({c}) FILTER ({cond} AND {c} IS NOT NULL))[least(count({c}) FILTER ({cond}) - 1, floor({p}::DOUBLE * count({c}) FILTER ({cond})))::INTEGER + 1]"


@query(f"""WITH {GRADED} SELECT config, round(avg(faithfulness), 8) AS context_recall, round(avg(verifier_supported), 8) AS context_coverage, {_at("ms", "0.5")} AS p50, {_at("ms", "0.95")} AS p95, {_at("ms", "0.5", "n_entities > 1")} AS multi_p50, {_at("ms", "0.95", "n_entities > 1")} AS multi_p95 FROM g GROUP BY config""")
def plan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = graded(spark, sf_dir).withColumns({"context_recall": F.col("faithfulness"), "context_coverage": F.col("verifier_supported")})
    s = evaluation.plan_summary(r)
    return s.withColumns({c: F.round(c, 8) for c in ("context_recall", "context_coverage")})


@query(f"""WITH {GRADED}, h AS (SELECT id, faithfulness AS gold FROM g WHERE id % 3 <> 1), a AS (SELECT id, coalesce(verifier_supported, 0) AS analyzed FROM g WHERE id % 4 <> 1)
SELECT h.id, gold, coalesce(analyzed, 0) AS analyzed, coalesce(analyzed, 0) - gold AS delta FROM h LEFT JOIN a USING (id)""")
def analyzer_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analyzed against gold filters, question by question; a refused one counts 0."""
    g = graded(spark, sf_dir)
    gold = g.where("id % 3 <> 1").select("id", F.col("faithfulness").alias("m"))
    return evaluation.retrieval_delta(gold, g.where("id % 4 <> 1").select("id", F.coalesce("verifier_supported", F.lit(0.0)).alias("m")), "m")


@query("""WITH x AS (SELECT event_id, list_transform(range(event_id % 4), lambda k: (event_id // (k + 1)) % 3 <> 0) AS a, list_transform(range(event_id % 3), lambda k: (event_id // (k + 2)) % 2 = 0) AS r FROM events),
n AS (SELECT *, len(list_filter(a, lambda e: e)) AS tp, len(list_filter(a, lambda e: NOT e)) AS fp, len(list_filter(r, lambda e: NOT e)) AS fn, len(list_filter(r, lambda e: e)) AS rt FROM x),
s AS (SELECT *, tp / nullif(tp + fp, 0)::DOUBLE AS p, tp / nullif(tp + fn, 0)::DOUBLE AS c FROM n)
SELECT event_id, p AS precision, rt / nullif(len(r), 0)::DOUBLE AS coverage, round(coalesce(2 * p * c / nullif(p + c, 0), 0), 2) AS f FROM s""")
def entailment_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, coverage and F of answers' claims by entailment."""
    i = F.col("event_id")
    seq = lambda n: F.slice(F.sequence(F.lit(0), (i % n).cast("int")), 1, (i % n).cast("int"))
    a, r = F.transform(seq(4), lambda k: F.floor(i / (k + 1)) % 3 != 0), F.transform(seq(3), lambda k: F.floor(i / (k + 2)) % 2 == 0)
    return table(spark, sf_dir, "events").select("event_id", evaluation.claim_scores(a, r).alias("s")).select("event_id", "s.*")


@query("""WITH x AS (SELECT event_id, event_id % 4 AS n FROM events) SELECT event_id, CASE WHEN n > 0 THEN round(list_sum(list_transform(range(n), lambda k: [1.0, 0.5, 0.0, 0.0][(event_id + k) % 4 + 1]::DOUBLE)) / n, 8) END AS faithfulness FROM x""")
def faithfulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over claims' verdicts; an unknown verdict counts 0."""
    i, names = F.col("event_id"), F.array(*map(F.lit, ["supported", "partial", "unsupported", "odd"]))
    n = (i % 4).cast("int")
    verdicts = F.transform(F.slice(F.sequence(F.lit(0), n), 1, n), lambda k: F.get(names, ((i + k) % 4).cast("int")))
    return table(spark, sf_dir, "events").select("event_id", F.round(evaluation.faithfulness(verdicts), 8).alias("faithfulness"))


@query("""WITH g AS (SELECT user_id AS query_id, 'T' || (event_id % 5)::VARCHAR AS ticker, 2022 + event_id % 3 AS fiscal_year, event_type FROM events), grid AS (SELECT DISTINCT query_id, ticker, fiscal_year FROM g), hits AS (SELECT DISTINCT query_id, ticker, fiscal_year FROM g WHERE event_type = 'purchase')
SELECT query_id, round(avg((hits.ticker IS NOT NULL)::INTEGER), 8) AS coverage FROM grid LEFT JOIN hits USING (query_id, ticker, fiscal_year) GROUP BY query_id""")
def context_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the asked cells of company and year that have a hit."""
    i = F.col("event_id")
    g = table(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), F.concat(F.lit("T"), (i % 5).cast("string")).alias("ticker"), (2022 + i % 3).alias("fiscal_year"), "event_type")
    return _rounded(evaluation.context_coverage(g.where("event_type = 'purchase'").drop("event_type"), g.drop("event_type").distinct()))


@query("SELECT doc_id, unnest(regexp_extract_all(text, '(?s).{0,40}(?:@|\\+[0-9]).{0,40}')) AS context FROM documents")
def grep_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every match of a pattern in whole texts with what stands around it."""
    return evaluation.grep(table(spark, sf_dir, "documents").select("doc_id", "text"), r"@|\+[0-9]", 40)
