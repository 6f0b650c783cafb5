"""Retrieval over ``documents`` and ``embeddings``. Documents stand in for chunks: the source is the company, the
language the section, and id arithmetic gives years, quarters and forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import content_hash
from tessera.operators import retrieval as R
from tessera.operators.filters import RELEASE, SearchFilters
from tessera.plans.registry import query, table

QUESTION = "thed onre heed erst whnd"
SECOND = "ciónque menteas adoja eauxle"


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    release = F.col("doc_id") % 5 == 0
    return d.select(
        F.col("doc_id").alias("id"),
        "text",
        F.upper("source").alias("ticker"),
        F.col("lang").alias("section"),
        (2022 + F.col("doc_id") % 4).cast("int").alias("fiscal_year"),
        F.when(release, (1 + F.col("doc_id") % 4).cast("int")).alias("fiscal_quarter"),
        F.when(release, RELEASE).otherwise("10-K").alias("form"),
        F.when(F.col("n_chars") > 2000, "table").otherwise("text").alias("chunk_type"),
    )


CHUNKS = """
c AS (SELECT doc_id AS id, text, upper(source) AS ticker, lang AS section, (2022 + doc_id % 4)::INTEGER AS fiscal_year,
  CASE WHEN doc_id % 5 = 0 THEN (1 + doc_id % 4)::INTEGER END AS fiscal_quarter,
  CASE WHEN doc_id % 5 = 0 THEN '8-K EX-99.1' ELSE '10-K' END AS form,
  CASE WHEN n_chars > 2000 THEN 'table' ELSE 'text' END AS chunk_type FROM documents)"""

STOP = "', '".join(w.replace("'", "''") for w in R.tokens.__globals__["STOPWORDS"])


def bm25_sql(questions: dict[int, str], part: str) -> str:
    """CTEs up to bm(query_id, part, id, score)."""
    toks = lambda x: f"list_filter(regexp_extract_all(lower(replace({x}, '’', '''')), '[a-z0-9]+(?:[.,''\\-][a-z0-9]+)*'), lambda t: t NOT IN ('{STOP}'))"
    qs = ", ".join(f"({i}, '{q}')" for i, q in questions.items())
    return f"""
d AS (SELECT id, {part} AS part, {toks("text")} AS toks FROM c),
q AS (SELECT query_id, term, count(*) AS qf FROM (SELECT query_id, unnest({toks("q")}) AS term FROM (VALUES {qs}) v(query_id, q)) GROUP BY ALL),
st AS (SELECT part, count(*) AS n, avg(len(toks)) AS avgdl FROM d GROUP BY part),
tf AS (SELECT id, part, dl, term, count(*) AS tf FROM (SELECT id, part, len(toks) AS dl, unnest(toks) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT part, term, count(*) AS df FROM tf GROUP BY ALL),
bm AS (SELECT q.query_id, tf.part, tf.id, sum(q.qf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score
  FROM tf JOIN df USING (part, term) JOIN st USING (part) JOIN q USING (term) GROUP BY ALL HAVING score > 0)"""


def one_query(spark: SparkSession, text: str = QUESTION) -> DataFrame:
    return spark.createDataFrame([(1, text)], "query_id int, text string")


@query(f"""WITH {CHUNKS}, {bm25_sql({1: QUESTION}, "ticker")},
r AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY score DESC, id) AS rank FROM bm)
SELECT part AS ticker, rank, id, round(score, 6) AS score FROM r WHERE rank <= 5""")
def bm25_topk_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = R.bm25(chunks(spark, sf_dir), one_query(spark), ["ticker"], stemmed=False)
    return R.ranked(scores, 5, ["ticker"]).select("ticker", "rank", "id", F.round("score", 6).alias("score"))


@query(f"""WITH {CHUNKS}, {bm25_sql({1: QUESTION}, "form")},
r AS (SELECT bm.id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, bm.id) AS rank
  FROM bm JOIN c ON bm.id = c.id WHERE form = '10-K' AND fiscal_year IN (2023, 2024) AND section IN ('en', 'de'))
SELECT * FROM r WHERE rank <= 20""")
def bm25_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the whole form; the filter after them."""
    c = chunks(spark, sf_dir)
    allowed = SearchFilters(fiscal_years=(2023, 2024), sections=("en", "de")).apply(c).select("id")
    scores = R.bm25(c, one_query(spark), ["form"], stemmed=False).join(allowed, "id", "left_semi")
    return R.ranked(scores, 20).select("id", F.round("score", 6).alias("score"), "rank")


def bm25_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search tokens with stemming; SQL has no stemmer."""
    scores = R.bm25(chunks(spark, sf_dir), one_query(spark), ["form"])
    return R.ranked(scores, 10, ["form"]).select("form", "rank", "id", F.round("score", 6).alias("score"))


query()(bm25_stemmed)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


DENSE = """
v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.id AS query_id, v.id, v.label, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * v.e[i])) AS score FROM v, v q WHERE q.id IN (0, 100, 200))"""


@query(f"""WITH {DENSE}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
SELECT query_id, id, rank, round(score, 6) AS score FROM r WHERE rank <= 10""")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    q = v.where(F.col("id").isin(0, 100, 200)).select(F.col("id").alias("query_id"), "embedding")
    return R.dense(v, q, 10).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@query(f"""WITH {DENSE}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE label IN (1, 2, 3))
SELECT query_id, id, rank, round(score, 6) AS score FROM r WHERE rank <= 10""")
def dense_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter before the search."""
    v = vectors(spark, sf_dir)
    q = v.where(F.col("id").isin(0, 100, 200)).select(F.col("id").alias("query_id"), "embedding")
    return R.dense(v.where(F.col("label").isin(1, 2, 3)), q, 10).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


TWO_LISTS = f"""{CHUNKS}, {bm25_sql({1: QUESTION, 2: SECOND}, "form")},
b AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bm WHERE part = '10-K') WHERE rank <= 50),
{DENSE.replace("q.id IN (0, 100, 200)", "q.id IN (1, 2)")},
e AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 50),
f AS (SELECT query_id, id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT query_id, id, rank FROM b UNION ALL SELECT query_id, id, rank FROM e) GROUP BY ALL),
rf AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f)"""


def fused(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    q = spark.createDataFrame([(1, QUESTION), (2, SECOND)], "query_id int, text string")
    lexical = R.bm25(chunks(spark, sf_dir), q, ["form"], stemmed=False).where("form = '10-K'")
    v = vectors(spark, sf_dir)
    by_vector = R.dense(v, v.where(F.col("id").isin(1, 2)).select(F.col("id").alias("query_id"), "embedding"), 50)
    return R.rrf([R.ranked(lexical, 50), by_vector], k)


@query(f"WITH {TWO_LISTS} SELECT query_id, id, rank, round(score, 8) AS score FROM rf WHERE rank <= 20")
def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused(spark, sf_dir).select("query_id", "id", "rank", F.round("score", 8).alias("score"))


@query(f"""WITH {CHUNKS}, {bm25_sql({1: QUESTION}, "form")},
l AS (SELECT c.ticker, c.fiscal_year, bm.id, score, row_number() OVER (PARTITION BY c.ticker, c.fiscal_year ORDER BY score DESC, bm.id) AS rank
  FROM bm JOIN c ON bm.id = c.id WHERE form = '10-K' AND ticker IN ('SRC1', 'SRC2', 'SRC3') AND fiscal_year IN (2022, 2024)),
x AS (SELECT *, row_number() OVER (ORDER BY rank, score DESC, ticker, fiscal_year) AS position FROM l WHERE rank <= 4)
SELECT ticker, fiscal_year, id, rank, position, round(score, 6) AS score FROM x""")
def interleave_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request split by company and year, a quota for each part, the parts interleaved."""
    request = spark.createDataFrame([(1, ["SRC1", "SRC2", "SRC3"], [2022, 2024], None)], "query_id int, tickers array<string>, fiscal_years array<int>, fiscal_quarters array<int>")
    grid = R.request_grid(request).select("ticker", "fiscal_year", F.col("part_no").alias("list_no"))
    c = chunks(spark, sf_dir)
    scores = R.bm25(c, one_query(spark), ["form"], stemmed=False).where("form = '10-K'")
    parts = scores.join(c.select("id", "ticker", "fiscal_year"), "id").join(F.broadcast(grid), ["ticker", "fiscal_year"])
    cut = R.quota_cut(parts, 4)
    return R.interleave(cut).select("ticker", "fiscal_year", "id", "rank", "position", F.round("score", 6).alias("score"))


@query(f"""WITH {CHUNKS}, p AS (
SELECT t.ticker, y.fiscal_year, row_number() OVER (ORDER BY t.n, y.n) - 1 AS part_no
FROM (VALUES ('A', 0), ('B', 1)) t(ticker, n), (VALUES (2022, 0), (2023, 1), (2024, 2)) y(fiscal_year, n))
SELECT ticker, fiscal_year::INTEGER AS fiscal_year, NULL::INTEGER AS fiscal_quarter, part_no FROM p""")
def filter_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    request = spark.createDataFrame([(1, ["A", "B"], [2022, 2023, 2024], None)], "query_id int, tickers array<string>, fiscal_years array<int>, fiscal_quarters array<int>")
    return R.request_grid(request).drop("query_id")


@query(f"WITH {CHUNKS} SELECT id, ticker, fiscal_year, section FROM c WHERE form = '10-K' AND ticker IN ('SRC1', 'SRC7') AND fiscal_year = 2023 AND section = 'en' AND chunk_type = 'text'")
def filter_conjunction(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = SearchFilters(tickers=("src1", "src7"), fiscal_years=(2023,), sections=("en",), chunk_types=("text",))
    return f.apply(chunks(spark, sf_dir)).select("id", "ticker", "fiscal_year", "section")


@query(f"""WITH {CHUNKS} SELECT 'none' AS filters, form, count(*) AS n FROM c WHERE form = '10-K' GROUP BY form
UNION ALL SELECT 'quarters', form, count(*) FROM c WHERE form = '8-K EX-99.1' AND fiscal_quarter IN (1, 2) GROUP BY form
UNION ALL SELECT 'forms', form, count(*) FROM c WHERE form IN ('10-K', '8-K EX-99.1') GROUP BY form""")
def filter_default_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir)
    named = {"none": SearchFilters(), "quarters": SearchFilters(fiscal_quarters=(1, 2)), "forms": SearchFilters(forms=("10-K", RELEASE))}
    parts = [f.apply(c).groupBy("form").agg(F.count("*").alias("n")).select(F.lit(name).alias("filters"), "form", "n") for name, f in named.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""WITH {TWO_LISTS},
p AS (SELECT rf.query_id, rf.id, rf.rank AS before, length(d.text) AS s FROM rf JOIN documents d ON d.doc_id = rf.id WHERE rank <= 10)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY s, before) AS rank, (-s)::DOUBLE AS score FROM p""")
def rerank_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in scorer that prefers short passages reorders the first ten fused candidates."""
    q = spark.createDataFrame([(1, QUESTION), (2, SECOND)], "query_id int, text string")
    r = R.rerank(fused(spark, sf_dir), chunks(spark, sf_dir), q, lambda query, passage: -F.length(passage).cast("double"), 10)
    return r.select("query_id", "id", "rank", "score")


@query(f"""WITH {TWO_LISTS},
p AS (SELECT query_id, rf.id, lang, score + CASE WHEN lang = 'en' THEN 0.005 ELSE 0 END AS s, rank FROM rf JOIN documents d ON d.doc_id = rf.id WHERE rank <= 20),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, rank) AS position FROM p)
SELECT query_id, id, position, round(s, 8) AS score FROM o WHERE position <= 5""")
def section_prior_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bonus for one section before the quota cut."""
    from tessera.operators.planning import apply_prior

    hits = fused(spark, sf_dir).join(chunks(spark, sf_dir).select("id", "section"), "id")
    return apply_prior(hits, {"en": 0.005}, 5).select("query_id", "id", F.col("rank").alias("position"), F.round("score", 8).alias("score"))


@query("""SELECT doc_id, substr(sha1(text), 1, 16) AS content_hash, doc_id % 3 <> 0 OR doc_id % 2 = 0 AS computed FROM documents""")
def content_hash_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which embeddings must be computed: the cache holds every third row, and half of those with old content."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    cache = d.where("chunk_id % 3 = 0").select("chunk_id", F.when(F.col("chunk_id") % 2 == 0, "stale").otherwise(content_hash(F.col("text"))).alias("content_hash"), F.array(F.lit(0.0)).cast("array<float>").alias("embedding"))
    fresh = R.embed_incrementally(d, cache, lambda c: F.array(F.lit(1.0)).cast("array<float>"))
    return fresh.select(F.col("chunk_id").alias("doc_id"), "content_hash", (F.get("embedding", F.lit(0)) == 1).alias("computed"))


@query("""SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d
ON contains(lower(trim(regexp_replace(translate(d.text, '’‘“”–—', '''''""--'), '\\s+', ' ', 'g'))), lower(trim(regexp_replace(translate(b.text, '’‘“”–—', '''''""--'), '\\s+', ' ', 'g'))))""")
def quote_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the benchmark's passages are quoted."""
    from tessera.operators.evaluation import resolve_quotes

    pages = table(spark, sf_dir, "documents").select("doc_id", "text")
    quotes = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"))
    return resolve_quotes(pages, quotes).select("item_id", "doc_id")


@query("""SELECT upper(source) AS ticker, list_sort(list(DISTINCT (2022 + doc_id % 4)::INTEGER)) AS fiscal_years FROM documents GROUP BY ALL""")
def corpus_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    years, _ = R.corpus_meta(chunks(spark, sf_dir).withColumn("section_title", F.col("section")))
    return years


@query("""SELECT 'Item ' || (doc_id % 3 + 1)::VARCHAR || CASE WHEN doc_id % 2 = 0 THEN 'A' ELSE '' END AS section, count(*) AS chunks, (doc_id % 3 + 1)::INTEGER AS sort_number,
CASE WHEN doc_id % 2 = 0 THEN 'A' ELSE '' END AS sort_suffix FROM documents GROUP BY ALL""")
def corpus_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    section = F.concat(F.lit("Item "), (F.col("id") % 3 + 1).cast("string"), F.when(F.col("id") % 2 == 0, "A").otherwise(""))
    _, s = R.corpus_meta(chunks(spark, sf_dir).withColumn("section", section).withColumn("section_title", F.lit("x")))
    return s.drop("title")


def hybrid_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four modes of the retriever with the stand-in models; an embedding model has no SQL form."""
    embed = R.bag_of_words_embedder()
    c = chunks(spark, sf_dir).withColumn("embedding", embed(F.col("text")))
    r = R.Retriever(c, embed, lambda q, p: -F.length(p).cast("double"))
    out = None
    for mode, found in r.search_modes(one_query(spark), SearchFilters(), 5).items():
        hits = found.select(F.lit(mode).alias("mode"), "id", "rank", F.size("stages").alias("n_stages"))
        out = hits if out is None else out.unionByName(hits)
    return out


query()(hybrid_modes)


def ann_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of hashed search; the random planes have no SQL form."""
    v = vectors(spark, sf_dir)
    return R.ann_recall(v, v.where("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding"))


query()(ann_recall)


@query("""SELECT doc_id, contains(lower(text), 'the') AND contains(lower(text), 'ing') AS passed FROM documents""")
def keyword_smoke(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", R.contains_all(F.col("text"), F.array(F.lit("THE"), F.lit("ing"))).alias("passed"))


