"""Operators against hand-made cases."""

import datetime

import pytest
from pyspark.sql import functions as F

from tessera.operators import chunking, context, entities, evaluation, facts, filings, html_blocks, planning, retrieval, sections, usage, verification
from tessera.operators.filters import RELEASE, SearchFilters, merge_filters, validate_request

# --- filters -------------------------------------------------------------------------------------------------------


def test_filters(spark):
    rows = [(1, "AAPL", 2024, "Item 7", "text", None, "10-K"), (2, "AAPL", 2024, "r", "text", 3, RELEASE), (3, "MSFT", 2023, "Item 7", "table", None, "10-K")]
    c = spark.createDataFrame(rows, "id int, ticker string, fiscal_year int, section string, chunk_type string, fiscal_quarter int, form string")
    ids = lambda f: [r.id for r in f.apply(c).orderBy("id").collect()]
    assert ids(SearchFilters()) == [1, 3] and ids(SearchFilters(tickers=("aapl",))) == [1] and ids(SearchFilters(fiscal_quarters=(3,))) == [2]
    assert ids(SearchFilters(forms=("10-K", RELEASE), chunk_types=("text",))) == [1, 2]
    m = merge_filters(SearchFilters(tickers=("V",), fiscal_quarters=(1,), sections=("Item 7",)), SearchFilters(forms=("10-K",)))
    assert m.fiscal_quarters is None and m.tickers == ("V",) and m.sections == ("Item 7",)
    assert merge_filters(SearchFilters(sections=("Item 7",)), SearchFilters(fiscal_quarters=(2,))).sections is None
    assert validate_request("", 50, SearchFilters(tickers=("XX",), fiscal_quarters=(5,)), {"V"}) and not validate_request("q", 5, SearchFilters(), set())


def test_pushed_filters(spark, tmp_path):
    p = str(tmp_path / "c")
    spark.createDataFrame([("AAPL", 2024, "10-K")], "ticker string, fiscal_year int, form string").write.parquet(p)
    plan = SearchFilters(tickers=("AAPL", "V"), fiscal_years=(2024,)).apply(spark.read.parquet(p))._jdf.queryExecution().executedPlan().toString()
    assert "In(ticker" in plan and "EqualTo(form" in plan


# --- retrieval -----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def chunks(spark):
    texts = ["Data center revenue grew strongly", "Gaming revenue declined", "Cloud services revenue and margin", "Risk factors include competition", "Automotive deliveries in the quarter"]
    rows = [(i, t, ["NVDA", "NVDA", "MSFT", "MSFT", "TSLA"][i], 2024 + i % 2, "Item 7", "text", None, "10-K") for i, t in enumerate(texts)]
    rows.append((9, "Data center revenue in the release", "NVDA", 2025, "r", "text", 3, RELEASE))
    c = spark.createDataFrame(rows, "id int, text string, ticker string, fiscal_year int, section string, chunk_type string, fiscal_quarter int, form string")
    return c.withColumn("embedding", retrieval.bag_of_words_embedder()(F.col("text"))).cache()


def queries(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "query_id int, text string")


def test_bm25_statistics_ignore_filters(spark, chunks):
    annual = chunks.where("form = '10-K'")
    q = queries(spark, "data center revenues", "no such words whatsoever")
    both = {r.id: r.score for r in retrieval.bm25(chunks, q, ["form"]).where("form = '10-K'").collect()}
    alone = {r.id: r.score for r in retrieval.bm25(annual, q, ["form"]).collect()}
    assert both == alone and max(both, key=both.get) == 0 and 3 not in both


def test_fusion_and_interleaving(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id int, id int, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id int, id int, rank int")
    r = retrieval.rrf([a, b], 5).orderBy("rank").collect()
    assert [x.id for x in r] == [11, 10, 12] and abs(r[0].score - (1 / 61 + 1 / 62)) < 1e-12
    hits = spark.createDataFrame([(1, 0, 1, 5, 0.9), (1, 0, 2, 6, 0.8), (1, 1, 1, 7, 0.95), (1, 1, 2, 5, 0.7)], "query_id int, list_no int, rank int, id int, score double")
    assert [x.id for x in retrieval.interleave(hits).orderBy("position").collect()] == [7, 5, 6]
    assert retrieval.interleave(hits, 2).count() == 2


def test_modes_and_rerank(spark, chunks):
    r = retrieval.Retriever(chunks, scorer=lambda q, p: -F.length(p).cast("double"))
    for mode in retrieval.MODES:
        hits = r.search(queries(spark, "data center revenue"), SearchFilters(), 3, mode).orderBy("rank").collect()
        assert hits and all(h.id != 9 for h in hits) and hits[0].stages
    assert hits[0].id == 1  # the shortest of the pool
    d = retrieval.search_decomposed(r, queries(spark, "revenue"), SearchFilters(tickers=("NVDA", "MSFT")), 4, "bm25").orderBy("position").collect()
    assert {d[0].id, d[1].id} == {1, 2} or len(d) >= 2
    assert len(retrieval.split_filters(SearchFilters(tickers=("A", "B"), fiscal_years=(1, 2, 3)))) == 6


def test_incremental_embedding(spark):
    c = spark.createDataFrame([("a", "one"), ("b", "two"), ("c", "three")], "chunk_id string, text string")
    embed = lambda x: F.array(F.length(x).cast("float"))
    cache = retrieval.embed_incrementally(c.where("chunk_id <> 'c'"), spark.createDataFrame([], "chunk_id string, content_hash string, embedding array<float>"), embed)
    changed = c.withColumn("text", F.when(F.col("chunk_id") == "b", "twenty").otherwise(F.col("text"))).where("chunk_id <> 'a'")
    again = {r.chunk_id: r.embedding[0] for r in retrieval.embed_incrementally(changed, cache, embed).collect()}
    assert again == {"b": 6.0, "c": 5.0}


def test_plans():
    p = planning.make_plan("q", SearchFilters(tickers=("A", "B"), fiscal_years=(2024,), fiscal_quarters=(1, 2, 3, 4)), True, 10)
    assert len(p.parts) == 8 and p.quota == 2 and p.pool == 30 and p.section_bonus == {"Item 7": 0.05}
    assert planning.make_plan("q", SearchFilters(tickers=("A", "B", "C"), fiscal_years=(2024,), fiscal_quarters=(1, 2, 3)), False).pool == 15


def test_execute_plan(spark, chunks):
    r = retrieval.Retriever(chunks)
    q = queries(spark, "revenue")
    p = planning.make_plan("revenue", SearchFilters(tickers=("NVDA", "MSFT")), True, 4)
    hits = planning.execute(r, p, q, "bm25").collect()
    assert hits and max(h["rank"] for h in hits) <= p.quota


# --- questions -----------------------------------------------------------------------------------------------------

QUESTIONS = [
    ("How did Apple's iPhone revenue change from 2022 to 2024?", ["AAPL"], [2022, 2023, 2024], [], False),
    ("Compare Visa and Mastercard in fiscal 2023", ["V", "MA"], [2023], [], False),
    ("NVIDIA data center revenue in Q3 FY25", ["NVDA"], [2025], [3], True),
    ("What was revenue in the three months ended October 27, 2024 at NVIDIA?", ["NVDA"], [2025], [3], True),
    ("What is the outlook for Q1 2025 at Tesla?", ["TSLA"], [2024], [4], True),
    ("quarterly dividend of Microsoft", ["MSFT"], [], [], False),
    ("Tesla quarterly deliveries in the last two years", ["TSLA"], [2024, 2025], [1, 2, 3, 4], True),
    ("Amazon spent $2025 and 1,990 units in 2018", ["AMZN"], [], [], False),
    ("latest year of Meta", ["META"], [2025], [], False),
    ("What are JPMorgan Chase risk factors for 2024?", ["JPM"], [2024], [], False),
]


def test_entities(spark):
    q = spark.createDataFrame([(i, x[0]) for i, x in enumerate(QUESTIONS)], "n int, question string")
    got = {r.n: r for r in entities.scope(entities.extract(q)).collect()}
    for i, (text, tickers, years, quarters, release) in enumerate(QUESTIONS):
        r = got[i]
        assert (r.tickers, r.fiscal_years, r.fiscal_quarters, r.release) == (tickers, years, quarters, release), text
    assert got[7].scope == "out_of_range" and got[7].out_of_range_years == [2018] and got[9].sections == ["Item 1A"]


def test_scope_intent_and_metrics(spark):
    q = spark.createDataFrame([("What is Apple's stock price right now?",), ("How much revenue did Visa earn?",), ("How did AWS sales evolve?",), ("What does Meta do?",)], "question string")
    r = entities.scope(entities.extract(q)).select("scope", planning.intent(F.col("question"), F.size("tickers"), F.size("fiscal_years"), F.size("fiscal_quarters")).alias("intent"), facts.detect_metrics(F.col("question")).alias("m")).collect()
    assert r[0].scope == "live_data" and [x.intent for x in r[1:]] == ["numeric", "trend", "lookup"] and r[1].m == ["revenue", "net_income"] or r[1].m == ["revenue"]
    assert r[2].m == []


def test_follow_ups(spark):
    turns = [(1, 0, "user", "Apple revenue in 2024?"), (1, 1, "assistant", "Microsoft 2022"), (1, 2, "user", "And the year before?"), (1, 3, "assistant", "x"), (1, 4, "user", "What about Visa?"), (2, 0, "user", "And its margin?")]
    t = spark.createDataFrame(turns, "conv_id int, turn int, role string, text string")
    got = {(r.conv_id, r.turn): r for r in entities.follow_ups(t).collect()}
    assert got[(1, 2)].tickers == ["AAPL"] and got[(1, 2)].fiscal_years == [2023] and got[(1, 2)].carried
    assert got[(1, 4)].tickers == ["V"] and got[(2, 0)].tickers == []


# --- facts and filings ---------------------------------------------------------------------------------------------


def test_fact_lookup(spark):
    f = lambda n, concept, start, end, val, accn, filed: ("X", "X Inc", concept, concept, "USD", n, start, end, val, accn, "10-K", filed)
    rows = [
        f(0, "Revenues", "2023-01-01", "2023-12-31", 100.0, "a23", "2024-02-01"),
        f(1, "Revenues", "2022-01-01", "2022-12-31", 80.0, "a23", "2024-02-01"),
        f(2, "Revenues", "2023-10-01", "2023-12-31", 30.0, "a23", "2024-02-01"),
        f(3, "Revenues", "2023-01-01", "2023-12-31", 101.0, "a24", "2025-02-01"),
        f(4, "NetIncomeLoss", "2023-01-01", "2023-12-31", 9.0, "a24", "2025-02-01"),
        f(5, "ProfitLoss", "2023-01-01", "2023-12-31", 8.0, "a25", "2026-02-01"),
        f(6, "Assets", None, "2023-12-28", 500.0, "a23", "2024-02-01"),
    ]
    facts_df = spark.createDataFrame(rows, "ticker string, company string, concept string, concept_label string, unit string, fact_no int, start string, end string, val double, accn string, form string, filed string")
    filings_df = spark.createDataFrame([("X", 2023, "a23", "2023-12-31", "2024-02-01", "u")], "ticker string, fiscal_year int, accession_number string, period_end string, filing_date string, source_url string")
    got = {r.metric: r for r in facts.lookup(facts_df, filings_df, facts.metrics_dim(spark)).withColumn("sentence", facts.fact_text()).collect()}
    assert got["revenue"].val == 100.0 and got["revenue"].prior_value == 80.0 and got["revenue"].change_pct == 25.0 and not got["revenue"].comparative
    assert got["net_income"].val == 9.0 and got["net_income"].comparative and got["total_assets"].val == 500.0
    assert "prior year" in got["revenue"].sentence and "comparative in the next 10-K" in got["net_income"].sentence
    assert facts.lookup_many(facts.lookup(facts_df, filings_df, facts.metrics_dim(spark)), ["X"], [2023], ["total_assets", "revenue"]).first().metric == "total_assets"


def test_company_facts_file(spark, tmp_path):
    from tessera.sources import files

    (tmp_path / "NVDA.json").write_text('{"cik": 1, "entityName": "N", "facts": {"us-gaap": {"Revenues": {"label": "Rev", "units": {"USD": [{"start": "2023-01-01", "end": "2023-12-31", "val": 5.0, "accn": "a", "fy": 2023, "fp": "FY", "form": "10-K", "filed": "2024-01-01"}]}}}}}')
    r = facts.flatten(files.company_facts(spark, str(tmp_path / "NVDA.json"))).first()
    assert (r.ticker, r.concept_label, r.unit, r.val, r.start) == ("NVDA", "Rev", "USD", 5.0, "2023-01-01")


def test_fiscal_periods_and_releases(spark):
    rows = [("N", 0, "10-K", "2023-01-29", "2023-02-24", None), ("N", 1, "10-Q", "2023-04-30", "2023-05-26", None), ("N", 2, "10-Q", "2023-07-30", "2023-08-28", None), ("N", 3, "8-K", None, "2023-05-24", "2.02,9.01"), ("N", 4, "8-K", None, "2023-05-10", "2.02,7.01,9.01"), ("N", 5, "8-K", None, "2023-12-30", "2.02"), ("N", 6, "8-K", None, "2023-05-25", "5.02")]
    f = spark.createDataFrame(rows, "ticker string, pos int, form string, reportDate string, filingDate string, items string")
    p = {str(r.period_end): (r.fiscal_year, r.fiscal_quarter) for r in filings.fiscal_periods(filings.period_ends(f)).collect()}
    assert p == {"2023-01-29": (2023, 4), "2023-04-30": (2024, 1), "2023-07-30": (2024, 2)}
    c = filings.release_candidates(f, [2024]).orderBy("preference").collect()
    assert [r.pos for r in c] == [3, 4]
    index = "<table><tr><td>1</td><td>x</td><td>a.htm</td><td>8-K</td></tr><tr><td>2</td><td>y</td><td><a>pr.htm</a>&nbsp; iXBRL</td><td>EX-99.1</td></tr></table>"
    assert spark.range(1).select(filings.exhibit_document(F.lit(index)).alias("x")).first().x == "pr.htm"
    pick = spark.createDataFrame([("N", 2024, 1, 1, "<p>nothing</p>"), ("N", 2024, 1, 2, "<p>Net income</p> per diluted share")], "ticker string, fiscal_year int, fiscal_quarter int, preference int, html string")
    assert filings.choose_release(pick).first().preference == 2
    cols = spark.createDataFrame([(["a", "b"], [1, 2, 3])], "form array<string>, n array<int>")
    assert filings.rows_of_columns(cols, ["form", "n"]).count() == 2


# --- structure -----------------------------------------------------------------------------------------------------

FILING = """<html><body><p>Page one</p><div style="page-break-after:always"></div><hr style="page-break-after: always"/>
<p><b>Item 1. Business</b></p><p>We sell <span>$</span><span>288</span> things.<br/>Yes.</p><div style="display:none">hidden</div>
<table><tr><td></td><td colspan="2">2025</td><td colspan="2">2024</td></tr><tr><td>Net sales</td><td>$</td><td>416</td><td>$</td><td>391</td></tr><tr><td>Cost</td><td></td><td>(5</td><td>)</td><td>4</td></tr></table>
<p>2</p><p style="page-break-before:always">Third page</p><p>3</p></body></html>"""


def test_html_blocks(spark):
    d = spark.createDataFrame([("d", FILING), ("e", ""), ("f", None)], "doc_id string, html string")
    b = html_blocks.blocks(d).orderBy("pos").collect()
    assert [(x.kind, x.page) for x in b] == [("text", 1), ("heading", 2), ("text", 2), ("table", 2), ("text", 2), ("text", 3), ("text", 3)]
    assert b[2].text == "We sell $288 things. Yes." and b[3].rows[1] == ["Net sales", "$416", "$391"]
    pages = html_blocks.pages_of(html_blocks.with_furniture(html_blocks.blocks(d))).orderBy("page").collect()
    assert [(p.page, p.label) for p in pages] == [(1, None), (2, "2"), (3, "3")] and pages[2].text == "Third page"
    assert html_blocks.unwrap("<DOCUMENT><TYPE>x<TEXT> <p>a</p> </TEXT></DOCUMENT>") == "<p>a</p>"


def test_label_validation(spark):
    raw = spark.createDataFrame([("d", 1, "3"), ("d", 2, "4"), ("d", 5, "7"), ("d", 6, "8"), ("d", 9, "99"), ("d", 10, "F-1")], "doc_id string, page int, label string")
    got = {r.page: r.label for r in html_blocks.validated_labels(raw).collect()}
    assert got == {1: "3", 2: "4", 3: "5", 4: "6", 5: "7", 6: "8", 10: "F-1"}


def blocks_of(spark, rows):
    return spark.createDataFrame([("d", i, k, t, p, False) for i, (k, t, p) in enumerate(rows)], "doc_id string, pos int, kind string, text string, page int, furniture boolean")


def test_sections(spark):
    toc = [("text", f"Item {i}. Title", 1) for i in ("1", "1A", "2", "7")]
    body = [("heading", "PART I", 2), ("heading", "Item 1. Business", 2), ("heading", "BUSINESS", 2), ("heading", "Our products", 2), ("text", "We make things. " * 20, 2), ("heading", "Item 1A. Risk Factors", 3), ("text", "See Item 1 above for more about this.", 3), ("text", "Risky " * 30, 3)]
    tail = [("heading", "Item 7. MD&A", 4), ("text", "Incorporated by reference.", 4), ("heading", "Item 15. Exhibits", 5), ("text", "list", 5), ("heading", "Management's Discussion and Analysis", 6), ("text", "Real discussion", 6)]
    got = sections.assign(blocks_of(spark, toc + body + tail)).orderBy("pos").collect()
    assert {r.section for r in got[:4]} == {"Cover"} and got[5].section == "Item 1" and got[5].part == "Part I"
    assert got[8].subsection == "Our products" and got[10].section == "Item 1A" and got[11].section == "Item 1A" and got[11].subsection is None
    assert got[-1].section == "Item 7" and got[-3].section == "Item 15"
    rel = sections.assign_release(blocks_of(spark, [("heading", "Exhibit 99.1", 1), ("heading", "Highlights", 1), ("text", "x", 1)])).orderBy("pos").collect()
    assert [r.subsection for r in rel] == [None, "Highlights", "Highlights"]


def test_packer():
    b = lambda kind, text, rows=None: {"kind": kind, "text": text, "page": 1, "subsection": None, "rows": rows, "header_rows": 1}
    sentence = " ".join(f"w{i}" for i in range(19)) + " end."
    made = chunking.Packer(chunking.count_words, chunking.Limits()).pack([b("text", f"S{i} {sentence}") for i in range(40)])
    assert len(made) > 2 and all(chunking.count_words(c["text"]) <= 420 for c in made) and made[1]["text"].split()[0] == "S14"
    big = b("table", "x " * 600, [["h", "a"], *[[f"row{i}", "1 " * 20] for i in range(40)]])
    made = chunking.Packer(chunking.count_words, chunking.Limits()).pack([b("text", "Caption here"), big])
    assert made[0]["text"].startswith("Caption here\n\n| h") and made[1]["text"].startswith("Caption here (continued)") and {c["kind"] for c in made} == {"table"}
    assert chunking.pieces("word " * 1000, chunking.count_words, chunking.Limits())[0].count(" ") < 420


def test_slides():
    text = "Q U A R T E R L Y update B A L A N C E S H E E T unaudited in millions Q1-2024 Q2-2024 Q3-2024 YoY Cash 16,398 14,635 18,111 7% Receivables 3,887 3,737 3,313 -9% Inventory 16,033 14,195 14,530 3%"
    s = chunking.slide(text, 4)
    assert s[0]["kind"] == "heading" and "BALANCE SHEET" in s[0]["text"] and s[-1]["kind"] == "table" and s[-1]["text"].split("\n")[1].startswith("Cash")
    assert chunking.slide("short", 1) == []


def test_chunks(spark):
    rows = [("heading", "A heading", 1)] + [("text", f"Sentence number {i}. " * 20, 1 + i // 3) for i in range(12)]
    b = sections.assign_release(blocks_of(spark, rows)).withColumns({"rows": F.lit(None).cast("array<array<string>>"), "header_rows": F.lit(0)})
    c = chunking.chunk(b).orderBy("chunk_no").collect()
    assert [x.chunk_no for x in c] == list(range(len(c))) and len(c) > 1 and c[0].section == "Earnings release"


# --- answers -------------------------------------------------------------------------------------------------------


def test_context(spark):
    hits = spark.createDataFrame([(1, 1, "a", 900), (1, 2, "b", 3000), (1, 3, "c", 100), (1, 4, "a", 10)], "query_id int, rank int, id string, token_count int")
    assert [r.id for r in context.pack(hits, 1200).orderBy("source_no").collect()] == ["a", "c"]


def test_claims_and_citations(spark):
    t = "Sales rose 5% in the U.S. market (S1; Source 2). It was $3 billion. [S3] More text. And more [S4]."
    r = spark.range(1).select(context.normalize_markers(F.lit("a [S1, S2] (Source 3)")).alias("n"), context.claims(F.lit(t)).alias("c"), context.render_citations(F.lit("x [S1] [S2] [S9]"), F.create_map(F.lit("S1"), F.lit("[V Q1 FY2024 release]"), F.lit("S2"), F.lit("[V Q1 FY2024 release]"))).alias("r")).first()
    assert r.n == "a [S1][S2] [S3]" and r.r == "x [V Q1 FY2024 release] [S9]"
    assert [c.ids for c in r.c] == [["S1", "S2"], ["S3"], ["S3"], ["S4"]] or [c.ids for c in r.c][:2] == [["S1", "S2"], ["S3"]]


def source(text, quarter=None, kind="text", year=2025, ticker="TSLA"):
    return {"id": "", "text": text, "rendered": text, "context": "Tesla (TSLA) earnings release", "ticker": ticker, "fiscal_year": year, "fiscal_quarter": quarter, "period_end": "2025-09-30", "chunk_type": kind}


def test_verification():
    s = {"S1": source("Net sales were $416,161 million in total for the segment."), "S2": source("Operating margin of the cloud business was 42.5% this year.")}
    v = lambda claim, ids, src=s: verification.verify_claim(claim, ids, src)
    assert v("Net sales were $416.2 billion.", ["[S1]"])["status"] == "supported"
    assert v("Net sales were $417.2 billion.", ["S1"])["status"] == "unsupported_number"
    r = v("The cloud business operating margin was 42.5%.", ["S1"])
    assert r["status"] == "supported" and r["ids"] == ["S1", "S2"] and r["repaired"]
    assert v("Nothing cited here at all.", ["S9"])["status"] == "invalid_citation"
    flat = {"S1": source("Title Q2-2025 Q3-2025\nTotal deliveries 384,122 497,099\nChart 0 100 200 300", 3, "table")}
    assert v("Total deliveries were 497,099 in Q3 2025.", ["S1"], flat)["status"] == "supported"
    assert v("Total deliveries were 384,122 in Q3 2025.", ["S1"], flat)["status"] == "unsupported_number"
    assert v("Total deliveries were 384,122 in Q2 2025.", ["S1"], flat)["status"] == "supported"


def test_plain_verdicts(spark):
    c = spark.createDataFrame([(1, "up 5% to $3.2 billion", ["S1"]), (2, "was 7%", ["S1"]), (3, "x", ["S8"])], "claim_id int, text string, ids array<string>")
    s = spark.createDataFrame([("S1", "5% growth to 3,204")], "id string, text string")
    assert {r.claim_id: r.status for r in verification.plain_verdicts(c, s).collect()} == {1: "supported", 2: "unsupported_number", 3: "invalid_citation"}


def test_confidence(spark):
    f = lambda *a: spark.range(1).select(context.confidence(*map(F.lit, a)).alias("c")).first().c
    assert f(2, 2, 0.7, False, False) == "high" and f(2, 2, 0.7, True, False) == "medium" and f(3, 1, 0.9, False, False) == "low" and f(0, 0, 0.0, False, False) == "none"


# --- evaluation ----------------------------------------------------------------------------------------------------


def test_ranking_metrics(spark):
    found = spark.createDataFrame([(1, 2, 0), (1, 3, 1), (1, 4, 0)], "query_id int, rank int, item int")
    sizes = spark.createDataFrame([(1, 2), (2, 1)], "query_id int, n_items int")
    r = {x.query_id: x for x in evaluation.ranking_metrics(found, sizes, (2, 5)).collect()}
    import math

    ideal = 1 + 1 / math.log2(3)
    assert r[1].mrr == 0.5 and r[1].recall_2 == 0.5 and r[1].recall_5 == 1.0 and abs(r[1].ndcg_5 - (1 / math.log2(3) + 0.5) / ideal) < 1e-9 and r[2].mrr == 0 and r[2].ndcg_5 == 0


def test_agreement_and_gate(spark):
    d = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (2.0, 3.0), (3.0, 4.0)], "a double, b double")
    assert abs(evaluation.spearman(d, "a", "b").first().spearman - 0.9486832980505138) < 1e-9
    assert evaluation.spearman(d.limit(2), "a", "b").first().spearman is None
    checks = spark.createDataFrame([("x", "m", 0.5, None), ("y", "m", None, 0.1), ("z", "none", 0.0, None)], "label string, metric string, min double, max double")
    g = {r.label: r.passed for r in evaluation.gate(checks, spark.createDataFrame([("m", 0.6)], "metric string, value double")).collect()}
    assert g == {"x": True, "y": False, "z": False}
    s = spark.range(1).select(evaluation.claim_scores(F.array(F.lit(True), F.lit(False)), F.array(F.lit(True), F.lit(True))).alias("s")).first().s
    assert s.precision == 0.5 and s.coverage == 1.0 and s.f == 0.67
    assert evaluation.markdown([{"a": 1.0, "b": None}], ["a", "b"]).splitlines()[-1] == "| 1.000 |  |"


def test_question_set_rules(spark):
    from tessera.schemas import GOLD

    e = lambda q: [("V", 2024, None, [3], [q])]
    f = (["V"], [2024], None, None)
    rows = [("q1", "numeric", "?", "a", f, e("net “revenue”"), None, None, None, None), ("q1", "odd", "?", "a", f, e("missing"), None, None, None, None), ("q2", "unanswerable", "?", "a", f, e("x"), None, None, None, None), ("q3", "follow_up", "?", "a", (["MA"], None, None, None), e("net"), None, None, None, None)]
    q = spark.createDataFrame(rows, GOLD)
    pages = spark.createDataFrame([("V", 2024, 3, 'the Net  "revenue" was')], "ticker string, fiscal_year int, page int, text string")
    got = {(r.id, r.problem) for r in evaluation.validate_questions(q, pages).collect()}
    assert ("q1", "duplicate id") in got and ("q1", "unknown category") in got and ("q1", "no quote on the page") in got and ("q3", "follow_up needs history and standalone_query") in got and ("q3", "evidence ticker outside filters") in got
    assert ("q3", "no quote on the page") not in got


def test_usage(spark):
    now = datetime.datetime(2025, 1, 3, tzinfo=datetime.timezone.utc).timestamp()
    c = spark.createDataFrame([(int(now - 90_000), "ollama", "m1", 10, 1, 5.0), (int(now - 10), "groq", "m2", 20, 2, 7.0)], "ts long, provider string, model string, prompt_tokens long, completion_tokens long, latency_ms double")
    r = {x["where"]: x for x in usage.hosted_local_total(c, F.lit(int(now))).collect()}
    assert r["total"].tokens == 33 and r["total"].tokens_24h == 22 and r["local"].calls_24h == 0
    days = usage.by_day(c, F.lit("2025-01-01").cast("date"), F.lit("2025-01-03").cast("date")).collect()
    assert len(days) == 6 and sum(d.tokens for d in days) == 33
    kinds = spark.createDataFrame([('{"answer": 1}',), ('{"correctness": 1}',), ("no json",), ("[1]",)], "t string").select(usage.call_kind(F.col("t")).alias("k")).collect()
    assert [k.k for k in kinds] == ["Answer", "Judge", "Other", "Other"]
    assert usage.series_of(c, 1).where("series = 'Other'").count() == 2
