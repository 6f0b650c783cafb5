"""Explicit schemas. Sources are always read with one of these, never inferred."""

from __future__ import annotations

CHUNK = (
    "chunk_id string, doc_id string, ticker string, company string, fiscal_year int, form string, filing_date string, period_end string, "
    "part string, section string, section_title string, subsection string, page_start int, page_end int, page_label_start string, "
    "page_label_end string, chunk_type string, context string, text string, token_count int, source_url string, fiscal_quarter int, "
    "metadata map<string,string>"
)
BLOCK = "pos int, kind string, text string, page int, rows array<array<string>>, header_rows int"
PAGE = "index int, label string, text string"
FILING = (
    "ticker string, company string, cik int, form string, fiscal_year int, accession_number string, filing_date string, report_date string, "
    "primary_document string, source_url string, filing_index_url string, local_path string, size_bytes long, fiscal_quarter int"
)
FACT = "start string, end string, val double, accn string, fy int, fp string, form string, filed string, frame string"
COMPANY_FACTS = f"cik int, entityName string, facts map<string, map<string, struct<label: string, units: map<string, array<struct<{FACT.replace(' ', ': ').replace(',: ', ', ')}>>>>>>"
GOLD = (
    "id string, category string, question string, reference_answer string, "
    "filters struct<tickers: array<string>, fiscal_years: array<int>, fiscal_quarters: array<int>, forms: array<string>>, "
    "evidence array<struct<ticker: string, fiscal_year: int, fiscal_quarter: int, pages: array<int>, quotes: array<string>>>, "
    "tags array<string>, history array<string>, standalone_query string, notes string"
)
SPAN = "name: string, start: double, end: double"
GENERATION = "name: string, provider: string, model: string, cached: boolean, prompt_tokens: long, completion_tokens: long, provider_ms: double, start: double, end: double"
TRACE = f"id string, name string, start double, end double, input string, spans array<struct<{SPAN}>>, generations array<struct<{GENERATION}>>, metadata map<string,string>"
CALL = "provider string, model string, text string, usage struct<prompt_tokens: long, completion_tokens: long>, latency_ms double"
LABEL = "id string, correctness string, note string"
GATE = "checks array<struct<label: string, metric: string, min: double, max: double>>"
EMBEDDING = "chunk_id string, content_hash string, embedding array<float>"
