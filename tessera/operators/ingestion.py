"""Filings and releases from HTML to the chunk table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import word_count
from tessera.operators import chunking, html_blocks, sections
from tessera.operators.filings import document_id

META = ("ticker", "company", "fiscal_year", "form", "filing_date", "period_end", "source_url", "fiscal_quarter")


def with_document_id(filings: DataFrame) -> DataFrame:
    return filings.withColumn("doc_id", document_id(F.col("ticker"), F.col("fiscal_year"), F.col("fiscal_quarter")))


def _finish(chunks: DataFrame, filings: DataFrame, labels: DataFrame | None, limits: chunking.Limits) -> DataFrame:
    """The columns of the chunk table."""
    c = chunks.join(filings.select("doc_id", *META), "doc_id")
    if labels is None:  # a release has no printed pages; 0 can't be taken for a filing's page
        c = c.withColumns({"page_start": F.lit(0), "page_end": F.lit(0), "page_label_start": F.lit(None).cast("string"), "page_label_end": F.lit(None).cast("string")})
    else:
        at = lambda end: labels.select("doc_id", F.col("page").alias(f"page_{end}"), F.col("label").alias(f"page_label_{end}"))
        c = c.join(at("start"), ["doc_id", "page_start"], "left").join(at("end"), ["doc_id", "page_end"], "left")
    c = c.withColumn("context", chunking.context_header(limits)).withColumn("chunk_id", F.format_string("%s-%04d", "doc_id", "chunk_no"))
    c = c.withColumn("token_count", word_count(F.concat("context", F.lit("\n\n"), "text")))
    return c.select("chunk_id", "doc_id", *META[:-2], "part", "section", "section_title", "subsection", "page_start", "page_end", "page_label_start", "page_label_end", "chunk_type", "context", "text", "token_count", "source_url", "fiscal_quarter", F.create_map().cast("map<string,string>").alias("metadata"))


def annual_chunks(filings: DataFrame, limits: chunking.Limits = chunking.Limits()) -> DataFrame:
    """Annual filings (META and html): blocks, furniture out, items, packed."""
    f = with_document_id(filings)
    b = html_blocks.with_furniture(html_blocks.blocks(f))
    labels = html_blocks.validated_labels(html_blocks.page_labels(b))
    return _finish(chunking.chunk(sections.assign(b), limits=limits), f, labels, limits)


def release_chunks(filings: DataFrame, limits: chunking.Limits = chunking.Limits()) -> DataFrame:
    """Releases: slide decks are restored first, other releases go as they are."""
    f = with_document_id(filings)
    b = html_blocks.with_furniture(html_blocks.blocks(f))
    decks = chunking.is_deck(b)
    plain = b.join(decks.where("NOT deck").select("doc_id"), "doc_id", "left_semi")
    deck = chunking.slides(b.join(decks.where("deck").select("doc_id"), "doc_id", "left_semi"))
    cols = ["doc_id", "pos", "kind", "text", "page", "rows", "header_rows", "furniture"]
    both = plain.select(*cols).unionByName(deck.select(*cols))
    return _finish(chunking.chunk(sections.assign_release(both), limits=limits), f, None, limits)


def pages(filings: DataFrame) -> DataFrame:
    """doc_id, page, label and text of annual filings."""
    return html_blocks.pages_of(html_blocks.with_furniture(html_blocks.blocks(with_document_id(filings))))
