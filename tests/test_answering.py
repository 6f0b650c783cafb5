"""Ingestion to answers on fakes, and the model chain."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import answering, ingestion, retrieval
from tessera.operators.filters import RELEASE, SearchFilters
from tessera.schemas import CHUNK
from tessera.sources import models

PARA = "Data center revenue grew to ${n} million in the year on strong demand for accelerated computing. "


@pytest.fixture(scope="module")
def chunks(spark, tmp_path_factory):
    annual = "<body><p><b>Item 1. Business</b></p><p>We design chips.</p><p><b>Item 7. Management's Discussion</b></p><p>" + PARA.replace("${n}", "$47,525") * 3 + "</p><p>12</p></body>"
    release = "<body><p><b>Highlights</b></p><p>" + PARA.replace("${n}", "$30,771") * 2 + "</p><table><tr><td></td><td>Q3-2025</td><td>Q2-2025</td></tr><tr><td>Revenue</td><td>35,082</td><td>30,040</td></tr></table></body>"
    meta = "ticker string, company string, fiscal_year int, form string, filing_date string, period_end string, source_url string, fiscal_quarter int, html string"
    a = ingestion.annual_chunks(spark.createDataFrame([("NVDA", "NVIDIA", 2024, "10-K", "2024-02-21", "2024-01-28", "u", None, annual)], meta))
    r = ingestion.release_chunks(spark.createDataFrame([("NVDA", "NVIDIA", 2025, RELEASE, "2024-11-20", "2024-10-27", "u", 3, release)], meta))
    c = a.unionByName(r)
    assert [f.split(" ")[0] for f in CHUNK.replace("map<string,string>", "map").split(", ")] == c.columns
    path = str(tmp_path_factory.mktemp("chunks") / "c")  # as in use: chunks are a table
    c.withColumn("id", F.col("chunk_id")).withColumn("embedding", retrieval.bag_of_words_embedder()(F.col("text"))).write.parquet(path)
    return spark.read.parquet(path)


def test_ingestion(chunks):
    rows = chunks.orderBy("chunk_id").collect()
    assert {r.section for r in rows} == {"Item 1", "Item 7", "Earnings release"}
    release = [r for r in rows if r.fiscal_quarter == 3]
    assert {r.page_start for r in release} == {0} and any(r.chunk_type == "table" for r in release) and release[0].doc_id == "NVDA-FY2025-Q3-EX-99.1"
    assert rows[0].chunk_id == "NVDA-FY2024-10-K-0000" and rows[0].context.startswith("NVIDIA (NVDA) Form 10-K, fiscal year 2024 | Item 1: Business")


def test_answers(spark, chunks, tmp_path):
    q = spark.createDataFrame([(1, "How much was data center revenue?")], "query_id int, text string")
    hits = answering.retrieve(retrieval.Retriever(chunks), q, SearchFilters(tickers=("NVDA",)), 4)
    answering.sources(hits, chunks).write.parquet(str(tmp_path / "p"))
    packed = spark.read.parquet(str(tmp_path / "p"))
    assert packed.count() and packed.first().rendered.startswith("[S")
    say = lambda text: lambda d: d.select("query_id", F.lit(text).alias("text"), F.lit(False).alias("abstained"))
    ids = {r.section: r.source_id for r in packed.collect()}
    good = answering.answer(q, packed, say(f"Data center revenue was $47.5 billion ({ids['Item 7']}).")).first()
    assert not good.abstained and "[NVDA FY2024 p." in good.answer and good.verified[0].status == "supported"
    bad = answering.answer(q, packed, say(f"Data center revenue was $99.9 billion ({ids['Item 7']}).")).first()
    assert bad.abstained and bad.answer == "" and bad.confidence == "none"
    assert answering.response_sources(packed, hits).count() == packed.count()
    assert answering.widened(SearchFilters(sections=("Item 7",)), True).sections is None and answering.widened(SearchFilters(), True) is None


class Fake:
    def __init__(self, name, *script):
        self.name, self.model, self.script, self.asked = name, "m", list(script), 0

    def complete(self, messages, schema):
        self.asked += 1
        step = self.script.pop(0)
        if isinstance(step, Exception):
            raise step
        return models.Reply(step, self.name, self.model)


def test_chain(tmp_path):
    waits = []
    a, b = Fake("a", models.Retryable("busy", 1.5), "not json"), Fake("b", '{"answer": 1}')
    valid = lambda t: t.startswith("{") and bool(json.loads(t))
    chain = models.Chain([a, b], models.Cache(tmp_path), waits.append)
    messages = [{"role": "user", "content": "x" * 40}]
    assert chain.generate(messages, {}, valid).provider == "b" and waits == [1.5]
    a.script, b.script = [models.Retryable("x")] * 3, []
    assert chain.generate(messages, {}, valid).cached and len(waits) == 3
    with pytest.raises(models.Failed):
        models.Chain([Fake("c", ValueError("no"))]).generate(messages, {})
    assert models.seconds("1m2.5s") == 62.5 and models.seconds("850ms") == 0.85 and models.seconds(None) is None
    assert models.estimated_tokens(messages) == 410


def test_strict_schema_and_budget():
    s = {"$defs": {"C": {"type": "object", "properties": {"t": {"type": "string", "default": ""}}}}, "type": "object", "properties": {"c": {"type": "array", "items": {"$ref": "#/$defs/C"}}}}
    out = models.strict(s)
    assert out["required"] == ["c"] and out["properties"]["c"]["items"]["additionalProperties"] is False and "$defs" not in out
    clock, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        clock[0] += s

    b = models.TokenBudget(100, lambda: clock[0], sleep)
    for _ in range(3):
        b.take(60)
    assert len(slept) == 2
