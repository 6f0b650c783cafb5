"""Sources against small files, streams driven to completion."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from tessera import schemas
from tessera.operators import usage
from tessera.sources import files, jdbc
from tessera.streaming import traces as streams


def jsonl(path, rows):
    path.write_text("\n".join(json.dumps(r) for r in rows) + "\n")
    return str(path)


def test_chunk_corpus(spark, tmp_path):
    a = jsonl(tmp_path / "a.jsonl", [{"chunk_id": "1", "fiscal_year": 2024, "metadata": {"series": "true"}}])
    b = jsonl(tmp_path / "b.jsonl", [{"chunk_id": "2", "fiscal_quarter": 3}])
    c = files.chunks(spark, a, b).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.fiscal_quarter, r.part_no) for r in c] == [("1", None, 0), ("2", 3, 1)]
    assert files.strict_chunks(spark, a).count() == 1
    with pytest.raises(ValueError, match="odd"):
        files.strict_chunks(spark, jsonl(tmp_path / "c.jsonl", [{"chunk_id": "1", "odd": 1}]))


def test_manifest_upsert(spark, tmp_path):
    old = tmp_path / "m.json"
    old.write_text(json.dumps([{"ticker": "V", "form": "10-K", "fiscal_year": 2023, "filing_date": "a"}, {"ticker": "A", "form": "10-K", "fiscal_year": 2023, "filing_date": "b"}]))
    new = spark.createDataFrame([{"ticker": "V", "form": "10-K", "fiscal_year": 2023, "filing_date": "c"}], schemas.FILING)
    files.update_manifest(spark, str(old), str(tmp_path / "out"), new)
    got = {r.ticker: r.filing_date for r in spark.read.schema(schemas.FILING).json(str(tmp_path / "out")).collect()}
    assert got == {"A": "b", "V": "c"}


def test_traces_and_ledger(spark, tmp_path):
    t = {"id": "t1", "start": 100.0, "end": 103.0, "spans": [{"name": "retrieve", "start": 100.0, "end": 101.0}, {"name": "retrieve", "start": 101.0, "end": 101.5}], "generations": [{"name": "A", "model": "m", "cached": True, "prompt_tokens": 5, "completion_tokens": 1, "provider_ms": 9.0}]}
    (tmp_path / "t.jsonl").write_text(json.dumps(t) + '\n{"id": "half')
    d = files.traces(spark, str(tmp_path / "t.jsonl"))
    assert {r.node: r.p50 for r in usage.trace_summary(d).collect()} == {"retrieve": 1500.0, "total": 3000.0}
    assert usage.generation_usage(d).first().prompt_tokens == 5 and files.recent_turns(spark, str(tmp_path / "t.jsonl")).count() == 1
    folder = tmp_path / "calls"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps({"provider": "p", "model": "m", "text": '{"answer": 1}', "usage": {"prompt_tokens": 1, "completion_tokens": 2}, "latency_ms": 3.0}))
    (folder / "b.json").write_text('{"provider": "p", ')
    os.utime(folder / "a.json", (1000, 1000))
    r = files.call_ledger(spark, str(folder)).collect()
    assert len(r) == 1 and r[0].ts == 1000 and r[0].completion_tokens == 2
    (tmp_path / "log").write_text("\n".join(map(str, range(500))))
    assert [x.value for x in files.log_tail(spark, str(tmp_path / "log"), 3).collect()] == ["497", "498", "499"]


def test_store_rows(spark):
    jdbc.check_rows(spark.range(3).withColumnRenamed("id", "row"))
    with pytest.raises(ValueError):
        jdbc.check_rows(spark.range(1, 3).withColumnRenamed("id", "row"))
    assert "vector(8)" in jdbc.ddl(dim=8)[0] and len(jdbc.ddl(index="hnsw")) == 8
    names = [c.split()[0] for c in jdbc.COLUMNS.split(", ")]
    assert names == [c.split()[0] for c in schemas.CHUNK.replace("map<string,string>", "map").split(", ")]


def run(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    assert q.awaitTermination(60)


def test_trace_windows(spark, tmp_path):
    rows = [{"id": str(i), "start": 1000.0 + 200 * i, "end": 1001.0, "spans": [{"name": "n", "start": 0.0, "end": 0.5}]} for i in range(20)]
    jsonl(tmp_path / "x.jsonl", rows)
    s = spark.readStream.schema(schemas.TRACE).json(str(tmp_path))
    run(streams.node_windows(s), "windows", "complete")
    assert spark.sql("SELECT sum(n) AS n FROM windows").first().n == 20 and spark.sql("SELECT max(max_ms) AS m FROM windows").first().m == 500.0


def test_conversation_memory(spark, tmp_path):
    jsonl(tmp_path / "x.jsonl", [{"thread_id": "a", "question": f"q{i}", "answer": "x"} for i in range(9)])
    s = spark.readStream.schema("thread_id string, question string, answer string").json(str(tmp_path))
    # timeouts would keep batches without data coming
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", False)
    run(streams.conversation_memory(s, max_turns=4), "memory_rows", "update")
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert spark.table("memory_rows").orderBy(F.desc("n")).first().n == 4


def test_embeddings_of_new_chunks(spark, tmp_path):
    source, cache = tmp_path / "in", str(tmp_path / "cache")
    source.mkdir()
    embed = lambda c: F.array(F.length(c).cast("float"))
    jsonl(source / "a.jsonl", [{"chunk_id": "1", "text": "one"}])
    for step in (1, 2):
        s = spark.readStream.schema("chunk_id string, text string").json(str(source))
        q = streams.keep_embeddings(s, cache, embed).option("checkpointLocation", str(tmp_path / f"cp{step}")).start()
        q.processAllAvailable()
        q.stop()
        time.sleep(0.1)
        jsonl(source / "b.jsonl", [{"chunk_id": "2", "text": "twenty"}])
    assert {r.chunk_id: r.embedding[0] for r in spark.read.parquet(cache).collect()} == {"1": 3.0, "2": 6.0}
    assert spark.read.parquet(cache).count() == 2
