"""The pipeline stage by stage on a small table, each stage on what the one before kept."""

from helpers import DOCS, documents
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import near_dedup, queries
from tessera.llm.common import keep, shared_dir

BENCH = "w1 w2 w3 w4 w5 and a passage of the benchmark that no other document of this small table would hold by chance"


def test_stages_and_run(spark, tmp_path):
    rows = documents()
    words = [f"ord{i % 40} filler{i % 7} plain{i}" for i in range(80)]
    rows += [(5000 + i, f"{words[i]} some text about number{i} " + ("blarg gruft zonk" if i % 8 == 0 else "fine day before bench by good great zebra words that have no harm"), "en", "a", 10) for i in range(80)]
    rows += [(6000, f"before it {BENCH} and after it", "en", "b", 10)]
    labels = [(5000 + i, 1, int(i % 8 == 0)) for i in range(80)]
    sf = str(tmp_path)
    spark.createDataFrame(rows, DOCS).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, BENCH)], "item_id bigint, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    left = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        docs = keep(out, f"test-{i}")
        left[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "mixing"]
    assert not left["toxicity"] & {5000 + i for i in range(0, 80, 8)} and 5001 in left["toxicity"]
    assert left["line_dedup"] == left["toxicity"]
    assert all(not (i in left["near_dedup"] and 100 + i in left["near_dedup"]) for i in range(12)) and left["near_dedup"] <= left["line_dedup"]
    assert 6000 in left["near_dedup"] and 6000 not in left["decontamination"] and left["mixing"] == left["decontamination"]
    run = corpus_pipeline.run(spark, sf)
    assert sorted(map(str, run.collect())) == sorted(map(str, docs.collect()))


def test_near_copies_of_the_stages_threshold(spark):
    """Jaccard 0.82 is a near copy for the stage, not for op8; 0.78 for neither."""
    texts = {}
    for n, edits in ((1, 4), (2, 5)):
        w = [f"t{n}w{i}" for i in range(204)]
        other = [f"x{i}" if i in {20 + 40 * j for j in range(edits)} else v for i, v in enumerate(w)]
        texts |= {10 * n: " ".join(w), 10 * n + 1: " ".join(other)}
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in texts.items()], DOCS)
    ids = lambda d: {r.doc_id for r in d.collect()}
    assert ids(dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, "")) == {10, 20, 21}
    assert ids(near_dedup.kept_documents(docs)) == {10, 11, 20, 21}


def test_registered_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert set(queries.ORACLE) <= set(queries.QUERIES)


def test_shared_dir_is_the_sessions(spark):
    assert shared_dir(spark) and not shared_dir(spark).endswith("/")
    assert keep(spark.range(3).select(F.col("id"))).count() == 3
