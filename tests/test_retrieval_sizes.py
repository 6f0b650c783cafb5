"""Retrieval on odd inputs, and that what it moves follows its input."""

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import stemmer
from tessera.functions.text import tokens
from tessera.operators import nearest, retrieval


def plain_recall(vectors, queries, k, bucket, tables, seed):
    """The definition, pair by pair."""
    dim = len(next(iter(queries.values())))
    planes = np.random.default_rng(seed).normal(size=(tables, dim))

    def dot(a, b):
        s = 0.0
        for x, y in zip(a, b, strict=True):
            s += float(x) * float(y)
        return s

    hashes = lambda v: [np.floor(dot(v, p) / bucket) for p in planes]
    own = {i: hashes(v) for i, v in vectors.items()}
    out = {}
    for qid, q in queries.items():
        h = hashes(q)
        score = {i: dot(v, q) for i, v in vectors.items()}
        top = lambda ids: set(sorted(ids, key=lambda i: (-score[i], i))[:k])  # noqa: B023, E731
        exact = top(vectors)
        out[qid] = len(exact & top([i for i in vectors if any(a == b for a, b in zip(own[i], h, strict=True))])) / len(exact)
    return out


def vectors_with_copies(n=700, dim=6):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(n, dim)).astype(np.float32)
    v[100:160] = v[7]
    v[300:303] = v[8]
    return {i: [float(x) for x in row] for i, row in enumerate(v)}


def frame(spark, rows, name="id"):
    return spark.createDataFrame(list(rows.items()), f"{name} bigint, embedding array<float>")


def test_ann_recall_equals_its_definition(spark, monkeypatch):
    monkeypatch.setattr(nearest, "SHARD", 64)
    monkeypatch.setattr(nearest, "QUERY_STEP", 5)
    rows = vectors_with_copies()
    asked = {i: v for i, v in rows.items() if i % 50 == 0 or i == 7}
    v, q = frame(spark, rows).repartition(3), frame(spark, asked, "query_id")
    for bucket, tables in ((0.02, 2), (0.3, 3)):
        want = plain_recall(rows, asked, 10, bucket, tables, 7)
        assert 0 < sum(want.values()) / len(want) < 1
        assert {r.query_id: r.recall for r in retrieval.ann_recall(v, q, 10, bucket, tables).collect()} == want
        assert {r.query_id: r.recall for r in nearest.recall(v, q, 10, bucket, tables, 7, query_block=4).collect()} == want


def test_ann_recall_makes_no_row_of_a_pair(spark):
    """Neither vectors repeated by table nor pairs are shuffled."""
    rows = vectors_with_copies()
    plan = retrieval.ann_recall(frame(spark, rows), frame(spark, {0: rows[0]}, "query_id"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Deduplicate" not in plan and "Join Inner" not in plan


def test_ann_recall_of_odd_vectors(spark):
    rows = {0: None, 1: [1.0, 0.0], 2: [1.0], 3: [1.0, None], 4: [float("nan"), 1.0], 5: [0.9, 0.1]}
    got = {r.query_id: r.recall for r in retrieval.ann_recall(frame(spark, rows), frame(spark, {k: rows[k] for k in (1, 0)}, "query_id")).collect()}
    assert got == {1: 1.0, 0: None}
    none = frame(spark, {}).where("id > 0")
    assert retrieval.ann_recall(none, none.withColumnRenamed("id", "query_id")).count() == 0


def test_bm25_scores_of_copies_are_equal(spark):
    """However their terms arrive; so ties go to the smaller id."""
    words = "alpha beta gamma delta epsilon".split()
    texts = [" ".join(w for j, w in enumerate(words) for _ in range((i >> j & 1) * (1 + (i + j) % 3))) + " pad" * (i % 7) for i in range(1, 32)]
    docs = [(1000 * c + i, t) for c in range(40) for i, t in enumerate(texts)]
    d = spark.createDataFrame(docs, "id bigint, text string").repartition(16)
    q = spark.createDataFrame([(1, " ".join(words))], "query_id int, text string")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        scores = {r.id: r.score for r in retrieval.bm25(d, q, stemmed=False).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(scores) == len(docs)
    assert all(scores[1000 * c + i] == scores[i] for c in range(40) for i in range(len(texts)))


def test_bm25_stems_each_distinct_word_once(spark):
    """Python never sees a document's tokens, only distinct words that begin as a term does; scores are those of stemmed tokens."""
    texts = {1: "Running runs run, ran; runner's 1,200 relational", 2: "relate related relations dying die", 3: None, 4: "", 5: "skies sky generously runs runs"}
    d = spark.createDataFrame(list(texts.items()), "id bigint, text string")
    q = spark.createDataFrame([(1, "runs relating sky 1,200 die")], "query_id int, text string")
    scored = retrieval.bm25(d, q)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "_stem_each(word" in plan
    below = plan[plan.index("_stem_each(word") :].split("\n")[1:]
    assert next(x for x in below if "Aggregate" in x or "Generate" in x).count("Aggregate")  # after the distinct
    ready = d.select("id", F.array_join(tokens(F.col("text")), " ").alias("text"))
    ready_q = q.select("query_id", F.array_join(tokens(F.col("text")), " ").alias("text"))
    want = {r.id: round(r.score, 12) for r in retrieval.bm25(ready, ready_q, stemmed=False).collect()}
    assert {r.id: round(r.score, 12) for r in scored.collect()} == want and len(want) == 3


def test_no_stem_changes_the_first_letter():
    rng = np.random.default_rng(1)
    ends = ["", "s", "ies", "ied", "ing", "ed", "eed", "ly", "ingly", "ational", "fulness", "ative", "y", "e", "al", "ion"]
    words = {"".join(rng.choice(list("aeiouybcdlst"), n)) + end for n in (1, 2, 3, 4) for end in ends for _ in range(60)} | set(stemmer.EXCEPTIONS)
    assert all(stemmer.stem(w)[:1] == w[0] for w in words)


def test_modes_pass_over_the_chunks_once_for_each_ranking(spark):
    """All four modes read two kept rankings, and no text is shuffled for the reranking."""
    rows = [(i, f"alpha {'beta ' * (i % 4)}", "A", "en", 2022, None, "10-K", "text", [float(i % 3), 1.0]) for i in range(60)]
    c = spark.createDataFrame(rows, "id bigint, text string, ticker string, section string, fiscal_year int, fiscal_quarter int, form string, chunk_type string, embedding array<float>")
    r = retrieval.Retriever(c, lambda t: F.array(F.lit(1.0), F.lit(0.5)).cast("array<float>"), lambda q, p: -F.length(p).cast("double"))
    q = spark.createDataFrame([(1, "beta")], "query_id int, text string")
    found = r.search_modes(q, None, 5)
    for mode, hits in found.items():
        plan = hits._jdf.queryExecution().withCachedData().toString()
        assert "InMemoryRelation" in plan and "regexp_extract_all" not in plan.replace("InMemoryRelation", "\nInMemoryRelation").split("\nInMemoryRelation")[0]
        want = [(x.id, x.rank, x.score, x.stages) for x in r.search(q, None, 5, mode).orderBy("rank").collect()]
        assert [(x.id, x.rank, x.score, x.stages) for x in hits.orderBy("rank").collect()] == want and len(want) == 5
