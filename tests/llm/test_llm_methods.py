"""Each method at its own work: against plain versions of its formulas, at default parameters, and at the limits of its
inputs."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import DOCS, documents
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import common, decontamination, lm, near_dedup, pii, token_counts, topk, toxicity
from tessera.llm.common import keep, membership, without

# --- shared pieces -------------------------------------------------------------------------------------------------


def test_membership_and_without(spark, monkeypatch):
    d = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"), F.lit("own").alias("doc"), F.lit("mine").alias("th"), F.lit("x").alias("__doc"))
    gone = common.identified(d).where("doc % 3 = 0").select("doc", "th")
    among = membership(gone, "doc", "th")
    rows = common.identified(d).select("doc", among(F.col("doc"), F.col("th")).alias("maybe")).collect()
    assert all(r.maybe for r in rows if r.doc % 3 == 0) and sum(r.maybe for r in rows if r.doc % 3) < 500
    want = {i for i in range(20_000) if i % 3}
    small = without(d, gone)
    monkeypatch.setattr(common, "broadcast_if_small", lambda df, rows=0: (df.hint("merge"), False))
    for out in (small, without(d, gone)):
        got = out.collect()
        assert {r.doc_id for r in got} == want and out.columns == d.columns and {(r.doc, r.th) for r in got} == {("own", "mine")}


def test_shared_dir_must_be_set_on_a_cluster(spark):
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)  # noqa: N815

    class Session:
        conf = {}
        sparkContext = Context()  # noqa: N815

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


def test_columns_of_any_name(spark):
    rows = [(i, f"w{i} some ordinary words number {i} that stand here", "mine") for i in range(30)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, __th string").withColumns({c: F.lit("own") for c in ("__doc", "__toxicity", "whole", "maybe", "doc", "th", "score", "kept", "smallest")})
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(30)], "doc_id bigint, quality int, toxic int")
    bench = spark.createDataFrame([(1, "an item that none of them holds in any form")], "item_id bigint, text string")
    for out in (toxicity.accepted(d, labels, reject=2.0), near_dedup.kept_documents(d), decontamination.clean_documents(d, bench)):
        assert out.columns == d.columns
        assert {(r["__th"], r["__doc"], r["__toxicity"], r["whole"], r["doc"]) for r in out.collect()} == {("mine", "own", "own", "own", "own")}


# --- token counts --------------------------------------------------------------------------------------------------


def test_long_white_space(spark):
    with open(token_counts.TOKENIZER, "rb") as f:
        encoding = token_counts._encoder(f.read(), token_counts.PATTERN)
    rng = random.Random(1)
    parts = ["a", "bc ", " ", "\n", "é", "1", "!", " " * 999, " " * 1000, " " * 3000, "\n" * 1200, "\u3000" * 1100, " \n" * 700, "\t" * 1000 + "x"]
    for _ in range(100):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 10)))
        assert token_counts.n_tokens(encoding, t) == len(encoding.encode_ordinary(t))
    texts = [" " * 1_000_000, " " * 3_000_000 + "x", "\n" * 1_000_000, "a" * 1_000_000]
    got = token_counts.with_length(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert [r.n_tokens for r in got] == [1_000_000, 3_000_000, 500_000, 250_000]


# --- personal data -------------------------------------------------------------------------------------------------


def test_terms_at_default_parameters(spark):
    rng = random.Random(3)
    prose = lambda n: " ".join(f"wo{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}rd" for _ in range(n))
    rows = [(i, prose(30)) for i in range(400)]
    rows += [(1000 + i, f"{prose(10)} treasurer Quillfeather writes from ann@corp.example.org to {prose(10)}") for i in range(3)]
    rows += [(2000, "Quillfeather again"), (2001, "nothing"), (2002, "quillfeather" * 2)]
    got = {r.doc_id: r for r in pii.report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all("term:" in got[i].spans and got[i].n_email == 1 for i in (1000, 1001, 1002))
    assert got[2000].spans == "term:0:12" and got[2001].spans == "" and got[2002].spans == "" and got[0].spans == ""


def test_many_spans(spark):
    n = 3_000
    t = "a.b@x.org, " * n
    r = pii.report(spark.createDataFrame([(1, t)], "doc_id bigint, text string")).first()
    assert r.n_email == n and r.spans == ",".join(f"email:{11 * i}:{11 * i + 9}" for i in range(n))


# --- decontamination -----------------------------------------------------------------------------------------------


def test_copies_in_any_case_and_broken_lines(spark):
    item = "A train leaves the old station at 7 and covers 120 km in 3 hours before Alice boards it with 7 heavy bags and a dog"
    forms = [item, item.upper(), item.lower(), item.title(), item.replace(" ", "\n"), item.replace(" ", " \t "), f"x {item}. y " * 300]
    d = spark.createDataFrame(list(enumerate(forms)), "doc_id bigint, text string")
    b = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    assert {r.doc_id for r in decontamination.report(d, b).collect()} == set(range(len(forms)))
    assert decontamination.clean_documents(d, b).count() == 0


def test_joins_without_broadcast(spark, monkeypatch):
    rows = documents()
    d = spark.createDataFrame(rows, DOCS)
    b = spark.createDataFrame([(i, rows[2 * i][1]) for i in range(4)], "item_id bigint, text string")
    found = lambda: sorted((r.doc_id, r.item_id) for r in decontamination.report(d, b).collect())
    comps = lambda: sorted(((r.doc_id, r.component_id) for r in near_dedup.report(d).collect()), key=str)
    want = found(), comps()
    no = lambda df, rows=0: (df.hint("merge"), False)
    monkeypatch.setattr(decontamination, "broadcast_if_small", no)
    monkeypatch.setattr(near_dedup, "broadcast_if_small", no)
    assert (found(), comps()) == want


# --- toxicity ------------------------------------------------------------------------------------------------------


def plain_ratio(train, text, discount=toxicity.DISCOUNT):
    """The formulas of the module word by word, over strings of symbols."""

    def symbols(t):
        out = [0, 0]
        for c in bytes(toxicity._CODES[np.frombuffer(t.encode(), np.uint8)]) + b"\0":
            if c or out[-1] or len(out) < 2:
                out.append(c)
        return tuple(out)

    grams = lambda t: [s[i : i + 4] for s in [symbols(t)] for i in range(len(s) - 3)]
    n4 = [Counter(g for t, y in train if y == c for g in grams(t)) for c in (0, 1)]
    n3 = [Counter() for _ in n4]
    for c in (0, 1):
        for g, k in n4[c].items():
            n3[c][g[1:]] += k
    types = Counter(g[1:] for g in {*n3[0], *n3[1]})

    def shared(x):
        return types[x] / sum(k for g, k in types.items() if g[0] == x[0])

    def p(n, c, g, lower):
        own = {h: k for h, k in n[c].items() if h[:-1] == g[:-1]}
        mass = sum(own.values())
        return lower if not mass else (max(own.get(g, 0) - discount, 0) + sum(min(k, discount) for k in own.values()) * lower) / mass

    total = 0.0
    for g in grams(text):
        t = g[1:]
        if not (n3[0][t] or n3[1][t]):
            continue
        p3 = [p(n3, c, t, shared(t[1:])) for c in (0, 1)]
        p4 = [p(n4, c, g, p3[c]) for c in (0, 1)] if n4[0][g] or n4[1][g] else p3
        total += math.log(p4[1] / p4[0])
    return total / math.sqrt(max(len(grams(text)), 1))


def test_kneser_ney_against_its_formulas(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdé漢") for _ in range(rng.randrange(1, 6)))
    train = [(" ".join(word() for _ in range(20)) + rng.choice(["", " zonk!", " blarg?"]), i % 2) for i in range(12)]
    tests = [train[0][0], "zonk blarg", "", "   ", "ABC, abc... abc", "漢漢é" * 10, "never seen qqq"]
    c = toxicity.counts(spark.createDataFrame([(y, t) for t, y in train], "y int, text string"))
    import pyarrow as pa

    got = toxicity.Model(c.grams, c.n.sum(axis=1)).z(pa.array(tests))
    assert np.allclose(got, [plain_ratio(train, t) for t in tests], atol=1e-4)


def test_every_byte_is_scored(monkeypatch):
    import pyarrow as pa

    c = toxicity.Counts(np.array([1]), np.ones((1, toxicity.PARTS, 2), np.int64))
    m = toxicity.Model(c.grams, c.n.sum(axis=1))
    m.low[:], m.high[:] = int(toxicity.SCALE), int(toxicity.SCALE)
    texts = ["x" * 5_000, "漢" * 2_000, "a" * 40 + " b" * 30, "", "q"]
    one = m.z(pa.array(texts))
    assert np.allclose(one[:2], [math.sqrt(5_001), math.sqrt(6_001)], atol=0.02)
    monkeypatch.setattr(toxicity, "PIECE", 64)
    assert np.array_equal(m.z(pa.array(texts)), one)


# --- near duplicates -----------------------------------------------------------------------------------------------


def test_near_dedup_against_all_pairs(spark):
    rng = random.Random(6)
    base = [[f"w{rng.randrange(5000)}" for _ in range(rng.randrange(30, 200))] for _ in range(25)]
    rows = []
    for i, w in enumerate(base):
        for k in range(6):
            v = list(w)
            for _ in range(k):
                v[rng.randrange(len(v))] = f"x{rng.randrange(10**6)}"
            rows.append((10 * i + k, " ".join(v)))
    rng.shuffle(rows)
    sets = {d: {tuple(w[j : j + 5]) for w in [t.split()] for j in range(len(w) - 4)} for d, t in rows}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = {r.doc_id: r.component_id for r in near_dedup.report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {d: root(d) for d in sets}


# --- search --------------------------------------------------------------------------------------------------------


def test_maxscore_prunes():
    rng = np.random.default_rng(0)
    w = np.floor(256 * rng.normal(size=(3_000, 32)) / np.sqrt(np.arange(1, 33))).astype(np.int64)
    seed, rest = topk.Shard(np.arange(topk.SEED), w[: topk.SEED]), topk.Shard(np.arange(topk.SEED, 3_000), w[topk.SEED :])
    for q in range(0, 3_000, 300):
        best = seed.search(q, w[q], 5, None)
        best = sorted(best + rest.search(q, w[q], 5, best[4][0]), key=lambda x: (-x[0], x[1]))[:5]
        assert best == sorted(((int(w[i] @ w[q]), i) for i in range(3_000) if i != q), key=lambda x: (-x[0], x[1]))[:5]
    assert rest.probed < 0.8 * rest.held


@pytest.mark.parametrize("x", [3e15, 1e300])
def test_scores_beyond_64_bits_are_errors(spark, x):
    d = spark.createDataFrame([(0, [x]), (1, [x])], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="64"):
        topk.report(d).collect()


# --- language model ------------------------------------------------------------------------------------------------


def plain_scores(rows):
    """Deleted interpolation over tokens, one by one, with the same histogram cells for EM."""
    toks = [[*(r[1] or "").encode().lower().split(), "END"] for r in rows]
    train = [zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 != 1 for r in rows]
    pairs = [[(t[i - 1] if i else "START", t[i]) for i in range(len(t))] for t in toks]
    c1 = Counter(w for t, y in zip(toks, train) if y for w in t)
    c2 = Counter(p for ps, y in zip(pairs, train) if y for p in ps)
    ch = Counter(c1)
    ch["START"] = sum(train)
    n, v = sum(c1.values()), len(c1)
    bucket = lambda k: min(math.ceil(math.log2(k + 1)), lm.BUCKETS - 1)
    snap = lambda p: 0.0 if p <= 0 else 2 ** -(round(-math.log2(p) * lm.PER_UNIT) / lm.PER_UNIT)
    held = {}
    for ps, y in zip(pairs, train):
        for h, w in ps if y else ():
            k = ch[h] - 1
            held.setdefault(bucket(k), []).append((snap((c2[h, w] - 1) / k if k else 0.0), snap((c1[w] - 1) / max(n - 1, 1)), 1 / (v + 1)))
    lam, last = {}, [1 / 3] * 3
    for b in range(lm.BUCKETS):
        if b in held:
            last = [1 / 3] * 3
            for _ in range(60):
                sums = [0.0] * 3
                for p in held[b]:
                    total = sum(x * y for x, y in zip(last, p))
                    sums = [s + x * y / total for s, x, y in zip(sums, last, p)]
                last = [s / len(held[b]) for s in sums]
            last = [max(x, 1e-6) for x in last]
            last = [x / sum(last) for x in last]
        lam[b] = last
    out = []
    for r, ps in zip(rows, pairs):
        score = 0.0
        for h, w in ps:
            l2, l1, l0 = lam[bucket(ch[h])]
            score += math.log10(l2 * (c2[h, w] / ch[h] if ch[h] else 0) + l1 * c1[w] / n + l0 / (v + 1))
        out.append((r[0], score))
    return out


@pytest.mark.parametrize("parts", [None, 1, 5])
def test_lm_scores_against_plain_em(spark, parts):
    rows = [r for r in documents(2) if len(r[1] or "") < 5_000]
    got = sorted(((r.doc_id, r.score) for r in lm.report(spark.createDataFrame(rows, DOCS).repartition(3), parts=parts, block_tokens=400).collect()), key=str)
    want = sorted(plain_scores(rows), key=str)
    assert [d for d, _ in got] == [d for d, _ in want]
    assert all(math.isclose(a, b, rel_tol=1e-6) for (_, a), (_, b) in zip(got, want))


# --- pipeline ------------------------------------------------------------------------------------------------------


def test_pipeline_of_empty_tables(spark, tmp_path):
    for name, schema in {"documents": DOCS, "labels": "doc_id bigint, quality int, toxic int", "benchmark": "item_id bigint, text string"}.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_pass_other_columns_on(spark, tmp_path):
    spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i in range(40)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "an item that no document of these has in it")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d = spark.createDataFrame(documents(), DOCS).withColumns({c: F.lit("own") for c in ("doc", "th", "score", "maybe", "whole", "new", "key", "src")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        d = keep(stage(spark, d, str(tmp_path)))
        assert {(r.doc, r.th, r.score, r.maybe, r.whole, r.new) for r in d.collect()} <= {("own",) * 6}


def test_small_tables_go_to_few_files(spark):
    cores = spark.sparkContext.defaultParallelism
    df = spark.range(0, 5000, 1, 10 * cores)
    kept = common.keep(df, "few", few=True)
    assert len(kept.inputFiles()) <= cores
    assert sorted(r.id for r in kept.collect()) == list(range(5000))
    assert common.keep(df.limit(0), "none", few=True).count() == 0


def test_pii_writes_small_tables_to_few_files(spark, monkeypatch):
    files, keep = {}, common.keep

    def counted(df, name="t", **how):
        out = keep(df, name, **how)
        files[name] = len(out.inputFiles())
        return out

    monkeypatch.setattr(pii, "keep", counted)
    cores = spark.sparkContext.defaultParallelism
    texts = [f"{a} zanzibar mail x{i}@y.org {b}" for i in range(8 * cores) for a, b in (("on", "now"), ("by", "then"))]
    texts = [t.replace("zanzibar", "z" + "".join(chr(97 + int(c)) for c in str(i // 2)) + "q") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4 * cores)
    many = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": str(8 * cores)}
    before = {k: spark.conf.get(k) for k in many}
    try:
        for k, v in many.items():
            spark.conf.set(k, v)
        assert pii.report(docs).where("n_term > 0").count() == len(texts)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert max(files[n] for n in ("pairs", "flagged", "marked")) <= cores


def test_component_tables_go_to_few_files(spark, monkeypatch):
    files, keep = [], common.keep

    def counted(df, name="t", **how):
        out = keep(df, name, **how)
        files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(near_dedup, "keep", counted)
    cores = spark.sparkContext.defaultParallelism
    fp = lambda c: F.col(c).cast("string").cast("binary")
    ids = spark.range(0, 400, 1, 4)
    one = ids.select(fp("id").alias("fp"), F.struct(F.lit(False).alias("no_id"), F.col("id").alias("doc_id"), F.lit(0).cast("bigint").alias("th")).alias("first"))
    links = ids.where("id % 2 = 0").select(fp("id").alias("a"), F.expr("id + 1").cast("string").cast("binary").alias("b"))
    many = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": str(4 * cores)}
    before = {k: spark.conf.get(k) for k in many}
    try:
        for k, v in many.items():
            spark.conf.set(k, v)
        got = {int(r.node): r.comp.doc_id for r in near_dedup.components(links, one).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {i: i - i % 2 for i in range(400)}
    assert max(files) <= cores
