"""Lexical, dense and fused retrieval. A ranking is a DataFrame (query_id, id, score, rank); ties go to the smaller id."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import content_hash, raw_tokens, stemmed_token, tokens
from tessera.operators.filters import SearchFilters

K1, B = 1.2, 0.75
RRF_K = 60
CANDIDATES = 50
RERANKED = 30
MODES = ("bm25", "dense", "hybrid", "hybrid_rerank")
EMBED_DIM = 64
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "


def ranked(scored: DataFrame, k: int | None = None, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """Add rank by score, then id, within ``by``; cut at k (Spark cuts before the shuffle already)."""
    out = scored.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), "id")))
    return out.where(F.col("rank") <= k) if k else out


def fixed_sum(c: Column) -> Column:
    """The sum of a group's few numbers in the order of their size, so that equal numbers have equal sums however rows arrive."""
    return F.aggregate(F.array_sort(F.collect_list(c)), F.lit(0.0), lambda s, x: s + x)


def wanted_words(toks: DataFrame, terms: DataFrame, stemmed: bool) -> DataFrame:
    """(word, term): the words of ``toks`` (toks) whose search token is among ``terms`` (term). Each distinct word is
    stemmed once, not each occurrence, and only if it begins as a term does, as no rule of the stemmer changes the first letter."""
    if not stemmed:
        return terms.select(F.col("term").alias("word"), "term")
    initials = F.broadcast(terms.select(F.left("term", F.lit(1)).alias("initial")).distinct())
    found = toks.select(F.explode("toks").alias("word")).withColumn("initial", F.left("word", F.lit(1)))
    words = found.join(initials, "initial", "left_semi").select("word").distinct()
    return words.select("word", stemmed_token(F.col("word")).alias("term")).join(F.broadcast(terms), "term", "left_semi")


def bm25(docs: DataFrame, queries: DataFrame, partition: Sequence[str] = (), k1: float = K1, b: float = B, stemmed: bool = True) -> DataFrame:
    """Scores (query_id, *partition, id, score) of ``docs`` (id, text, *partition) for ``queries`` (query_id, text).

    Counts, lengths and document frequencies are those of the whole partition, so filters belong after this. The
    queries' terms meet a document's tokens where these are made, so only matching terms are shuffled. A term that
    a query repeats counts that often; documents without a matching term get no row. Documents of equal counts have
    equal scores to the last digit."""
    part = list(partition)
    d = docs.select("id", *part, raw_tokens(F.col("text")).alias("toks")).withColumn("dl", F.size("toks"))
    q = queries.select("query_id", F.explode(tokens(F.col("text"), stemmed)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf"))
    words = F.broadcast(wanted_words(d, q.select("term").distinct(), stemmed))  # the words of the stated queries
    stats = d.groupBy(*part).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    tf = d.select("id", *part, "dl", F.explode("toks").alias("word")).join(words, "word").groupBy("id", *part, "dl", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy(*part, "term").agg(F.count(F.when(F.col("tf") > 0, 1)).alias("df"))  # reads tf, so that both uses share one shuffle
    t = tf.join(F.broadcast(df), [*part, "term"])
    t = t.join(F.broadcast(stats), part) if part else t.crossJoin(F.broadcast(stats))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("qf") * idf * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    hits = t.join(F.broadcast(q), "term").select("query_id", "id", *part, weight.alias("w"))
    return hits.groupBy("query_id", *part, "id").agg(fixed_sum(F.col("w")).alias("score")).where(F.col("score") > 0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dense(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exact top-k by inner product. ``vectors`` (id, embedding) are already filtered; ``queries`` (query_id,
    embedding) are few and go to every partition. Each partition keeps its own k best before the shuffle."""
    scored = vectors.join(F.broadcast(queries.select("query_id", F.col("embedding").alias("q"))), F.lit(True))
    return ranked(scored.select("query_id", "id", dot(F.col("embedding"), F.col("q")).alias("score")), k)


def rrf(rankings: Sequence[DataFrame], k: int, weights: Sequence[float] | None = None, constant: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of rankings (query_id, id, rank)."""
    weights = weights or [1.0] * len(rankings)
    parts = [r.select("query_id", "id", (F.lit(float(w)) / (constant + F.col("rank"))).alias("s")) for r, w in zip(rankings, weights, strict=True)]
    all_parts = parts[0]
    for p in parts[1:]:
        all_parts = all_parts.unionByName(p)
    return ranked(all_parts.groupBy("query_id", "id").agg(fixed_sum(F.col("s")).alias("score")), k)


def bag_of_words_embedder(dim: int = EMBED_DIM) -> Callable[[Column], Column]:
    """A stand-in for an embedding model: hashed bag of words, unit length."""

    def embed(texts: pd.Series) -> pd.Series:
        import zlib

        out = []
        for t in texts:
            at = np.fromiter((zlib.crc32(w.encode()) % dim for w in (t or "").lower().split()), np.int64)
            v = np.bincount(at, minlength=dim).astype(np.float32)
            out.append((v / (np.linalg.norm(v) or 1)).tolist())
        return pd.Series(out)

    return lambda c: F.pandas_udf(embed, "array<float>")(c)


def query_text(model: str, c: Column) -> Column:
    """Some models want an instruction before a query, none before a passage."""
    return F.concat(F.lit(QUERY_PREFIX), c) if "bge" in model.lower() else c


def embed_incrementally(chunks: DataFrame, cache: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    """The new cache (chunk_id, content_hash, embedding) of ``chunks`` (chunk_id, text): rows with the same id and
    content are taken over, others computed, stale ones left out."""
    keyed = chunks.select("chunk_id", content_hash(F.col("text")).alias("content_hash"), "text")
    kept = cache.join(keyed.select("chunk_id", "content_hash"), ["chunk_id", "content_hash"], "left_semi")
    missing = keyed.join(cache, ["chunk_id", "content_hash"], "left_anti")
    return kept.select("chunk_id", "content_hash", "embedding").unionByName(missing.select("chunk_id", "content_hash", embed(F.col("text")).alias("embedding")))


def rerank(candidates: DataFrame, texts: DataFrame, queries: DataFrame, score: Callable[[Column, Column], Column], pool: int = RERANKED) -> DataFrame:
    """Score the first ``pool`` candidates of every query in one pass and sort by the new score; equal scores keep
    their order. ``texts`` (id, text), ``queries`` (query_id, text)."""
    top = F.broadcast(candidates.where(F.col("rank") <= pool).select("query_id", "id", F.col("rank").alias("before")))  # a pool a query; texts aren't shuffled
    pairs = texts.select("id", F.col("text").alias("passage")).join(top, "id").join(F.broadcast(queries.select("query_id", F.col("text").alias("q"))), "query_id")
    scored = pairs.select("query_id", "id", "before", score(F.col("q"), F.col("passage")).alias("score"))
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "before")))


@dataclass
class Retriever:
    """Four search modes over chunks (id, text, embedding and the filter columns)."""

    chunks: DataFrame
    embed: Callable[[Column], Column] = field(default_factory=bag_of_words_embedder)
    scorer: Callable[[Column, Column], Column] | None = None
    partition: tuple[str, ...] = ("form",)
    stemmed: bool = True

    def lists(self, queries: DataFrame, filters: SearchFilters, n: int, mode: str) -> dict[str, DataFrame]:
        """First-stage rankings by name. Lexical scores come from the whole partition and are filtered after. The n rows
        a query are kept in memory, as several stages read them and each would pass over all chunks again."""
        out = {}
        allowed = filters.apply(self.chunks)
        if mode != "dense":
            scores = bm25(self.chunks.select("id", "text", *self.partition), queries, self.partition, stemmed=self.stemmed)
            out["bm25"] = ranked(scores.join(allowed.select("id"), "id", "left_semi").select("query_id", "id", "score"), n).persist()
        if mode != "bm25":
            out["dense"] = dense(allowed.select("id", "embedding"), queries.select("query_id", self.embed(F.col("text")).alias("embedding")), n).persist()
        return out

    def search(self, queries: DataFrame, filters: SearchFilters | None = None, k: int = 8, mode: str = "hybrid_rerank", pool: int = RERANKED) -> DataFrame:
        """query_id, id, score, rank and stages, the score and rank of each stage that saw the chunk."""
        return self.search_modes(queries, filters, k, (mode,), pool)[mode]

    def search_modes(self, queries: DataFrame, filters: SearchFilters | None = None, k: int = 8, modes: Sequence[str] = MODES, pool: int = RERANKED) -> dict[str, DataFrame]:
        """What search() gives in each of the modes, whose first-stage rankings are made once for all."""
        filters, n = filters or SearchFilters(), max(k, CANDIDATES)
        first = self.lists(queries, filters, n, modes[0] if len(set(modes)) == 1 else "hybrid")
        return {mode: self._finish({mode: first[mode]} if mode in first else first, queries, n, k, mode, pool) for mode in modes}

    def _finish(self, lists: dict[str, DataFrame], queries: DataFrame, n: int, k: int, mode: str, pool: int) -> DataFrame:
        final = rrf(list(lists.values()), 2 * n) if len(lists) > 1 else next(iter(lists.values()))
        stages = dict(lists)
        if len(lists) > 1:
            stages["rrf"] = final
        if mode == "hybrid_rerank" and self.scorer:
            final = rerank(final, self.chunks.select("id", "text"), queries, self.scorer, pool).persist()
            stages["rerank"] = final
        out = final.select("query_id", "id", "score", "rank").where(F.col("rank") <= k)
        long = None
        for name, s in stages.items():
            part = s.select("query_id", "id", F.explode(F.create_map(F.lit(name), F.col("score").cast("double"), F.lit(f"{name}_rank"), F.col("rank").cast("double"))))
            long = part if long is None else long.unionByName(part)
        maps = long.groupBy("query_id", "id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("stages"))
        return out.join(maps, ["query_id", "id"], "left")


def split_filters(filters: SearchFilters) -> list[SearchFilters]:
    """One filter for each company, year and quarter named; an axis that isn't named stays open."""
    axes = [[(x,) for x in getattr(filters, a)] if getattr(filters, a) else [None] for a in ("tickers", "fiscal_years", "fiscal_quarters")]
    return [replace(filters, tickers=t, fiscal_years=y, fiscal_quarters=q) for t, y, q in itertools.product(*axes)]


def request_grid(requests: DataFrame) -> DataFrame:
    """The same split for a table of requests with array columns tickers, fiscal_years and fiscal_quarters: a row for
    each part, numbered part_no in the order company, year, quarter."""
    out = requests
    for col, one in (("tickers", "ticker"), ("fiscal_years", "fiscal_year"), ("fiscal_quarters", "fiscal_quarter")):
        out = out.select("*", F.posexplode_outer(col).alias(f"{one}_no", one))
    order = W.partitionBy("query_id").orderBy(*[F.coalesce(f"{c}_no", F.lit(0)) for c in ("ticker", "fiscal_year", "fiscal_quarter")])
    return out.select("query_id", "ticker", "fiscal_year", "fiscal_quarter", (F.row_number().over(order) - 1).alias("part_no"))


def interleave(hits: DataFrame, k: int | None = None, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """Merge lists (list_no, rank, id, score): all first hits by score, then all second ones, and so on; a chunk
    stays where it first appears. Equal scores go by list."""
    first = W.partitionBy(*by, "id").orderBy("rank", F.desc("score"), "list_no")
    once = hits.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    order = W.partitionBy(*by).orderBy("rank", F.desc("score"), "list_no")
    out = once.withColumn("position", F.row_number().over(order))
    return out.where(F.col("position") <= k) if k else out


def quota_cut(hits: DataFrame, quota: int, by: Sequence[str] = ("query_id", "list_no")) -> DataFrame:
    """The first ``quota`` of every sub-query by score."""
    return ranked(hits.drop("rank") if "rank" in hits.columns else hits, quota, by)


def search_decomposed(retriever: Retriever, queries: DataFrame, filters: SearchFilters, k: int = 8, mode: str = "hybrid") -> DataFrame:
    """Search every part of the filters and interleave."""
    lists = None
    for i, part in enumerate(split_filters(filters)):
        r = retriever.search(queries, part, k, mode).withColumn("list_no", F.lit(i))
        lists = r if lists is None else lists.unionByName(r)
    return interleave(lists, k)


def ann_recall(vectors: DataFrame, queries: DataFrame, k: int = 10, bucket_length: float = 0.5, tables: int = 8, seed: int = 7) -> DataFrame:
    """Recall at k of random-projection hashing against the exact answer, by query. Vectors that share a hash with
    the query in any table are scored. Ids tell vectors apart; vectors that are null, of another length than the first
    query's or hold null or non-finite components take no part, and the recall of such a query is null."""
    from tessera.operators import nearest

    return nearest.recall(vectors, queries, k, bucket_length, tables, seed)


def contains_all(text: Column, words: Column) -> Column:
    """The keyword smoke check: every required word is in the text."""
    return F.forall(words, lambda w: F.contains(F.lower(text), F.lower(w)))


def corpus_meta(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Years by ticker; and sections with their most common title and size, sorted by item number."""
    years = chunks.groupBy("ticker").agg(F.array_sort(F.collect_set("fiscal_year")).alias("fiscal_years"))
    titles = chunks.groupBy("section", "section_title").agg(F.count("*").alias("n"))
    s = titles.groupBy("section").agg(F.max_by("section_title", F.col("n")).alias("title"), F.sum("n").alias("chunks"))
    item = F.regexp_extract("section", r"^Item (\d+)(.*)$", 1)
    number = F.when(F.startswith("section", F.lit("Item ")), F.coalesce(item.try_cast("int"), F.lit(0))).otherwise(-1)
    suffix = F.when(number >= 0, F.regexp_extract("section", r"^Item (\d+)(.*)$", 2)).otherwise(F.col("section"))
    return years, s.withColumn("sort_number", number).withColumn("sort_suffix", suffix)


def page_label(start: Column, end: Column) -> Column:
    return F.when(F.coalesce(start, F.lit("")) == "", None).when(end.isNull() | (end == "") | (end == start), start).otherwise(F.concat(start, F.lit("-"), end))
