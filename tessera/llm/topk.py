"""Exact top-k search by MaxScore.

A vector is a document over the terms 0..d-1, with floor(256 * x) as the integer weight of each term. For a
query q, term j can add at most max(q_j * hi_j, q_j * lo_j) to a score, hi and lo being the shard's extreme
weights. Terms are ordered by that bound. Those whose bounds together can't lift a document above the current
k-th score are non-essential: the postings of the other, essential terms are traversed, and only documents whose
partial score plus the open bounds still competes are probed in the non-essential terms, in steps that drop those
that fall behind. A partition's first ``SEED`` documents are scored whole and give the first k-th score, so every later
shard starts with one. Shards are merged by (score, id). Bounds are exact integers, so the result is exact.

Queries go out in blocks of at most ``QUERY_BLOCK`` broadcast vectors; each block passes over all rows.

Defined cases: a vector that is null or holds a null or non-finite component takes no part; rows without an id take
no part as queries and candidates, having none to return; vectors of unequal length are compared over the common
components; rows of the same id are one another's "own" row and never each other's candidates, and each
repeated row counts as a candidate; ties go to the smaller id; fewer than k candidates give fewer rows; an empty
table gives an empty result; weights or scores that 64 bits can't hold are an error; columns other than the two named
are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import keep

K = 5
EVERY = 50
QUERY_BLOCK = 16_384
SHARD = 2_048
#: Rows of a partition that are scored without a k-th score to beat.
SEED = 256
#: Least magnitude that is an error.
TOO_LARGE = 2.0**62
STEP = 8
HITS = "query_id bigint, vec_id bigint, score bigint"


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and w, the integer weights, of the vectors that take part."""
    v = F.col(vector_col).cast("array<double>")
    weight = lambda x: F.when(F.abs(x) * 256 < TOO_LARGE, F.floor(x * 256).cast("bigint")).otherwise(F.raise_error(F.lit("a component is too large for a 64-bit weight")).cast("bigint"))
    sound = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.coalesce(sound, F.lit(False))).select(F.col(id_col).cast("bigint").alias("vec_id"), F.transform(v, weight).alias("w"))


def _matrix(rows: list[list[int]], width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, : min(len(r), width)] = r[:width]
    return out


class Shard:
    """Postings of some candidates: one column of weights a term, and each term's extreme weights."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.w = ids[order], np.asfortranarray(weights[order])
        self.lo = np.minimum(self.w.min(axis=0, initial=0), 0)
        self.hi = np.maximum(self.w.max(axis=0, initial=0), 0)
        self.largest = np.maximum(self.hi.astype(float), -self.lo.astype(float))
        self.probed = self.held = 0  # postings that searches read, and that there are

    def search(self, query_id: int, q: np.ndarray, k: int, floor: int | None) -> list[tuple[int, int]]:
        """The k best (score, id) of at least ``floor``, the k-th score found elsewhere."""
        if np.abs(q.astype(float)) @ self.largest >= TOO_LARGE:
            raise OverflowError("a score could be too large for 64 bits")
        bound = np.maximum(q * self.lo, q * self.hi)
        order = np.argsort(-bound, kind="stable")
        open_after = np.append(np.cumsum(bound[order][::-1])[::-1], 0)  # what the terms from a place on can add
        alive, score = np.flatnonzero(self.ids != query_id), None
        # essential: as long as the terms still open could lift an unseen document to the floor
        essential = len(q) if floor is None else int(np.searchsorted(-open_after, -floor, side="right"))
        essential = min(max(essential, 1), len(q))
        terms = order[:essential]
        score = (self.w[:, terms] @ q[terms])[alive]
        self.held += self.w.size
        self.probed += len(self.ids) * len(terms)
        at = essential
        while True:
            if len(score) > k:
                # a document's score is at least its partial score plus the least that open terms give
                least = np.minimum(q * self.lo, q * self.hi)[order[at:]].sum()
                cut = int(np.partition(score, len(score) - k)[len(score) - k] + least)
                cut = cut if floor is None else max(cut, floor)
            else:
                cut = floor
            if cut is not None:
                stay = score + open_after[at] >= cut
                alive, score = alive[stay], score[stay]
            if at >= len(q) or not len(alive):
                break
            terms = order[at : at + STEP]
            score = score + self.w[np.ix_(alive, terms)] @ q[terms]
            self.probed += len(alive) * len(terms)
            at += len(terms)
        best = np.lexsort((self.ids[alive], -score))[:k]
        return [(int(score[i]), int(self.ids[alive[i]])) for i in best]


def _searched(batches: Iterator[pa.RecordBatch], queries, k: int) -> Iterator[pa.RecordBatch]:
    """The k best of each query over one partition's candidates, shard after shard."""
    query_ids, q = queries.value
    best: list[list[tuple[int, int]]] = [[] for _ in query_ids]
    ids: list[int] = []
    rows: list[list[int]] = []
    limit = SEED

    def flush() -> None:
        if not ids:
            return
        shard = Shard(np.array(ids, np.int64), _matrix(rows, q.shape[1]))
        for i, query_id in enumerate(query_ids):
            floor = best[i][k - 1][0] if len(best[i]) >= k else None
            found = shard.search(int(query_id), q[i], k, floor)
            best[i] = sorted(best[i] + found, key=lambda x: (-x[0], x[1]))[:k]
        ids.clear(), rows.clear()

    for b in batches:
        for vec_id, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            ids.append(vec_id), rows.append(w)
            if len(ids) >= limit:
                flush()
                limit = SHARD
    flush()
    flat = [(int(qid), v, s) for qid, hits in zip(query_ids, best, strict=True) for s, v in hits]
    if flat:
        a, b, c = zip(*flat, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, c)], names=["query_id", "vec_id", "score"])


def search(candidates: DataFrame, queries: DataFrame, k: int = K, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best among ``candidates`` (both from quantised())."""
    spark = candidates.sparkSession
    queries = keep(queries.distinct(), "queries")
    blocks = max(1, -(-queries.count() // query_block))
    hits = None
    for block in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block) if blocks > 1 else queries
        rows = part.orderBy("vec_id").toLocalIterator()
        ids, weights = [], []
        for r in rows:  # one block
            ids.append(r[0]), weights.append(r[1])
        if not ids:
            continue
        sent = spark.sparkContext.broadcast((np.array(ids, np.int64), _matrix(weights, max(1, max(map(len, weights))))))
        found = candidates.mapInArrow(lambda it, sent=sent: _searched(it, sent, k), HITS)
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        hits = spark.createDataFrame([], HITS)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def report(vectors: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    """Search with every row whose id is divisible by ``every`` against all rows."""
    q = quantised(vectors)
    return search(q, q.where(F.col("vec_id") % every == 0), k)


#: DuckDB SQL for report(embeddings).
SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.w) + 1), lambda i: q.w[i] * c.w[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
