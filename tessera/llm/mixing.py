"""Mixing sources to target weights.

Each document gets a hash-random key. Within its source the keys are range-sorted: the leading hex digits of a
uniform key cut its range into equal slices, slice totals and the running sums within a slice give distributed
prefix sums of word counts, and each source is cut at its exact budget. A budget beyond the source's size takes
whole epochs first, then the prefix again; the document at the cut gives only the words still missing.

Defined cases: a null text has no words; a null source is a source of its own and comes last; a null doc_id is
an id like others; rows with the same id and size are alike, so their order in a tie doesn't show in the result;
an empty table gives an empty result; columns other than doc_id, text and source are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import SPACE_CHARS, SPACE_CLASS, keep

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SEED = "mix"


def n_words(text: Column) -> Column:
    """Number of runs of non-space characters; 0 for null."""
    bare = F.trim(text, F.lit(SPACE_CHARS))
    return F.when(F.coalesce(bare, F.lit("")) == "", 0).otherwise(F.size(F.split(bare, f"[{SPACE_CLASS}]+"))).cast("bigint")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """From (src, source_size), one row a source: target = min(max_epochs * size, level * weight), the level
    such that the targets sum to all sizes. Sources are taken by how soon they reach their cap; the level is the
    first that leaves all later ones below theirs."""
    rank = F.row_number().over(W.orderBy("src"))
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * max_epochs)
    order = W.orderBy(F.col("cap") / F.col("w"), "src")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    from_here = order.rowsBetween(0, W.unboundedFollowing)
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    t = t.withColumn("level", left / F.sum("w").over(from_here))
    t = t.withColumn("level", F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level")))
    level = F.min_by("level", F.struct(F.col("cap") / F.col("w"), F.col("src"))).over(everything)
    level = F.first("level", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return t.select("src", "source_size", F.when(level.isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), level * F.col("w"))).alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target and taken, the words the mix takes of each document.

    The text is read once; after that only ids, keys and sizes move. The number of slices is the power of 16
    nearest to the square root of the row count, so a slice and the list of slices grow alike; it doesn't show
    in the result."""
    src = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("z"))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("key")
    d = keep(docs.select("doc_id", "source", src.alias("src"), key, n_words(F.col("text")).alias("size")), "sizes")
    digits = max(1, round(math.log(max(d.count(), 1)) / 2 / math.log(16)))
    d = d.withColumn("slice", F.substring("key", 1, digits))
    slices = d.groupBy("src", "slice").agg(F.sum("size").alias("slice_size"))
    sizes = slices.groupBy("src").agg(F.sum("slice_size").alias("source_size"))
    upto = W.partitionBy("src").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = slices.select("src", "slice", F.coalesce(F.sum("slice_size").over(upto), F.lit(0)).alias("offset")).join(targets(sizes, weights, max_epochs), "src")
    within = W.partitionBy("src", "slice").orderBy("key", "size").rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0))).join(offsets, ["src", "slice"])
    budget = F.floor(F.col("target") + 0.5).cast("bigint")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("bigint")
    rest = budget - epochs * F.col("source_size") - F.col("offset") - F.col("before")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return d.select("doc_id", "source", "size", "source_size", "target", taken.cast("bigint").alias("taken"))


#: DuckDB SQL for mix(documents) without the source column.
SQL = """
WITH d AS (
  SELECT doc_id, coalesce('s' || source, 'z') AS src, md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS key,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size
  FROM documents),
s AS (SELECT src, sum(size)::BIGINT AS source_size, 1 + (row_number() OVER (ORDER BY src) - 1) % 3 AS w FROM d GROUP BY src),
c AS (SELECT *, source_size * 3 AS cap FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / (sum(w) OVER (ORDER BY cap / w, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM c),
v AS (SELECT level FROM l WHERE level * w <= cap ORDER BY cap / w, src LIMIT 1),
t AS (SELECT src, source_size, CASE WHEN (SELECT count(*) FROM v) = 0 THEN cap::DOUBLE ELSE least(cap::DOUBLE, (SELECT level FROM v) * w) END AS target FROM c),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.src ORDER BY d.key, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.src = t.src),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM r)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::BIGINT AS taken
FROM e
"""
