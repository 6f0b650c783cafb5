"""Token counts by an exact length histogram.

Documents are encoded by a public tokenizer and aggregated by length; suffix sums over the lengths answer, for
every context limit, how many documents and tokens there are, which share lies within it, and how many tokens
are left when each document is truncated to it. Only (length, count) pairs are shuffled.

Defined cases: a null text counts as empty and has length 0; special-token strings in a text are ordinary text;
copies and repeated rows count each time; an empty table gives an empty histogram; columns other than text are
not looked at. A limit between two lengths of the histogram is answered by truncated(). Very long runs of white space are
encoded apart from the rest, at the places where the split pattern parts them anyway, so lengths are those of the whole
text.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import keep

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that goes with the vocabulary files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Runs of at least so many white-space characters are split off before the pattern is applied: matching ``\s+(?!\S)``
#: takes stack in proportion to the run.
LONG_SPACE = 1_000
_SPACES = re.compile(rf"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{{{LONG_SPACE},}}")
#: Lengths in one slice of the two-level suffix sums.
SLICE = 256

_encoders: dict[int, object] = {}


def _encoder(ranks: bytes, pattern: str):
    import tiktoken

    key = hash((ranks, pattern))
    if key not in _encoders:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _encoders[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _encoders[key]


def n_tokens(encoding, text: str) -> int:
    """Length of ``text`` encoded whole. The pattern takes all of a white-space run but its last character as one piece,
    or all of it at the end of the text, so a run's piece is encoded alone and the last character goes on with the rest."""
    if not (m := _SPACES.search(text)):
        return len(encoding.encode_ordinary(text))
    total, at = 0, 0
    while m:
        total += len(encoding.encode_ordinary(text[at : m.start()]))
        at = m.end() if m.end() == len(text) else m.end() - 1
        total += len(encoding._encode_single_piece(text[m.start() : at]))
        m = _SPACES.search(text, m.end())
    return total + len(encoding.encode_ordinary(text[at:]))


def with_length(docs: DataFrame, tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """n_tokens of every row (one column). The vocabulary file is read on the driver and sent out; its size is
    fixed, whatever the corpus."""
    with open(tokenizer, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("bigint")
    def length(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = _encoder(shared.value, pattern)
        for texts in batches:
            yield pd.Series([n_tokens(encoding, t) for t in texts], dtype="int64")

    return docs.select(length(F.coalesce("text", F.lit(""))).alias("n_tokens"))


def histogram(lengths: DataFrame) -> DataFrame:
    """From a column n_tokens, a row for each length: n_docs and n_tokens at it; docs_from and tokens_from, the
    suffix sums from it on; share_within, the documents no longer than it; truncated_tokens, what is left of the
    corpus with this length as the limit."""
    # kept, as it is read twice below and the texts should be encoded once
    h = keep(lengths.groupBy(F.col("n_tokens").alias("length")).agg(F.count("*").alias("n_docs")), "lengths")
    h = h.withColumn("n_tokens", F.col("length") * F.col("n_docs")).withColumn("slice", F.floor(F.col("length") / SLICE))
    # slices of lengths are summed first, so that only a row a slice meets in one task
    after = W.orderBy(F.desc("slice")).rowsBetween(W.unboundedPreceding, -1)
    everything = W.orderBy(F.desc("slice")).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = h.groupBy("slice").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    s = s.select("slice", *[F.coalesce(F.sum(c).over(after), F.lit(0)).alias(f"{c}_after") for c in "dt"], *[F.sum(c).over(everything).alias(f"{c}_all") for c in "dt"])
    within = W.partitionBy("slice").orderBy(F.desc("length")).rowsBetween(W.unboundedPreceding, W.currentRow)
    h = h.withColumns({"docs_from": F.sum("n_docs").over(within), "tokens_from": F.sum("n_tokens").over(within)}).join(s, "slice")
    docs_from, tokens_from = F.col("docs_from") + F.col("d_after"), F.col("tokens_from") + F.col("t_after")
    return h.select(
        "length",
        "n_docs",
        "n_tokens",
        docs_from.alias("docs_from"),
        tokens_from.alias("tokens_from"),
        ((F.col("d_all") - docs_from + F.col("n_docs")) / F.col("d_all")).alias("share_within"),
        (F.col("t_all") - tokens_from + F.col("length") * docs_from).alias("truncated_tokens"),
    )


def truncated(hist: DataFrame, limits: list[int]) -> DataFrame:
    """limit, n_docs and n_tokens over it, and truncated_tokens, for any limits."""
    cols = []
    for limit in limits:
        over = F.col("length") > limit
        cols.append(F.struct(F.lit(limit).cast("bigint").alias("limit"), F.coalesce(F.sum(F.when(over, F.col("n_docs"))), F.lit(0)).alias("n_docs"), F.coalesce(F.sum(F.when(over, F.col("n_tokens"))), F.lit(0)).alias("n_tokens"), F.coalesce(F.sum(F.least(F.col("length"), F.lit(limit)) * F.col("n_docs")), F.lit(0)).alias("truncated_tokens")))
    return hist.agg(F.array(*cols).alias("rows")).select(F.inline("rows"))


def quantiles(hist: DataFrame, shares: list[float]) -> DataFrame:
    """share and length: the least length that at least this share of the documents doesn't exceed."""
    cols = [F.struct(F.lit(q).alias("share"), F.min(F.when(F.col("share_within") >= q, F.col("length"))).alias("length")) for q in shares]
    return hist.agg(F.array(*cols).alias("rows")).select(F.inline("rows"))


def report(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    return histogram(with_length(docs, tokenizer))
