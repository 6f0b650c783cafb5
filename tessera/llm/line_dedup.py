"""Line deduplication over the corpus.

Each document gives a row for every distinct key of its long lines, with the lines' positions. The rows are
range-partitioned by (hash, document) and sorted with the largest document first, so that even one line that a
third of all documents hold is spread over many tasks. A stream over a partition keeps the first document of a
run and drops the others once ``min_docs`` documents are seen. Only what a partition boundary leaves open (its
first run, and a last run still short of ``min_docs``) is settled from sums over those runs. The result is a
compressed bitmap of kept lines for each document that loses some. Only texts that lose lines are moved to meet their
bitmaps (and about one in a hundred others, which the membership filter lets through).

Defined cases: a null or empty text is one empty line; rows without a doc_id count together as one document,
smaller than all others; rows that share a doc_id count as one document for a key, and each row has its own
bitmap by its text (identical rows share it); an empty table gives an empty result; columns other than doc_id
and text are passed through by deduplicated() and not looked at otherwise.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import NO_ID, SPACE_CHARS, identified, keep, membership

MIN_CHARS = 40
MIN_DOCS = 5
ROW = "k1 bigint, k2 bigint, doc bigint, th bigint, n_lines int, pos binary"
DECISION = f"kind int, {ROW}, n_docs bigint"


def _keys(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for doc, th, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            lines = text.split("\n")
            at: dict[str, list[int]] = {}
            for i, line in enumerate(lines):
                if len(line) >= min_chars and len(key := line.strip(SPACE_CHARS)) >= min_chars:
                    at.setdefault(key, []).append(i)
            merged: dict[bytes, list[int]] = {}
            for key, pos in at.items():
                merged.setdefault(hashlib.blake2b(key.encode().lower(), digest_size=16).digest(), []).extend(pos)
            for digest, pos in merged.items():
                out.append((*struct.unpack("<qq", digest), doc, th, len(lines), np.array(pos, "<i4").tobytes()))
        if out:
            k1, k2, d, t, n, p = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(d, pa.int64()), pa.array(t, pa.int64()), pa.array(n, pa.int32()), pa.array(p, pa.binary())], names=["k1", "k2", "doc", "th", "n_lines", "pos"])


class _Stream:
    """Decisions over one sorted partition. Holds at most the rows of min_docs - 1 documents of the open run."""

    def __init__(self, min_docs: int) -> None:
        self.min_docs = min_docs
        self.key = self.first_doc = self.last_doc = None
        self.first_run = True
        self.docs = 0
        self.pending: list[tuple] = []
        self.out: list[tuple] = []

    def close(self, last: bool) -> None:
        """End of the open run; ``last``: it may go on in the next partition."""
        if self.key is None or self.first_run or not last:
            self.pending = []
            return
        if self.docs < self.min_docs:
            self.out += [(1, *row, new) for row, new in self.pending]
        else:  # settled here; later partitions need to know
            self.out.append((2, *self.key, self.first_doc, 0, 0, b"", self.docs))
        self.pending = []

    def row(self, row: tuple) -> None:
        key, doc = row[:2], row[2]
        if key != self.key:
            self.close(False)
            self.first_run = self.key is None
            self.key, self.first_doc, self.last_doc, self.docs = key, doc, None, 0
        new = int(doc != self.last_doc)
        self.docs += new
        self.last_doc = doc
        if self.first_run:
            self.out.append((1, *row, new))
        elif self.docs < self.min_docs:
            self.pending.append((row, new))
        else:
            self.out += [(0, *r, 0) for r, _ in self.pending if r[2] != self.first_doc]
            self.pending = []
            self.out.append((0, *row, 0))

    def taken(self) -> Iterator[pa.RecordBatch]:
        if self.out:
            cols = list(zip(*self.out, strict=True))
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["kind", "k1", "k2", "doc", "th", "n_lines", "pos", "n_docs"])
            self.out = []


def _decide(batches: Iterator[pa.RecordBatch], min_docs: int) -> Iterator[pa.RecordBatch]:
    s = _Stream(min_docs)
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            s.row(row)
        yield from s.taken()
    s.close(True)
    yield from s.taken()


def _bitmap(n_lines: pd.Series, pos: pd.Series) -> pd.DataFrame:
    out = []
    for n, parts in zip(n_lines, pos, strict=True):
        bits = np.ones(n, bool)
        for p in parts:
            bits[np.frombuffer(p, "<i4")] = False
        out.append((int(n - bits.sum()), zlib.compress(np.packbits(bits).tobytes())))
    return pd.DataFrame(out, columns=["n_dropped", "kept"])


def _kept_text(text: pd.Series, kept: pd.Series) -> pd.Series:
    out = []
    for t, k in zip(text, kept, strict=True):
        if k is None or t is None:
            out.append(None)
        else:
            lines = t.split("\n")
            bits = np.unpackbits(np.frombuffer(zlib.decompress(k), np.uint8))[: len(lines)]
            out.append("\n".join(line for line, b in zip(lines, bits, strict=True) if b))
    return pd.Series(out, dtype=object)


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("th"), text.alias("text"))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc (NO_ID for none), th (hash of the text), n_lines, n_dropped and kept, a zlib-compressed bitmap with
    a set bit for each line that stays; only for documents that lose lines."""
    long_lines = keep(_keyed(docs).mapInArrow(lambda it: _keys(it, min_chars), ROW), "lines")
    order = ["k1", "k2", F.desc("doc")]
    sorted_rows = long_lines.repartitionByRange(*order).sortWithinPartitions(*order, "th")
    decided = keep(sorted_rows.mapInArrow(lambda it: _decide(it, min_docs), DECISION), "decisions")
    open_rows = decided.where("kind = 1")
    verdicts = decided.where("kind > 0").groupBy("k1", "k2").agg(F.sum("n_docs").alias("all_docs"), F.max("doc").alias("largest"))
    # two runs at most stay open in a partition, so this side is bounded by the number of partitions
    settled = open_rows.join(F.broadcast(verdicts.where(F.col("all_docs") >= min_docs)), ["k1", "k2"]).where(F.col("doc") < F.col("largest"))
    dropped = decided.where("kind = 0").select("doc", "th", "n_lines", "pos").unionByName(settled.select("doc", "th", "n_lines", "pos"))
    by_doc = dropped.groupBy("doc", "th").agg(F.first("n_lines").alias("n_lines"), F.collect_list("pos").alias("pos"))
    return by_doc.select("doc", "th", "n_lines", F.pandas_udf(_bitmap, "struct<n_dropped:bigint,kept:binary>")("n_lines", "pos").alias("b")).select("doc", "th", "n_lines", "b.n_dropped", "b.kept")


def _with_bitmaps(rows: DataFrame, bitmaps: DataFrame, text: str) -> DataFrame:
    """``rows`` (with doc and th) with n_dropped and new, the text that stays; both null where nothing is dropped. Rows that
    may have a bitmap meet theirs by a sort-merge join at every size, the others pass. The bitmaps are written first, and
    only texts that met one are cut, so that a task never holds Python workers for two steps."""
    bitmaps = keep(bitmaps.select("doc", "th", "n_dropped", "kept"), "bitmaps")
    rows = rows.withColumn("maybe", membership(bitmaps, "doc", "th")(F.col("doc"), F.col("th")))
    met = rows.where("maybe").join(bitmaps.hint("merge"), ["doc", "th"], "left")
    cut = F.pandas_udf(_kept_text, "string")(F.when(F.col("kept").isNotNull(), F.col(text)), F.col("kept"))
    met = met.withColumn("new", cut).drop("kept")
    return met.unionByName(rows.where("not maybe").withColumns({"n_dropped": F.lit(None).cast("bigint"), "new": F.lit(None).cast("string")}))


def deduplicated(docs: DataFrame, **params) -> DataFrame:
    """``docs`` with all its columns; text without the dropped lines (a text that loses none is unchanged)."""
    j = _with_bitmaps(identified(docs), keep_bitmaps(docs, **params), "whole.text")
    return j.select(*[F.coalesce("new", "whole.text").alias(c) if c == "text" else F.col("whole").getField(c).alias(c) for c in docs.columns])


def report(docs: DataFrame, **params) -> DataFrame:
    """doc_id, n_lines (before dropping), n_dropped and kept_sha256 of every row."""
    j = _with_bitmaps(_keyed(docs), keep_bitmaps(docs, **params), "text")
    return j.select(
        F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"),
        F.size(F.split("text", "\n", -1)).cast("bigint").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("bigint").alias("n_dropped"),
        F.sha2(F.coalesce("new", "text").cast("binary"), 256).alias("kept_sha256"),
    )


#: DuckDB SQL for report(documents).
SQL = """
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM s),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS largest FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
d AS (SELECT k.*, f.key IS NOT NULL AND k.doc_id <> f.largest AS dropped FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, (count(*) FILTER (WHERE dropped))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""
