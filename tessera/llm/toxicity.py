"""Toxicity by class-conditional Kneser-Ney models.

A text is the sequence of its bytes, A-Z lowered; every run of bytes that are no letter, digit or part of a longer
character counts as one gap. For each class c (toxic, ordinary), n_c counts sequences of four bytes and of three:

    P_c(x | abc) = max(n_c(abcx) - D, 0) / n_c(abc) + g_c(abc) * P_c(x | bc)
    P_c(x | bc)  = max(n_c(bcx) - D, 0) / n_c(bc)   + g_c(bc)  * S(x | c)
    S(x | c)     = T(cx) / T(c)

where g_c is the mass that the discount D frees, and T(cx) counts the distinct bytes before cx in either class. This
back-off is shared: a rare expression without evidence in either class takes the same value in both and cancels, and
one known to a class only by its parts takes the value of the parts. What neither class has seen after a history
takes the ratio of the lower order alone, as the freed masses tell how much text of a class was read, not what it is
like; so unknown text counts for neither class. The difference of the classes' log-likelihoods
of a text, divided by the root of its length (the scale of its noise), is z; a logistic map of z alone, fitted on
documents scored by models that didn't see them, gives 0 to 1.

The model is fitted on at most ``MAX_TOXIC`` toxic and ``MAX_ORDINARY`` ordinary labelled ids, those of lowest hash (a
bounded sample, see the parameters). Counts are summed on the executors; the driver gets the distinct sequences and a
histogram of z. Every text is scored whole, every occurrence counts, and sums are exact, so copies score alike.

Defined cases: a null text counts as empty; an empty text gets the score of z = 0; a null doc_id belongs to the
remainder of the empty text's crc32; labels that are null or repeated with different values for one doc_id are left
out; each row of a repeated doc_id is used; without labelled documents of both classes every score is 0; an empty
table gives an empty result; columns other than doc_id and text are passed through, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import doc_hash_mod, keep

MAX_TOXIC = 4_000
MAX_ORDINARY = 8_000
DISCOUNT = 0.75
REJECT = 0.3
HELD_OUT, FOLDS = 2, 4
PARTS = 5
#: Bytes that are handled at a time; log-ratios are whole multiples of 1 / SCALE.
PIECE = 1 << 18
SCALE = float(1 << 20)
#: Bins of z in the histogram for the logistic map, so many a unit.
Z_BINS = 1_000

_SYMBOLS = b"abcdefghijklmnopqrstuvwxyz0123456789" + bytes(range(0x80, 0x100))
A = len(_SYMBOLS) + 1
_CODES = np.zeros(256, np.uint8)
_CODES[np.frombuffer(_SYMBOLS, np.uint8)] = np.arange(1, A)
_CODES[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8)] = np.arange(1, 27)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of non-null strings, and where each begins."""
    a = column.cast(pa.large_string())
    at = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, at


def _groups(at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about PIECE bytes; a longer text stands alone."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(at, at[lo] + PIECE, side="right")) - 1))
        yield lo, hi
        lo = hi


def _symbols(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of some texts in one array, each text led by two gaps and ended by one; where each begins."""
    n, lens = len(at) - 1, np.diff(at)
    codes = _CODES[data[at[0] : at[-1]]]
    start = at[:-1] - at[0] + 3 * np.arange(n)
    if n == 1:
        s = np.concatenate([np.zeros(2, np.uint8), codes, np.zeros(1, np.uint8)])
    else:
        s = np.zeros(len(codes) + 3 * n, np.uint8)
        s[np.arange(len(codes)) + np.repeat(3 * np.arange(n) + 2, lens)] = codes
    stay = s != 0
    stay[1:] |= s[:-1] != 0
    stay[start] = stay[start + 1] = True
    return s[stay], np.concatenate([[0], np.cumsum(np.add.reduceat(stay, start, dtype=np.int64))[:-1]])


def _windows(s: np.ndarray, start: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Piece by piece: the place of the first window's last symbol, history and last symbol of the windows of four, and
    which of them lie within one text."""
    for lo in range(3, len(s), PIECE):
        hi = min(lo + PIECE, len(s))
        a, b, c = (s[lo - k : hi - k].astype(np.int32) for k in (3, 2, 1))
        own = np.ones(hi - lo, bool)
        for k in range(3):
            cut = start + k
            own[cut[(cut >= lo) & (cut < hi)] - lo] = False
        yield lo, (a * A + b) * A + c, s[lo:hi].astype(np.int32), own


@dataclass
class Counts:
    """Distinct four-byte sequences (as numbers to base A) and their counts by fold and class."""

    grams: np.ndarray
    n: np.ndarray  # grams x PARTS x 2


class Model:
    """Log-ratios, times SCALE: of x after each known history of three, and of x after any two."""

    def __init__(self, grams: np.ndarray, n: np.ndarray, discount: float = DISCOUNT) -> None:
        used = n.sum(axis=1) > 0
        grams, n = grams[used], n[used].astype(float)
        tri, tri_of = np.unique(grams % A**3, return_inverse=True)
        n3 = np.stack([np.bincount(tri_of, weights=n[:, c], minlength=len(tri)) for c in (0, 1)], axis=1)
        bi, bi_of = np.unique(tri % A**2, return_inverse=True)
        types = np.bincount(bi_of, minlength=len(bi)).astype(float)
        total = np.bincount(bi // A, weights=types, minlength=A)
        shared = (types / total[bi // A])[bi_of]
        p3 = self._order(tri // A, n3, np.stack([shared, shared], axis=1), discount)
        self.low = np.zeros(A**3, np.int32)
        self.low[tri] = self._fixed(p3)
        p4 = self._order(grams // A, n, p3[tri_of], discount)
        known = np.unique(grams // A)
        self.row = np.zeros(A**3, np.uint16 if len(known) < 1 << 16 else np.int32)
        self.row[known] = np.arange(1, len(known) + 1)
        high = np.zeros((len(known) + 1, A), np.int32)
        high[1:] = self.low.reshape(A**2, A)[known % A**2]
        high[self.row[grams // A], grams % A] = self._fixed(p4)
        self.high = high.reshape(-1)

    @staticmethod
    def _fixed(p: np.ndarray) -> np.ndarray:
        return np.rint(np.log(p[:, 1] / p[:, 0]) * SCALE).astype(np.int32)

    @staticmethod
    def _order(history: np.ndarray, n: np.ndarray, lower: np.ndarray, discount: float) -> np.ndarray:
        """Probabilities in both classes of sequences with these histories, counts and lower-order probabilities."""
        _, of = np.unique(history, return_inverse=True)
        mass = np.stack([np.bincount(of, weights=n[:, c]) for c in (0, 1)], axis=1)[of]
        freed = np.stack([np.bincount(of, weights=np.minimum(n[:, c], discount)) for c in (0, 1)], axis=1)[of]
        return np.where(mass > 0, (np.maximum(n - discount, 0) + freed * lower) / np.maximum(mass, 1e-9), lower)

    def z(self, column: pa.Array) -> np.ndarray:
        data, at = _bytes_of(column)
        out = np.zeros(len(at) - 1)
        for lo, hi in _groups(at):
            s, start = _symbols(data, at[lo : hi + 1])
            sums = np.zeros(hi - lo, np.int64)
            for begin, history, x, own in _windows(s, start):
                row = self.row[history]
                v = np.where(row > 0, self.high[row.astype(np.int32) * A + x], self.low[history % A**2 * A + x]).astype(np.int64)
                v *= own
                i, j = int(np.searchsorted(start, begin, side="right")) - 1, int(np.searchsorted(start, begin + len(x)))
                sums[i:j] += np.add.reduceat(v, np.maximum(start[i:j], begin) - begin)
            n = np.diff(np.append(start, len(s))) - 3
            out[lo:hi] = sums / SCALE / np.sqrt(np.maximum(n, 1))
        return out


def _logistic(z: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Offset and slope of the logistic map of z, by Newton's method."""
    x, w = np.stack([np.ones(len(z)), z], axis=1), np.zeros(2)
    loss = lambda w: float((weight * np.logaddexp(0, np.where(y == 1, -1, 1) * (x @ w))).sum() + ridge / 2 * w @ w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(2), x.T @ (weight * (p - y)) + ridge * w)
        while loss(w - step) > loss(w) and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _sample(docs: DataFrame, labels: DataFrame, max_toxic: int, max_ordinary: int) -> tuple[DataFrame, int, int]:
    """y and text of the rows to learn from, and the number of labelled ids of either class."""
    known = labels.where(F.col("toxic").isin(0, 1) & (doc_hash_mod("doc_id", FOLDS) != HELD_OUT)).groupBy("doc_id").agg(F.min("toxic").alias("y"), F.max("toxic").alias("y2")).where("y = y2").select("doc_id", F.col("y").cast("int").alias("y"))
    order = F.xxhash64("doc_id")
    ones, zeros = known.where("y = 1"), known.where("y = 0")
    picked = ones.orderBy(order, "doc_id").limit(max_toxic).unionByName(zeros.orderBy(order, "doc_id").limit(max_ordinary))
    # at most max_toxic + max_ordinary ids go out
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id").select("y", "text")
    return rows, ones.count(), zeros.count()


def _folds(column: pa.Array) -> np.ndarray:
    """A text and its copies fall into one fold."""
    data, at = _bytes_of(column)
    return np.array([zlib.crc32(data[a:b]) % PARTS for a, b in zip(at[:-1], at[1:], strict=True)], np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (y, text): counts of (fold, class, sequence)."""
    for b in batches:
        (data, at), cell = _bytes_of(b.column(1)), _folds(b.column(1)) * 2 + b.column(0).to_numpy()
        for lo, hi in _groups(at):
            s, start = _symbols(data, at[lo : hi + 1])
            of = np.repeat(cell[lo:hi], np.diff(np.append(start, len(s))))
            for begin, history, x, own in _windows(s, start):
                key = (of[begin : begin + len(x)] * A**4 + history.astype(np.int64) * A + x)[own]
                keys, n = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], names=["key", "n"])


def counts(rows: DataFrame) -> Counts:
    """Of rows (y, text). The table that reaches the driver holds distinct sequences of the sample only."""
    found = rows.mapInArrow(_counted, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    key, n = found.column("key").to_numpy(), found.column("n").to_numpy()
    grams, at = np.unique(key % A**4, return_inverse=True)
    table = np.zeros((len(grams), PARTS, 2), np.int64)
    table[at, key // A**4 // 2, key // A**4 % 2] = n
    return Counts(grams, table)


def _model(c: Counts, fold: int | None) -> Model:
    """The model of all folds, or of all but one. It is made once a task and goes with it, as workers live on."""
    return Model(c.grams, c.n.sum(axis=1) - (0 if fold is None else c.n[:, fold]))


def _held_out(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Rows (y, text): y and the bin of z by the model of the other folds."""
    for b in batches:
        fold, z = _folds(b.column(1)), np.zeros(b.num_rows)
        for k in range(PARTS):
            here = np.flatnonzero(fold == k)
            if len(here):
                z[here] = _model(shared.value, k).z(b.column(1).take(pa.array(here)))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.rint(z * Z_BINS).astype(np.int64))], names=["y", "z"])


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_ordinary: int = MAX_ORDINARY) -> tuple[Counts, np.ndarray] | None:
    """Counts of a sample of the labelled rows whose id's remainder isn't HELD_OUT, and the logistic map. None without
    both classes."""
    rows, n1, n0 = _sample(docs, labels, max_toxic, max_ordinary)
    if not n1 or not n0:
        return None
    rows = keep(rows, "labelled")
    c = counts(rows)
    by_fold = c.n.sum(axis=0)
    if not ((by_fold.sum(axis=0) - by_fold) > 0).all():  # a fold's model needs both classes
        return None
    shared = rows.sparkSession.sparkContext.broadcast(c)
    found = rows.mapInArrow(lambda it: _held_out(it, shared), "y int, z bigint").groupBy("y", "z").agg(F.count("*").alias("n")).toPandas()
    z, y, n = found["z"].to_numpy() / Z_BINS, found["y"].to_numpy(), found["n"].to_numpy().astype(float)
    n *= np.where(y == 1, n1 / n[y == 1].sum(), n0 / n[y == 0].sum()) * n.sum() / (n1 + n0)
    return c, _logistic(z, y, n)


def _scorer(shared, line: np.ndarray):
    """A pandas UDF over texts, for broadcast counts (bounded by the training sample)."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = _model(shared.value, None)
        for texts in batches:
            z = m.z(pa.array(texts, pa.large_string()))
            yield pd.Series(1 / (1 + np.exp(-np.clip(line[0] + line[1] * z, -30, 30))))

    return score


def with_score(docs: DataFrame, labels: DataFrame, column: str = "toxicity_score", **params) -> DataFrame:
    """``docs`` with all its columns and the score."""
    model = fit(docs, labels, **params)
    if model is None:
        return docs.withColumn(column, F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model[0])
    return docs.withColumn(column, _scorer(shared, model[1])(F.coalesce(docs["text"], F.lit(""))))


def accepted(docs: DataFrame, labels: DataFrame, reject: float = REJECT, **params) -> DataFrame:
    """The documents whose score is below ``reject``, with their columns."""
    whole = docs.select("doc_id", "text", F.struct(*[docs[c] for c in docs.columns]).alias("whole"))
    return with_score(whole, labels, "score", **params).where(F.col("score") < reject).select("whole.*")


def report(docs: DataFrame, labels: DataFrame, reject: float = REJECT, **params) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    scored = with_score(docs.select("doc_id", "text"), labels, "score", **params)
    return scored.select("doc_id", (doc_hash_mod("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= reject).cast("int").alias("predicted"))
