"""Language-model scoring by deleted interpolation.

    P(w | h) = l2(b) * c(h w) / c(h) + l1(b) * c(w) / N + l0(b) / (V + 1),    b = bucket of c(h)

over word bigrams with an end token; the first word's history is the start of the text. The weights of a bucket
are learned by expectation-maximisation on held-out counts: each training token is deleted in turn, so its ratios
are those of the other tokens, (c(h w) - 1) / (c(h) - 1) and (c(w) - 1) / (N - 1), and its bucket is that of
c(h) - 1. EM runs on a histogram of these ratios over all training tokens, of bounded size.

Texts are first written as blocks of integers: a block holds its distinct words' hashes and the words by local
number. A block then sends its distinct words and bigrams with their training counts, sorted by hash and cut
into parts; a part's task adds up the counts of all blocks and answers each block in its own order. So a word or
pair crosses the network once a block however frequent it is, and no count table is held whole anywhere. There are as
many parts as the corpus has ``PART_TOKENS`` tokens, so a part's task stays the same size however large the corpus.

Defined cases: a null text counts as empty; an empty text is the end token alone; a null doc_id belongs to the
remainder of the empty text's crc32; copies and repeated rows count each time; without training documents N and V
are 0 and every score is that of the uniform part; an empty table gives an empty result; columns other than doc_id
and text are not looked at. Words are told apart by 64-bit hashes, pairs by their part and 48 bits: of the at most
PART_TOKENS pairs of a part, about one in 10^8 shares its bits with another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import doc_hash_mod, keep

HELD_OUT, FOLDS = 1, 5
BLOCK_TOKENS = 700_000
PART_TOKENS = 2_500_000
END = np.uint64(0x9AE16A3B2F90404F)
START = np.uint64(0xC3A5C85C97CB3127)
BUCKETS = 24
#: Bins of a ratio's logarithm to base 2 in the histogram for EM: so many a unit, from 1 down to 2^-FLOOR.
PER_UNIT, FLOOR = 4, 40
BINS = PER_UNIT * FLOOR + 2

BLOCK = "block bigint, n bigint, doc_ids array<bigint>, train binary, lens binary, vocab binary, toks binary"
REQUEST = "part int, block bigint, kind int, keys binary, counts binary"
ANSWER = "block bigint, part int, kind int, counts binary, n_tokens bigint, n_types bigint"


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _pack(x: np.ndarray) -> bytes:
    """Bytes of equal weight together, compressed."""
    raw = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(raw.T).tobytes())


def _unpack(b: bytes, dtype: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).reshape(-1)


def _encoded(batches: Iterator[pa.RecordBatch], block_tokens: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    words, serial = _Words(), TaskContext.get().partitionId() << 24
    doc_ids, train, hashes, held = [], [], [], 0

    def flush() -> pa.RecordBatch:
        nonlocal held, serial
        lens = np.array([len(h) for h in hashes], np.int32)
        vocab, local, counts = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")  # frequent words get small numbers, which pack better
        number = np.empty(len(order), np.int32)
        number[order] = np.arange(len(order), dtype=np.int32)
        row = [[serial], [int(lens.sum())], [list(doc_ids)], [np.array(train, np.uint8).tobytes()], [_pack(lens)], [vocab[order].tobytes()], [_pack(number[local])]]
        serial += 1
        doc_ids.clear(), train.clear(), hashes.clear()
        held = 0
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds, strict=True)], names=["block", "n", "doc_ids", "train", "lens", "vocab", "toks"])

    for b in batches:
        for doc_id, is_train, text in _rows(b, ("doc_id", "train", "text")):
            toks = text.encode().lower().split()
            h = np.empty(len(toks) + 1, np.uint64)
            h[:-1] = np.fromiter(map(words.__getitem__, toks), np.uint64, len(toks))
            h[-1] = END
            doc_ids.append(doc_id), train.append(is_train), hashes.append(h)
            held += len(h)
            if held >= block_tokens:
                yield flush()
    if hashes:
        yield flush()


class Block:
    """A block's tokens, and its distinct words and pairs in the order of their hashes."""

    def __init__(self, train: bytes, lens: bytes, vocab: bytes, toks: bytes) -> None:
        self.lens = _unpack(lens, "<i4")
        self.vocab = np.frombuffer(vocab, np.uint64)
        self.toks = _unpack(toks, "<i4")
        self.train = np.repeat(np.frombuffer(train, np.uint8).astype(bool), self.lens)
        self.starts = np.concatenate([[0], np.cumsum(self.lens)[:-1]]).astype(np.int64)
        v = len(self.vocab)
        self.history = np.empty_like(self.toks)
        self.history[1:] = self.toks[:-1]
        self.history[self.starts] = v  # the start of a text
        code = self.history.astype(np.int64) * v + self.toks
        pairs, self.pair = np.unique(code, return_inverse=True)
        h = np.append(self.vocab, START)
        keys = (h[pairs // v] * np.uint64(0x9E3779B97F4A7C15)) ^ self.vocab[pairs % v]
        keys = (keys ^ (keys >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        self.keys = keys ^ (keys >> np.uint64(32))
        self.word_order, self.pair_order = np.argsort(self.vocab, kind="stable"), np.argsort(self.keys, kind="stable")

    def sets(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(kind, sorted hashes, training counts) of the words and of the pairs."""
        n = np.bincount(self.toks[self.train], minlength=len(self.vocab)).astype(np.uint32)
        yield 1, self.vocab[self.word_order], n[self.word_order]
        n = np.bincount(self.pair[self.train], minlength=len(self.keys)).astype(np.uint32)
        yield 2, self.keys[self.pair_order], n[self.pair_order]


def _rows(b: pa.RecordBatch, names: tuple[str, ...]) -> Iterator[list]:
    """One row after the other, as each is large."""
    cols = [b.column(b.schema.get_field_index(n)) for n in names]
    for i in range(b.num_rows):
        yield [c[i].as_py() for c in cols]


def _part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)


def _requests(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for block, train, lens, vocab, toks in _rows(b, ("block", "train", "lens", "vocab", "toks")):
            rows = []
            for kind, keys, n in Block(train, lens, vocab, toks).sets():
                cuts = np.searchsorted(_part_of(keys, parts), np.arange(parts + 1))
                for p in range(parts):
                    k = keys[cuts[p] : cuts[p + 1]]
                    if len(k):
                        raw = k.tobytes() if kind == 1 else np.ascontiguousarray(k.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()
                        rows.append((p, block, kind, raw, _pack(n[cuts[p] : cuts[p + 1]])))
            if rows:
                kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["part", "block", "kind", "keys", "counts"])


def _answers(rows: pd.DataFrame) -> pd.DataFrame:
    """Counts over all blocks of the words and pairs of one part."""
    out = []
    for kind, group in rows.groupby("kind"):
        if kind == 1:
            keys = [np.frombuffer(k, np.uint64) for k in group["keys"]]
        else:
            keys = []
            for k in group["keys"]:
                wide = np.zeros((len(k) // 6, 8), np.uint8)
                wide[:, :6] = np.frombuffer(k, np.uint8).reshape(-1, 6)
                keys.append(wide.view(np.uint64).reshape(-1))
        n = np.concatenate([_unpack(c, "<u4") for c in group["counts"]])
        every, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, weights=n, minlength=len(every)).astype(np.uint32)
        each = np.split(total[at], np.cumsum([len(k) for k in keys])[:-1])
        sums = (int(total.sum()), int((total > 0).sum())) if kind == 1 else (0, 0)
        for i, (block, part, counts) in enumerate(zip(group["block"], group["part"], each, strict=True)):
            out.append((block, part, kind, _pack(counts), *(sums if i == 0 else (0, 0))))
    return pd.DataFrame(out, columns=["block", "part", "kind", "counts", "n_tokens", "n_types"])


class Resolved(Block):
    """A block with the counts over the whole training corpus: c2 = c(h w), ch = c(h), c1 = c(w) of each token."""

    def __init__(self, train: bytes, lens: bytes, vocab: bytes, toks: bytes, answers: list[dict], n_train_docs: int) -> None:
        super().__init__(train, lens, vocab, toks)
        got = {1: {}, 2: {}}
        for a in answers:
            got[a["kind"]][a["part"]] = _unpack(a["counts"], "<u4")
        words, pairs = np.zeros(len(self.vocab) + 1, np.int64), np.zeros(len(self.keys), np.int64)
        words[self.word_order] = np.concatenate([got[1][p] for p in sorted(got[1])])
        pairs[self.pair_order] = np.concatenate([got[2][p] for p in sorted(got[2])])
        words[-1] = n_train_docs
        self.c1, self.ch, self.c2 = words[self.toks], words[self.history], pairs[self.pair]


def _bucket(ch: np.ndarray) -> np.ndarray:
    return np.minimum(np.ceil(np.log2(ch + 1.0)), BUCKETS - 1).astype(np.int64)


def _bin(p: np.ndarray) -> np.ndarray:
    """0 for no chance at all, else 1 + steps below 1."""
    with np.errstate(divide="ignore"):
        steps = np.where(p > 0, np.rint(-np.log2(p) * PER_UNIT), 0)
    return np.where(p > 0, 1 + np.minimum(steps, BINS - 2), 0).astype(np.int64)


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(b > 0, a / np.maximum(b, 1), 0.0)


def _resolved(b: pa.RecordBatch, n_train_docs: int) -> Iterator[tuple[list, Resolved]]:
    for ids, train, lens, vocab, toks, answers in _rows(b, ("doc_ids", "train", "lens", "vocab", "toks", "answers")):
        yield ids, Resolved(train, lens, vocab, toks, answers, n_train_docs)


def _histogram(batches: Iterator[pa.RecordBatch], n: int, n_train_docs: int) -> Iterator[pa.RecordBatch]:
    """Deleted ratios of the training tokens by cell (bucket, bin of p2, bin of p1)."""
    cells = np.zeros(BUCKETS * BINS * BINS, np.int64)
    for b in batches:
        for _, r in _resolved(b, n_train_docs):
            t = r.train
            ch, p1 = r.ch[t] - 1, (r.c1[t] - 1) / max(n - 1, 1)
            p2 = _ratio(r.c2[t] - 1, ch)
            at, k = np.unique((_bucket(ch) * BINS + _bin(p2)) * BINS + _bin(p1), return_counts=True)
            cells[at] += k
    at = np.flatnonzero(cells)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(cells[at], pa.int64())], names=["cell", "n"])


def weights(cell: np.ndarray, n: np.ndarray, types: int, rounds: int = 60) -> np.ndarray:
    """Weights (l2, l1, l0) of each bucket by EM; a bucket without tokens takes its lower neighbour's."""
    bucket, b2, b1 = cell // (BINS * BINS), cell // BINS % BINS, cell % BINS
    back = lambda b: np.where(b > 0, 2.0 ** (-(b - 1) / PER_UNIT), 0.0)
    p = np.stack([back(b2), back(b1), np.full(len(cell), 1 / (types + 1))], axis=1)
    out = np.full((BUCKETS, 3), 1 / 3)
    for k in range(BUCKETS):
        here = bucket == k
        if not here.any():
            out[k] = out[k - 1] if k else out[k]
            continue
        lam, q, m = np.full(3, 1 / 3), p[here], n[here]
        for _ in range(rounds):
            part = q * lam
            lam = (part / part.sum(axis=1, keepdims=True) * m[:, None]).sum(axis=0) / m.sum()
        lam = np.maximum(lam, 1e-6)  # no token is impossible
        out[k] = lam / lam.sum()
    return out


def _scores(batches: Iterator[pa.RecordBatch], n: int, types: int, n_train_docs: int, lam: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for ids, r in _resolved(b, n_train_docs):
            # base: with no training tokens V is 0 and the fraction is 1
            base = np.log10((r.c1 + 0.5) / (n + 0.5 * (types + 1)))
            w = lam[_bucket(r.ch)]
            p = w[:, 0] * _ratio(r.c2, r.ch) + w[:, 1] * (r.c1 / max(n, 1)) + w[:, 2] / (types + 1)
            sums = [np.add.reduceat(x, r.starts) for x in (base, np.log10(p), (r.c1 > 0).astype(np.int64))]
            held = ~r.train[r.starts]
            cols = [pa.array(ids, pa.int64()), pa.array(held), pa.array(r.lens.astype(np.int64)), pa.array(sums[2], pa.int64()), pa.array(np.full(len(ids), n, np.int64)), pa.array(sums[0]), pa.array(sums[1])]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def report(docs: DataFrame, parts: int | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    is_train = doc_hash_mod("doc_id", FOLDS) != HELD_OUT
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), is_train.alias("train"), F.coalesce("text", F.lit("")).alias("text"))
    blocks = keep(rows.mapInArrow(lambda it: _encoded(it, block_tokens), BLOCK), "blocks")
    if not parts:
        n = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
        parts = max(1, -(-n // PART_TOKENS))
    requests = blocks.select("block", "train", "lens", "vocab", "toks").mapInArrow(lambda it: _requests(it, parts), REQUEST)
    answers = keep(requests.repartitionById(parts, F.col("part")).groupBy("part").applyInPandas(_answers, ANSWER), "answers")
    totals = answers.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_types"), F.lit(0)).alias("v")).first()
    n, types = totals["n"], totals["v"]
    n_docs = rows.where("train").count()
    by_block = answers.groupBy("block").agg(F.collect_list(F.struct("part", "kind", "counts")).alias("answers"))
    resolved = keep(blocks.join(by_block, "block"), "resolved")
    cells = resolved.mapInArrow(lambda it: _histogram(it, n, n_docs), "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    found = cells.toPandas()  # at most BUCKETS * BINS * BINS rows
    lam = weights(found["cell"].to_numpy(), found["n"].to_numpy(), types)
    return resolved.mapInArrow(lambda it: _scores(it, n, types, n_docs, lam), "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
