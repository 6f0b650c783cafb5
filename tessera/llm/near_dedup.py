"""MinHash near-duplicate detection by fast similarity sketching.

A text's set holds its distinct five-word shingles. The sketch has ``BINS`` coordinates, filled in rounds: in
round i < BINS every element is hashed to a (bin, value) of that round; in round BINS + b every element goes to
bin b, so each coordinate fills. A coordinate is the smallest (round, value) that fell into its bin; rounds stop
once all are filled. Two sketches agree in a coordinate with the sets' Jaccard similarity, with concentration as
for independent hashes.

1. Texts with the same set form a class; only classes go on.
2. Bands of ``ROWS`` coordinates put classes into buckets. A bucket is streamed in the order of its classes;
   each class is proposed against the few leaders its sketch resembles, or becomes a leader.
3. Proposals are confirmed on the full sets, and components follow from the confirmed links.
4. Buckets that still hold several components are streamed again, and every pair across components that
   resembles in the sketch and in a longer one of ``LONG_BINS`` coordinates, and wasn't proposed before, is
   proposed: so no link is lost behind a leader. Links of step 4 are confirmed and the components joined anew.

A pair at the very limit of 0.85 misses all bands with a probability of 4e-7, falls below ``alike`` of agreeing
coordinates with one of 1e-5 and below ``alike_long`` of the longer sketch with one of 5e-7; more alike pairs far less.

Defined cases: a null text or one without words has an empty set and is linked with nothing; fewer than five
words count as one shingle; copies and repeated rows are linked; component_id is the smallest doc_id of the
component (a null doc_id is larger than any; a component of such rows alone has a null id and its row is kept);
rows that share their doc_id and set are all kept or all not; an empty table gives an empty result; columns other
than doc_id and text are passed through by kept_documents() and not looked at otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import NO_ID, broadcast_if_small, identified, keep, membership, without

SHINGLE = 5
ROWS = 5
LEADERS = 64
#: Coordinates of the longer sketch that step 4 compares, a byte each.
LONG_BINS = 2000


@dataclass(frozen=True)
class Threshold:
    """The least similarity of a link, in percent, and what finds such links."""

    percent: int
    bands: int
    #: Share of agreeing coordinates from which a pair is proposed: the threshold less 4.7 standard deviations.
    alike: float
    #: The same of the longer sketch: the threshold less 5 standard deviations.
    alike_long: float

    @property
    def bins(self) -> int:
        return self.bands * ROWS


#: The contract's threshold.
CONTRACT = Threshold(85, 25, 0.70, 0.81)
#: The pipeline's threshold; a pair at its limit misses all bands with a probability of 1.3e-7.
STAGE = Threshold(80, 40, 0.66, 0.75)
BINS = CONTRACT.bins

_MIX1, _MIX2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """64-bit hashes of words; forgets all when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str, words: _Words, width: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles."""
    toks = text.encode().lower().split()
    if not toks:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, toks), np.uint64, len(toks))
    n = max(1, len(h) - width + 1)
    out = np.full(n, min(len(h), width), np.uint64)
    for i in range(min(width, len(h))):
        out = _mix(out * _STEP + h[i : i + n])
    return np.unique(out)


def sketch(elements: np.ndarray, bins: int = BINS) -> np.ndarray:
    """The sketch of a non-empty set as uint64: round in the high bits, value in the low ones."""
    none = np.uint64(2**64 - 1)
    out = np.full(bins, none, np.uint64)
    done, n = 0, len(elements)
    while done < 2 * bins:
        span = min(max(1, 2048 // n), bins - done if done < bins else 2 * bins - done)
        rounds = np.arange(done, done + span, dtype=np.uint64)
        v = _mix(elements[None, :] + (rounds[:, None] + np.uint64(1)) * _STEP)
        low = (v >> np.uint64(20)) | (rounds[:, None] << np.uint64(44))
        at = (v & np.uint64(0xFFFFF)).astype(np.int64) * bins >> 20 if done < bins else np.broadcast_to((rounds[:, None] - np.uint64(bins)).astype(np.int64), v.shape)
        np.minimum.at(out, at.ravel(), low.ravel())
        done += span
        if (out != none).all():
            break
    return out


def _sketched(batches: Iterator[pa.RecordBatch], limit: Threshold) -> Iterator[pa.RecordBatch]:
    words = _Words()
    weights = _mix(np.arange(1, ROWS + 1, dtype=np.uint64))
    for b in batches:
        n, fp, bands, short = [], [], [], []
        for text in b.column(1).to_pylist():
            s = shingles(text, words)
            n.append(len(s))
            if not len(s):
                fp.append(None), bands.append(None), short.append(None)
                continue
            fp.append(xxhash.xxh3_128_digest(s.tobytes()))
            k = _mix(sketch(s, limit.bins))
            bands.append(_mix((k.reshape(limit.bands, ROWS) * weights).sum(axis=1, dtype=np.uint64) + np.arange(limit.bands, dtype=np.uint64)).view(np.int64).tolist())
            short.append((k >> np.uint64(48)).astype("<u2").tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(short, pa.binary())], names=["doc_id", "n_shingles", "fp", "bands", "short"])


class _Bucket:
    """Leaders of one bucket in a stream; each row costs one comparison with all of them."""

    def __init__(self, limit: Threshold) -> None:
        self.limit = limit
        self.fp: list[bytes] = []
        self.short = np.zeros((0, limit.bins), np.uint16)

    def add(self, fp: bytes, short: np.ndarray) -> Iterator[bytes]:
        """The leaders to propose; the row becomes a leader if there is none."""
        if self.fp:
            same = (self.short[-LEADERS:] == short).mean(axis=1)
            best = int(same.argmax())
            if same[best] >= self.limit.alike:
                yield self.fp[-LEADERS:][best]
                return
        self.fp = [*self.fp[-LEADERS + 1 :], fp]
        self.short = np.concatenate([self.short[-LEADERS + 1 :], short[None, :]])


def _propose(batches: Iterator[pa.RecordBatch], limit: Threshold) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (band, fp): pairs of a class and a leader."""
    band, bucket = None, _Bucket(limit)
    for b in batches:
        left, right = [], []
        for k, fp, short in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if k != band:
                band, bucket = k, _Bucket(limit)
            for leader in bucket.add(fp, np.frombuffer(short, "<u2")):
                left.append(leader), right.append(fp)
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["a", "b"])


class _Rows:
    """The rows of one bucket so far, in arrays that double."""

    def __init__(self, with_long: bool, limit: Threshold) -> None:
        self.limit = limit
        self.fps: list[bytes] = []
        self.codes: dict[bytes, int] = {}
        self.comp, self.short, self.hit = np.zeros(16, np.int64), np.zeros((16, limit.bins), np.uint16), np.zeros(16, bool)
        self.long = np.zeros((16, LONG_BINS), np.uint8) if with_long else None

    def resembling(self, short: np.ndarray, comp: bytes, number: int) -> np.ndarray:
        """Earlier rows of other components that resemble this one and share no earlier band with it."""
        n, out = len(self.fps), []
        other = np.flatnonzero(self.comp[:n] != self.codes.setdefault(comp, len(self.codes)))
        for at in range(0, len(other), 4096):
            block = other[at : at + 4096]
            same = self.short[block] == short
            near = same.mean(axis=1) >= self.limit.alike
            first = same[near].reshape(int(near.sum()), self.limit.bands, ROWS).all(axis=2).argmax(axis=1)
            out.append(block[near][first == number])
        return np.concatenate(out) if out else other

    def add(self, fp: bytes, short: np.ndarray, comp: bytes, hit: bool, long: np.ndarray | None = None) -> None:
        n = len(self.fps)
        if n == len(self.comp):
            grow = lambda x: np.concatenate([x, np.zeros_like(x)])
            self.comp, self.short, self.hit = grow(self.comp), grow(self.short), grow(self.hit)
            self.long = None if self.long is None else grow(self.long)
        self.fps.append(fp)
        self.comp[n], self.short[n], self.hit[n] = self.codes[comp], short, hit
        if long is not None:
            self.long[n] = long


def _candidates(batches: Iterator[pa.RecordBatch], limit: Threshold) -> Iterator[pa.RecordBatch]:
    """From rows (band, fp, short, comp, number) sorted by band: the classes that resemble one of another component."""
    band, rows = None, _Rows(False, limit)
    found = lambda: pa.RecordBatch.from_arrays([pa.array([rows.fps[i] for i in np.flatnonzero(rows.hit[: len(rows.fps)])], pa.binary())], names=["fp"])
    for b in batches:
        for k, fp, short, comp, number in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            if k != band:
                if rows.hit.any():
                    yield found()
                band, rows = k, _Rows(False, limit)
            s = np.frombuffer(short, "<u2")
            near = rows.resembling(s, comp, number)
            rows.hit[near] = True
            rows.add(fp, s, comp, len(near) > 0)
    if rows.hit.any():
        yield found()


def _across(batches: Iterator[pa.RecordBatch], limit: Threshold) -> Iterator[pa.RecordBatch]:
    """From rows (band, fp, short, comp, number, long) sorted by band: the pairs across components that resemble in
    both sketches."""
    band, rows = None, _Rows(True, limit)
    for b in batches:
        left, right = [], []
        for k, fp, short, comp, number, long in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
            if k != band:
                band, rows = k, _Rows(True, limit)
            s, t = np.frombuffer(short, "<u2"), np.frombuffer(long, np.uint8)
            near = rows.resembling(s, comp, number)
            for i in near[(rows.long[near] == t).mean(axis=1) >= limit.alike_long] if len(near) else ():
                left.append(min(rows.fps[i], fp)), right.append(max(rows.fps[i], fp))
            rows.add(fp, s, comp, False, t)
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["a", "b"])


def _long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (fp, text): the longer sketch."""
    words = _Words()
    for b in batches:
        long = [(_mix(sketch(shingles(t, words), LONG_BINS)) >> np.uint64(56)).astype(np.uint8).tobytes() for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(long, pa.binary())], names=["fp", "long"])


def _confirmed(batches: Iterator[pa.RecordBatch], limit: Threshold) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, text of a, text of b): the pairs whose full sets are similar enough."""
    words = _Words()
    sets: dict[bytes, np.ndarray] = {}

    def of(fp: bytes, text: str) -> np.ndarray:
        if fp not in sets:
            if len(sets) >= 2000:
                sets.clear()
            sets[fp] = shingles(text, words)
        return sets[fp]

    for batch in batches:
        left, right = [], []
        for a, b, ta, tb in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            x, y = of(a, ta), of(b, tb)
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= limit.percent * (len(x) + len(y) - both):
                left.append(a), right.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["a", "b"])


def texts_of(involved: DataFrame, one: DataFrame, docs: DataFrame) -> DataFrame:
    """fp and the text of each class of ``involved`` (fp), that of its first row; no other text is moved."""
    sample = keep(one.join(involved, "fp", "left_semi").select("fp", F.coalesce("first.doc_id", F.lit(NO_ID)).alias("doc"), "first.th"), "involved", few=True)
    side, small = broadcast_if_small(sample)
    rows = identified(docs).select("doc", "th", F.coalesce("whole.text", F.lit("")).alias("text"))
    if not small:
        rows = rows.where(membership(sample, "doc", "th")(F.col("doc"), F.col("th")))
    return rows.join(side, ["doc", "th"]).groupBy("fp").agg(F.max("text").alias("text"))


def confirm(pairs: DataFrame, one: DataFrame, docs: DataFrame, limit: Threshold) -> DataFrame:
    """The pairs (a, b) of classes that are links."""
    involved = pairs.select(F.col("a").alias("fp")).union(pairs.select(F.col("b").alias("fp"))).distinct()
    texts = keep(texts_of(involved, one, docs), "texts")
    return (
        pairs.join(texts.select(F.col("fp").alias("a"), F.col("text").alias("ta")), "a")
        .join(texts.select(F.col("fp").alias("b"), F.col("text").alias("tb")), "b")
        .select("a", "b", "ta", "tb")
        .mapInArrow(lambda batches: _confirmed(batches, limit), "a binary, b binary")
    )


def components(links: DataFrame, one: DataFrame) -> DataFrame:
    """node and comp for every node of ``links`` (a, b); comp is the first row of the component's classes with its
    class, so a component's smallest doc_id comes with the label and no component has to be gathered.

    Labels spread to the smallest neighbour's and then to the label's own label, so the number of rounds grows
    with the logarithm of a component's diameter. Every round is written to the shared folder."""
    both = keep(links.union(links.select("b", "a")).toDF("node", "other").distinct(), "edges", few=True)
    own = F.struct("first.no_id", "first.doc_id", "fp").alias("comp")
    labels = keep(one.select(F.col("fp").alias("node"), own).join(both.select("node").distinct(), "node"), "labels", few=True)
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "comp"), "other").groupBy("node").agg(F.min("comp").alias("m"))
        step = labels.join(near, "node").select("node", F.least("comp", "m").alias("comp"), F.col("comp").alias("old"))
        step = step.withColumn("at", F.col("comp.fp"))
        up = labels.select(F.col("node").alias("at"), F.col("comp").alias("up"))
        step = keep(step.join(up, "at").select("node", F.least("comp", "up").alias("comp"), "old"), "labels", few=True)
        labels = step.select("node", "comp")
        if not step.where("comp <> old").limit(1).count():
            return labels


def _by_text(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.struct(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("th")).alias("id"), text.alias("text"))


def classes(docs: DataFrame, limit: Threshold = CONTRACT) -> DataFrame:
    """doc_id, th, n_shingles, fp (the set's class) and smallest (the component's smallest doc_id) of every row."""
    sketched = _by_text(docs).mapInArrow(lambda batches: _sketched(batches, limit), "id struct<doc_id:bigint,th:bigint>, n_shingles bigint, fp binary, bands array<bigint>, short binary")
    sketched = keep(sketched.select("id.doc_id", "id.th", "n_shingles", "fp", "bands", "short"), "sketched")
    # a set's bands follow from it, so any row of the class serves
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")).alias("first")
    one = keep(sketched.where(F.col("fp").isNotNull()).groupBy("fp").agg(first, F.min(F.struct("bands", "short")).alias("s")).select("fp", "first", "s.*"), "classes")
    # the sketches join only those buckets that hold more than one class
    bands = one.select(F.posexplode("bands").alias("number", "band"), "fp")
    shared = bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    buckets = keep(bands.join(shared, "band").join(one.select("fp", "short"), "fp").select("number", "band", "fp", "short"), "buckets")
    ordered = buckets.repartitionByRange("band").sortWithinPartitions("band", "fp")
    tried = keep(ordered.select("band", "fp", "short").mapInArrow(lambda batches: _propose(batches, limit), "a binary, b binary").distinct(), "tried", few=True)
    links = keep(confirm(tried, one, docs, limit), "links", few=True)
    labels = components(links, one)
    labelled = buckets.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("band", "fp", "short", F.coalesce("comp.fp", "fp").alias("comp"), "number")
    mixed = labelled.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("band")
    again = keep(labelled.join(mixed, "band"), "again")
    # the longer sketch is made only for classes that the short one can't tell from one of another component
    near = again.repartitionByRange("band").sortWithinPartitions("band", "fp").select("band", "fp", "short", "comp", "number").mapInArrow(lambda batches: _candidates(batches, limit), "fp binary")
    long = keep(texts_of(near.distinct(), one, docs).mapInArrow(_long, "fp binary, long binary"), "long")
    again = again.join(long, "fp").repartitionByRange("band").sortWithinPartitions("band", "fp")
    more = again.select("band", "fp", "short", "comp", "number", "long").mapInArrow(lambda batches: _across(batches, limit), "a binary, b binary")
    more = keep(more.join(tried, ["a", "b"], "left_anti"), "more", few=True)
    more_links = keep(confirm(more, one, docs, limit), "more-links", few=True)
    if more_links.limit(1).count():
        labels = components(links.union(more_links), one)
    verdict = keep(one.select("fp", "first").join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.when(F.col("comp").isNull(), F.col("first.doc_id")).otherwise(F.col("comp.doc_id")).alias("smallest")), "verdicts")
    # rows without a set don't meet anything; copies of one text are the skew that the join of plain tables can split
    rows = sketched.select("doc_id", "th", "n_shingles", "fp")
    alone = rows.where(F.col("fp").isNull()).withColumn("smallest", F.col("doc_id"))
    return rows.where(F.col("fp").isNotNull()).join(verdict, "fp").select(*alone.columns).unionByName(alone)


def verdicts(docs: DataFrame, limit: Threshold = CONTRACT) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, component_id and kept of every row."""
    kept = F.col("doc_id").eqNullSafe(F.col("smallest")).alias("kept")
    return classes(docs, limit).select("doc_id", "th", "n_shingles", F.col("smallest").alias("component_id"), kept)


def report(docs: DataFrame, limit: Threshold = CONTRACT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    return verdicts(docs, limit).drop("th")


def kept_documents(docs: DataFrame, limit: Threshold = CONTRACT) -> DataFrame:
    """``docs`` with all its columns, one document of each component: its smallest doc_id."""
    gone = verdicts(docs, limit).where(~F.col("kept"))
    return without(docs, gone.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), "th"))
