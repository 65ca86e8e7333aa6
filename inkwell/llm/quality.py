"""Quality selection by importance resampling over hashed n-grams (Xie et al., 2023).

Two generative models share one table of hashed byte n-grams: the raw model counts all documents, the
target model a bounded sample of rows labelled good. A document's log weight is the log of the ratio of its
probabilities under the two: the sum of the log ratios of its n-grams.

Both models are smoothed alike: the raw counts are brought to the target's total, then each bucket of both gets
one. So an n-gram that neither has seen says nothing, and one that is rare in both next to nothing.

Rows are drawn without replacement by Gumbel top-k: the k rows of largest tempered log weight plus a
Gumbel variate of their own hash, k being the labelled share of good rows. The temperature of a text of n n-grams is
n / ``ngrams``, 1 at least: sums of thousands of n-grams would differ by hundreds, so that the longest rows were taken and
chance decided nothing. So a row's odds are those of its whole text up to ``ngrams`` n-grams, and beyond that those of
a text of ``ngrams`` n-grams like its own: with a mean log ratio of 0.02, odds of exp(0.02), exp(0.2), e and e for
1, 10, 50 and 5000 n-grams. A short text is never told apart better than its few n-grams can.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.scratch import Scratch, drawn
from inkwell.llm.tokens import mix, slices, text_buffers

BUCKETS = 1 << 16
WIDTH = 3
#: Bound of the labelled rows that fit the target model, drawn by the hash of their ids.
LABELLED = 200_000
SEED = 0x5EED
#: Default of ``ngrams``, the number at which the odds of longer rows are taken; see above.
NGRAMS = 50.0


def ngram_buckets(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every run of ``WIDTH`` bytes inside a text, and their n + 1 offsets by text."""
    size = np.maximum(np.diff(off) - (WIDTH - 1), 0)
    out = np.concatenate([[0], np.cumsum(size)])
    n = len(raw) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    code = np.zeros(n, np.uint32)
    for i in range(WIDTH):
        code = (code << np.uint32(8)) | raw[i : n + i]
    inside = np.ones(n, bool)
    for i in range(1, WIDTH):
        cut = off[1:-1] - i
        inside[cut[(cut >= 0) & (cut < n)]] = False
    short = np.flatnonzero((np.diff(off) < WIDTH) & (np.diff(off) > 0))
    for s in short:
        inside[off[s] : min(off[s + 1], n)] = False
    return ((code[inside] * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64), out


def gumbel(ids: list, seed: int = SEED) -> np.ndarray:
    """A Gumbel variate of each id's hash; null ids share one."""
    h = mix(np.array([hash_id(i) for i in ids], np.uint64) ^ mix(np.array([seed], np.uint64)))
    u = ((h >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
    return -np.log(-np.log(u))


def hash_id(value) -> int:
    """64 bits of an id of any type, all of it."""
    return 0 if value is None else int.from_bytes(hashlib.blake2b(str(value).encode(), digest_size=8).digest(), "little")


def ordered(keys: np.ndarray) -> np.ndarray:
    """Longs that sort as the doubles do."""
    bits = (keys + 0.0).view(np.int64)
    return np.where(bits < 0, np.int64(-(2**63)) - bits - 1, bits) if len(bits) else bits


class Ratio:
    """Log ratios of the hashed n-grams, target over raw, with add-one smoothing at the target's total."""

    def __init__(self, table: np.ndarray, ngrams: float = NGRAMS):
        self.table, self.ngrams = table, ngrams

    @classmethod
    def of_counts(cls, raw: np.ndarray, target: np.ndarray) -> Ratio:
        return cls(np.log1p(target) - np.log1p(raw * (target.sum() / max(raw.sum(), 1))))

    def weigh(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Log weights of texts, and tempered ones."""
        out, size = [np.zeros(0)], [np.zeros(0)]
        for a, b in slices(column):
            at, off = ngram_buckets(*text_buffers(column.slice(a, b - a)))
            total = np.concatenate([[0.0], np.cumsum(self.table[at])])
            out.append(total[off[1:]] - total[off[:-1]])
            size.append(np.diff(off))
        weight = np.concatenate(out)
        return weight, weight * np.minimum(1.0, self.ngrams / np.maximum(np.concatenate(size), 1))


def labelled_good(labels: DataFrame, id_col: str, good: str, bound: int = LABELLED) -> tuple[DataFrame, float | None]:
    """Ids of good labelled rows, at most ``bound``, and the share of good ones among all labelled rows.

    ``good`` is an SQL predicate over ``labels``; an id counts once, as good only if all its rows are.
    """
    marked = labels.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(F.coalesce(F.expr(good).cast("int"), F.lit(0))).alias("good"))
    share, good_rows = marked.agg(F.avg("good"), F.sum("good")).first()
    return marked.where((F.col("good") == 1) & drawn(F.col(id_col), good_rows or 0, bound)).select(id_col), share


def fit_ratio(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Ratio:
    """Both models, counted over whole texts; ``target_ids`` is bounded and broadcast."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            good = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for a, b in slices(batch.column(0)):
                at, off = ngram_buckets(*text_buffers(batch.column(0).slice(a, b - a)))
                raw += np.bincount(at, minlength=BUCKETS)
                target += np.bincount(at[np.repeat(good[a:b], np.diff(off))], minlength=BUCKETS)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(used, pa.int32()), "raw": raw[used], "target": target[used]})

    flag = F.broadcast(target_ids.select(F.col(id_col).alias("id"), F.lit(True).alias("good")))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(flag, "id", "left")
    rows = rows.select("text", F.coalesce("good", F.lit(False)).alias("good"))
    counted = rows.mapInArrow(count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counted.collect():  # at most BUCKETS rows
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    return Ratio.of_counts(raw, target)


def keyed(docs: DataFrame, ratio: Ratio, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, ngrams: float = NGRAMS) -> DataFrame:
    """``(<id_col>, log_weight, place)``: place sorts as tempered log weight plus Gumbel variate."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio.table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Ratio(shared.value, ngrams)
        for batch in batches:
            w, tempered = model.weigh(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(w), pa.array(ordered(tempered + gumbel(batch.column(0).to_pylist(), seed)))], names=["id", "log_weight", "place"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, log_weight double, place long")
    return out.withColumnRenamed("id", id_col)


def kth_largest(places: DataFrame, k: int) -> int:
    """The k-th largest value of the long column ``place`` by radix selection: four counting passes."""
    floor, rows, left = 0, places.select((F.col("place").bitwiseXOR(F.lit(-(2**63)))).alias("p")), k
    for shift in (48, 32, 16, 0):
        digit = F.shiftrightunsigned("p", shift).bitwiseAND(F.lit(0xFFFF)).cast("int")
        counts = sorted(((r[0], r[1]) for r in rows.groupBy(digit.alias("d")).count().collect()), reverse=True)  # at most 65536 rows
        for d, n in counts:
            if left <= n:
                break
            left -= n
        floor |= d << shift
        rows = rows.where(digit == d)
    return floor - 2**63


def select(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", good: str = "quality = 1", share: float | None = None, seed: int = SEED, ngrams: float = NGRAMS, scratch: Scratch | None = None) -> DataFrame:
    """``(<id_col>, log_weight, kept)``, one row per input row.

    ``share`` of the rows are drawn, by default the share of good labels. Rows that tie with the last
    drawn place are kept too (repeated rows have one place). Texts of any length are counted and weighed whole; those shorter
    than an n-gram, empty and null texts weigh 0. Without a labelled row everything is kept with weight 0. A null
    id is no label's; its row takes part. Ids of any type. Other columns are ignored; an empty table gives an
    empty result.
    """
    scratch = scratch or Scratch(docs.sparkSession, "quality")
    ids, labelled_share = labelled_good(labels, id_col, good)
    if labelled_share is None:
        return docs.select(id_col, F.lit(0.0).alias("log_weight"), F.lit(True).alias("kept"))
    places = scratch.save(keyed(docs, fit_ratio(docs, ids, id_col, text_col), id_col, text_col, seed, ngrams), "places")
    k = round(places.count() * (labelled_share if share is None else share))
    if k == 0:
        return places.select(id_col, "log_weight", F.lit(False).alias("kept"))
    return places.select(id_col, "log_weight", (F.col("place") >= kth_largest(places, k)).alias("kept"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", good: str = "quality = 1", share: float | None = None, seed: int = SEED, ngrams: float = NGRAMS, scratch: Scratch | None = None) -> DataFrame:
    """The rows of ``docs`` that ``select`` keeps, with all their columns; see there for nulls, ties and empty tables.

    The threshold is one number, so each row is weighed again where it is read: no text is shuffled.
    """
    scratch = scratch or Scratch(docs.sparkSession, "quality")
    ids, labelled_share = labelled_good(labels, id_col, good)
    if labelled_share is None:
        return docs
    ratio = fit_ratio(docs, ids, id_col, text_col)
    places = scratch.save(keyed(docs, ratio, id_col, text_col, seed, ngrams).select("place"), "places")
    k = round(places.count() * (labelled_share if share is None else share))
    least = kth_largest(places, k) if k else 2**63 - 1
    scratch.drop(places)
    shared = docs.sparkSession.sparkContext.broadcast(ratio.table)
    i, t = docs.columns.index(id_col), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Ratio(shared.value, ngrams)
        for batch in batches:
            place = ordered(model.weigh(batch.column(t))[1] + gumbel(batch.column(i).to_pylist(), seed))
            yield batch.filter(pa.array(place >= least))

    return docs.mapInArrow(run, docs.schema)
