"""Stupid-backoff language-model scores (Brants et al., 2007) over count tables partitioned by hash.

S(w | v) = c(vw) / c(v) if c(vw) > 0, else BACKOFF * S(w | v') with v' one word shorter, and S(w) = c(w) / N at
the end; a document's score is the sum of ln S over its words, divided by their number. The counts a document is scored with are those of all other documents: its own are taken off.

The join of n-grams with their counts moves packed rows. Documents are gathered in chunks of about
``CHUNK`` words or more; a chunk sends each of its distinct n-grams once, as sorted hashes delta-coded by hash
bucket, so a frequent n-gram costs one entry a chunk and no key is hot. A bucket's task adds up the
entries of all chunks, which is its partition of the count table, and answers each chunk with the
counts of what it sent. The chunk then scores its documents. Row by row, the same join would move
some 30 bytes for each word of the corpus twice; packed, it moves about 5.

A chunk sends one row to each bucket. For rows of ``ROW`` entries, chunk size times bucket size must be about
``ROW`` times the corpus, so both follow the square root of its size, which is estimated from its bytes
in a pass of their own: 1e6 words a chunk up to 2e10 words, 3e7 at 2e13 (1 GB in a task).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.scratch import Scratch
from inkwell.llm.tokens import ngram_hashes, slices, text_buffers, word_hashes

BACKOFF = 0.4
#: Least words of a chunk and least entries of a hash bucket; entries of a row where the corpus asks for more of both.
CHUNK, BUCKET_ENTRIES, ROW = 1_000_000, 2_000_000, 100


def plan(words: int, order: int = 2) -> tuple[int, int]:
    """Words of a chunk and entries of a bucket for a corpus: their product is ``ROW`` times its entries, or more."""
    grow = max(1.0, (ROW * order * words / (CHUNK * BUCKET_ENTRIES)) ** 0.5)
    return int(CHUNK * grow), int(BUCKET_ENTRIES * grow)


def pack(x: np.ndarray) -> bytes:
    """Unsigned integers as compressed byte planes."""
    x = np.ascontiguousarray(x.astype(np.uint64))
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    planes = x.view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(raw: bytes) -> np.ndarray:
    width = raw[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view(np.uint64).ravel()


def _deltas(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=np.uint64(0))


class Chunk:
    """Words of some documents as places in a sorted vocabulary of hashes."""

    def __init__(self, vocabulary: np.ndarray, words: np.ndarray, sizes: np.ndarray):
        self.vocabulary, self.words, self.sizes = vocabulary, words, sizes
        self.off = np.concatenate([[0], np.cumsum(sizes.astype(np.int64))])

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct hashes of the n-grams, and the place of each occurrence in them."""
        if n == 1:
            return self.vocabulary, self.words
        return np.unique(ngram_hashes(self.vocabulary[self.words], self.off, n)[0], return_inverse=True)


def _chunks(rows: DataFrame, most: int) -> DataFrame:
    """``chunk, ids, sizes, words, vocabulary`` rows of about ``most`` words; a document is never cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, serial = TaskContext.get().partitionId(), 0
        ids: list = []
        hashes: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held = 0

        def out() -> pa.RecordBatch:
            vocabulary, place = np.unique(np.concatenate(hashes), return_inverse=True)
            row = [[(part << 32) + serial], [pa.concat_arrays(ids)], [pack(np.concatenate(sizes))], [pack(place)], [pack(_deltas(vocabulary))]]
            return pa.RecordBatch.from_arrays([pa.array(row[0], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(row[1][0])], pa.int32()), row[1][0]), *(pa.array(r, pa.binary()) for r in row[2:])], names=["chunk", "ids", "sizes", "words", "vocabulary"])

        for batch in batches:
            for a, b in slices(batch.column(1)):
                h, off = word_hashes(*text_buffers(batch.column(1).slice(a, b - a)))
                ids.append(batch.column(0).slice(a, b - a).cast(pa.int64()))
                hashes.append(h)
                sizes.append(np.diff(off))
                held += len(h) + (b - a)
                if held >= most:
                    yield out()
                    ids, hashes, sizes, held, serial = [], [], [], 0, serial + 1
        if ids:
            yield out()

    return rows.mapInArrow(run, "chunk long, ids array<long>, sizes binary, words binary, vocabulary binary")


def _open(sizes: bytes, words: bytes, vocabulary: bytes) -> Chunk:
    return Chunk(np.cumsum(unpack(vocabulary), dtype=np.uint64), unpack(words).astype(np.int64), unpack(sizes))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 2, scratch: Scratch | None = None) -> DataFrame:
    """``(<id_col>, n_tokens, n_backoff, score)``, one row per input row.

    Words are those of ``tokens``; n-grams have up to ``order`` of them. A word's context is the ``order`` - 1 words
    before it, as far as its document has them, so the first word is scored by its unigram share c(w) / N. A word that no
    other document has counts as c(w) = 1, N is the number of words of the other documents, at least 1. ``n_backoff``
    counts the words that no other document has after their whole context, if there is one; ``score`` is the mean of ln S over the words.

    Null or empty text, or text without words: 0 words and a null score. A text of any length is one
    document of one chunk. Null ids and repeated rows stay, each row a document of its own. Ids are numbers. Other columns are ignored; an empty table gives an empty
    result; an ``order`` below 1 is an error.
    """
    if order < 1:
        raise ValueError("order must be at least 1")
    scratch = scratch or Scratch(docs.sparkSession, "lm")
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunk, bucket = plan(size // 5, order)
    chunks = scratch.save(_chunks(rows, chunk), "chunks")
    stats = chunks.mapInArrow(_sizes, "words long").agg(F.sum("words")).first()[0] or 0
    buckets = max(8, -(-order * stats // bucket))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, *raw in zip(*(batch.column(c).to_pylist() for c in ("chunk", "sizes", "words", "vocabulary"))):
                c = _open(*raw)
                for n in range(1, order + 1):
                    keys, place = c.grams(n)
                    count = np.bincount(place, minlength=len(keys))
                    # buckets are ranges of the hash, so a sorted list falls into runs
                    bounds = np.searchsorted(keys, (np.arange(1, buckets, dtype=np.uint64) * np.uint64((1 << 64) // buckets))) if buckets > 1 else np.zeros(0, np.int64)
                    cuts = np.concatenate([[0], bounds, [len(keys)]])
                    rows = [(b, chunk, n, pack(_deltas(keys[x:y])), pack(count[x:y])) for b, (x, y) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if y > x]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "chunk", "grams", "keys", "counts"])

    asked = chunks.mapInArrow(ask, "bucket int, chunk long, grams int, keys binary, counts binary")

    def answer(key, table):
        keys = [np.cumsum(unpack(k), dtype=np.uint64) for k in table.column("keys").to_pylist()]
        flat, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, weights=np.concatenate([unpack(c) for c in table.column("counts").to_pylist()]), minlength=len(flat)).astype(np.uint64)
        cuts = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
        found = [pack(total[place[a:b]]) for a, b in zip(cuts[:-1], cuts[1:])]
        return pa.table({"chunk": table.column("chunk"), "grams": table.column("grams"), "bucket": table.column("bucket"), "totals": pa.array(found, pa.binary())})

    answered = asked.groupBy("bucket", "grams").applyInArrow(answer, "chunk long, grams int, bucket int, totals binary")

    def score(key, left, right):
        out: list[pa.Table] = []
        for ids, *raw in zip(*(left.column(c) for c in ("ids", "sizes", "words", "vocabulary"))):
            c = _open(*(r.as_py() for r in raw))
            totals = []
            for n in range(1, order + 1):
                rows = sorted((b, t) for g, b, t in zip(*(right.column(x).to_pylist() for x in ("grams", "bucket", "totals"))) if g == n)
                totals.append(np.concatenate([unpack(t) for _, t in rows]).astype(np.int64) if rows else np.zeros(0, np.int64))
            out.append(_scored(c, totals, stats, ids.values))
        return pa.concat_tables(out) if out else _scored(Chunk(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0)), [np.zeros(0, np.int64)] * order, stats, pa.array([], pa.int64()))

    scored = chunks.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(score, "id long, n_tokens long, n_backoff long, score double")
    return scored.withColumnRenamed("id", id_col)


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_pydict({"words": pa.array([int(unpack(s).sum()) for s in batch.column(batch.schema.get_field_index("sizes")).to_pylist()], pa.int64())})


def _own_counts(doc: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """For each occurrence, how often its document has its n-gram."""
    _, inverse, count = np.unique(doc * max(n, 1) + place, return_inverse=True, return_counts=True)
    return count[inverse]


def _scored(c: Chunk, totals: list[np.ndarray], words: int, ids: pa.Array) -> pa.Table:
    """Scores of a chunk's documents; ``totals`` are the corpus counts of its distinct n-grams by n, ``words`` those of the corpus."""
    n_docs = len(c.sizes)
    size = c.sizes.astype(np.int64)
    doc = np.repeat(np.arange(n_docs), size)
    before = np.arange(len(doc)) - c.off[doc]  # words before it in its document
    others = np.maximum(words - size, 1)
    unseen = np.zeros(len(doc), bool)
    for n, total in enumerate(totals, 1):
        _, place = c.grams(n)
        ends = np.flatnonzero(before >= n - 1)  # the n-grams' last words, in order
        count = np.zeros(len(doc), np.int64)
        count[ends] = total[place] - _own_counts(doc[ends], place, len(total))
        if n == 1:
            s = np.log(np.maximum(count, 1)) - np.log(others[doc])
        else:
            s[ends] += np.log(BACKOFF)
            seen = ends[count[ends] > 0]
            s[seen] = np.log(count[seen]) - np.log(shorter[seen - 1])
            unseen[ends] = count[ends] == 0
        shorter = count
    # sums by document, each begun at 0
    mean = [float(s[a:b].sum() / (b - a)) if b > a else None for a, b in zip(c.off[:-1], c.off[1:])]
    backed = np.bincount(doc[unseen], minlength=n_docs)[:n_docs] if n_docs else np.zeros(0, np.int64)
    return pa.table({"id": ids, "n_tokens": pa.array(size, pa.int64()), "n_backoff": pa.array(backed, pa.int64()), "score": pa.array(mean, pa.float64())})
