"""The bigram model of ``kneser`` fitted on a corpus and asked by the same corpus, by packed rows.

Texts are gathered in chunks of about ``CHUNK`` words. A chunk sends each of its distinct pairs of words once, with its count, to the
bucket of the pair; the bucket adds up what all chunks sent and answers each with the sums. What the model has to know of
a word by itself, its uses and distinct neighbours, goes from the buckets to buckets of words and from there to the chunks that have the word. Then
each chunk scores its texts. Words are 64-bit hashes, sorted and sent as differences, so that a pair costs some 8 bytes a chunk
and not a row for each of its uses; no word or pair is hot. n distinct words share a hash with a chance of n * n / 2^65.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.operators.kneser import DISCOUNT, START, TOKENS
from inkwell.operators.scopes import _word_characters, code_points, slices, whole
from inkwell.operators.tables import small_batches, stored

#: Least words of a chunk and least entries of a bucket; entries of a row where the corpus asks for more of both.
CHUNK, BUCKET, ROW = 3_000_000, 2_000_000, 100


def plan(words: int) -> tuple[int, int, int]:
    """Words of a chunk, and rows and columns of the buckets: a pair goes by its first word and its second one."""
    grow = max(1.0, (ROW * words / (CHUNK * BUCKET)) ** 0.5)
    buckets = max(8, math.ceil(words / (BUCKET * grow)))
    columns = math.isqrt(buckets)
    return int(CHUNK * grow), -(-buckets // columns), columns


def pack(x: np.ndarray) -> bytes:
    """Unsigned integers as compressed byte planes."""
    x = np.ascontiguousarray(x.astype(np.uint64))
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + len(x).to_bytes(6, "little") + pa.Codec("zstd", 1).compress(planes.tobytes(), asbytes=True)


def unpack(raw: bytes) -> np.ndarray:
    width, n = raw[0], int.from_bytes(raw[1:7], "little")
    planes = np.frombuffer(pa.Codec("zstd", 1).decompress(raw[7:], width * n, asbytes=True), np.uint8).reshape(width, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = planes.T
    return out.view(np.uint64).ravel()


def _steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=np.uint64(0))


def _hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


BEGIN = np.uint64(_hash(START.encode()))


def tokens(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words and marks of ``kneser.word_array``, and of the sentences with any: how many each has, its number of runs of
    non-space characters, the place of its text."""
    data, points, width, first = code_points(texts)
    n, heads = len(points), first[first < len(points)]
    space = (points == 32) | ((points >= 9) & (points <= 13))
    word = _word_characters()[points]
    opens, runs = ~space, ~space
    opens[1:] &= ~(word[1:] & word[:-1])
    runs[1:] &= space[:-1]
    opens[heads] = runs[heads] = ~space[heads]
    begins = np.zeros(n, bool)
    begins[1:] = space[1:] & ~space[:-1] & ((points[:-1] == 46) | (points[:-1] == 33) | (points[:-1] == 63))
    begins[heads] = True
    sentence = np.cumsum(begins) - 1
    size = ~space if width is None else np.where(space, 0, width)
    ends = np.cumsum(size, dtype=np.int64)
    at = np.flatnonzero(opens)
    offsets = np.append((ends - size)[at], ends[-1] if n else 0).astype(np.int32)
    kept = data[~space if width is None else np.repeat(~space, width)]
    found = pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(kept)]).dictionary_encode()
    hashes = np.array([_hash(w) for w in found.dictionary.to_pylist()], np.uint64)[found.indices.to_numpy()]
    own, start, length = np.unique(sentence[at], return_index=True, return_counts=True)
    text = np.searchsorted(first, at[start], "right") - 1
    return hashes, length, np.bincount(sentence[runs], minlength=int(sentence[-1]) + 1 if n else 0)[own], text


def _numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers in order and the place of each there, in half the memory that ``np.unique`` takes."""
    order = np.argsort(x)
    x = x[order]
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    place = np.empty(len(x), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    return x[new], place


CHUNKS = "chunk long, ids array<{}>, sents binary, lens binary, long binary, words binary, common binary, vocabulary binary"


def _chunks(rows: DataFrame, most: int, least_words: int) -> DataFrame:
    kind = rows.schema.fields[0].dataType.simpleString()
    names = [c.split()[0] for c in CHUNKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, serial, held = TaskContext.get().partitionId(), 0, 0
        parts: list[list] = [[], [], [], [], []]

        def out() -> pa.RecordBatch:
            ids = pa.concat_arrays(parts[0])
            hashes, lens, long, sents = (np.concatenate(p) for p in parts[1:])
            vocabulary = np.unique(np.append(hashes, BEGIN))
            words = np.searchsorted(vocabulary, hashes)
            # written as ranks by frequency, most of which are small
            common = np.argsort(-np.bincount(words, minlength=len(vocabulary)), kind="stable")
            rank = np.empty(len(common), np.int64)
            rank[common] = np.arange(len(common))
            packed = [pack(sents), pack(lens), pack(long), pack(rank[words]), pack(common), pack(_steps(vocabulary))]
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + serial]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *(pa.array([p], pa.binary()) for p in packed)], names=names)

        for batch in batches:
            texts = batch.column(1)
            for a, b in slices(np.diff(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1])):
                hashes, lens, runs, text = tokens(texts.slice(a, b - a))
                for p, x in zip(parts, (batch.column(0).slice(a, b - a), hashes, lens, runs >= least_words, np.bincount(text, minlength=b - a))):
                    p.append(x)
                held += len(hashes)
                if held >= most:
                    yield out()
                    parts, held, serial = [[], [], [], [], []], 0, serial + 1
        if parts[0]:
            yield out()

    return rows.mapInArrow(run, CHUNKS.format(kind))


class Chunk:
    """Words of some texts as places in a sorted vocabulary of hashes, and their pairs."""

    def __init__(self, row: dict):
        self.sents, self.lens, self.long = (unpack(row[c]).astype(np.int64) for c in ("sents", "lens", "long"))
        self.words = unpack(row["common"]).astype(np.int32)[unpack(row["words"]).astype(np.int32)]
        self.vocabulary = np.cumsum(unpack(row["vocabulary"]), dtype=np.uint64)
        self.start = np.cumsum(self.lens) - self.lens  # of sentences
        by = np.concatenate([[0], np.cumsum(self.lens)])[np.concatenate([[0], np.cumsum(self.sents)])]
        self.text_start, self.text_lens = by[:-1], np.diff(by)

    def pairs(self, rows: int, columns: int) -> None:
        """Sets ``first`` and ``second``, places of the distinct pairs by bucket and hash, ``cuts`` between buckets, ``count`` in the sentences,
        ``own``, each word's pair in its sentence, ``joints`` and ``joint``, words that begin a later sentence of a text's first ``TOKENS`` words and their pairs there."""
        v, n = self.vocabulary, len(self.vocabulary)
        before = np.roll(self.words, 1)
        before[self.start] = np.searchsorted(v, BEGIN)
        text = np.repeat(np.arange(len(self.sents)), self.sents)
        later = self.start - self.text_start[text]
        self.joints = self.start[(later > 0) & (later < TOKENS)]
        before = np.concatenate([before, self.words[self.joints - 1]]).astype(np.int64)
        before *= n
        before += np.concatenate([self.words, self.words[self.joints]])
        keys, place = _numbered(before)
        count = np.bincount(place[: len(self.words)], minlength=len(keys))
        a, b = np.divmod(keys, n)
        bucket = (v[a] % np.uint64(rows)).astype(np.int64) * columns + (v[b] % np.uint64(columns)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        back = np.empty(len(order), np.int32)
        back[order] = np.arange(len(order))
        self.first, self.second, self.count = a[order], b[order], count[order]
        self.own, self.joint = np.split(back[place], [len(self.words)])
        self.cuts = np.searchsorted(bucket[order], np.arange(rows * columns + 1))


def _by_word(words: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Buckets of sorted words and the places of those in each."""
    at = (words % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    cuts = np.searchsorted(at[order], np.arange(buckets + 1))
    for b in range(buckets):
        if cuts[b] < cuts[b + 1]:
            yield b, order[cuts[b] : cuts[b + 1]]


PACKED = "bucket int, chunk long, kind int, a binary, b binary, c binary, d binary, x long, y long"
_KINDS = (pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 4, pa.int64(), pa.int64())


def _table(rows: list[tuple]) -> pa.Table:
    columns = zip(*rows) if rows else [[]] * len(_KINDS)
    return pa.table([pa.array(c, t) for c, t in zip(columns, _KINDS)], names=[c.split()[0] for c in PACKED.split(", ")])


def _ask(rows: int, columns: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                c = Chunk(row)
                c.pairs(rows, columns)
                out = []
                for b, (x, y) in enumerate(zip(c.cuts[:-1].tolist(), c.cuts[1:].tolist())):
                    if y == x:
                        continue
                    first, second = c.first[x:y], c.vocabulary[c.second[x:y]]
                    new = np.flatnonzero(np.diff(first, prepend=-1))
                    step = _steps(second)
                    step[new] = second[new]  # each first word's begin anew
                    out.append((b, row["chunk"], 0, pack(_steps(c.vocabulary[first[new]])), pack(np.diff(np.append(new, y - x))), pack(step), pack(c.count[x:y]), 0, 0))
                yield from _table(out).to_batches()

    return run


def _asked(a: bytes, b: bytes, c: bytes) -> tuple[np.ndarray, np.ndarray]:
    first, runs, step = np.cumsum(unpack(a), dtype=np.uint64), unpack(b).astype(np.int64), unpack(c)
    total = np.cumsum(step, dtype=np.uint64)
    start = np.cumsum(runs) - runs
    return np.repeat(first, runs), total - np.repeat(total[start] - step[start], runs)


def _answer(buckets: int):
    """Sums of a bucket's pairs for each chunk, and what they say of their words for the buckets of words."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.select(["bucket", "chunk", "a", "b", "c", "d"]).to_pylist()
        sides = [_asked(r["a"], r["b"], r["c"]) for r in rows]
        cuts = np.concatenate([[0], np.cumsum([len(s[0]) for s in sides])])
        first, second = (np.concatenate(s) for s in zip(*sides))
        order = np.lexsort((second, first))
        f, s = first[order], second[order]
        new = np.ones(len(f), bool)
        new[1:] = (f[1:] != f[:-1]) | (s[1:] != s[:-1])
        place = np.empty(len(f), np.int64)
        place[order] = np.cumsum(new) - 1
        total = np.bincount(place, np.concatenate([unpack(r["d"]) for r in rows])).astype(np.int64)
        out = [(r["bucket"], r["chunk"], 0, pack(total[place[a:b]]), None, None, None, 0, 0) for r, a, b in zip(rows, cuts[:-1], cuts[1:])]
        seen = total > 0
        f, s, total = f[new][seen], s[new][seen], total[seen]
        words, at = np.unique(np.concatenate([f, s]), return_inverse=True)
        uses = np.bincount(at[: len(f)], total, minlength=len(words)).astype(np.int64)
        behind, ahead = np.bincount(at[: len(f)], minlength=len(words)), np.bincount(at[len(f) :], minlength=len(words))
        out += [(b, None, 1, pack(_steps(words[i])), pack(uses[i]), pack(behind[i]), pack(ahead[i]), 0, 0) for b, i in _by_word(words, buckets)]
        return _table(out)

    return run


def _ask_words(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = np.cumsum(unpack(raw), dtype=np.uint64)
                yield from _table([(b, chunk, 1, pack(_steps(words[i])), None, None, None, 0, 0) for b, i in _by_word(words, buckets)]).to_batches()

    return run


def _answer_words(key: tuple, asked: pa.Table, parts: pa.Table) -> pa.Table:
    """Uses as a first word and distinct neighbours behind and ahead of each asked word, and the numbers of distinct pairs and second words of the bucket."""
    rows = parts.select(["a", "b", "c", "d"]).to_pylist()
    every = np.concatenate([np.zeros(0, np.uint64), *(np.cumsum(unpack(r["a"]), dtype=np.uint64) for r in rows)])
    words, at = np.unique(every, return_inverse=True)
    sums = [np.append(np.bincount(at, np.concatenate([np.zeros(0, np.uint64), *(unpack(r[c]) for r in rows)]), minlength=len(words)).astype(np.int64), 0) for c in "bcd"]
    out = [(key[0].as_py(), None, 2, None, None, None, None, int(sums[2].sum()), int((sums[2] > 0).sum()))]
    for bucket, chunk, raw in zip(*(asked.column(c).to_pylist() for c in ("bucket", "chunk", "a"))):
        own = np.cumsum(unpack(raw), dtype=np.uint64)
        i = np.searchsorted(words, own)
        i[np.append(words, np.uint64(0))[i] != own] = len(words)
        out.append((bucket, chunk, 1, *(pack(s[i]) for s in sums), None, 0, 0))
    return _table(out)


def _score(rows: int, columns: int, buckets: int, pairs: int, kinds: int, names: list[str]):
    even = 1.0 / (kinds + 1)
    share = DISCOUNT * kinds / pairs if pairs else 1.0

    def mean(q: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Perplexities in whole ten-thousandths."""
        return whole(np.exp(q / (np.maximum(n, 1) * 1e6)) * 1e4)

    def run(key: tuple, chunks: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        got: dict[int, dict] = {0: {}, 1: {}}
        for r in answers.select(["bucket", "kind", "a", "b", "c"]).to_pylist():
            got[r["kind"]][r["bucket"]] = r
        for i in range(len(chunks)):
            row = chunks.slice(i, 1)
            c = Chunk(row.drop_columns(["ids"]).to_pylist()[0])
            c.pairs(rows, columns)
            count = np.concatenate([np.zeros(0, np.uint64), *(unpack(got[0][b]["a"]) for b in range(rows * columns) if c.cuts[b] < c.cuts[b + 1])]).astype(np.int64)
            uses, behind, ahead = np.zeros((3, len(c.vocabulary)), np.int64)
            for b, at in _by_word(c.vocabulary, buckets):
                for x, side in zip((uses, behind, ahead), "abc"):
                    x[at] = unpack(got[1][b][side])
            p = np.maximum(ahead - DISCOUNT, 0.0) / float(max(pairs, 1)) + share * even
            rest = np.where(uses > 0, DISCOUNT * behind / np.maximum(uses, 1), 1.0)
            a, w = c.first, c.second
            found = np.where(count > 0, np.maximum(count - DISCOUNT, 0.0) / np.maximum(uses[a], 1) + rest[a] * p[w], rest[a] * p[w])
            q = whole(-np.log(found) * 1e6)
            # sums of whole millionths over the first words of sentences and texts
            inner = q[c.own]
            upto = np.concatenate([[0], np.cumsum(inner)])
            n = np.minimum(c.lens, TOKENS)
            scored = mean(upto[c.start + n] - upto[c.start], n)
            inner[c.joints] = q[c.joint]
            upto = np.concatenate([[0], np.cumsum(inner)])
            m = np.minimum(c.text_lens, TOKENS)
            whole_text = mean(upto[c.text_start + m] - upto[c.text_start], m)
            kept = np.flatnonzero((c.long > 0) & (n >= 2))
            text = np.repeat(np.arange(len(c.sents)), c.sents)[kept]
            cuts = np.searchsorted(text, np.arange(len(c.sents) + 1)).tolist()
            values, sizes, spread = scored[kept].tolist(), np.diff(cuts), np.zeros(len(c.sents))
            for k in np.flatnonzero(sizes > 1).tolist():
                own = values[cuts[k] : cuts[k + 1]]
                spread[k] = float(len(own) * sum(x * x for x in own) - sum(own) ** 2) ** 0.5 / (len(own) * 1e4)
            at = np.flatnonzero(m >= 2)
            ids = row.column("ids").combine_chunks().flatten().take(pa.array(at))
            out.append(pa.table([ids, pa.array(sizes[at], pa.int64()), pa.array(whole_text[at] / 1e4), pa.array(whole(spread[at] * 1e6) / 1e6)], names=names))
        return pa.concat_tables(out) if out else pa.table([pa.array([], chunks.schema.field("ids").type.value_type), pa.array([], pa.int64()), pa.array([], pa.float64()), pa.array([], pa.float64())], names=names)

    return run


def corpus_perplexity(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 4) -> DataFrame:
    """The rows of ``kneser.document_perplexity`` under the bigram model of the documents' own sentences."""
    from inkwell.operators.style import perplexity_score

    small_batches(docs.sparkSession)
    rows = docs.select(id_col, F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    most, across, columns = plan(size // 5)
    buckets = max(8, across * columns // 4)
    chunks = stored(_chunks(rows, most, least_words), "perplexity-chunks")
    answers = stored(chunks.mapInArrow(_ask(across, columns), PACKED).groupBy("bucket").applyInArrow(_answer(buckets), PACKED), "perplexity-pairs")
    asked = chunks.select("chunk", "vocabulary").mapInArrow(_ask_words(buckets), PACKED)
    found = stored(asked.groupBy("bucket").cogroup(answers.where("kind = 1").groupBy("bucket")).applyInArrow(_answer_words, PACKED), "perplexity-words")
    pairs, kinds = found.where("kind = 2").agg(F.coalesce(F.sum("x"), F.lit(0)), F.coalesce(F.sum("y"), F.lit(0))).first()
    names = [id_col, "n_sentences", "perplexity", "spread"]
    told = answers.where("kind = 0").unionByName(found.where("kind = 1"))
    kind = docs.schema[id_col].dataType.simpleString()
    scored = chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_score(across, columns, buckets, pairs, kinds, names), f"{id_col} {kind}, n_sentences long, perplexity double, spread double")
    return scored.withColumn("ai_score", perplexity_score(F.col("perplexity")))
