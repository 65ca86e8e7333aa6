"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

The tree of a word holds ``rank << SHIFT | position`` of every adjacent pair of symbols. Its root is
the leftmost pair of lowest rank; a merge changes at most three leaves, each with a logarithmic
path to the root. Words of a batch run in step as numpy columns of one tree array; words of over
``LONG`` bytes run one by one on the same tree in plain lists.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.scratch import small_batches
from inkwell.llm.tokens import _BYTE, _LOW, mix, slices, text_buffers

LONG = 64
SHIFT = 32
NONE = np.int64(1) << np.int64(62)
CACHE = 300_000
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point, for the pre-tokeniser's pattern."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        major = unicodedata.category(chr(c))[0]
        out[c] = LETTER if major == "L" else NUMBER if major == "N" else OTHER
    for a, b in ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
        out[a : b + 1] = SPACE
    return out


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte: printable Latin-1 for itself, others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizer:
    """Encoder and decoder made of the text of a byte-level BPE tokenizer file."""

    def __init__(self, spec: str):
        raw = json.loads(spec)
        model, alphabet = raw["model"], byte_alphabet()
        vocab = model["vocab"]
        self.added = {t["content"]: t["id"] for t in raw.get("added_tokens", [])}
        size = max([*vocab.values(), *self.added.values()]) + 1
        table = [b""] * size
        for token, i in vocab.items():
            table[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        for token, i in self.added.items():
            table[i] = token.encode()
        self.table = table
        self.table_len = np.array([len(t) for t in table], np.int64)
        self.table_off = np.concatenate([[0], np.cumsum(self.table_len)])
        self.table_raw = np.frombuffer(b"".join(table), np.uint8)
        self.of_byte = np.zeros(256, np.int64)
        for c, b in alphabet.items():
            self.of_byte[b] = vocab[c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.size = size
        keys = np.array([vocab[a] * size + vocab[b] for a, b in pairs], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_at = keys[order], order.astype(np.int64)
        self.ranks = dict(zip(keys.tolist(), range(len(keys))))
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat = np.zeros(0, np.int32)
        self.at = np.zeros(1, np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[i] == key, self.rank_at[i], -1)

    def encode_words(self, words: list[bytes]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """An order of the words, all their ids in that order, and the count of each."""
        order: list[int] = []
        ids: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        by_leaves: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) > LONG:
                order.append(i)
                ids.append(self._encode_long(w))
                counts.append(np.array([len(ids[-1])]))
            else:
                by_leaves.setdefault(1 << (len(w) - 1).bit_length(), []).append(i)
        for leaves, members in by_leaves.items():
            for k in range(0, len(members), 16384):
                part = members[k : k + 16384]
                flat, count = self._encode_batch([words[i] for i in part], leaves)
                order += part
                ids.append(flat)
                counts.append(count)
        return order, np.concatenate(ids), np.concatenate(counts)

    def _encode_batch(self, words: list[bytes], leaves: int) -> tuple[np.ndarray, np.ndarray]:
        n, width = len(words), leaves + 1
        size = np.array([len(w) for w in words])
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        sym = self.of_byte[raw]
        inside = np.arange(width)[None, :] < size[:, None]
        nxt = np.tile(np.arange(1, width + 1), (n, 1))
        prev = np.tile(np.arange(-1, width - 1), (n, 1))
        rank = np.where(inside[:, 1:], self.rank(sym[:, :-1], sym[:, 1:]), -1)
        tree = np.full((n, 2 * leaves), NONE)
        tree[:, leaves:] = np.where(rank >= 0, rank << SHIFT | np.arange(leaves), NONE)
        for k in range(leaves - 1, 0, -1):
            tree[:, k] = np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1])
        alive = inside.copy()

        def put(rows: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
            k = leaf + leaves
            tree[rows, k] = value
            while leaves > 1 and k[0] > 1:  # all paths have one length
                k = k >> 1
                tree[rows, k] = np.minimum(tree[rows, 2 * k], tree[rows, 2 * k + 1])

        rows = np.flatnonzero(tree[:, 1] < NONE)
        while len(rows):
            root = tree[rows, 1]
            p = root & ((1 << SHIFT) - 1)
            gone = nxt[rows, p]
            after = nxt[rows, gone]
            sym[rows, p] = self.merged[root >> SHIFT]
            alive[rows, gone] = False
            nxt[rows, p] = after
            more = after < size[rows]
            prev[rows[more], after[more]] = p[more]
            inner = gone < leaves
            put(rows[inner], gone[inner], np.full(inner.sum(), NONE)) if inner.any() else None
            r = np.full(len(rows), -1)
            r[more] = self.rank(sym[rows[more], p[more]], sym[rows[more], after[more]])
            put(rows, p, np.where(r >= 0, r << SHIFT | p, NONE))
            before = prev[rows, p]
            has = before >= 0
            if has.any():
                r = self.rank(sym[rows[has], before[has]], sym[rows[has], p[has]])
                put(rows[has], before[has], np.where(r >= 0, r << SHIFT | before[has], NONE))
            rows = rows[tree[rows, 1] < NONE]
        return sym[alive].astype(np.int32), alive.sum(axis=1)

    def _encode_long(self, word: bytes) -> np.ndarray:
        sym = self.of_byte[np.frombuffer(word, np.uint8)].tolist()
        n, ranks, size, none = len(sym), self.ranks, self.size, int(NONE)
        leaves = 1 << (n - 1).bit_length()
        tree = [none] * (2 * leaves)
        for i in range(n - 1):
            r = ranks.get(sym[i] * size + sym[i + 1])
            if r is not None:
                tree[leaves + i] = r << SHIFT | i
        for k in range(leaves - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        nxt, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n

        def put(leaf: int, value: int) -> None:
            k = leaf + leaves
            tree[k] = value
            while k > 1:
                k >>= 1
                low = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == low:
                    break
                tree[k] = low

        while tree[1] < none:
            p = tree[1] & ((1 << SHIFT) - 1)
            gone = nxt[p]
            after = nxt[gone]
            sym[p] = int(self.merged[tree[1] >> SHIFT])
            alive[gone] = False
            nxt[p] = after
            put(gone, none)
            r = None
            if after < n:
                prev[after] = p
                r = ranks.get(sym[p] * size + sym[after])
            put(p, none if r is None else r << SHIFT | p)
            if prev[p] >= 0:
                r = ranks.get(sym[prev[p]] * size + sym[p])
                put(prev[p], none if r is None else r << SHIFT | prev[p])
        return np.array([s for s, a in zip(sym, alive) if a], np.int32)

    def _lookup(self, words: list[bytes]) -> np.ndarray:
        """Cache rows of words; unknown ones are encoded in one batch."""
        known = self.known
        new = [w for w in dict.fromkeys(words) if w not in known]
        if new:
            base = len(known)
            order, ids, counts = self.encode_words(new)
            known.update((new[i], base + k) for k, i in enumerate(order))
            self.flat = np.concatenate([self.flat, ids])
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(counts)])
        return np.array([known[w] for w in words], np.int64)

    def encode_buffers(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a buffer, and the n + 1 id offsets by text. Added tokens aren't looked for."""
        if len(self.known) > CACHE:
            self._clear()
        starts, ends = pretokens(raw, off)
        if len(starts) == 0:
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        size = ends - starts
        key = _word_keys(raw, starts, size)
        long = np.flatnonzero(size > LONG)
        key[long] = np.arange(len(long), dtype=np.uint64)  # equal hashes of long words aren't trusted
        key[long] |= np.uint64(1) << np.uint64(63)
        key[size <= LONG] &= ~(np.uint64(1) << np.uint64(63))
        _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        data = raw.tobytes()
        row = self._lookup([data[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())])[inverse]
        count = self.at[row + 1] - self.at[row]
        total = np.concatenate([[0], np.cumsum(count)])
        ids = self.flat[np.arange(total[-1]) + np.repeat(self.at[row] - total[:-1], count)]
        return ids, total[np.searchsorted(starts, off)]

    def encode(self, text: str) -> np.ndarray:
        """Ids of one text as the library gives them, added tokens in it included."""
        out, rest = [], text
        while rest:
            found = [(i, -len(t), t) for t in self.added if (i := rest.find(t)) >= 0]
            i, _, token = min(found, default=(len(rest), 0, ""))
            if i:
                raw = np.frombuffer(rest[:i].encode(), np.uint8)
                out.append(self.encode_buffers(raw, np.array([0, len(raw)]))[0])
            if token:
                out.append(np.array([self.added[token]], np.int32))
            rest = rest[i + len(token) :]
        return np.concatenate(out) if out else np.zeros(0, np.int32)

    def decode_bytes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of a run of ids, and the n + 1 byte offsets by id."""
        size = self.table_len[ids]
        total = np.concatenate([[0], np.cumsum(size)])
        return self.table_raw[np.arange(total[-1]) + np.repeat(self.table_off[ids] - total[:-1], size)], total

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that form no UTF-8 become U+FFFD."""
        return self.decode_bytes(np.asarray(ids, np.int64))[0].tobytes().decode("utf-8", "replace")


def _word_keys(raw: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit keys of adjoining words that cover the buffer."""
    k = np.arange(len(raw)) - np.repeat(starts, size)
    # upper and lower case differ here: the byte itself joins its table value
    term = (_BYTE[raw] ^ (raw.astype(np.uint64) << np.uint64(17))) * _LOW[k & 0xFFF]
    return mix(np.add.reduceat(term, starts) + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def pretokens(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of the pre-tokeniser's words of all texts in a buffer of valid UTF-8.

    The rules, for runs of letters, of numbers, of spaces and of others: a run takes one U+0020 before
    it along; of other spaces before a run the last stands alone; an apostrophe that begins a word,
    alone in its run, takes s, t, m, d, re, ve or ll from the letters behind it.
    """
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero((raw & 0xC0) != 0x80)
    code = raw[at].astype(np.int64)
    wide = np.flatnonzero(code >= 0x80)
    if len(wide):
        p, lead = at[wide], code[wide]
        tail = lambda i: raw[np.minimum(p + i, n - 1)].astype(np.int64) & 0x3F
        two, three, four = ((lead & 0x1F) << 6) | tail(1), ((lead & 0x0F) << 12) | (tail(1) << 6) | tail(2), ((lead & 0x07) << 18) | (tail(1) << 12) | (tail(2) << 6) | tail(3)
        code[wide] = np.where(lead < 0xE0, two, np.where(lead < 0xF0, three, four))
    kind = _classes()[np.minimum(code, 0x10FFFF)]
    m = len(code)
    text_start = np.zeros(m + 1, dtype=bool)
    text_start[np.searchsorted(at, off[:-1])] = True
    text_start[m] = True
    run = text_start[:m].copy()
    run[1:] |= kind[1:] != kind[:-1]
    begin = run.copy()
    # a run of spaces before another run of the same text
    solid = np.flatnonzero(run & (kind != SPACE) & ~text_start[:m])
    solid = solid[kind[solid - 1] == SPACE]
    begin[solid - 1] = True
    plain = solid[code[solid - 1] == 0x20]
    begin[plain] = False
    # contractions
    quote = np.flatnonzero((code == 0x27) & begin)
    follows = lambda i, j: (i + j < m) & ~text_start[np.minimum(i + j, m)]
    quote = quote[follows(quote, 1)]
    one = code[quote + 1]
    two = np.where(follows(quote, 2) & follows(quote, 1), code[np.minimum(quote + 2, m - 1)], -1)
    single = np.isin(one, [ord(c) for c in "stmd"])
    double = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    for hit, length in ((single, 2), (double & ~single, 3)):
        q = quote[hit]
        begin[q + 1] = False
        end = q + length
        end = end[end < m]
        inner = end[kind[end] == LETTER]
        begin[inner] = True
    starts = at[begin]
    return starts, np.append(starts[1:], n)


def tokenize(docs: DataFrame, spec: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(<id_col>, ids array<int>, decoded string)`` of every row.

    ``spec`` is the text of a tokenizer file (byte-level BPE, no normaliser); it is sent to the tasks
    as a broadcast of the file's fixed size. Ids are those of the library without special tokens
    added; an added token that stands in a text is one id. ``decoded`` is decoded from the ids alone.

    Null or empty text: no ids, empty text. A null id and repeated rows stay as they are. Other
    columns are ignored; an empty table gives an empty result. A row depends on nothing but its
    own text, so a lost task is simply run again.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Tokenizer(shared.value)
        marks = [t.encode() for t in coder.added]
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                raw, off = text_buffers(part.column(1))
                data = raw.tobytes()
                if any(m in data for m in marks):
                    each = [coder.encode(data[x:y].decode()) for x, y in zip(off[:-1], off[1:])]
                    ids = np.concatenate(each)
                    ioff = np.concatenate([[0], np.cumsum([len(x) for x in each])])
                else:
                    ids, ioff = coder.encode_buffers(raw, off)
                text, at = coder.decode_bytes(ids)
                toff = at[ioff]
                data = text.tobytes()
                decoded = [data[x:y].decode("utf-8", "replace") for x, y in zip(toff[:-1].tolist(), toff[1:].tolist())]
                yield pa.RecordBatch.from_pydict({"id": part.column(0), "ids": pa.ListArray.from_arrays(pa.array(ioff, pa.int32()), pa.array(ids, pa.int32())), "decoded": pa.array(decoded, pa.string())})

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, ids array<int>, decoded string")
    return out.select(F.col("id").alias(id_col), "ids", "decoded")
