"""Packing documents into sequences of one length.

A document's ids are cut into full pieces of the sequence length and one shorter rest. Rests are packed by
first-fit decreasing: the longest first, each into the leftmost bin that holds it, found by walking down a
tournament tree of the bins' free places. Documents are dealt by a hash of their row into groups of
bounded size, which are packed independently of each other.

What first-fit decreasing leaves free is then filled: the emptiest bins of a group are taken apart, and their
pieces, cut where needed, fill the others. Of a group at most one bin stays short; its ids are cut at the binary
digits of their number, since a sequence of a power of two needs no padding.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.bpe import Tokenizer
from inkwell.llm.scratch import small_batches
from inkwell.llm.tiles import over_groups
from inkwell.llm.tokens import mix, slices

#: Bytes of text, and rows, in one group on average: groups hold some half a million ids.
GROUP_BYTES, GROUP_ROWS = 2_000_000, 16_384

# The public pattern that cuts text into words before byte-level merges
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A run of white space that the fast encoder's pattern engine may not hold on its stack.
LONG_SPACE = re.compile(r"\s{2000}")


class Encoder:
    """Ids of texts by the merges of a byte-level BPE file, as the library gives them.

    The fast encoder serves ordinary texts. Texts with an added token in them, or with very long runs of white
    space, go through this library's own tokenizer; so do all if the file's ids don't follow its merges.
    """

    def __init__(self, spec: str):
        import tiktoken

        self.slow = Tokenizer(spec)
        self.marks = list(self.slow.added)
        added = set(self.slow.added.values())
        table = {t: i for i, t in enumerate(self.slow.table) if t and i not in added}
        self.fast = None
        if bool((np.diff(self.slow.merged) > 0).all()) and len(table) == len(self.slow.table) - len(added):
            self.fast = tiktoken.Encoding("corpus", pat_str=WORDS, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is None or any(m in text for m in self.marks) or LONG_SPACE.search(text):
            return self.slow.encode(text)
        return np.array(self.fast.encode_ordinary(text), np.int32)


@lru_cache(maxsize=1)
def _encoder(spec: str) -> Encoder:
    return Encoder(spec)


class Bins:
    """A tournament tree over the free places of bins: each inner node holds the larger of its two children."""

    def __init__(self, n: int, room: int):
        self.leaves = 1 << max(0, n - 1).bit_length()
        self.free = [room] * (2 * self.leaves)

    def first(self, need: int) -> int:
        """Leftmost bin with ``need`` free places, which are taken; each of the n bins begins empty."""
        free, k = self.free, 1
        while k < self.leaves:
            k <<= 1
            if free[k] < need:
                k += 1
        at = k - self.leaves
        free[k] -= need
        while k > 1:
            k >>= 1
            most = free[2 * k] if free[2 * k] >= free[2 * k + 1] else free[2 * k + 1]
            if free[k] == most:
                break
            free[k] = most
        return at


def first_fit_decreasing(sizes: list[int], room: int) -> list[list[int]]:
    """Bins of places in ``sizes``, each size at most ``room``; equal sizes in the order given."""
    bins, out = Bins(len(sizes), room), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = bins.first(sizes[i])
        if at == len(out):
            out.append([])
        out[at].append(i)
    return out


def pack_sizes(sizes: list[int], room: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of ``(place, start, length)`` over items of at most ``room``: first-fit decreasing, then filled up.

    All sequences but those of the last few ids are full; the others' lengths are distinct powers of two.
    """
    bins = [[(i, 0, sizes[i]) for i in held] for held in first_fit_decreasing(sizes, room)]
    bins.sort(key=lambda b: -sum(x[2] for x in b))
    used = [sum(x[2] for x in b) for b in bins]
    low, high = 0, len(bins) - 1
    while low < high:
        gap = room - used[low]
        if gap == 0:
            low += 1
            continue
        place, start, length = bins[high].pop()
        take = min(gap, length)
        bins[low].append((place, start, take))
        used[low] += take
        used[high] -= take
        if take < length:
            bins[high].append((place, start + take, length - take))
        elif not bins[high]:
            bins.pop()
            used.pop()
            high -= 1
    if not bins or used[-1] == room:
        return bins
    rest, out = bins.pop(), bins
    left = used[-1]
    while rest:
        want, seq = 1 << (left.bit_length() - 1), []
        left -= want
        while want:
            place, start, length = rest.pop()
            take = min(want, length)
            seq.append((place, start, take))
            want -= take
            if take < length:
                rest.append((place, start + take, length - take))
        out.append(seq)
    return out


def pack(docs: DataFrame, spec: str, id_col: str = "doc_id", text_col: str = "text", length: int = 2048, end: int = 1) -> DataFrame:
    """``(<id_col>, start, length, ids, doc_tokens, sequence_id, offset)``, one row per piece.

    A document's ids are those of its whole text by the tokenizer file ``spec`` (no special tokens added), then
    ``end``. ``ids`` are the piece's ids as little-endian unsigned 32-bit integers, ``start`` counts the document's
    ids before it. Pieces lie in their sequence from ``offset`` on, without gaps; a sequence holds ``length`` ids or,
    at the end of a group, a smaller power of two if ``length`` is one (else the last bin of a group may be short).

    Null or empty texts have the id ``end`` alone. Null ids stay; repeated rows are documents of their own. Very long
    texts are cut into pieces that spread over all groups, so no group grows with one text. Other columns, of any
    name, are ignored; an empty table gives an empty result. Group sizes come from one pass that counts rows and
    bytes. A row's group follows from its place in the input, so the input must be a table or another plan that
    gives its rows in the same order when a lost task runs again; packing a group has one outcome.
    """
    small_batches(docs.sparkSession)
    text = F.col(text_col).cast("string")
    n_rows, n_bytes = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(text))).first()
    groups = max(1, -(-n_rows // GROUP_ROWS), -(-(n_bytes or 0) // GROUP_BYTES))
    shared = docs.sparkSession.sparkContext.broadcast(spec)  # of the file's fixed size

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(shared.value)
        kind = "<u2" if max(len(encode.slow.table), end + 1) <= 1 << 16 else "<u4"
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                row, start, size, total, ids, held = [], [], [], [], [], 0
                for i, t in enumerate(part.column(1).to_pylist()):
                    own = np.append(encode(t or ""), end).astype(kind)
                    for at in range(0, len(own), length):
                        piece = own[at : at + length]
                        row.append(i)
                        start.append(at)
                        size.append(len(piece))
                        total.append(len(own))
                        ids.append(piece.tobytes())
                        held += len(piece)
                        if held >= 1 << 20:
                            yield dealt(part, row, start, size, total, ids)
                            row, start, size, total, ids, held = [], [], [], [], [], 0
                if row:
                    yield dealt(part, row, start, size, total, ids)

    def dealt(part: pa.RecordBatch, row: list, start: list, size: list, total: list, ids: list) -> pa.RecordBatch:
        place = part.column(2).to_numpy()[row]
        hashed = mix(mix(place.astype(np.uint64)) + np.array(start, np.uint64))
        group = (hashed % np.uint64(groups)).astype(np.int64)
        return pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(place), pa.array(group), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(total, pa.int64()), pa.array(ids, pa.binary())], names=["id", "row", "grp", "start", "size", "total", "ids"])

    def packed(table: pa.Table, bounds: np.ndarray) -> pa.RecordBatch:
        row, start, size, grp = (table.column(c).to_numpy() for c in ("row", "start", "size", "grp"))
        raw, source, begin, long, seq, offset, out = table.column("ids").to_pylist(), [], [], [], [], [], []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            order = a + np.lexsort((start[a:b], row[a:b]))  # of one outcome, whatever the order of arrival
            sequences = pack_sizes(size[order].tolist(), length)
            for k, pieces in enumerate(sequences):
                at = 0
                for place, first, n in pieces:
                    i = int(order[place])
                    width = len(raw[i]) // int(size[i])
                    source.append(i)
                    begin.append(int(start[i]) + first)
                    long.append(n)
                    seq.append((int(grp[a]) << 32) + k)
                    offset.append(at)
                    out.append(np.frombuffer(raw[i], f"<u{width}")[first : first + n].astype("<u4").tobytes())
                    at += n
        index = pa.array(source, pa.int64())
        whole = table.select(["id", "total"]).combine_chunks().take(index)
        return pa.RecordBatch.from_arrays([whole.column("id").combine_chunks(), pa.array(begin, pa.int64()), pa.array(long, pa.int64()), pa.array(out, pa.binary()), whole.column("total").combine_chunks(), pa.array(seq, pa.int64()), pa.array(offset, pa.int64())], names=["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    kind = docs.schema[id_col].dataType.simpleString()
    pieces = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.monotonically_increasing_id().alias("row")).mapInArrow(cut, f"id {kind}, row long, grp long, start long, size long, total long, ids binary")
    out = over_groups(pieces, ["grp"], packed, f"id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
