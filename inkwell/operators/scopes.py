"""Terms as numbers, for what is fitted on one document.

A task takes the texts of its batches in slices of about ``SLICE`` bytes, whatever the batches hold. The words of a slice are
numbered in their order, so that terms are counted, weighed and sorted as arrays; only what is returned becomes text again.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions.lexicons import CONNECTORS, STOP_WORDS
from inkwell.operators.tables import small_batches

#: Bytes of text that are worked on at once.
SLICE = 2_000_000
#: On bytes, so that white space is that of ``T.sentence_array`` and ``T.words``.
SENTENCE_END, BLANK_LINE, SPACE = re.compile(rb"[.!?]\s+"), re.compile(rb"\n\s*\n"), re.compile(rb"\s+")


@cache
def _word_characters() -> np.ndarray:
    """Of each code point, whether it is a letter, a number or an underscore."""
    points = np.setdiff1d(np.arange(0x110000), np.arange(0xD800, 0xE000))
    found = np.zeros(0x110000, bool)
    found[points] = pc.match_substring_regex(pa.array(list(map(chr, points.tolist()))), r"[\p{L}\p{N}_]").to_numpy(zero_copy_only=False)
    return found


def code_points(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray]:
    """Of the texts in lower case, one behind the other: bytes, code points, how many bytes each of these has (None if one each), and at which each text begins."""
    low = pc.utf8_lower(texts)
    off = np.frombuffer(low.buffers()[1], np.int32)[low.offset : low.offset + len(low) + 1].astype(np.int64) if len(low) else np.zeros(1, np.int64)
    raw = memoryview(low.buffers()[2] or b"")[off[0] : off[-1]]
    data, off = np.frombuffer(raw, np.uint8), off - off[0]
    if not len(data) or data.max() < 0x80:
        return data, data, None, off[:-1]
    points = np.frombuffer(str(raw, "utf-8").encode("utf-32-le"), np.uint32)
    width = 1 + (points >= 0x80).astype(np.uint8) + (points >= 0x800) + (points >= 0x10000)
    return data, points, width, np.searchsorted(np.cumsum(width, dtype=np.int64) - width, off[:-1])


def word_runs(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """Runs of two or more word characters of the texts in lower case, and the place of the text that each is in."""
    data, points, width, first = code_points(texts)
    n, plain = len(points), width is None
    word = _word_characters()[points]
    opens = word.copy()
    opens[1:] &= ~word[:-1]
    heads = first[first < n]
    opens[heads] = word[heads]
    closes = word.copy()
    closes[:-1] &= ~word[1:] | opens[1:]
    a, b = np.flatnonzero(opens), np.flatnonzero(closes)
    long = b > a
    word[a[~long]] = False
    a, b = a[long], b[long]
    size = b - a + 1 if plain else np.add.reduceat(np.append(width, 0).astype(np.int64), np.stack([a, b + 1], 1).ravel())[::2] if len(a) else a
    kept = data[word if plain else np.repeat(word, width)]
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(a), pa.py_buffer(ends), pa.py_buffer(kept)), np.searchsorted(first, a, "right") - 1


def numbered_words(texts: pa.StringArray, stop: list[str] | tuple = STOP_WORDS) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """The distinct words of ``T.analysed`` in order, and of each word of the texts its number there and the place of its text."""
    words, text = word_runs(texts)
    held = words.dictionary_encode()
    order = pc.sort_indices(held.dictionary)
    number = np.empty(len(order), np.int64)
    number[order.to_numpy()] = np.arange(len(order))
    codes, kinds = number[held.indices.to_numpy()], held.dictionary.take(order)
    kept = ~pc.is_in(kinds, value_set=pa.array(stop, pa.string())).to_numpy(zero_copy_only=False)[codes]
    return kinds, codes[kept], text[kept]


class Units:
    """Parts of texts: ``texts``, the row and the position of each, and the place of its row and position among the distinct ones in order.

    Equal positions of one row, of texts whose id repeats, are one place.
    """

    def __init__(self, rows: list[list[bytes]], cut: Callable[[bytes], list[tuple[int, bytes]]]):
        found = [(i, pos, part) for i, texts in enumerate(rows) for pos, part in sorted(u for t in texts for u in cut(t))]
        self.texts = pa.array([x[2] for x in found], pa.binary()).cast(pa.string())
        self.row, self.pos = (np.array([x[k] for x in found], np.int64) for k in (0, 1))
        self.in_row = np.bincount(self.row, minlength=len(rows))
        new = np.ones(len(found), bool)
        new[1:] = (self.row[1:] != self.row[:-1]) | (self.pos[1:] != self.pos[:-1])
        self.place = np.cumsum(new) - 1
        self.row_of_place, self.pos_of_place = self.row[new], self.pos[new]


def weights(units: Units, place: np.ndarray, term: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors fitted on each row, over ``kinds`` terms: the keys ``place * kinds + term`` in order and their weights;
    the keys ``row * kinds + term`` in order, and which of these each of the former belongs to."""
    keys, tf = np.unique(place * kinds + term, return_counts=True)
    place, term = np.divmod(keys, max(kinds, 1))
    row = units.row_of_place[place]
    own, which, df = np.unique(row * kinds + term, return_inverse=True, return_counts=True)
    w = tf * (np.log((1 + units.in_row[row]) / (1 + df[which])) + 1)
    return keys, w / np.sqrt(np.bincount(place, w * w))[place], own, which


def whole(x: np.ndarray) -> np.ndarray:
    """Rounded to whole numbers, halves up."""
    return np.floor(x + 0.5).astype(np.int64)


def sentences_of(text: bytes) -> list[tuple[int, bytes]]:
    """Position and text of the non-empty sentences, as ``T.sentence_array`` has them."""
    at, parts = 0, []
    for m in SENTENCE_END.finditer(text):
        parts.append(text[at : m.start() + 1])
        at = m.end()
    parts.append(text[at:])
    return [(i, s) for i, p in enumerate(parts) if (s := p.strip(b" "))]


class Ranked:
    """All one- and two-word terms of each row by their sums of weights over sentences, best first: ``row``, ``millionths`` and the
    numbers of the ``first`` and ``second`` word, the latter -1 for terms of one."""

    def __init__(self, rows: list[list[bytes]]):
        units = Units(rows, sentences_of)
        self.words, codes, unit = numbered_words(units.texts)
        n = max(len(self.words), 1)
        near = np.flatnonzero(unit[1:] == unit[:-1])
        # of equal sums the longer terms come first, then they go by their words
        numbers, term = np.unique(np.concatenate([codes[near] * n + codes[near + 1], n * n + codes]), return_inverse=True)
        keys, w, own, which = weights(units, units.place[np.concatenate([unit[near], unit])], term, len(numbers))
        q = whole(np.bincount(which, w, minlength=len(own)) * 1e6)
        row, term = np.divmod(own, max(len(numbers), 1))
        order = np.lexsort((-q, row))
        self.row, self.millionths, number = row[order], q[order], numbers[term[order]]
        single = number >= n * n
        self.first, self.second = np.where(single, number - n * n, number // n), np.where(single, -1, number % n)

    def text(self, at: np.ndarray) -> pa.StringArray:
        """The terms of some rows."""
        second = pa.array(self.second[at], mask=self.second[at] < 0)
        pairs = pc.binary_join_element_wise(self.words.take(pa.array(self.first[at])), self.words.take(second), " ", null_handling="skip")
        return pairs


def place_in_row(row: np.ndarray) -> np.ndarray:
    """The place of each among those of its row, which stand together in order."""
    return np.arange(len(row)) - np.searchsorted(row, row)


def scored_terms(rows: list[list[bytes]]) -> tuple[np.ndarray, list[pa.Array]]:
    r = Ranked(rows)
    return r.row, [r.text(np.arange(len(r.row))), pa.array(r.millionths / 1e6), pa.array(place_in_row(r.row) + 1)]


def chosen_terms(top: int) -> Callable:
    """The first ``top`` terms of each row whose words don't all stand in one chosen before."""

    def work(rows: list[list[bytes]]) -> tuple[np.ndarray, list[pa.Array]]:
        r = Ranked(rows)
        kept: list[int] = []
        starts = np.flatnonzero(np.diff(r.row, prepend=-1)).tolist()
        for a, b in zip(starts, [*starts[1:], len(r.row)]):
            chosen: list[tuple[int, int]] = []
            for i, x, y in zip(range(a, b), r.first[a:b].tolist(), r.second[a:b].tolist()):
                if len(chosen) == top:
                    break
                if not any(x in k and (y < 0 or y in k) for k in chosen):
                    chosen.append((x, y))
                    kept.append(i)
        at = np.array(kept, np.int64)
        return r.row[at], [pa.array(place_in_row(r.row[at])), r.text(at)]

    return work


def paragraphs_of(text: bytes) -> list[tuple[int, bytes]]:
    """Position and text of the paragraphs, as ``T.paragraph_array`` has them."""
    text = text.strip(b" ")
    long = lambda parts: [p for p in (x.strip(b" ") for x in parts) if len(p.split(None, 5)) >= 5]
    found = long(BLANK_LINE.split(text))
    return list(enumerate(found if len(found) > 1 else long(text.split(b"\n"))))


_LINKS = [f" {c} " for c in CONNECTORS]


def _linked(paragraph: bytes) -> bool:
    """Whether a connector stands among the first six words."""
    head = b" ".join(x.strip(b".,;:") for x in SPACE.split(paragraph.strip(b" "), maxsplit=6)[:6])
    head = f" {head.decode().lower()} "
    return any(c in head for c in _LINKS)


def transitions(floor: float) -> Callable:
    """Of each paragraph but the last of a row: position, similarity to the next, threshold, whether a connector opens the next, whether the step is weak."""

    def work(rows: list[list[bytes]]) -> tuple[np.ndarray, list[pa.Array]]:
        units = Units(rows, paragraphs_of)
        words, codes, unit = numbered_words(units.texts)
        kinds = len(words)
        keys, w, _, _ = weights(units, units.place[unit], codes, kinds)
        # the same term at the next position of the row
        at = np.minimum(np.searchsorted(keys, keys + kinds), max(len(keys) - 1, 0))
        place = keys // max(kinds, 1)
        follows = np.append((units.row_of_place[1:] == units.row_of_place[:-1]) & (units.pos_of_place[1:] == units.pos_of_place[:-1] + 1), False)
        both = np.flatnonzero((keys[at] == keys + kinds) & follows[place])
        dots = np.bincount(place[both], w[both] * w[at[both]], minlength=len(units.row_of_place))
        edge = np.flatnonzero(units.row[1:] == units.row[:-1])
        row, q = units.row[edge], whole(dots[units.place[edge]] * 1e6)
        linked = np.fromiter(map(_linked, units.texts.take(pa.array(edge + 1)).cast(pa.binary()).to_pylist()), bool, len(edge))
        level = np.full(len(rows), floor)
        starts = np.flatnonzero(np.diff(row, prepend=-1)).tolist()
        for a, b in zip(starts, [*starts[1:], len(row)]):
            n, total, squares = b - a, int(q[a:b].sum()), int((q[a:b] * q[a:b]).sum())  # whole millionths: exact in any order
            level[row[a]] = max(floor, (float(total) - 0.75 * float(n * squares - total * total) ** 0.5) / (n * 1e6))
        similarity, threshold = q / 1e6, whole(level * 1e6)[row] / 1e6
        return row, [pa.array(units.pos[edge]), pa.array(similarity), pa.array(threshold), pa.array(linked), pa.array((similarity < threshold) & ~linked)]

    return work


def by_rows(docs: DataFrame, id_col: str, text_col: str, work: Callable, columns: str) -> DataFrame:
    """``(id, columns)``: what ``work`` makes of lists of the texts of each id, slice by slice: the place of the row in its list, and the columns.

    The texts alone are shuffled, once.
    """
    small_batches(docs.sparkSession)
    texts = docs.groupBy(id_col).agg(F.collect_list(F.col(text_col).cast("string")).alias("_ts"))
    names = [id_col, *(c.split()[0] for c in columns.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1).cast(pa.list_(pa.binary()))
            for a, b in slices(_sizes(lists)):
                row, found = work(lists.slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a).take(pa.array(row)), *found], names=names)

    return texts.mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, {columns}")


def _sizes(lists: pa.ListArray) -> np.ndarray:
    """Bytes of each row's texts."""
    each = np.concatenate([[0], np.cumsum(pc.binary_length(lists.values).to_numpy(zero_copy_only=False), dtype=np.int64)])
    off = lists.offsets.to_numpy()
    return each[off[1:]] - each[off[:-1]]


def slices(size: np.ndarray, most: int | None = None) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``most`` bytes, by default ``SLICE``."""
    most = most or SLICE
    a, held = 0, 0
    for i, n in enumerate(size.tolist(), 1):
        held += n
        if held >= most or i == len(size):
            yield a, i
            a, held = i, 0
