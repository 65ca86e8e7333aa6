"""Vocabularies of the most frequent n-word terms, for every choice of folds but one, without counting the rest.

A term is at most as frequent as the words and shorter terms in it. So words are counted first; two-word terms are counted
only if both words may be in a vocabulary, three-word terms only if both of their two-word terms may, and so on. The bound is
the count that a vocabulary's last term has so far; of equally frequent terms the shorter come first, so nothing that belongs into one is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.operators.tables import stored


def numbered(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Written rows of ``keep``, ``fold``, words ``_w1`` and a number of their own, ``_row``."""
    return stored(rows.select(*keep, "fold", "_w1", F.monotonically_increasing_id().alias("_row")), "words")


def _choices(sums: DataFrame, folds: list[int]) -> list[tuple[int | None, DataFrame]]:
    """For all folds, and for all but each: ``(key, n)`` of the terms that stand in two texts."""
    out = []
    for left in (None, *(folds if len(folds) > 1 else [])):
        part = sums if left is None else sums.where(F.col("fold") != left)
        whole = part.groupBy("key").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi")
        out.append((left, whole.select("key", "n")))
    return out


def _best(sums: DataFrame, folds: list[int], held: dict, features: int) -> dict[int | None, list[tuple]]:
    """``(key, n)`` of the first ``features`` of each choice by count, then key, if they reach the count that is held."""
    return {left: [tuple(r) for r in whole.where(F.col("n") >= held.get(left, 0)).orderBy(F.desc("n"), "key").limit(features).collect()] for left, whole in _choices(sums, folds)}


def _runs(size: int, words: list[str], known: list[np.ndarray]):
    """Counts ``size``-word terms by batch; a term's key is its words' places in ``words``, base ``len(words)``."""
    base = len(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("_w1")
            values = pa.array(words, lists.type.value_type)
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            flat = pc.fill_null(pc.index_in(lists.flatten(), value_set=values), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(lists)), lengths)
            n = len(flat) - size + 1
            if n < 1:
                continue
            ok = row[:n] == row[size - 1 :]
            for k in range(size):
                ok &= flat[k : k + n] >= 0
            at = np.flatnonzero(ok)
            for length, keys in enumerate(known, 2):  # every shorter term in it may be in a vocabulary
                for k in range(size - length + 1):
                    at = at[np.isin(_keys(flat, at + k, length, base), keys)]
            if not len(at):
                continue
            fold, own = (batch.column(c).to_numpy(zero_copy_only=False)[row[at]].astype(np.int64) for c in ("fold", "_row"))
            table = pa.table({"key": _keys(flat, at, size, base), "fold": fold, "row": own}).group_by(["key", "fold"]).aggregate([("row", "count"), ("row", "min"), ("row", "max")])
            for part in table.select(["key", "fold", "row_count", "row_min", "row_max"]).rename_columns(["key", "fold", "n", "lo", "hi"]).to_batches():
                yield part

    return run


def _keys(flat: np.ndarray, at: np.ndarray, size: int, base: int) -> np.ndarray:
    key = np.zeros(len(at), np.int64)
    for k in range(size):
        key = key * base + flat[at + k]
    return key


def vocabularies(rows: DataFrame, features: int, n_max: int) -> dict[int | None, list[str]]:
    """The ``features`` most frequent one- to ``n_max``-word terms of two texts at least: of all rows under None, of all folds but one under that one.

    Of equally frequent terms those of fewer words come first, then by term. ``rows`` must be a table of ``numbered``. The driver sees at most
    ``features`` terms of each size and choice.
    """
    sums = rows.select("fold", "_row", F.explode("_w1").alias("key")).groupBy("key", "fold").agg(F.count("*").alias("n"), F.min("_row").alias("lo"), F.max("_row").alias("hi"))
    folds = sorted(r.fold for r in rows.select("fold").distinct().collect())
    best = {left: [(-n, 1, w) for w, n in got] for left, got in _best(stored(sums, "term-sums"), folds, {}, features).items()}
    words = sorted({w for got in best.values() for *_, w in got})
    if len(words) ** n_max >= 2**63:
        raise ValueError("the keys of terms of so many words exceed 64 bits")
    known: list[np.ndarray] = []
    for size in range(2, n_max + 1):
        held = {left: -got[features - 1][0] if len(got) >= features else 0 for left, got in best.items()}
        sums = rows.select("_w1", "fold", "_row").mapInArrow(_runs(size, words, known), "key long, fold long, n long, lo long, hi long")
        sums = stored(sums.groupBy("key", "fold").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")), "term-sums")
        grown = _best(sums, folds, held, features)
        known.append(np.array(sorted({key for got in grown.values() for key, _ in got}), np.int64))
        named = lambda key, size=size: " ".join(words[key // len(words) ** k % len(words)] for k in reversed(range(size)))
        best = {left: sorted([*got, *((-n, size, named(key)) for key, n in grown[left])])[:features] for left, got in best.items()}
    return {left: [t for *_, t in got] for left, got in best.items()}
