"""Groups of bounded size from key groups of any size.

A group of at most ``tile`` members is one tile. A larger one is dealt by hash into several, and each
pair of tiles is a group of its own, so every pair of members meets exactly once (members of one tile
meet in that tile's own group) and no task holds more than two tiles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.scratch import with_group


def in_tiles(members: DataFrame, keys: list[str], member: str, tile: int, sizes: DataFrame) -> DataFrame:
    """Adds ``lo``, ``hi`` and ``side`` (the row's own tile); groups of one member go.

    ``sizes`` is a written table of the groups' row counts ``_n``.
    """
    tiles = F.ceil(F.col("_n") / F.lit(tile)).cast("int")
    rows = with_group(members, sizes.where("_n > 1").select(*keys, "_n", tiles.alias("_tiles")), keys).drop("_n")
    rows = rows.withColumn("side", F.pmod(F.xxhash64(F.col(member)), F.col("_tiles").cast("long")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))
    return rows.withColumns({"lo": F.least("side", "_other"), "hi": F.greatest("side", "_other")}).drop("_other", "_tiles")


def over_groups(rows: DataFrame, keys: list[str], work: Callable[[pa.Table, np.ndarray], pa.RecordBatch | None], schema: str, chunk_rows: int = 4096) -> DataFrame:
    """Deals rows by keys and calls ``work(table, bounds)`` on runs of whole groups.

    ``bounds`` are the n + 1 row offsets of the n groups in ``table``. Calls get about ``chunk_rows``
    rows (or one group), so many small groups cost no call each.
    """
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if len(held) >= chunk_rows:
                cuts = _changes(held, keys)
                if len(cuts) > 1:
                    yield from _call(held.slice(0, cuts[-1]), cuts)
                    held = held.slice(cuts[-1])
        if held is not None and len(held):
            yield from _call(held, np.append(_changes(held, keys), len(held)))

    def _call(table: pa.Table, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        first = 0
        while first < len(cuts) - 1:
            last = max(first + 1, int(np.searchsorted(cuts, cuts[first] + chunk_rows, side="right")) - 1)
            out = work(table.slice(cuts[first], cuts[last] - cuts[first]), cuts[first : last + 1] - cuts[first])
            if out is not None and out.num_rows:
                yield out
            first = last

    return dealt.mapInArrow(run, schema)


def _changes(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Offsets at which a new key begins, 0 included."""
    new = np.zeros(len(table), dtype=bool)
    new[:1] = True
    for k in keys:
        x = table.column(k).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)
