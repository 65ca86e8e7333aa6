"""Line deduplication by a deletion-neighbourhood join.

A line that isn't blank goes if an equal line stands earlier in the order of (document, line); one of at
least ``NEAR_CHARS`` characters also goes if another such line within the edit bound (insertions, deletions and
substitutions of a character) does.

Equal lines meet by a 128-bit hash. For the others, every line emits the hashes of its variants with
characters deleted. A bare variant only says that two lines lie within twice the bound; so a variant is
keyed with the slots at which the bound allows an edit: the places of its deletions and, for those that
only the other line has, free ones. Two lines of one key differ in at most one character at each slot,
so all lines of a key lie within the bound of each other, and it is enough to know the earliest: a minimum,
aggregated before the shuffle, instead of pairs. The pair of a line and that earliest one is verified on the
texts (the hash has 64 bits).

For a bound of 1 the keys are: the variant with its place, for substitutions; the variant alone, which meets
the shorter line itself, for insertions. A larger bound k takes about 2 n^k / k! keys for a line of n
characters, so it is for tables of short lines.

A lossless filter goes before: of k + 1 segments of a line one is free of edits, so only lines that share a
segment with another line, moved by at most k places, emit variants; for k = 1 only over the other half.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations, combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.scratch import Scratch, semi_join_ids, small_batches, text_key, with_group
from inkwell.llm.tokens import mix

#: Shorter lines are compared for equality only: one edit of so short a line is often another line.
NEAR_CHARS = 24
BLANK = " \t\n\v\f\r"
#: Up to so many rows (about 64 bytes each) a side is broadcast, after it was counted.
BROADCAST_ROWS = 300_000

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _key(line: str) -> bytes:
    return hashlib.blake2b(line.encode(), digest_size=16).digest()


def halves(line: str) -> list[int]:
    """Keys of the half lines: as the shorter or equal one of a pair (0 first, 1 last half), as the longer (2, 3).

    A pair (x, y) with len(y) - len(x) in (0, 1) cuts both at len(x) // 2, from the front and from the end.
    """
    n, out = len(line), []
    for role, size in ((0, n), (1, n - 1)):
        cut = size // 2
        for side, part in ((0, line[:cut]), (1, line[n - (size - cut) :])):
            out.append(int.from_bytes(hashlib.blake2b(f"{size}:{side}:{part}".encode(), digest_size=8).digest(), "little", signed=True))
    return out


def segments(line: str, bound: int) -> list[int]:
    """Keys of segments that a line shares with one within ``bound``: at its own cuts, and at those of shorter ones, moved."""
    n, out = len(line), set()
    for size in range(max(n - bound, 0), n + 1):
        cuts = [size * i // (bound + 1) for i in range(bound + 2)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            for shift in range(-bound, bound + 1):
                if 0 <= a + shift and b + shift <= n:
                    out.add((size, i, line[a + shift : b + shift]))
    return [int.from_bytes(hashlib.blake2b(f"{size}:{i}:{part}".encode(), digest_size=8).digest(), "little", signed=True) for size, i, part in sorted(out)]


def slot_keys(line: str, bound: int) -> set[int]:
    """Hashes of (variant, slots) for every choice of up to ``bound`` deletions, filled up with free slots."""
    out = set()
    for gone in (c for d in range(min(bound, len(line)) + 1) for c in combinations(range(len(line)), d)):
        left = "".join(x for i, x in enumerate(line) if i not in gone)
        own = [i - k for k, i in enumerate(gone)]
        for free in combinations_with_replacement(range(len(left) + 1), bound - len(gone)):
            slots = ",".join(map(str, sorted([*own, *free])))
            out.add(int.from_bytes(hashlib.blake2b(f"{slots}:{left}".encode(), digest_size=8).digest(), "little", signed=True))
    return out


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def variants(line: str, first: bool, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the line with one character deleted, in its last half, its first half or both.

    ``first`` says that the first half agrees with some line, so an edit is looked for in the last half.
    """
    code = np.frombuffer(line.encode("utf-32-le"), np.uint32).astype(np.uint64)
    n, cut = len(code), len(code) // 2
    power = _powers(n)
    term = mix(code + np.uint64(0xA24BAED4963EE407)) * power
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(term, dtype=np.uint64)])
    # one place of slack: the longer line of a pair cuts at the shorter one's half
    lo, hi = 0 if last else max(cut - 1, 0), n if first else min(cut + 2, n)
    at = np.arange(lo, hi)
    return at, mix(total[at] + (total[n] - total[at + 1]) * np.uint64(_INVERSE) + np.uint64(n - 1))


def whole_hash(line: str) -> np.uint64:
    """The hash that a variant of a longer line has if it equals this line."""
    code = np.frombuffer(line.encode("utf-32-le"), np.uint32).astype(np.uint64)
    power = _powers(len(code))
    return mix(np.array([(mix(code + np.uint64(0xA24BAED4963EE407)) * power).sum(dtype=np.uint64) + np.uint64(len(code))], np.uint64))[0]


def _occurrences(rows: DataFrame, near_chars: int, bound: int) -> DataFrame:
    """``id, row, line_no, key, again, h`` of every line that isn't blank; ``again`` marks those after the first in their row.

    ``h``: segment keys of lines of ``near_chars`` characters or more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, row, no, keys, again, hs = [], [], [], [], [], []
            for d, r, text in zip(*(c.to_pylist() for c in batch.columns)):
                seen: set[bytes] = set()
                for i, line in enumerate((text or "").split("\n")):
                    if line.strip(BLANK):
                        k = _key(line)
                        ids.append(d)
                        row.append(r)
                        no.append(i)
                        keys.append(k)
                        again.append(k in seen)
                        hs.append(None if k in seen or len(line) < near_chars else halves(line) if bound == 1 else segments(line, bound))
                        seen.add(k)
                        if len(ids) >= 4096:
                            yield _batch(ids, row, no, keys, again, hs)
                            ids, row, no, keys, again, hs = [], [], [], [], [], []
            yield _batch(ids, row, no, keys, again, hs)

    return rows.mapInArrow(run, "id long, row binary, line_no int, key binary, again boolean, h array<long>")


def _batch(ids: list, row: list, no: list, keys: list, again: list, hs: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(row, pa.binary()), pa.array(no, pa.int32()), pa.array(keys, pa.binary()), pa.array(again, pa.bool_()), pa.array(hs, pa.list_(pa.int64()))], names=["id", "row", "line_no", "key", "again", "h"])


def line_decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near_chars: int = NEAR_CHARS, bound: int = 1, scratch: Scratch | None = None) -> DataFrame:
    """``(<id_col>, line_no, kept, reason, text_key)`` of every line that isn't blank; ``<id_col>`` is a number.

    Lines are what newlines separate, numbered from 0; blank ones stay and aren't listed. ``reason`` is ``exact``
    or ``near`` where a line goes, else null; a line with an equal earlier one is ``exact``. The first of its
    kind always stays. ``bound`` 0 compares for equality only.

    Null or empty text has no line. Lines of any length are compared; one of n characters emits about 3 n
    variants with a bound of 1. Rows with a null id are listed and kept, and count as no one's earlier line.
    Rows that repeat an id are judged line by line as texts of their own, in the order of ``text_key``
    (``scratch.text_key``), which tells them apart; rows that repeat id and text are one, so a line that stands first in
    them stays in each. Other columns are ignored; an empty table gives an empty result.
    """
    scratch = scratch or Scratch(docs.sparkSession, "lines")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_key(F.col(text_col)).alias("row"), F.col(text_col).cast("string").alias("text"))
    every = scratch.save(_occurrences(rows, near_chars, bound), "lines")
    named = every.where("id is not null and not again")
    lines = named.groupBy("key").agg(F.min(F.struct("id", "row")).alias("first"), F.min("h").alias("h"), F.count("*").alias("_n"))
    lines = scratch.save(lines.select("key", "first.*", "h", "_n"), "distinct")

    half = lines.where("h is not null").select("key", "id", "row", F.posexplode("h").alias("role", "h")).withColumn("role", F.least("role", F.lit(30)))
    shared = scratch.save(half.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "halves")
    suspect = semi_join_ids(half, "h", shared).groupBy("id", "row", "key").agg(F.bit_or(F.expr("shiftleft(1, role)")).alias("roles"))
    suspect = scratch.save(suspect.groupBy("id", "row").agg(F.collect_list(F.struct("key", "roles")).alias("wanted")), "suspects")
    texts = _suspect_lines(_join_small(rows, suspect, ["id", "row"]), near_chars).dropDuplicates(["key"]).orderBy("id", "row", "line_no")
    texts = scratch.save(texts.withColumn("place", F.monotonically_increasing_id()), "texts")  # places are in the order of lines

    if bound == 1:
        neighbours = texts.mapInArrow(_neighbourhood, "v long, place long, part int")
        # part -1: substitution; 0: the line itself; 1: a variant of a longer line
        met = neighbours.groupBy("v").agg(F.count("*").alias("n"), *(F.min(F.when(F.col("part") == p, F.col("place"))).alias(n) for p, n in ((-1, "swap"), (0, "short"), (1, "long"))))
        met = scratch.save(met.where("n > 1 and (swap is not null or (short is not null and long is not null))").drop("n"), "met")
        pair = _join_small(neighbours, met, ["v"]).select("place", F.when(F.col("part") == -1, F.col("swap")).when(F.col("part") == 0, F.col("long")).otherwise(F.col("short")).alias("e"))
    else:
        neighbours = texts.mapInArrow(_slots(bound), "v long, place long")
        met = scratch.save(neighbours.groupBy("v").agg(F.count("*").alias("n"), F.min("place").alias("e")).where("n > 1").drop("n"), "met")
        pair = _join_small(neighbours, met, ["v"]).select("place", "e")
    pair = pair.where("e < place").distinct()
    pair = pair.join(texts.select("place", "key", "line"), "place").join(texts.select(F.col("place").alias("e"), F.col("line").alias("e_line")), "e")
    near = scratch.save(pair.where(F.levenshtein("line", "e_line", bound).between(1, bound)).select("key").distinct().withColumn("near", F.lit(True)), "near")

    state = scratch.save(lines.select("key", F.col("id").alias("first_id"), F.col("row").alias("first_row"), "_n").join(near, "key", "left"), "state")
    scratch.keep(every, state)
    out = with_group(every.drop("h"), state, ["key"], how="left")
    first = (F.col("first_id") == F.col("id")) & (F.col("first_row") == F.col("row"))
    exact = F.coalesce(F.col("again") | ~first, F.lit(False))
    reason = F.when(F.col("id").isNull(), None).when(exact, "exact").when(F.col("near"), "near")
    return out.select(F.col("id").alias(id_col), "line_no", reason.isNull().alias("kept"), reason.alias("reason"), F.col("row").alias("text_key"))


def _join_small(rows: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    """A join whose right side, a written table, is broadcast only if counted to be small."""
    return rows.join(F.broadcast(small) if small.count() <= BROADCAST_ROWS else small, on)


def _suspect_lines(rows: DataFrame, near_chars: int) -> DataFrame:
    """``id, row, line_no, key, roles, line`` of the wanted lines of their first rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for d, row, text, wanted in zip(*(c.to_pylist() for c in batch.columns)):
                roles = {w["key"]: w["roles"] for w in wanted}
                for i, line in enumerate((text or "").split("\n")):
                    if len(line) >= near_chars and (r := roles.pop(k := _key(line), None)) is not None:
                        for col, v in zip(out, (d, row, i, k, r, line)):
                            col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.int32(), pa.string()))], names=["id", "row", "line_no", "key", "roles", "line"])

    return rows.select("id", "row", "text", "wanted").mapInArrow(run, "id long, row binary, line_no int, key binary, roles int, line string")


def _slots(bound: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, line in zip(*(batch.column(c).to_pylist() for c in ("place", "line"))):
                keys = np.fromiter(slot_keys(line, bound), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), place))], names=["v", "place"])

    return run


def _neighbourhood(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        v, places, part, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).view(np.int64)), pa.array(np.concatenate(places), pa.int64()), pa.array(np.concatenate(part), pa.int32())], names=["v", "place", "part"])

        def put(hashes: np.ndarray, place: int, p: int) -> None:
            v.append(hashes)
            places.append(np.full(len(hashes), place))
            part.append(np.full(len(hashes), p))

        for place, roles, line in zip(*(batch.column(c).to_pylist() for c in ("place", "roles", "line"))):
            if roles & 3:  # some line of the same length, or the longer one of a pair, agrees in a half
                at, h = variants(line, bool(roles & 1), bool(roles & 2))
                put(mix(h + (at.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)), place, -1)
                put(np.array([whole_hash(line)], np.uint64), place, 0)
            if roles & 12:
                put(np.unique(variants(line, bool(roles & 4), bool(roles & 8))[1]), place, 1)
            held += len(line)
            if held > 100_000:
                yield flush()
                v, places, part, held = [], [], [], 0
        if v:
            yield flush()


def without_lines(docs: DataFrame, decisions: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """``docs`` less the lines that ``decisions`` drops, with all their columns.

    Decisions meet their rows by id and text, so rows that repeat an id lose their own lines only. A row that had
    text and has none but white space left goes; null and empty texts and rows with a null id stay as they are.
    ``size_col``, if there is such a column, follows the new text. Lines to drop are gathered by row, which
    its own text bounds, whatever its length. An empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    key, row, lines = "_id", "_row", "_gone"
    while {key, row, lines} & set(docs.columns):
        key, row, lines = key + "_", row + "_", lines + "_"
    gone = decisions.where(~F.col("kept")).groupBy(F.col(id_col).alias(key), F.col("text_key").alias(row)).agg(F.array_sort(F.collect_set("line_no")).alias(lines))
    rows = docs.join(gone, (docs[id_col] == gone[key]) & (text_key(docs[text_col]) == gone[row]), "left").drop(key, row)
    names, t = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, stay = [], []
            for text, drop in zip(batch.column(t).to_pylist(), batch.column(len(names)).to_pylist()):
                if drop:
                    drop = set(drop)
                    text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop)
                texts.append(text)
                stay.append(not drop or bool(text.strip()))
            columns = batch.columns[: len(names)]
            columns[t] = pa.array(texts, batch.schema.field(t).type)
            if size_col in names:
                s = names.index(size_col)
                sizes = [old if not d else len(x) for old, d, x in zip(columns[s].to_pylist(), batch.column(len(names)).to_pylist(), texts)]
                columns[s] = pa.array(sizes, columns[s].type)
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(stay, pa.bool_()))

    return rows.mapInArrow(run, docs.schema)
