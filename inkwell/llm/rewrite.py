"""Rewriting Parquet files of drifted schemas to one evolved schema, in constant memory.

Columns are matched by Parquet field id, never by name or place: a plan made once for a file's schema names, for
each field of the evolved schema, the column that holds it and the cast it takes, or the value that fills it. A
task then iterates the batches of the file's row groups, casts and fills each one, appends it to a
``ParquetWriter`` and feeds it to running SHA-256 digests. It holds one batch at a time, whatever the file's size.

A rewrite has two phases. Tasks write beside the table's folder and name the file only when it is whole. Once
every file is written and the manifest of them is stored, the new files are moved over the old ones. Tasks of both
phases can run again, at any point, with the same outcome.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import TimestampType

from inkwell.llm.scratch import Scratch

#: Bytes of one batch of a row group, by the file's own mean row size, and its rows at most.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 65_536
#: Ranges into which rows are dealt for ordering, at most.
RANGES = 1024
#: Number with which doubles are brought to whole numbers for digests.
UNIT = 1_048_576

FIELD_ID = b"PARQUET:field_id"


@dataclass(frozen=True)
class Field:
    """A column of the evolved schema; ``fill`` is its value in files that lack it."""

    id: int
    name: str
    type: pa.DataType
    fill: object = None

    def arrow(self) -> pa.Field:
        return pa.field(self.name, self.type, nullable=True, metadata={FIELD_ID: str(self.id).encode()})


def arrow_schema(fields: list[Field]) -> pa.Schema:
    return pa.schema([f.arrow() for f in fields])


def fields_of(frame: DataFrame, types: dict[str, pa.DataType] | None = None, fills: dict[str, object] | None = None) -> list[Field]:
    """Fields of a frame's columns, numbered from 1, with changed types and fill values by name."""
    types, fills = types or {}, fills or {}
    kind = lambda f: pa.timestamp("us", tz="UTC") if isinstance(f.dataType, TimestampType) else to_arrow_type(f.dataType)
    return [Field(i, f.name, types.get(f.name, kind(f)), fills.get(f.name)) for i, f in enumerate(frame.schema.fields, 1)]


def field_ids(schema: pa.Schema) -> list[int | None]:
    return [int(f.metadata[FIELD_ID]) if f.metadata and FIELD_ID in f.metadata else None for f in schema]


def column_plan(schema: pa.Schema, fields: list[Field]) -> list[tuple[Field, int | None]]:
    """Each evolved field with the place of its column in a file, None where the file lacks it.

    Ids that the evolved schema doesn't know are dropped. A column without an id, or an id that repeats, is an error.
    """
    ids = field_ids(schema)
    if None in ids or len(set(ids)) < len(ids):
        raise ValueError(f"columns need one field id each: {list(zip(schema.names, ids))}")
    at = {i: n for n, i in enumerate(ids)}
    return [(f, at.get(f.id)) for f in fields]


def is_evolved(schema: pa.Schema, fields: list[Field]) -> bool:
    """Whether a file has the evolved names, ids and types in order."""
    want = arrow_schema(fields)
    return schema.names == want.names and schema.types == want.types and field_ids(schema) == [f.id for f in fields] and all(f.nullable for f in schema)


def converted(batch: pa.RecordBatch, plan: list[tuple[Field, int | None]]) -> pa.RecordBatch:
    """A batch cast and filled by a plan."""
    columns = [pa.array([f.fill], f.type).take(pa.array(np.zeros(len(batch), np.int64))) if at is None else batch.column(at).cast(f.type) for f, at in plan]
    return pa.RecordBatch.from_arrays(columns, schema=arrow_schema([f for f, _ in plan]))


def as_text(column: pa.Array) -> pa.Array:
    """Canonical text of values: numbers in decimals, timestamps as microseconds since 1970, null as ``?``.

    Doubles become floor(1048576 * x); those that aren't finite ``nan``, ``inf`` and ``-inf``.
    """
    if pa.types.is_timestamp(column.type):
        column = column.cast(pa.timestamp("us", tz=column.type.tz)).cast(pa.int64())
    if pa.types.is_floating(column.type):
        x = column.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
        plain = np.abs(x) < 2.0**42
        if plain.all():
            whole = pa.array(np.floor(x * UNIT).astype(np.int64)).cast(pa.string())
        else:
            whole = pa.array([str(math.floor(v * UNIT)) if math.isfinite(v * UNIT) else str(math.floor(int(v) * UNIT)) if math.isfinite(v) else str(v) for v in x.tolist()], pa.string())
        return pc.if_else(column.is_valid(), whole, "?")
    return column.cast(pa.string()).fill_null("?")


class Digests:
    """Running counts and digests of a file's rows: its keys joined by commas, its rows by newlines."""

    def __init__(self, key: int):
        self.key, self.rows, self.nulls = key, 0, 0
        self.of_keys, self.of_rows = hashlib.sha256(), hashlib.sha256()

    def update(self, batch: pa.RecordBatch) -> None:
        if not len(batch):
            return
        texts = [as_text(c) for c in batch.columns]
        lines = pc.binary_join_element_wise(*[t.cast(pa.large_string()) for t in texts], pa.scalar("|", pa.large_string()))
        for digest, column, mark in ((self.of_keys, texts[self.key], ","), (self.of_rows, lines, "\n")):
            digest.update((mark * (self.rows > 0) + mark.join(column.to_pylist())).encode())
        self.rows += len(batch)
        self.nulls += sum(c.null_count for c in batch.columns)


def _open(uri: str) -> tuple[pa.fs.FileSystem, str]:
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _publish(store: pa.fs.FileSystem, draft: str, name: str) -> None:
    """Gives a whole file its name, over one of that name that another attempt left."""
    try:
        store.move(draft, name)
    except OSError:  # stores whose rename doesn't replace
        store.delete_file(name)
        store.move(draft, name)


def _moved(uri: str, draft: str) -> None:
    """Phase two for one file; the draft is gone if an earlier attempt has moved it."""
    store, name = _open(uri)
    if store.get_file_info(_open(draft)[1]).type != pa.fs.FileType.NotFound:
        _publish(store, _open(draft)[1], name)


def rewrite_file(uri: str, draft: str, fields: list[Field], key: int) -> dict:
    """Streams one file to ``draft`` under the evolved schema; a file that has it already is only read."""
    store, name = _open(uri)
    with store.open_input_file(name) as source, pq.ParquetFile(source, pre_buffer=False) as file:
        schema, meta = file.schema_arrow, file.metadata
        plan, done, digests = column_plan(schema, fields), is_evolved(schema, fields), Digests(key)
        width = max([1, *(meta.row_group(g).total_byte_size // max(1, meta.row_group(g).num_rows) for g in range(meta.num_row_groups))])
        batches = (converted(b, plan) for b in file.iter_batches(max(1, min(BATCH_ROWS, BATCH_BYTES // width))))
        if done:
            for batch in batches:
                digests.update(batch)
        else:
            to, last = _open(draft)
            attempt = f"{last}.{uuid.uuid4().hex}"
            with to.open_output_stream(attempt) as sink, pq.ParquetWriter(sink, arrow_schema(fields), store_schema=False) as writer:
                for batch in batches:
                    writer.write_batch(batch)
                    digests.update(batch)
            _publish(to, attempt, last)
    return {"n_rows": digests.rows, "n_nulls": digests.nulls, "keys_sha256": digests.of_keys.hexdigest(), "rows_sha256": digests.of_rows.hexdigest(), "start_columns": ",".join(schema.names), "columns": ",".join(f.name for f in fields), "rewritten": not done}


def _folder(spark: SparkSession, uri: str) -> str:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    return uri


def rewrite_files(files: DataFrame, fields: list[Field], key: int, scratch: Scratch, n_files: int) -> DataFrame:
    """Rewrites the files of ``(file_no long, path string)`` in place and returns one row for each.

    Rows have ``file_no, path, draft (where it was written first), n_rows, n_nulls, keys_sha256, rows_sha256, start_columns, columns, rewritten``; ``key`` is the
    place of the field whose values are digested by themselves. Rows and their order stay, nulls stay; fields
    that a file lacks get their fill. Files of the evolved schema are read, not written. A file without rows keeps
    none; an empty table of files gives an empty result; paths that repeat are an error. A file's values are
    held a batch at a time, so one very long value bounds the memory, not the file. ``n_files`` deals the
    files out: a task each, but for collisions of their hashes.
    """
    if not files.groupBy("path").count().where("count > 1").isEmpty():
        raise ValueError("a path stands twice among the files")
    drafts = _folder(files.sparkSession, f"{scratch.root}/drafts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                draft = f"{drafts}/{row['file_no']:09d}.parquet"
                yield pa.RecordBatch.from_pylist([row | {"draft": draft} | rewrite_file(row["path"], draft, fields, key)])

    schema = "file_no long, path string, draft string, n_rows long, n_nulls long, keys_sha256 string, rows_sha256 string, start_columns string, columns string, rewritten boolean"
    done = scratch.save(files.select("file_no", "path").repartition(max(1, n_files), "file_no").mapInArrow(run, schema), "manifest")

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, draft in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                _moved(path, draft)
            yield pa.RecordBatch.from_pydict({"moved": pa.array([len(batch)], pa.int64())})

    done.where("rewritten").select("path", "draft").mapInArrow(commit, "moved long").agg(F.sum("moved")).first()
    return done


def in_order(rows: DataFrame, keys: list[str], scratch: Scratch) -> tuple[DataFrame, int]:
    """Rows with their place ``_rank`` (from 0) in the order of ``keys``, and their number.

    Ties follow a hash of the whole row. Ranges are split at sampled keys, ties included, so that rows of one
    key lie in as many ranges as they need; places are counted within ranges, and at most ``RANGES`` counts meet
    at the driver. No task gets more than a range. The input must give the same rows in the same order when a
    task runs again, as tables do.
    """
    spark = rows.sparkSession
    n = min(int(spark.conf.get("spark.sql.shuffle.partitions")), RANGES)
    order = [*keys, "_tie", "_row"]
    tied = rows.withColumns({"_tie": F.xxhash64(*rows.columns), "_row": F.monotonically_increasing_id()})
    sorted_rows = tied.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("_tie", "_row")
    ranged = scratch.save(sorted_rows.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", 33)
    counts = sorted(map(tuple, ranged.groupBy(part.alias("part")).agg(F.count(F.lit(1))).collect()))
    before, total = [], 0
    for p, c in counts:
        before.append((p, total))
        total += c
    offsets = spark.createDataFrame(before, "_part long, _before long")
    ranked = ranged.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return ranked.withColumn("_rank", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_before"), total


def write_files(rows: DataFrame, fields: list[Field], drift: Callable[[int], list[Field]], folder: str, scratch: Scratch, n_files: int) -> DataFrame:
    """Writes rows to one file for each ``_file``, in the order of ``_rank``; returns ``(file_no, path)``.

    The columns of ``rows`` beside these are named ``f<field id>``. ``drift(file_no)`` gives the fields of a file: names, types
    and order are its own, values are those of its field ids. A task streams its files one after the other.
    """
    drafts, folder = _folder(rows.sparkSession, f"{scratch.root}/drafts"), _folder(rows.sparkSession, folder)
    names = [f"f{f.id}" for f in fields]
    place = {f.id: i + 1 for i, f in enumerate(fields)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, writer, sink, own, attempt, done = None, None, None, [], "", []

        def close() -> None:
            writer.close()
            sink.close()
            uri = f"{folder}/{current:09d}.parquet"
            _publish(store, attempt, _open(uri)[1])
            done.append({"file_no": current, "path": uri})

        for batch in batches:
            numbers = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(numbers, prepend=numbers[:1] - 1)).tolist()
            for a, b in zip(cuts, [*cuts[1:], len(batch)]):
                if numbers[a] != current:
                    if writer is not None:
                        close()
                    current = int(numbers[a])
                    own = drift(current)
                    store, attempt = _open(f"{drafts}/{current:09d}.{uuid.uuid4().hex}")
                    sink = store.open_output_stream(attempt)
                    writer = pq.ParquetWriter(sink, arrow_schema(own), store_schema=False)
                part = batch.slice(a, b - a)
                columns = [part.column(place[f.id]).cast(f.type, safe=False) for f in own]
                writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=arrow_schema(own)))
        if writer is not None:
            close()
        yield pa.RecordBatch.from_pylist(done, pa.schema([("file_no", pa.int64()), ("path", pa.string())]))

    dealt = rows.select("_file", *names, "_rank").repartition(max(1, n_files), "_file").sortWithinPartitions("_file", "_rank")
    return scratch.save(dealt.drop("_rank").mapInArrow(run, "file_no long, path string"), "files")


# Fixed values of the exercise: salt and modulus of the versions, and what their bits change
SALT, VERSIONS, KNOWN = "19:", 24, 15


def version_of(file_no: int) -> int:
    """Drift bits of a starting file: 1 swaps names, 2 reverses, 4 lacks columns, 8 has narrow types."""
    import zlib

    version = zlib.crc32(f"{SALT}{file_no}".encode()) % VERSIONS
    return version if version <= KNOWN else 0


def drifted(fields: list[Field], version: int, swap: tuple[str, str], missing: tuple[str, ...], narrow: dict[str, pa.DataType]) -> list[Field]:
    """The fields of a file of some version."""
    other = dict([swap, swap[::-1]]) if version & 1 else {}
    out = [Field(f.id, other.get(f.name, f.name), narrow.get(f.name, f.type) if version & 8 else f.type) for f in fields if not (version & 4 and f.name in missing)]
    return out[:1] + out[:0:-1] if version & 2 else out


def rewrite_clients(clients: DataFrame, files: int = 250, scratch: Scratch | None = None) -> DataFrame:
    """Deals ``clients`` into drifted files in a new folder and rewrites these to one schema; a row for each file.

    Order and files follow the exercise: rows by the CRC-32 of the decimal ``client_id``, then the id, ``1 + N // files``
    rows a file. Null ids come first, rows that repeat an id follow a hash of the whole row. Null values stay null;
    empty and very long texts are values like others; columns beyond the ten are left out. An empty table has no
    files and an empty result. Files and manifest stay in the folder.
    """
    spark = clients.sparkSession
    scratch = scratch or Scratch(spark, "rewrite")
    names = ["client_id", "master_id", "source", "updated_at", "name", "email", "city", "nation_id", "segment", "balance"]
    rows = clients.select(names).withColumn("nation_id", F.col("nation_id").cast("long"))
    fields = fields_of(rows, fills={"nation_id": -1, "segment": "none"})
    named = rows.toDF(*[f"f{f.id}" for f in fields])
    key = F.crc32(F.col("f1").cast("string").cast("binary"))
    ranked, n = in_order(named.withColumn("_crc", key), ["_crc", "f1"], scratch)
    per = 1 + n // files
    n_files = -(-n // per)
    ranked = ranked.drop("_crc").withColumn("_file", F.floor(F.col("_rank") / F.lit(per)).cast("long"))

    def drift(file_no: int) -> list[Field]:
        return drifted(fields, version_of(file_no), ("name", "email"), ("nation_id", "segment"), {"balance": pa.float32(), "nation_id": pa.int32()})

    written = write_files(ranked, fields, drift, f"{scratch.root}/data", scratch, n_files)
    done = rewrite_files(written, fields, 0, scratch, n_files)
    scratch.keep(done)
    crc = F.pmod(F.crc32(F.concat(F.lit(SALT), F.col("file_no").cast("string")).cast("binary")), F.lit(VERSIONS))
    return done.withColumn("version", F.when(crc > KNOWN, 0).otherwise(crc).cast("long"))
