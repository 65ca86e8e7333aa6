"""Written tables in the cluster's shared folder, used to cut lineage.

The folder is the one the session names in ``spark.checkpoint.dir``. Where it is unset, a local
session (tests) gets a temporary folder and a cluster session a folder in its warehouse.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if spark.sparkContext.master.startswith("local"):
        return "file://" + tempfile.mkdtemp(prefix="inkwell-")
    return spark.conf.get("spark.sql.warehouse.dir") + "/_inkwell_scratch"


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Keeps the batches that tasks exchange with Python to 8 MB, unless the session has a limit of its own.

    Plans run after the operator returns, so the setting stays in the session; set a value of your own to keep it.
    """
    if spark.conf.get(BATCH, None) in (None, "67108864b", "64m", "64MB"):  # Spark's default
        spark.conf.set(BATCH, "8m")


#: Scratch folders that were made and not cleared, in order.
OPEN: list[Scratch] = []


class Scratch:
    """Tables of one operator run under one fresh folder of the shared directory.

    Operators drop the tables that their result doesn't read. What it reads lives until the caller has consumed
    the result: pass a ``Scratch`` of your own and ``clear`` it then, or ``clear_since`` a mark in ``OPEN``.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        small_batches(spark)
        self.root = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
        self._n = 0
        self._paths: set[str] = set()
        OPEN.append(self)

    def save(self, frame: DataFrame, name: str) -> DataFrame:
        """Write ``frame`` and return it re-read: later plans start at the table."""
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        frame.write.parquet(path)
        saved = self.spark.read.schema(frame.schema).parquet(path)
        saved._inkwell_path = path
        self._paths.add(path)
        return saved

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that no live plan reads any more."""
        for frame in frames:
            self._delete(frame._inkwell_path)

    def keep(self, *frames: DataFrame) -> None:
        """Delete all tables but these."""
        for path in self._paths - {f._inkwell_path for f in frames}:
            self._delete(path)

    def clear(self) -> None:
        """Delete the folder."""
        self._delete(self.root)
        if self in OPEN:
            OPEN.remove(self)

    def _delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self._paths.discard(name)


def clear_since(mark: int, but: Scratch | None = None) -> None:
    """Clear the folders made since ``mark = len(OPEN)``, except one."""
    for made in OPEN[mark:]:
        if made is not but:
            made.clear()


def text_key(text: Column) -> Column:
    """128 bits of a text's SHA-256, null counting as empty: with the id, the identity of a row."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256), 1, 32))


#: A key of more than ``HOT_ROWS`` rows and over 1 / ``HOT_KEYS`` of all rows is hot; there are fewer than ``HOT_KEYS``.
HOT_ROWS, HOT_KEYS = 128, 100_000


def with_group(rows: DataFrame, groups: DataFrame, keys: list[str], size: str = "_n", how: str = "inner") -> DataFrame:
    """Joins rows with the values of their groups, where one key may hold a third of all rows.

    ``groups`` is a written table of one row a key, ``size`` its number of rows. Hot keys, bounded in number by
    their own definition, are broadcast, so that their rows stay where they are; the others meet by a
    shuffle. ``how`` is ``inner`` or ``left``.
    """
    total, most = groups.agg(F.sum(size), F.max(size)).first()
    bound = max(HOT_ROWS, (total or 0) // HOT_KEYS)
    if (most or 0) <= bound:
        return rows.join(groups, keys, how)
    hot = F.broadcast(groups.where(F.col(size) > bound))
    rest = rows.join(F.broadcast(groups.where(F.col(size) > bound).select(*keys)), keys, "left_anti")
    return rows.join(hot, keys).unionByName(rest.join(groups.where(F.col(size) <= bound), keys, how))


def semi_join_ids(rows: DataFrame, column: str, ids: DataFrame, broadcast_rows: int = 2_000_000) -> DataFrame:
    """Rows whose ``column`` is in the one-column, already written table ``ids``.

    The ids are broadcast only if counted to be at most ``broadcast_rows`` (16 bytes each when
    hashed, so 32 MB); beyond that the join shuffles both sides.
    """
    ids = ids.select(F.col(ids.columns[0]).alias(column))
    if ids.count() <= broadcast_rows:
        return rows.join(F.broadcast(ids), column, "left_semi")
    return rows.join(ids, column, "left_semi")


def drawn(key: Column, rows: int, bound: int) -> Column:
    """Whether a row belongs to a sample of at most ``bound`` of ``rows`` rows, drawn by the hash of its key.

    The rate leaves five standard deviations of room, so the bound holds but for a chance of 3e-7; rows of one
    key are drawn together.
    """
    rate = 1.0 if rows <= bound else max(0.0, bound - 5 * bound**0.5) / rows
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(1 << 30)) < int(rate * (1 << 30))
