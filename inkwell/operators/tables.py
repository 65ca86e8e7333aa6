"""Written intermediate tables, in the folder that the cluster shares.

A fitted model is read by several plans; writing it once keeps these from fitting it again, and a lost executor from
taking it along.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that may be broadcast.
BROADCAST_ROWS = 200_000
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, a temporary one in local sessions, else one in the warehouse."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return "file://" + tempfile.mkdtemp(prefix="inkwell-")
    return spark.conf.get("spark.sql.warehouse.dir") + "/_inkwell_tables"


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The frame, written to a folder of its own and read again."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Keeps the batches that tasks exchange with Python to 8 MB, unless the session has a limit of its own.

    Plans run after the operator returns, so the setting stays in the session.
    """
    if spark.conf.get(BATCH, None) in (None, "67108864b", "64m", "64MB"):  # Spark's default
        spark.conf.set(BATCH, "8m")


def small(table: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A written table, marked for broadcast if it is counted to have at most ``most`` rows."""
    return F.broadcast(table) if table.count() <= most else table
