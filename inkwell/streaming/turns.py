"""The last turns of each conversation as keyed state of a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

#: What a conversation's state holds, one entry for each kept turn.
TURN = StructType([StructField("role", StringType()), StructField("text", StringType())])
OUT = StructType([StructField("conv_id", LongType()), StructField("version", LongType()), StructField("turn", LongType()), StructField("role", StringType()), StructField("text", StringType()), StructField("back", LongType())])
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LastTurns(StatefulProcessor):
    """Keeps the ``n`` highest turns of a conversation, whatever order they come in, and emits them when they change.

    State is a map from turn number to its text, never over ``n`` entries. A turn that comes again with the same number
    replaces nothing; an older one than those kept changes nothing. A timer clears a conversation that has
    been silent for ``idle_ms`` of processing time; 0 keeps it for good.
    """

    def __init__(self, n: int = 3, idle_ms: int = 0):
        self.n, self.idle_ms = n, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns = handle.getMapState("turns", StructType([StructField("turn", LongType())]), TURN)
        self.version = handle.getValueState("version", StructType([StructField("version", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = {k[0]: tuple(v) for k, v in self.turns.iterator()}
        before = set(kept)
        for part in rows:
            for turn, role, text in zip(part["turn"], part["role"], part["text"]):
                if pd.isna(turn) or int(turn) in kept:
                    continue
                kept[int(turn)] = (None if pd.isna(role) else role, None if pd.isna(text) else text)
                if len(kept) > self.n:
                    del kept[min(kept)]
        if self.idle_ms:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at if isinstance(at, int) else at[0])
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        if set(kept) == before:
            return
        for turn in before - set(kept):
            self.turns.removeKey((turn,))
        for turn in set(kept) - before:
            self.turns.updateValue((turn,), kept[turn])
        version = (self.version.get()[0] if self.version.exists() else 0) + 1
        self.version.update((version,))
        rows = [(key[0], version, t, *kept[t], back) for back, t in enumerate(sorted(kept, reverse=True), 1)]
        yield pd.DataFrame(rows, columns=OUT.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.turns.clear()
        self.version.clear()
        return iter([])

    def close(self) -> None:
        pass


def recent_turns_stream(turns: DataFrame, n: int = 3, idle: int = 0) -> DataFrame:
    """``OUT`` rows: a conversation's last ``n`` turns (``conv_id, turn, role, text`` in), anew each time that they change.

    ``version`` counts these; the highest of a conversation is its present state. Needs the RocksDB state store
    (``use_state_store``). Rows with a null ``conv_id`` or ``turn`` are left out.
    """
    rows = turns.where("conv_id IS NOT NULL AND turn IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return rows.groupBy("conv_id").transformWithStateInPandas(LastTurns(n, idle), OUT, "Update", "ProcessingTime" if idle else "None")


def use_state_store(spark: SparkSession) -> None:
    """Sets the state store that keyed state needs, unless the session names one."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in (spark.conf.get(name, None) or ""):
        spark.conf.set(name, STATE_STORE)


def keep_current(stream: DataFrame, folder: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Writes each batch of changes to a folder of its own, so that a batch that runs again after a failure replaces itself.

    Reads what there is and ends, or goes on at the interval ``every``. A stream with timers needs an interval, as it always asks for
    one more batch.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    use_state_store(stream.sparkSession)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The present last turns: of each conversation the rows of its highest version, those without text left out."""
    rows = spark.read.schema(OUT).parquet(folder)
    rows = rows.withColumn("_v", F.max("version").over(Window.partitionBy("conv_id"))).where("version = _v")
    return rows.where(F.trim(F.coalesce("text", F.lit(""))) != "").select("conv_id", "turn", "role", "text", "back")

